"""Signals derived from the `events` table, the same in Spark and in SQL.

Sources, types, places and states are dealt by arithmetic on ids, so that each engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalloom import policy as P
from signalloom.functions import cases

#: The fixed present of all queries.
NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _dealt(values: tuple, index: str) -> str:
    return f"CASE CAST({index} AS INT) " + " ".join(f"WHEN {i} THEN {cases.quoted(v)}" for i, v in enumerate(values)) + " END"


_ALERT = "event_id % 17 = 0"
_SOURCE = f"CASE WHEN {_ALERT} THEN 'senapred' ELSE {_dealt(P.SOURCES, 'event_id % 18')} END"
_TYPE = f"""CASE WHEN event_id % 34 = 0 THEN 'evacuation' WHEN {_ALERT} THEN 'alert' WHEN event_id % 23 = 0 THEN 'earthquake'
 WHEN event_id % 29 = 0 THEN 'dispatch' WHEN event_type = 'click' THEN 'smoke' WHEN event_type = 'error' THEN 'accident'
 WHEN event_type = 'purchase' THEN 'wildfire' WHEN event_type = 'signup' THEN 'power_outage' ELSE 'thermal_anomaly' END"""
_COMMUNE = f"CASE WHEN event_id % 3 = 0 THEN NULL ELSE {_dealt(P.COMMUNES, 'user_id % 10')} END"
_ALERT_COMMUNES = f"{_dealt(P.COMMUNES, 'event_id % 10')} || ', ' || {_dealt(P.COMMUNES, '(event_id + 3) % 10')} || ' y ' || {_dealt(P.COMMUNES, '(event_id + 7) % 10')}"
_ALERT_TEXT = "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'Alerta Roja por incendio forestal' WHEN 1 THEN 'Alerta Amarilla por inundación' WHEN 2 THEN 'Alerta Temprana Preventiva por humo' WHEN 3 THEN 'Alerta Verde' ELSE 'Aviso en toda la Región' END"

_COLUMNS = f"""
  event_id AS id, CAST(ts AS TIMESTAMP) AS ts, {_SOURCE} AS source, {_TYPE} AS type, user_id,
  CASE WHEN {_ALERT} THEN NULL ELSE -33.8e0 + 1.8e0 * CAST((user_id * 37) % 151 AS DOUBLE) / 151e0 + 0.03e0 * CAST((event_id * 7919) % 1009 AS DOUBLE) / 1009e0 END AS lat,
  CASE WHEN {_ALERT} THEN NULL ELSE -72e0 + 2.2e0 * CAST((user_id * 53) % 157 AS DOUBLE) / 157e0 + 0.03e0 * CAST((event_id * 104729) % 1013 AS DOUBLE) / 1013e0 END AS lon,
  CAST(least(1e0, value / 1e2) AS FLOAT) AS confidence,
  CASE WHEN {_ALERT} THEN {_ALERT_TEXT} ELSE 'Señal ' || CAST(event_id AS STRING) END AS text,
  CASE WHEN {_SOURCE} = 'citizen' THEN NULL ELSE {_SOURCE} || ':' || CAST(event_id % 4000 AS STRING) END AS external_id,
  CASE WHEN {_ALERT} THEN {_ALERT_COMMUNES} ELSE {_COMMUNE} END AS commune,
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'Marga Marga' ELSE 'Quillota' END AS province,
  {_dealt(P.STATES, 'event_id % 5')} AS state,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE 2e0 + CAST(event_id % 50 AS DOUBLE) / 1e1 END AS magnitude,
  CAST((event_id * 7) % 300 AS DOUBLE) AS depth_km, event_id % 13 = 0 AS tsunami, event_id % 7 AS felt,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 900 END AS clients
"""

#: A common table expression `signals` over the table events.
SIGNALS_SQL = f"signals AS (SELECT {_COLUMNS.replace('AS STRING', 'AS VARCHAR')} FROM events)"

_FAMILY_NUMBER = "CASE {f} WHEN 'fire' THEN 1 WHEN 'hydro' THEN 2 WHEN 'traffic' THEN 3 WHEN 'power' THEN 4 ELSE 5 END".format(f=cases.family("type"))
_LOCATED = f"lat IS NOT NULL AND type NOT IN ({cases.listed(P.NOT_CORRELATABLE)})"
_INCIDENT = f"(user_id % 50) * 10 + {_FAMILY_NUMBER}"

#: Located signals with the incident that they are dealt to; alerts go to the incidents of one user group as text links.
LINKED_SQL = f"linked AS (SELECT {_INCIDENT} AS incident_id, * FROM signals WHERE {_LOCATED} UNION ALL SELECT (id % 50) * 10 + 1 AS incident_id, * FROM signals WHERE type IN ('alert', 'evacuation'))"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals: id, ts, source, type, place, confidence, text, identifiers, territory and details."""
    return derived(spark.read.parquet(f"{sf_dir}/events.parquet"))


def derived(events: DataFrame) -> DataFrame:
    """The signals of a table or stream of events."""
    return events.selectExpr(*_split(_COLUMNS))


def linked(df: DataFrame) -> DataFrame:
    """Signals with incident_id, as LINKED_SQL has them."""
    located = df.where(_LOCATED).selectExpr(f"{_INCIDENT} AS incident_id", "*")
    return located.unionByName(df.where("type IN ('alert', 'evacuation')").selectExpr("(id % 50) * 10 + 1 AS incident_id", "*"))


def _split(columns: str) -> list[str]:
    """The top-level items of a select list."""
    out, depth, quote, now = [], 0, False, ""
    for ch in columns:
        quote ^= ch == "'"
        depth += (ch == "(") - (ch == ")") if not quote else 0
        if ch == "," and not depth and not quote:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [*out, now.strip()]
