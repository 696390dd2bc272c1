"""Registered queries over the derived signals, with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom import policy as P
from signalloom.adapter import LINKED_SQL, NOW, SIGNALS_SQL, linked, signals
from signalloom.functions import cases, geo, text
from signalloom.operators import alerts, cluster, lifecycle, listing, score, store
from signalloom.plans import passes
from signalloom.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Since when clustering and attaching look back, from the fixed present.
SINCE = "2024-01-20 00:00:00"
PRESENT = "2024-01-31 00:00:00"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql if sql.lstrip().startswith("WITH RECURSIVE") else f"WITH {SIGNALS_SQL}, {LINKED_SQL} {sql}" if " linked" in sql else f"WITH {SIGNALS_SQL} {sql}"
        return f

    return keep


def stamp(text_: str):
    return F.lit(text_).cast("timestamp")


# --- Listings and statistics ------------------------------------------------------------------

BOX = (-71.6, -33.4, -70.8, -32.9)
PLACE = (-33.02, -71.55)


@query("p01_t01_events_list", f"""SELECT id, ts, source, type FROM signals
 WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00' AND source IN ('conaf', 'waze', 'citizen') AND confidence >= 0.4e0 - 1e-6
 ORDER BY ts DESC, id LIMIT 100""")
def events_list(spark, d):
    found = listing.filter_events(signals(spark, d), stamp("2024-01-05 00:00:00"), stamp("2024-01-25 00:00:00"), ("conaf", "waze", "citizen"), least=0.4)
    return listing.list_events(found.select("id", "ts", "source", "type"))


@query("p03_least_confidence", "SELECT id, confidence FROM signals WHERE confidence >= 0.4e0 - 1e-6 AND confidence <= 0.6e0 + 1e-6")
def least_confidence(spark, d):
    return signals(spark, d).where(listing.at_least("confidence", 0.4) & listing.at_most("confidence", 0.6)).select("id", "confidence")


@query("p04_box", f"SELECT id, lat, lon FROM signals WHERE {geo.in_box('lat', 'lon', BOX)}")
def box(spark, d):
    return signals(spark, d).where(listing.in_box(BOX)).select("id", "lat", "lon")


@query("p05_radius", f"SELECT id, round({geo.spheroid('-33.02e0', '-71.55e0', 'lat', 'lon')}, 2) AS distance_m FROM signals WHERE {geo.spheroid('-33.02e0', '-71.55e0', 'lat', 'lon')} <= 30000e0")
def radius(spark, d):
    return listing.within(signals(spark, d), *PLACE, 30000.0).select("id", F.round("distance_m", 2).alias("distance_m"))


@query("p07_candidates", f"""SELECT id, confidence, ts FROM signals WHERE lat IS NOT NULL AND ts >= TIMESTAMP '{SINCE}' AND type NOT IN ({cases.listed(P.NOT_CORRELATABLE)})
 ORDER BY confidence DESC, ts, id LIMIT 5000""")
def candidates(spark, d):
    rows = signals(spark, d).where(F.col("lat").isNotNull() & (F.col("ts") >= stamp(SINCE)) & ~F.col("type").isin(*P.NOT_CORRELATABLE))
    return rows.orderBy(F.col("confidence").desc(), "ts", "id").limit(5000).select("id", "confidence", "ts")


@query("p08_vigent_alerts", f"""SELECT id, source, updated_at FROM (SELECT *, ts + to_hours(CAST(id % 48 AS INT)) AS updated_at FROM signals)
 WHERE lat IS NULL AND type IN ('alert', 'evacuation') AND source IN ('senapred', 'municipality') AND updated_at >= TIMESTAMP '{SINCE}'""")
def vigent(spark, d):
    rows = signals(spark, d).withColumn("updated_at", F.expr("ts + make_interval(0, 0, 0, 0, int(id % 48), 0, 0)"))
    return alerts.vigent_alerts(rows, stamp(SINCE)).select("id", "source", "updated_at")


@query("p09_t03_seismic_list", f"""SELECT id, ts, magnitude, depth_km FROM signals WHERE type = 'earthquake' AND source = 'usgs' AND magnitude >= 2.5e0 AND depth_km <= 250e0
 AND {geo.in_box('lat', 'lon', P.SEISMIC_BOX)} ORDER BY magnitude DESC NULLS LAST, ts DESC, id LIMIT 100""")
def seismic_list(spark, d):
    return listing.seismic_listing(signals(spark, d), "usgs", 2.5, 250.0, None, P.SEISMIC_BOX).select("id", "ts", "magnitude", "depth_km")


@query("p12_relevant_quakes", "SELECT id, magnitude, magnitude >= 4e0 OR magnitude IS NULL AS relevant FROM signals WHERE type = 'earthquake'")
def relevant_quakes(spark, d):
    quakes = signals(spark, d).where("type = 'earthquake'")
    both = listing.relevant(quakes).withColumn("relevant", F.lit(True)).unionByName(listing.relevant(quakes, micro=True).withColumn("relevant", F.lit(False)))
    return both.select("id", "magnitude", "relevant")


@query("p16_reading", f"""SELECT id, lat IS NOT NULL AS has_location, coalesce({geo.in_box('lat', 'lon', P.REGION_BOX)}, FALSE) AS in_region, {cases.family('type')} AS family,
 {cases.level('confidence')} AS confidence_level, {cases.confidence_label('confidence')} AS confidence_label FROM signals""")
def reading(spark, d):
    return listing.with_reading(signals(spark, d)).select("id", "has_location", "in_region", "family", "confidence_level", "confidence_label")


@query("a01_event_stats", """SELECT source, type, count(*) AS total, count(lat) AS located, min(ts) AS first_ts, max(ts) AS last_ts FROM signals GROUP BY GROUPING SETS ((), (source), (type))""")
def event_stats(spark, d):
    return listing.event_stats(signals(spark, d))


@query("a03_daily_rollup", "SELECT date_trunc('day', ts) AS day, source, type, count(*) AS events, count(lat) AS located, round(avg(confidence), 3) AS avg_confidence FROM signals GROUP BY ALL")
def daily_rollup(spark, d):
    return listing.daily_rollup(signals(spark, d))


@query("a11_seismic_stats", "SELECT count(*) AS quakes, max(magnitude) AS max_magnitude, count(*) FILTER (WHERE felt > 0) AS felt, count(*) FILTER (WHERE tsunami) AS tsunami FROM signals WHERE type = 'earthquake'")
def seismic_stats(spark, d):
    return listing.seismic_stats(signals(spark, d).where("type = 'earthquake'"))


@query("a12_facets", f"SELECT {cases.family('type')} AS layer, {cases.level('confidence')} AS level, count(*) AS n FROM signals GROUP BY ALL")
def facets(spark, d):
    return signals(spark, d).groupBy(F.expr(cases.family("type")).alias("layer"), F.expr(cases.level("confidence")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("a16_outages_by_provider", "SELECT source, count(*) AS outages, CAST(sum(clients) AS BIGINT) AS clients FROM signals WHERE type = 'power_outage' GROUP BY source")
def outages_by_provider(spark, d):
    return signals(spark, d).where("type = 'power_outage'").groupBy("source").agg(F.count(F.lit(1)).alias("outages"), F.sum("clients").alias("clients"))


@query("t10_outage_pins", "SELECT id, clients FROM signals WHERE type = 'power_outage' ORDER BY coalesce(clients, 0) DESC, id LIMIT 150")
def outage_pins(spark, d):
    return listing.outage_pins(signals(spark, d)).select("id", "clients")


# --- Identity, validation and upserts ---------------------------------------------------------


@query("k02_last_of_batch", """SELECT id, source, external_id, position FROM (
 SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY id DESC) AS r, min(id) OVER (PARTITION BY source, external_id) AS position FROM signals WHERE external_id IS NOT NULL
 UNION ALL SELECT *, 1, id FROM signals WHERE external_id IS NULL) WHERE r = 1""")
def last_of_batch(spark, d):
    return store.last_of_batch(signals(spark, d), "id").select("id", "source", "external_id", "position")


_HALVES = """, stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY id DESC) AS r FROM signals WHERE external_id IS NOT NULL AND id % 10 < 6) WHERE r = 1),
 incoming AS (SELECT id AS position, * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY id DESC) AS r FROM signals WHERE external_id IS NOT NULL AND id % 10 >= 4) WHERE r = 1
  UNION ALL SELECT id AS position, * FROM signals WHERE external_id IS NULL AND id % 10 >= 4)"""


def _halves(spark, d):
    rows = signals(spark, d)
    stored = store.last_of_batch(rows.where("external_id IS NOT NULL AND id % 10 < 6"), "id").drop("position")
    return stored, store.last_of_batch(rows.where("id % 10 >= 4"), "id").drop("position").withColumn("position", F.col("id"))


@query("k01_upsert", _HALVES + """SELECT s.id, s.source, s.external_id, s.ts, CASE WHEN b.source IS NULL THEN s.type ELSE b.type END AS type, CASE WHEN b.source IS NULL THEN s.commune ELSE b.commune END AS commune,
 CASE WHEN b.source IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM stored s LEFT JOIN incoming b ON s.source = b.source AND s.external_id = b.external_id
 UNION ALL SELECT (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY b.position), b.source, b.external_id, b.ts, b.type, b.commune, 'inserted' FROM incoming b
 WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.source = b.source AND s.external_id = b.external_id)""")
def upsert(spark, d):
    return store.upsert(*_halves(spark, d)).select("id", "source", "external_id", "ts", "type", "commune", "outcome")


@query("k01_upsert_counts", _HALVES + """SELECT count(*) FILTER (WHERE s.id IS NULL) AS inserted, count(*) FILTER (WHERE s.id IS NOT NULL) AS updated
 FROM incoming b LEFT JOIN stored s ON s.source = b.source AND s.external_id = b.external_id""")
def upsert_counts(spark, d):
    return store.upsert_counts(store.upsert(*_halves(spark, d)))


@query("k05_ids_by_external_id", _HALVES + "SELECT b.source, b.external_id, coalesce(s.id, -1) AS id FROM incoming b LEFT JOIN stored s ON s.source = b.source AND s.external_id = b.external_id WHERE b.external_id IS NOT NULL")
def ids_by_external_id(spark, d):
    stored, batch = _halves(spark, d)
    return store.ids_by_external_id(stored, batch.where("external_id IS NOT NULL").select("source", "external_id")).withColumn("id", F.coalesce("id", F.lit(-1)))


@query("k07_n10_validation", f"""SELECT id, array_to_string(list_filter([CASE WHEN ts > TIMESTAMP '2024-01-29 00:05:00' THEN 'future' END, CASE WHEN (lat IS NULL) <> (lon IS NULL) THEN 'half_place' END,
  CASE WHEN lat IS NULL AND lon IS NULL AND nullif(trim(text), '') IS NULL THEN 'no_place_no_text' END], lambda x: x IS NOT NULL), ',') AS errors,
  round(coalesce(confidence, CAST({cases.baseline('source')} AS FLOAT)), 4) AS confidence
 FROM (SELECT id, ts, source, CASE WHEN id % 19 = 0 THEN NULL ELSE lat END AS lat, CASE WHEN id % 57 = 0 THEN NULL ELSE lon END AS lon, CASE WHEN id % 3 = 0 THEN '  ' ELSE text END AS text,
  CASE WHEN id % 7 = 0 THEN NULL ELSE confidence END AS confidence FROM signals)""")
def validation(spark, d):
    rows = signals(spark, d).withColumns({
        "lat": F.expr("CASE WHEN id % 19 = 0 THEN NULL ELSE lat END"), "lon": F.expr("CASE WHEN id % 57 = 0 THEN NULL ELSE lon END"),
        "text": F.expr("CASE WHEN id % 3 = 0 THEN '  ' ELSE text END"), "confidence": F.expr("CASE WHEN id % 7 = 0 THEN NULL ELSE confidence END"),
    })
    return store.validated(rows, stamp("2024-01-29 00:00:00")).select("id", F.array_join("errors", ",").alias("errors"), F.round("confidence", 4).alias("confidence"))


@query("k06_citizen_reports", """SELECT id AS report, ts, 'citizen' AS source, CASE event_type WHEN 'click' THEN 'smoke' WHEN 'error' THEN 'accident' ELSE 'other' END AS type FROM (SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, event_type FROM events)""")
def citizen_reports(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    reports = rows.select(F.col("ts").cast("timestamp").alias("reported_at"), F.expr("CASE event_type WHEN 'click' THEN 'fire' WHEN 'error' THEN 'traffic_accident' ELSE 'other' END").alias("category"), F.lit(-33.0).alias("lat"), F.lit(-71.5).alias("lon"), F.col("event_id").cast("string").alias("text"))
    return store.citizen_reports(reports, stamp(PRESENT)).select(F.col("text").cast("long").alias("report"), "ts", "source", "type")


@query("f22_external_ids", "SELECT id, 'firms:' || substr(sha256(source || '|' || CAST(ts AS VARCHAR) || '|' || printf('%.5f', lat) || '|' || printf('%.5f', lon)), 1, 32) AS external FROM signals WHERE lat IS NOT NULL")
def external_ids(spark, d):
    rows = signals(spark, d).where("lat IS NOT NULL")
    return rows.select("id", text.external_id("firms", F.col("source"), F.col("ts").cast("string"), F.format_string("%.5f", "lat"), F.format_string("%.5f", "lon")).alias("external"))


# --- Scoring ----------------------------------------------------------------------------------

_WEIGHED = f"""weighed AS (SELECT *, {cases.rule('source', 'decay')} AS decay, {cases.rule('source', 'ceiling')} AS ceiling, {cases.rule('source', 'confirming')} AS confirming,
  CASE WHEN {cases.rule('source', 'dispatch')} AND type IN ('dispatch', 'rescue') THEN greatest(least({cases.rule('source', 'most')}, greatest({cases.rule('source', 'least')}, confidence::DOUBLE)), least(0.8e0, {cases.rule('source', 'ceiling')}))
       ELSE least({cases.rule('source', 'most')}, greatest({cases.rule('source', 'least')}, confidence::DOUBLE)) END AS weight FROM linked),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY incident_id, source ORDER BY weight DESC) - 1 AS k FROM weighed),
 parts AS (SELECT incident_id, source, count(*) AS signals, least(max(ceiling), sum(weight * pow(decay, k))) AS contribution, bool_or(confirming) AS confirming FROM ranked GROUP BY ALL),
 scored AS (SELECT incident_id, round(CASE WHEN bool_or(confirming) THEN 1e0 ELSE least(0.95e0, sum(contribution)) END, 4) AS confidence, bool_or(confirming) AS is_official_confirmed,
  count(*) AS source_count, CAST(sum(signals) AS BIGINT) AS event_count FROM parts GROUP BY incident_id)"""


@query("a04_score", f", {_WEIGHED} SELECT * FROM scored /* linked */")
def scores(spark, d):
    return score.score(linked(signals(spark, d))).drop("breakdown")


@query("t11_breakdown", f", {_WEIGHED} SELECT incident_id, source, signals, round(contribution, 4) AS contribution FROM parts /* linked */")
def breakdown(spark, d):
    rows = score.score(linked(signals(spark, d))).select("incident_id", F.explode("breakdown").alias("b"))
    return rows.select("incident_id", "b.source", "b.signals", "b.contribution")


_LEVELS = """levels AS (SELECT incident_id, arg_max(level, severity) AS alert_level FROM (SELECT incident_id, level, CASE level WHEN 'roja' THEN 4 WHEN 'amarilla' THEN 3 WHEN 'temprana_preventiva' THEN 2 WHEN 'verde' THEN 1 ELSE 0 END AS severity
  FROM (SELECT incident_id, CASE WHEN contains(t, 'roja') THEN 'roja' WHEN contains(t, 'amarilla') THEN 'amarilla' WHEN contains(t, 'preventiva') THEN 'temprana_preventiva' WHEN contains(t, 'verde') THEN 'verde' ELSE 'otra' END AS level
   FROM (SELECT incident_id, lower(strip_accents(text)) AS t FROM linked WHERE type IN ('alert', 'evacuation') AND source = 'senapred'))) GROUP BY incident_id)"""


@query("a05_alert_levels", f", {_LEVELS} SELECT * FROM levels /* linked */")
def alert_levels(spark, d):
    return score.alert_levels(linked(signals(spark, d)))


_TYPES = f"""sums AS (SELECT incident_id, {cases.incident_type('type')} AS t, round(sum(confidence::DOUBLE), 6) AS a, round(sum(confidence::DOUBLE) FILTER (WHERE {cases.rule('source', 'confirming')}), 6) AS c FROM linked GROUP BY ALL),
 types AS (SELECT incident_id, coalesce(arg_max(t, {{'c': c, 't': t}}) FILTER (WHERE t IS NOT NULL AND c IS NOT NULL), arg_max(t, {{'a': a, 't': t}}) FILTER (WHERE t IS NOT NULL), 'possible_fire') AS type FROM sums GROUP BY incident_id)"""


@query("a06_types", f", {_TYPES} SELECT * FROM types /* linked */")
def types(spark, d):
    return score.incident_types(linked(signals(spark, d)))


_STATUSES = f"""stated AS (SELECT incident_id, id, ts, confidence, CASE WHEN NOT {cases.rule('source', 'confirming')} THEN NULL {' '.join(f"WHEN contains(lower(state), '{w}') THEN '{v}'" for w, v in P.STATE_WORDS)} END AS s FROM linked),
 last_said AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC, confidence, id DESC) AS r FROM stated WHERE s IS NOT NULL) WHERE r = 1),
 statuses AS (SELECT i.incident_id, coalesce(l.s, 'active') AS status, CASE WHEN l.s = 'extinguished' THEN l.ts END AS resolved_at FROM (SELECT DISTINCT incident_id FROM linked) i LEFT JOIN last_said l USING (incident_id))"""


@query("a07_statuses", f", {_STATUSES} SELECT * FROM statuses /* linked */")
def statuses(spark, d):
    return score.incident_statuses(linked(signals(spark, d)))


_CENTROIDS = "centroids AS (SELECT incident_id, sum(lat * greatest(confidence::DOUBLE, 0.01e0)) / sum(greatest(confidence::DOUBLE, 0.01e0)) AS lat, sum(lon * greatest(confidence::DOUBLE, 0.01e0)) / sum(greatest(confidence::DOUBLE, 0.01e0)) AS lon FROM linked WHERE lat IS NOT NULL GROUP BY incident_id)"


@query("a08_centroids", f", {_CENTROIDS} SELECT incident_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM centroids /* linked */")
def centroids(spark, d):
    return score.centroids(linked(signals(spark, d))).select("incident_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_REFRESH = f""", {_WEIGHED}, {_LEVELS}, {_TYPES}, {_STATUSES}, {_CENTROIDS},
 base AS (SELECT incident_id, coalesce(min(ts) FILTER (WHERE lat IS NOT NULL), min(ts)) AS first_seen_at, coalesce(max(ts) FILTER (WHERE lat IS NOT NULL), max(ts)) AS last_seen_at, list_sort(list(DISTINCT source)) AS sources FROM linked GROUP BY incident_id),
 land AS (SELECT incident_id, (list(commune ORDER BY confidence DESC, ts, id) FILTER (WHERE commune IS NOT NULL))[1] AS commune, (list(province ORDER BY confidence DESC, ts, id) FILTER (WHERE province IS NOT NULL))[1] AS province FROM linked WHERE type NOT IN ('alert', 'evacuation') GROUP BY incident_id),
 incidents AS (SELECT b.incident_id, t.type, s.status, s.resolved_at, c.confidence, c.is_official_confirmed, c.source_count, c.event_count, b.first_seen_at, b.last_seen_at, b.sources, l.alert_level, m.lat, m.lon, n.commune, n.province,
  {cases.title('t.type', 'n.commune')} AS title, {cases.incident_family('t.type')} AS family
  FROM base b JOIN types t USING (incident_id) JOIN statuses s USING (incident_id) JOIN scored c USING (incident_id) LEFT JOIN levels l USING (incident_id) LEFT JOIN centroids m USING (incident_id) LEFT JOIN land n USING (incident_id))"""


def incidents(spark, d):
    return score.refresh(linked(signals(spark, d)))


@query("a09_refresh", _REFRESH + "SELECT incident_id, type, status, confidence, event_count, source_count, array_to_string(sources, ',') AS sources, first_seen_at, last_seen_at, commune, province, title, alert_level FROM incidents /* linked */")
def refreshed(spark, d):
    return incidents(spark, d).select("incident_id", "type", "status", "confidence", "event_count", "source_count", F.array_join("sources", ",").alias("sources"), "first_seen_at", "last_seen_at", "commune", "province", "title", "alert_level")


@query("p02_t02_incidents_list", _REFRESH + """SELECT incident_id, type, confidence, last_seen_at, title FROM incidents WHERE status IN ('active', 'controlled') AND confidence >= 0.3e0 - 1e-6 AND commune ILIKE '%a%'
 ORDER BY is_official_confirmed DESC, confidence DESC, last_seen_at DESC, incident_id LIMIT 100 /* linked */""")
def incidents_list(spark, d):
    found = listing.filter_incidents(incidents(spark, d), least=0.3, commune="a")
    return listing.list_incidents(found).select("incident_id", "type", "confidence", "last_seen_at", "title")


@query("a02_incident_stats", _REFRESH + "SELECT count(*) AS total, count(*) FILTER (WHERE is_official_confirmed) AS confirmed, count(alert_level) AS alerted, round(avg(confidence), 4) AS avg_confidence, max(last_seen_at) AS last_seen_at FROM incidents /* linked */")
def incident_stats(spark, d):
    return listing.incident_stats(incidents(spark, d))


@query("a10_outages", "SELECT incident_id, count(*) AS outages, CAST(sum(clients) AS BIGINT) AS clients, arg_max(source, {'t': ts, 'i': id}) AS last_source FROM linked WHERE type = 'power_outage' GROUP BY incident_id")
def outages(spark, d):
    return score.outage_details(linked(signals(spark, d)))


_EXPIRED = f"""expired AS (SELECT *, CASE WHEN status IN ('active', 'controlled') AND date_diff('second', first_seen_at, {NOW}) > 300 AND confidence <= 0.4e0 + 1e-6 AND NOT is_official_confirmed AND len(list_filter(sources, lambda x: x <> 'citizen')) = 0 THEN 'dismissed'
  WHEN status = 'active' AND date_diff('second', last_seen_at, {NOW}) > 43200 THEN 'stale' ELSE status END AS new_status FROM incidents)"""


@query("m08_m09_expire", _REFRESH + f", {_EXPIRED} SELECT incident_id, new_status AS status FROM expired /* linked */")
def expired(spark, d):
    return lifecycle.expire(incidents(spark, d), stamp(PRESENT)).select("incident_id", "status")


@query("t09_active_view", _REFRESH + f"SELECT incident_id, status, date_diff('second', last_seen_at, {NOW}) AS silence_s FROM incidents WHERE status IN ('active', 'controlled') /* linked */")
def active_view(spark, d):
    return lifecycle.active_view(incidents(spark, d), stamp(PRESENT)).select("incident_id", "status", "silence_s")


@query("w05_codes", _REFRESH + "SELECT incident_id, printf('INC-2024-%05d', CAST(41 + row_number() OVER (ORDER BY first_seen_at, incident_id) AS INT)) AS code FROM incidents /* linked */")
def codes(spark, d):
    return lifecycle.with_codes(incidents(spark, d), 2024, 41).select("incident_id", "code")


# --- Clusters, attachments, merges ------------------------------------------------------------

_EAST, _NORTH = geo.utm("lat", "lon")
_WINDOW = f"lat IS NOT NULL AND ts >= TIMESTAMP '{SINCE}' AND type NOT IN ({cases.listed(P.NOT_CORRELATABLE)})"
_CLUSTERS = f"""WITH RECURSIVE {SIGNALS_SQL}, points AS (SELECT id, {cases.family('type')} AS family, {_EAST} AS x, {_NORTH} AS y FROM signals WHERE {_WINDOW}),
 cells AS (SELECT *, CAST(floor(x / 1500) AS BIGINT) AS cx, CAST(floor(y / 1500) AS BIGINT) AS cy FROM points),
 edges AS (SELECT a.id AS u, b.id AS v FROM (SELECT *, unnest([cx - 1, cx, cx + 1]) AS nx FROM cells) a JOIN cells b ON a.family = b.family AND a.nx = b.cx AND abs(a.cy - b.cy) <= 1 AND a.id <> b.id
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2250000),
 reach AS (SELECT id, id AS c FROM points UNION SELECT e.v, r.c FROM reach r JOIN edges e ON r.id = e.u AND r.c < e.v),
 clusters AS (SELECT p.id, p.family, m.c AS cluster_id FROM points p JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) m ON p.id = m.id)"""


def recent(spark, d):
    return signals(spark, d).where(_WINDOW)


@query("j01_clusters", f"{_CLUSTERS} SELECT * FROM clusters")
def clusters(spark, d):
    return cluster.clusters(recent(spark, d))


def members(spark, d):
    return recent(spark, d).join(clusters(spark, d), "id")


@query("a08_cluster_centroids", f"{_CLUSTERS} SELECT cluster_id, round(sum(lat * greatest(confidence::DOUBLE, 0.01e0)) / sum(greatest(confidence::DOUBLE, 0.01e0)), 6) AS lat, round(sum(lon * greatest(confidence::DOUBLE, 0.01e0)) / sum(greatest(confidence::DOUBLE, 0.01e0)), 6) AS lon FROM clusters JOIN signals USING (id) GROUP BY cluster_id")
def cluster_centroids(spark, d):
    return cluster.cluster_centroids(members(spark, d)).select("cluster_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("m02_open_or_defer", f"{_CLUSTERS} SELECT cluster_id, count(*) AS signals, bool_or({cases.rule('source', 'confirming')}) OR count(*) >= 3 AS opens FROM clusters JOIN signals USING (id) GROUP BY cluster_id")
def open_or_defer(spark, d):
    return cluster.open_or_defer(members(spark, d), 3)


_NEAR = _REFRESH + f""", clustered AS (SELECT id AS cluster_id, lat AS lat1, lon AS lon1, {cases.family('type')} AS family FROM signals WHERE {_WINDOW}),
 near AS (SELECT c.cluster_id, i.incident_id, {geo.spheroid('c.lat1', 'c.lon1', 'i.lat', 'i.lon')} AS distance_m FROM clustered c JOIN incidents i ON c.family = i.family AND i.status IN ('active', 'controlled') AND i.last_seen_at >= TIMESTAMP '{SINCE}' AND abs(c.lat1 - i.lat) < 0.2e0)"""


_NEAREST = _NEAR + " SELECT cluster_id, arg_min(incident_id, {'d': distance_m, 'i': incident_id}) AS incident_id, round(min(distance_m), 2) AS distance_m FROM near WHERE distance_m <= 15000e0 GROUP BY cluster_id /* linked */"


@query("j02_nearest_open", _NEAREST)
def nearest_open(spark, d):
    """Every recent located signal's nearest incident."""
    found = recent(spark, d).selectExpr("id AS cluster_id", f"{cases.family('type')} AS family", "lat", "lon")
    out = cluster.nearest_open(found, incidents(spark, d), 15000.0, stamp(SINCE))
    return out.select("cluster_id", "incident_id", F.round("distance_m", 2).alias("distance_m"))


_PAIRS = _REFRESH + f""", pairs AS (SELECT a.incident_id AS a, b.incident_id AS b FROM incidents a JOIN incidents b ON a.family = b.family AND a.incident_id < b.incident_id
  AND a.status IN ('active', 'controlled') AND b.status IN ('active', 'controlled') AND a.last_seen_at >= TIMESTAMP '{SINCE}' AND b.last_seen_at >= TIMESTAMP '{SINCE}' WHERE {geo.spheroid('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 8000e0)"""


@query("j03_merge_pairs", _PAIRS + " SELECT * FROM pairs /* linked */")
def merge_pairs(spark, d):
    return cluster.merge_pairs(incidents(spark, d), 8000.0, stamp(SINCE))


@query("m06_survivors", f"WITH RECURSIVE {SIGNALS_SQL}, {LINKED_SQL}" + _PAIRS + """, sides AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT a AS n, a AS c FROM sides UNION SELECT b, r.c FROM reach r JOIN sides ON r.n = sides.a)
 SELECT n AS incident_id, min(c) AS kept_id FROM reach GROUP BY n""")
def survivors(spark, d):
    return cluster.survivors(merge_pairs(spark, d))


@query("j08_relink", f"WITH RECURSIVE {SIGNALS_SQL}, {LINKED_SQL}" + _PAIRS + """, sides AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT a AS n, a AS c FROM sides UNION SELECT b, r.c FROM reach r JOIN sides ON r.n = sides.a),
 kept AS (SELECT n, min(c) AS k FROM reach GROUP BY n) SELECT DISTINCT coalesce(k, incident_id) AS incident_id, id AS event_id FROM linked LEFT JOIN kept ON incident_id = n""")
def relinked(spark, d):
    links = linked(signals(spark, d)).select("incident_id", F.col("id").alias("event_id"), F.lit(0.0).alias("distance_m"))
    return cluster.relink(links, survivors(spark, d)).select("incident_id", "event_id")


@query("j04_neighbours", f"""SELECT a.id AS a, b.id AS b, round({geo.spheroid('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 2) AS distance_m FROM signals a JOIN signals b ON a.id < b.id AND abs(date_diff('second', a.ts, b.ts)) <= 14400 AND a.lat BETWEEN b.lat - 0.03e0 AND b.lat + 0.03e0 AND a.lon BETWEEN b.lon - 0.04e0 AND b.lon + 0.04e0
 WHERE {geo.spheroid('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 3000e0""")
def neighbours(spark, d):
    return cluster.neighbours(signals(spark, d), 3000.0, 240).select("a", "b", F.round("distance_m", 2).alias("distance_m"))


_MATCHES = _REFRESH + """, views AS (SELECT id, CASE WHEN regexp_matches(t, 'incendio|forestal|fuego|humo') THEN 'fire' WHEN regexp_matches(t, 'inundacion|crecida|aluvion|remocion|deslizamiento|lluvia|marejada') THEN 'hydro' ELSE 'unknown' END AS family,
  regexp_matches(t, 'toda la region|todas las comunas|todo el pais|region completa|nivel nacional|todo el territorio') AS regional, string_split(regexp_replace(commune, ' y ', ',', 'g'), ',') AS names
  FROM (SELECT id, commune, lower(strip_accents(text)) AS t FROM signals WHERE type IN ('alert', 'evacuation'))),
 named AS (SELECT id, family, trim(name) AS name, pos FROM (SELECT id, family, unnest(names) AS name, unnest(range(len(names))) AS pos FROM views WHERE NOT regional)),
 found AS (SELECT n.id, i.incident_id, n.name, n.pos, n.family, CASE WHEN p = q THEN 0.7e0 ELSE 0.55e0 END AS w FROM (SELECT *, lower(strip_accents(name)) AS p FROM named) n
  JOIN (SELECT *, lower(strip_accents(commune)) AS q FROM incidents WHERE commune IS NOT NULL) i ON (n.family = 'unknown' OR n.family = i.family) AND (p = q OR (length(p) >= 5 AND (contains(p, q) OR contains(q, p)))))"""


@query("j07_alert_matches", _MATCHES + " SELECT id AS alert_id, incident_id, name AS matched_commune, round(w - CASE WHEN family = 'unknown' THEN 0.15e0 ELSE 0e0 END, 4) AS link_confidence FROM (SELECT *, row_number() OVER (PARTITION BY id, incident_id ORDER BY w DESC, pos) AS r FROM found) WHERE r = 1 /* linked */")
def alert_matches(spark, d):
    rows = signals(spark, d)
    return alerts.match_alerts(rows.where("type IN ('alert', 'evacuation')"), incidents(spark, d))


# --- Scalar functions and derived shapes ------------------------------------------------------


@query("f01_plain_text", "SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[ \\t\\n\\r]+', ' ', 'g'))) AS plain FROM documents")
def plain_text(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(F.expr(cases.plain_text("text"))).alias("plain"))


@query("f12_split_communes", "SELECT id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(commune, '\\s[yYeE]\\s', ',', 'g'), '[,;/|]'), lambda x: trim(x, ' .')), lambda x: x <> ''), '|') AS communes FROM signals WHERE type IN ('alert', 'evacuation')")
def split_communes(spark, d):
    return signals(spark, d).where("type IN ('alert', 'evacuation')").select("id", F.array_join(alerts.split_communes("commune"), "|").alias("communes"))


_CODED = "'Despacho ' || CASE id % 5 WHEN 0 THEN '10-4' WHEN 1 THEN '10-0-4' WHEN 2 THEN '10-40' WHEN 3 THEN '10-4-2024' ELSE '10.4.1' END || ' en calle ' || CAST(id AS {s})"


@query("f08_radio_codes", f"""SELECT id, id % 5 IN (0, 1, 4) AS rescue FROM signals""")
def radio_codes(spark, d):
    rows = signals(spark, d).select("id", F.expr(_CODED.format(s="STRING")).alias("said"))
    return rows.select("id", text.has_code(text.radio_codes(F.col("said")), (10, 4)).alias("rescue"))


@query("f09_satellite_confidence", "SELECT id, CASE WHEN id % 4 = 0 THEN 0.3e0 WHEN id % 4 = 1 THEN 0.8e0 WHEN id % 4 = 2 THEN least(0.85e0, greatest(0.1e0, CAST(id % 101 AS DOUBLE) / 1e2)) ELSE 0.5e0 END AS confidence FROM signals")
def satellite_confidence(spark, d):
    raw = F.expr("CASE WHEN id % 4 = 0 THEN 'l' WHEN id % 4 = 1 THEN 'h' WHEN id % 4 = 2 THEN CAST(id % 101 AS STRING) ELSE '?' END")
    return signals(spark, d).select("id", text.satellite_confidence(raw).alias("confidence"))


@query("f13_keywords", "SELECT doc_id, regexp_matches(lower(text), 'accident|erth|tion') AS hit FROM documents")
def keywords(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.exists(F.array(*[F.lit(w) for w in ("accident", "erth", "tion")]), lambda w: F.contains(F.lower("text"), w)).alias("hit"))


@query("f18_haversine", f"SELECT id, round({geo.haversine('lat', 'lon', '-33.0245e0', '-71.5518e0')}, 2) AS metres FROM signals WHERE lat IS NOT NULL")
def haversine(spark, d):
    return signals(spark, d).where("lat IS NOT NULL").select("id", F.round(F.expr(geo.haversine("lat", "lon", "-33.0245e0", "-71.5518e0")), 2).alias("metres"))


@query("f19_utm", f"SELECT id, round({_EAST}, 3) AS east, round({_NORTH}, 3) AS north FROM signals WHERE lat IS NOT NULL")
def utm(spark, d):
    return signals(spark, d).where("lat IS NOT NULL").selectExpr("id", f"round({_EAST}, 3) AS east", f"round({_NORTH}, 3) AS north")


@query("f21_levels", f"SELECT id, {cases.level('confidence')} AS level, {cases.confidence_label('confidence')} AS label FROM signals")
def levels(spark, d):
    return signals(spark, d).selectExpr("id", f"{cases.level('confidence')} AS level", f"{cases.confidence_label('confidence')} AS label")


@query("f28_f29_quakes", f"SELECT id, {cases.magnitude_band('magnitude')} AS band, round({geo.perception_radius('magnitude', 'depth_km')}, 6) AS reach_km FROM signals WHERE type = 'earthquake'")
def quakes(spark, d):
    return signals(spark, d).where("type = 'earthquake'").selectExpr("id", f"{cases.magnitude_band('magnitude')} AS band", f"round({geo.perception_radius('magnitude', 'depth_km')}, 6) AS reach_km")


_CONE = geo.wind_cone("CAST(id % 90 AS DOUBLE)", "CAST((id * 31) % 360 AS DOUBLE)")


@query("f30_wind_cones", "SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in _CONE.items()) + f", {geo.compass('CAST((id * 31) % 360 AS DOUBLE)')} AS wind_from FROM signals")
def wind_cones(spark, d):
    return signals(spark, d).selectExpr("id", *[f"{v} AS {k}" for k, v in _CONE.items()], f"{geo.compass('CAST((id * 31) % 360 AS DOUBLE)')} AS wind_from")


_RING = geo.destination("lat", "lon", "CAST(k AS DOUBLE) * 5e0", "2000e0")


@query("f31_rings", f"SELECT id, k, round({_RING[0]}, 7) AS ring_lat, round({_RING[1]}, 7) AS ring_lon FROM (SELECT *, unnest(range(72)) AS k FROM signals WHERE type = 'wildfire')")
def rings(spark, d):
    rows = signals(spark, d).where("type = 'wildfire'").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(71).cast("long"))))
    return rows.selectExpr("id", "k", f"round({_RING[0]}, 7) AS ring_lat", f"round({_RING[1]}, 7) AS ring_lon")


@query("k09_geojson", """SELECT id, '{"type":"Feature","geometry":' || CASE WHEN lat IS NULL THEN 'null' ELSE '{"type":"Point","coordinates":[' || CAST(CAST(round(lon) AS INT) AS VARCHAR) || ',' || CAST(CAST(round(lat) AS INT) AS VARCHAR) || ']}' END || ',"properties":{"id":' || CAST(id AS VARCHAR) || ',"source":"' || source || '","type":"' || type || '"}}' AS feature FROM signals""")
def geojson(spark, d):
    rows = signals(spark, d).withColumns({"lat": F.round("lat").cast("int"), "lon": F.round("lon").cast("int")})
    return listing.to_features(rows, ["id", "source", "type"]).select("id", "feature")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Active incidents with auditable confidence: clusters of recent signals, scored and listed."""
    rows = members(spark, d).drop("family").withColumnRenamed("cluster_id", "incident_id")
    return listing.list_incidents(score.refresh(rows)).select("incident_id", "type", "status", "confidence", "is_official_confirmed", "breakdown", "event_count", "lat", "lon", "title", "last_seen_at")


def _unassigned(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).withColumns({"incident_id": F.lit(None).cast("long"), "updated_at": F.expr("ts + make_interval(0, 0, 0, 0, int(id % 48), 0, 0)")})


@query("m01_correlation_pass")
def correlation_pass(spark, d):
    """A whole first pass with wide windows: incidents by id."""
    policy = P.Policy(window_h=264, match_window_h=264, active_window_h=264, alert_valid_h=264, min_signals=2)
    return passes.first_pass(spark, _unassigned(spark, d), PRESENT, policy).incidents.drop("breakdown", "sources")


@query("x06_rate_limit", """WITH RECURSIVE calls AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch(CAST(ts AS TIMESTAMP)) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
 walk AS (SELECT key, t, r, TRUE AS allowed, t AS last_t FROM calls WHERE r = 1
  UNION ALL SELECT c.key, c.t, c.r, c.t - w.last_t >= 86400, CASE WHEN c.t - w.last_t >= 86400 THEN c.t ELSE w.last_t END FROM walk w JOIN calls c ON c.key = w.key AND c.r = w.r + 1)
 SELECT key, t AS "at", allowed, CAST(CASE WHEN allowed THEN 0 ELSE ceil(86400 - (t - last_t)) END AS BIGINT) AS retry_after FROM walk""")
def rate_limit(spark, d):
    calls = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return ingest.limit_batch(calls, 86400.0)
