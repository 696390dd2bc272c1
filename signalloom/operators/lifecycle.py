"""Life cycle of incidents: folios, dismissal of uncorroborated reports, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom import policy as P
from signalloom.operators.listing import at_most
from signalloom.tables import numbered


def with_codes(incidents: DataFrame, year: int, last: int = 0) -> DataFrame:
    """Adds the folio INC-year-number, numbered on from `last` by first_seen_at and id: one pass's new incidents."""
    rows = numbered(incidents, ["first_seen_at", "incident_id"], "_number")
    return rows.withColumn("code", F.format_string(f"INC-{year}-%05d", (F.col("_number") + last).cast("int"))).drop("_number")


def last_code(incidents: DataFrame, year: int) -> int:
    """The greatest number that a folio of the year has; 0 where none has one, so that each year begins anew."""
    number = F.regexp_extract("code", rf"^INC-{year}-(\d+)$", 1).try_cast("long")
    return incidents.agg(F.coalesce(F.max(number), F.lit(0))).first()[0]


def expire(incidents: DataFrame, now, policy: P.Policy = P.Policy()) -> DataFrame:
    """Status after time has passed: first lone citizen reports are dismissed, then silent active incidents go stale."""
    at = F.lit(now)
    age = lambda c: F.unix_timestamp(at) - F.unix_timestamp(c)
    only_citizens = F.size(F.array_except("sources", F.array(F.lit("citizen")))) == 0
    lone = F.col("status").isin(*P.OPEN_STATUSES) & (age("first_seen_at") > policy.citizen_ttl_min * 60) & at_most("confidence", policy.citizen_most) & ~F.col("is_official_confirmed") & only_citizens
    silent = (F.col("status") == "active") & (age("last_seen_at") > policy.stale_h * 3600)
    return incidents.withColumn("status", F.when(lone, "dismissed").when(silent, "stale").otherwise(F.col("status")))


def active_view(incidents: DataFrame, now) -> DataFrame:
    """Open incidents with the seconds since they were last seen."""
    return incidents.where(F.col("status").isin(*P.OPEN_STATUSES)).withColumn("silence_s", F.unix_timestamp(F.lit(now)) - F.unix_timestamp("last_seen_at"))


def violations(incidents: DataFrame) -> DataFrame:
    """Rows that break an invariant, with its name."""
    say = lambda bad, what: F.when(bad, F.lit(what))
    merged = F.coalesce(F.col("merged_into_id").isNotNull(), F.lit(False)) if "merged_into_id" in incidents.columns else F.lit(False)
    checks = F.array_compact(F.array(
        say(F.col("last_seen_at") < F.col("first_seen_at"), "window"),
        say(F.col("event_count") < 0, "count"),
        say((F.col("status") == "merged") != merged, "merged"),
        say(~F.col("confidence").between(0, 1), "confidence"),
    ))
    return incidents.withColumn("violated", F.explode(checks)).select("incident_id", "violated")
