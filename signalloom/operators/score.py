"""Additive confidence of incidents with its breakdown, and what else their signals say."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom import policy as P
from signalloom.functions import cases


def with_weights(signals: DataFrame) -> DataFrame:
    """Adds weight, decay, ceiling, confirming. A dispatch by a source that dispatches weighs 0.80 at least."""
    rule = lambda field: F.expr(cases.rule("source", field))
    held = F.least(rule("most"), F.greatest(rule("least"), F.col("confidence").cast("double")))
    sent = rule("dispatch") & F.col("type").isin(*P.DISPATCH_TYPES)
    weight = F.when(sent, F.greatest(held, F.least(F.lit(P.DISPATCH_WEIGHT), rule("ceiling")))).otherwise(held)
    return signals.withColumns({"weight": weight, "decay": rule("decay"), "ceiling": rule("ceiling"), "confirming": rule("confirming")})


def ranks_that_count(rules: dict[str, P.Rule] = P.RULES, least: float = 2.0**-60) -> int:
    """How many of a source's signals can add to its contribution.

    With decay, all ranks from this one on add less than `least` together; without, the cap is reached. A source
    without decay and without a least weight would have no such rank, and is refused.
    """
    most = 1
    for name, rule in rules.items():
        if rule.ceiling <= 0 or rule.decay <= 0:
            continue
        weight = max(rule.most, rule.ceiling)
        if rule.decay >= 1:
            if rule.least <= 0:
                raise ValueError(f"every signal of {name} counts: no rank bounds its sum")
            need = math.ceil(rule.ceiling / rule.least)
        else:
            need = math.ceil(math.log(least * (1 - rule.decay) / weight, rule.decay))
        most = max(most, need)
    return most


#: Ranks of a source's signals that are summed.
RANKS = ranks_that_count()


def contributions(signals: DataFrame) -> DataFrame:
    """(incident_id, source, signals, contribution, confirming): weights by rank, decayed, summed and capped.

    A source's signals of one incident are ranked by weight, which needs no order among equal weights. All signals are
    counted; the sum takes the RANKS first, as later ones add nothing, which are picked before rows are shuffled, so that a busy incident and
    source costs a task as many rows. A source without decay reaches its cap, its weight, with the first.
    """
    keys = ["incident_id", "source"]
    weighed = with_weights(signals)
    rank = Window.partitionBy(*keys).orderBy(F.col("weight").desc())
    ranked = weighed.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= RANKS)
    sums = ranked.groupBy(*keys).agg(F.least(F.max("ceiling"), F.sum(F.col("weight") * F.pow(F.col("decay"), F.col("_r") - 1))).alias("contribution"))
    counts = weighed.groupBy(*keys).agg(F.count(F.lit(1)).alias("signals"), F.max("confirming").alias("confirming"))
    return counts.join(sums, keys)


def score(signals: DataFrame) -> DataFrame:
    """(incident_id, confidence, is_official_confirmed, source_count, event_count, breakdown).

    Contributions add up to at most 1; without a confirming source to at most 0.95, with one to 1. Rounded to four
    places, half up.
    """
    parts = contributions(signals)
    out = parts.groupBy("incident_id").agg(
        F.sum("contribution").alias("_sum"),
        F.max("confirming").alias("is_official_confirmed"),
        F.count(F.lit(1)).alias("source_count"),
        F.sum("signals").alias("event_count"),
        F.sort_array(F.collect_list(F.struct("source", F.round("contribution", 4).alias("contribution"), "signals"))).alias("breakdown"),
    )
    total = F.when(F.col("is_official_confirmed"), F.lit(1.0)).otherwise(F.least(F.lit(P.UNCONFIRMED_CEILING), F.col("_sum")))
    return out.withColumn("confidence", F.round(total, 4)).drop("_sum")


def alert_levels(signals: DataFrame) -> DataFrame:
    """(incident_id, alert_level): the gravest level that an alert's text declares."""
    said = signals.where(F.col("type").isin("alert", "evacuation") & F.expr(cases.rule("source", "alerts")))
    text = cases.plain_text("text")
    level = f"CASE {' '.join(f'WHEN contains({text}, {cases.quoted(w)}) THEN {cases.quoted(v)}' for w, v in P.LEVEL_WORDS)} ELSE 'otra' END"
    ranked = said.withColumn("alert_level", F.expr(level)).withColumn("_s", F.expr(cases.case("alert_level", P.SEVERITY, 0)))
    return ranked.groupBy("incident_id").agg(F.max_by("alert_level", "_s").alias("alert_level"))


def incident_types(signals: DataFrame) -> DataFrame:
    """(incident_id, type): the type with most confidence among confirming signals, or among all if none confirms.

    Ties go to the later type name; incidents of unmapped signals only are possible fires.
    """
    typed = signals.withColumn("_type", F.expr(cases.incident_type("type"))).withColumn("_sure", F.expr(cases.rule("source", "confirming")))
    sums = typed.groupBy("incident_id", "_type").agg(F.sum(F.col("confidence").cast("double")).alias("_all"), F.sum(F.when(F.col("_sure"), F.col("confidence").cast("double"))).alias("_confirmed"))
    named = F.col("_type").isNotNull()
    best = sums.groupBy("incident_id").agg(
        F.max_by(F.when(named & F.col("_confirmed").isNotNull(), F.col("_type")), F.when(named & F.col("_confirmed").isNotNull(), F.struct(F.round("_confirmed", 6), "_type"))).alias("_a"),
        F.max_by(F.when(named, F.col("_type")), F.when(named, F.struct(F.round("_all", 6), "_type"))).alias("_b"),
    )
    return best.select("incident_id", F.coalesce("_a", "_b", F.lit("possible_fire")).alias("type"))


def incident_statuses(signals: DataFrame) -> DataFrame:
    """(incident_id, status, resolved_at): what the last confirming signal with a state word says; active if none.

    Of equal times the less confident signal counts, as it comes later in the order of reading.
    """
    said = f"CASE {' '.join(f'WHEN contains(lower(state), {cases.quoted(w)}) THEN {cases.quoted(v)}' for w, v in P.STATE_WORDS)} END"
    stated = signals.withColumn("_status", F.when(F.expr(cases.rule("source", "confirming")), F.expr(said)))
    last = stated.groupBy("incident_id").agg(
        F.max_by(F.struct("_status", "ts"), F.when(F.col("_status").isNotNull(), F.struct(F.col("ts"), -F.col("confidence").cast("double"), F.col("id")))).alias("_l")
    )
    status = F.coalesce("_l._status", F.lit("active"))
    return last.select("incident_id", status.alias("status"), F.when(status == "extinguished", F.col("_l.ts")).alias("resolved_at"))


def centroids(signals: DataFrame, key: str = "incident_id") -> DataFrame:
    """(key, lat, lon) weighted by confidence, at least 0.01 a signal; unplaced signals do not count."""
    w = F.greatest(F.col("confidence").cast("double"), F.lit(0.01))
    placed = signals.where("lat IS NOT NULL AND lon IS NOT NULL")
    return placed.groupBy(key).agg((F.sum(F.col("lat") * w) / F.sum(w)).alias("lat"), (F.sum(F.col("lon") * w) / F.sum(w)).alias("lon"))


def refresh(signals: DataFrame) -> DataFrame:
    """Incidents as their signals make them: type, status, score, place, territory, times and counts.

    Times are those of placed signals, or of all if none is placed; commune and province come from the most
    confident signal that has one. A commune is taken from placed signals' own column, not from lists in alerts.
    """
    order = F.struct(-F.col("confidence").cast("double"), "ts", "id")
    own = lambda c: F.when(F.col(c).isNotNull() & ~F.col("type").isin("alert", "evacuation"), order)
    base = signals.groupBy("incident_id").agg(
        F.coalesce(F.min(F.when(F.col("lat").isNotNull(), F.col("ts"))), F.min("ts")).alias("first_seen_at"),
        F.coalesce(F.max(F.when(F.col("lat").isNotNull(), F.col("ts"))), F.max("ts")).alias("last_seen_at"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min_by("commune", own("commune")).alias("commune"),
        F.min_by("province", own("province")).alias("province"),
    )
    out = base.join(score(signals), "incident_id").join(incident_types(signals), "incident_id").join(incident_statuses(signals), "incident_id")
    out = out.join(centroids(signals), "incident_id", "left").join(alert_levels(signals), "incident_id", "left")
    return out.withColumn("title", F.expr(cases.title("type", "commune"))).withColumn("family", F.expr(cases.incident_family("type")))


def outage_details(signals: DataFrame) -> DataFrame:
    """(incident_id, outages, clients, last_source) of incidents with outages; clients is null if none is known."""
    cuts = signals.where("type = 'power_outage'")
    return cuts.groupBy("incident_id").agg(F.count(F.lit(1)).alias("outages"), F.sum("clients").alias("clients"), F.max_by("source", F.struct("ts", "id")).alias("last_source"))
