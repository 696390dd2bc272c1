"""Validation and idempotent merges of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom import policy as P
from signalloom.functions import cases
from signalloom.operators.listing import in_box
from signalloom.tables import materialise, numbered

#: What an update leaves as it was.
KEPT = ("id", "ts", "ingested_at", "incident_id", "processed_at")


def validated(batch: DataFrame, now, tolerance_s: int = 300, inside_only: bool = False) -> DataFrame:
    """Signals with blanks as nulls, a baseline where confidence is missing, and `errors`: why a row is rejected, empty if it is not."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    out = batch.withColumn("text", blank("text")).withColumn("external_id", blank("external_id"))
    out = out.withColumn("confidence", F.coalesce(F.col("confidence"), F.expr(cases.baseline("source")).cast("float")))
    say = lambda bad, what: F.when(bad, F.lit(what))
    lat, lon = F.col("lat"), F.col("lon")
    checks = [
        say(F.col("ts").isNull(), "no_time"),
        say(F.col("ts") > F.timestamp_add("SECOND", F.lit(tolerance_s), F.lit(now)), "future"),  # parts of a second count
        say(~F.col("source").isin(*P.SOURCES), "source"),
        say(lat.isNull() != lon.isNull(), "half_place"),
        say(lat.isNull() & lon.isNull() & F.col("text").isNull(), "no_place_no_text"),
        say(~lat.between(-90, 90) | ~lon.between(-180, 180), "off_globe"),
        say(~F.col("confidence").between(0, 1), "confidence"),
    ]
    if inside_only:
        checks.append(say(lat.isNotNull() & ~in_box(P.REGION_BOX), "outside"))
    return out.withColumn("errors", F.array_compact(F.array(*checks)))


def split_valid(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of validated rows."""
    good = F.size("errors") == 0
    return batch.where(good).drop("errors"), batch.where(~good)


def last_of_batch(batch: DataFrame, order: str) -> DataFrame:
    """One row a (source, external_id): the last by `order`, with `position` of the first; rows without external_id all stay."""
    key = Window.partitionBy("source", "external_id")
    keyed = batch.where(F.col("external_id").isNotNull())
    last = keyed.withColumn("_r", F.row_number().over(key.orderBy(F.col(order).desc()))).withColumn("position", F.min(order).over(key)).where("_r = 1").drop("_r")
    return last.unionByName(batch.where(F.col("external_id").isNull()).withColumn("position", F.col(order)))


def upsert(stored: DataFrame, batch: DataFrame, order: str = "position", top: int | None = None) -> DataFrame:
    """The stored rows with the batch merged in by (source, external_id), and `outcome`: kept, updated or inserted.

    A known row takes the batch's values, nulls too, but for KEPT; new rows get ids after the largest (after `top` where
    it is given), in order. Rows without external_id are always new. The batch has one row a key (last_of_batch). Both
    sides meet once; rows without external_id, which meet nothing, are spread over all tasks.
    """
    columns, types = stored.columns, {f.name: f.dataType for f in stored.schema}
    keyless = F.col("external_id").isNull()
    spread = lambda c: F.when(keyless, F.xxhash64(c)).otherwise(F.lit(0)).alias("_salt")
    s = stored.select(F.struct(*columns).alias("_s"), "source", "external_id", spread("id"))
    given = [F.col(c) if c in batch.columns else F.lit(None).cast(types[c]).alias(c) for c in columns]
    b = batch.select(F.struct(*given).alias("_b"), F.col(order).alias("_order"), "source", "external_id", spread(order))
    met = s.join(b, ["source", "external_id", "_salt"], "full")
    old, new = F.col("_s").isNotNull(), F.col("_b").isNotNull()
    outcome = F.when(~old, "inserted").when(new, "updated").otherwise("kept")
    value = lambda c: F.when(new & ~(old & F.lit(c in KEPT)), F.col(f"_b.{c}")).otherwise(F.col(f"_s.{c}")).alias(c)
    met = materialise(met.select(*map(value, columns), outcome.alias("outcome"), "_order"), "merged")
    known, added = met.where("outcome <> 'inserted'"), met.where("outcome = 'inserted'")
    least = F.lit(top) if top is not None else F.col("_top")
    added = numbered(added, ["_order"], "_r")
    if top is None:
        added = added.crossJoin(F.broadcast(known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))))
    added = added.withColumn("id", (least + F.col("_r")).cast(types["id"]))
    return known.select(*columns, "outcome").unionByName(added.select(*columns, "outcome"))


def upsert_by(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows with the batch's in place of those of equal keys; the batch has one row a key."""
    return batch.select(*stored.columns).unionByName(stored.join(batch.select(*keys), keys, "left_anti").select(*stored.columns))


def upsert_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count_if(F.col("outcome") == "inserted").alias("inserted"), F.count_if(F.col("outcome") == "updated").alias("updated"))


def ids_by_external_id(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, external_id, id) of wanted keys; id is null for keys that are not stored."""
    return wanted.join(stored.select("source", "external_id", "id"), ["source", "external_id"], "left")


def citizen_reports(reports: DataFrame, received) -> DataFrame:
    """Signals of citizen reports: the server sets source, confidence and type, whatever the client says."""
    kind = F.expr(cases.case("category", {"fire": "smoke", "traffic_accident": "accident"}, "other"))
    return reports.select(F.coalesce("reported_at", F.lit(received)).alias("ts"), F.lit("citizen").alias("source"), kind.alias("type"), "lat", "lon", "text", F.lit(0.40).cast("float").alias("confidence"), F.lit(None).cast("string").alias("external_id"))


def error_log(rejected: DataFrame, most: int = 50) -> DataFrame:
    """The first rejected rows, by source and external_id, with what is wrong with each: the log keeps `most`, the counts all."""
    return rejected.select("source", "external_id", F.array_join("errors", ", ").alias("error")).orderBy("source", "external_id", "error").limit(most)


def assigned(events: DataFrame, ids: DataFrame, incident: int, now) -> DataFrame:
    """Events with the ids (a table of `id`) pointed at an incident and stamped; the others as they are."""
    mine = ids.select("id", F.lit(True).alias("_mine")).distinct()
    out = events.join(mine, "id", "left")
    return out.withColumns({"incident_id": F.when(F.col("_mine"), F.lit(incident)).otherwise(F.col("incident_id")), "processed_at": F.when(F.col("_mine"), F.lit(now)).otherwise(F.col("processed_at"))}).drop("_mine")


def run_row(spark: SparkSession, collector: str, fetched: int, inserted: int, rejected: int, warnings: int = 0, error: str | None = None) -> DataFrame:
    """One row of the run log: failed on an error, partial on rejects or warnings, else success."""
    status = "failed" if error else "partial" if rejected or warnings else "success"
    return spark.createDataFrame([(collector, fetched, inserted, rejected, status, error)], "collector string, fetched long, inserted long, rejected long, status string, error string")


def run_status(rejected, warnings, error):
    """The same as a column, for a log of many runs."""
    return F.when(error.isNotNull(), "failed").when((rejected > 0) | (warnings > 0), "partial").otherwise("success")


def latest_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), "id").limit(n)
