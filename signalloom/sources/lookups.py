"""Places of addresses by a table of answers: what is known is joined, what is not is queued for a bounded number of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.operators.store import upsert_by

#: Answers of a geocoder: a place, or none for an address that it does not know.
ANSWERS = "query string, lat double, lon double, asked_at timestamp"


def no_answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ANSWERS)


def query_text(street_1: Column, street_2: Column, city: Column, region: str = "Región de Valparaíso") -> Column:
    """What a geocoder is asked for an address; null without a street, as a city alone would give a point that is plausible and wrong."""
    crossing = F.when(street_2.isNull(), street_1).otherwise(F.concat(street_1, F.lit(" y "), street_2))
    return F.when(street_1.isNotNull(), F.concat_ws(", ", crossing, city, F.lit(region)))


def _good(answers: DataFrame, now: Column, found_days: int, missing_days: int) -> DataFrame:
    """Answers that still hold: one that found a place for longer than one that did not."""
    days = F.when(F.col("lat").isNotNull(), found_days).otherwise(missing_days)
    return answers.where(F.unix_timestamp("asked_at") > F.unix_timestamp(now) - days * 86400)


def placed(rows: DataFrame, answers: DataFrame, now: Column, most: int = 20, found_days: int = 180, missing_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(rows with lat, lon; queue) of rows with a column `query`.

    Rows whose query has an answer that holds get its place, null where it has none. queue: query, uses; the `most`
    unknown queries of most rows, which a run may ask for. The rest waits for later runs: the queue ranks anew each time.
    A hot query is counted before the shuffle, and meets its one answer by a join that may split it.
    """
    good = _good(answers, now, found_days, missing_days).select("query", "lat", "lon", F.lit(True).alias("_asked"))
    met = rows.join(good, "query", "left")
    unknown = met.where("query IS NOT NULL AND _asked IS NULL").groupBy("query").agg(F.count(F.lit(1)).alias("uses"))
    return met.drop("_asked"), unknown.orderBy(F.col("uses").desc(), "query").limit(most)


def answered(answers: DataFrame, queue: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """The answers after a run that asked for the queue: found (query, lat, lon) has what came; the rest of the queue is known to be missing.

    Of several places for one query the first by latitude and longitude counts. Stale answers are replaced.
    """
    first = Window.partitionBy("query").orderBy("lat", "lon")
    one = found.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("query", "lat", "lon")
    asked = queue.select("query").join(one, "query", "left").withColumn("asked_at", now)
    return upsert_by(answers, asked, ["query"])
