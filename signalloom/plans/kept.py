"""Registered queries that go through a store of versions or through streams; their SQL is that of the finished tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.adapter import derived
from signalloom.operators.versions import SIGNALS, Versions
from signalloom.plans import catalog
from signalloom.streaming import follow
from signalloom.tables import materialise, shared_dir


def _query(name: str, sql: str):
    def keep(f):
        catalog.QUERIES[name], catalog.SQL[name] = f, sql
        return f

    return keep


def _finished(stream: DataFrame, name: str) -> DataFrame:
    """The rows of a stream once all that its source has now is taken."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@_query("k01_bucket_upsert", f"SELECT * EXCLUDE (outcome) FROM ({catalog.SQL['k01_upsert']})")
def bucket_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The upsert through a store: the stored half is one version, the merged table the next, of which only touched buckets are new."""
    stored, incoming = catalog._halves(spark, d)
    table = Versions(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", {"signals": SIGNALS})
    base = table.commit({"signals": stored})
    table.upsert("signals", incoming, base=base, applied=("k01", 0))
    table.upsert("signals", incoming, applied=("k01", 0))  # the same batch again changes nothing
    return table.read("signals").select("id", "source", "external_id", "ts", "type", "commune")


@_query("j04_streamed_neighbours", catalog.SQL["j04_neighbours"])
def streamed_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours by a join of the stream of signals with itself."""
    path = f"{d}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern may be one file or a folder of them
    found = _finished(follow.streamed_neighbours(derived(events), 3000.0, 240), "neighbours")
    return found.select("a", "b", F.round("distance_m", 2).alias("distance_m"))


@_query("x05_expiry_timers", catalog.SQL["m08_m09_expire"])
def expiry_timers(spark: SparkSession, d: str) -> DataFrame:
    """Statuses at the present, by timers over the stream of incidents as they were last refreshed."""
    columns = ["incident_id", "status", "first_seen_at", "last_seen_at", "confidence", "is_official_confirmed", "sources"]
    rows = catalog.incidents(spark, d).select(*columns).withColumn("seen_at", F.col("last_seen_at"))
    present = rows.limit(0).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("incident_id"), F.lit("extinguished").alias("status"), catalog.stamp(catalog.PRESENT).alias("seen_at")), allowMissingColumns=True)
    stored = materialise(rows.unionByName(present), "refreshed")
    before = {k: spark.conf.get(k, None) for k in follow.timer_conf()}
    for k, v in follow.timer_conf().items():
        spark.conf.set(k, v)
    try:
        turned = _finished(follow.expiries(spark.readStream.schema(stored.schema).parquet(stored._written)), "turned")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    last = turned.groupBy("incident_id").agg(F.max_by("status", "at").alias("_new"))
    return stored.where("incident_id >= 0").join(last, "incident_id", "left").select("incident_id", F.coalesce("_new", "status").alias("status"))
