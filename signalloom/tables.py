"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of our own where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        found = tempfile.mkdtemp(prefix="signalloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """A table of materialise(), and aggregates of its rows taken while it was written; those without a value are 0."""
    seen = Observation()
    table = materialise(df.observe(seen, *[F.coalesce(c, F.lit(0)).alias(k) for k, c in counts.items()]), name)
    return table, observed(seen, *counts)


def observed(seen: Observation, *names: str) -> dict[str, int]:
    """What was observed; 0 for all names where Spark knew before that there were no rows, and so took no count."""
    try:
        return seen.get
    except Py4JJavaError as e:
        if "assertion failed" not in str(e.java_exception):
            raise
        return dict.fromkeys(names, 0)


def discard(df: DataFrame) -> None:
    """Deletes a table of materialise() that nothing will read again."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds a gapless number from 1 in the order of columns that tell all rows apart, without gathering rows in one task.

    Rows are dealt into ranges and written; each range is numbered by itself and moved up by the counts of the ranges
    before it, which are as many rows as there are ranges.
    """
    rows = materialise(df.repartitionByRange(tasks(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.join(F.broadcast(counts), "_range").withColumn(out, own + F.col("_before")).drop("_range", "_before")
