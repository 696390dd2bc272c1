"""Shared DataFrame helpers: distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stands for a null id inside Python tasks; sorts after every real id.
NULL_ID = 2**63 - 1


def words_pattern() -> str:
    return r"[^\x20\x09-\x0D]+"


def ranked(df: DataFrame, group: list[str], bucket: list[str], order: list[Column], out: str = "_rank", extra: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """Adds a 0-based gapless rank within `group`, in the order of `bucket`, then `order`, without putting a group into one task.

    Rows are counted by (group, bucket); a running sum over these counts gives each bucket its first rank, and
    only the rows of one bucket are numbered together. The rank is a function of the rows' values alone as long
    as `order` leaves no ties but equal rows. extra: a table with a row per group and its key columns, whose other
    columns are added on the way, so that no row is joined by its group alone. Nulls in keys form groups of their own.
    """
    keys = [*group, *bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    w = w.orderBy(*[F.col(c).asc_nulls_last() for c in bucket]).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    counts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_first")
    if extra:
        table, names = extra
        same = None
        for i, c in enumerate(names):
            one = F.col(f"_k{i}").eqNullSafe(table[c])
            same = one if same is None else same & one
        counts = counts.join(table, same).drop(*names)
    own = df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    on = None
    for i, c in enumerate(keys):
        same = own[c].eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    return own.join(counts, on).withColumn(out, F.col("_first") + F.col("_row") - 1).drop("_row", "_first", *[f"_k{i}" for i in range(len(keys))])
