"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.tables import ranked
from signalloom.tables import materialise

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float, most: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row a source: source, source_size, weight, target.

    The sources share `share` times all sizes by weight; a target stops at `most` times its source's size, and what
    is left is shared again by weight. Sorted by cap over weight, the capped sources are a prefix, so that two
    running sums find them. The table has a row per source, which is what meets in one task.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("_k", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.expr(f"int(_k % {len(weights)}) + 1")))
    t = t.withColumn("_cap", F.col("source_size") * most).withColumn("_all", F.sum("source_size").over(every) * F.lit(share))
    t = t.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    order = every.orderBy("_ratio", "_k")
    t = t.withColumn("_capped", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("_open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("_full", (F.col("_all") - F.col("_capped")) * F.col("weight") >= F.col("_cap") * F.col("_open"))
    t = t.withColumn("_left", F.col("_all") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0)))
    t = t.withColumn("_share", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(every))
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("weight") * F.col("_left") / F.col("_share"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, seed: str = "mix", salts: int = 64) -> DataFrame:
    """Adds to (doc_id, source, size): source_size, target and copies, the times the mix takes the document.

    A document's expected copies are its source's target over its source's size. Within a source, documents are
    lined up by size, the expected copies are summed along the line from one random offset a source, and a document
    is taken once for each integer that the sum passes in it: at most `most` times, and each source's total stays
    near its target. The offset and the order within equal sizes are functions of the seed, source and doc_id, so
    reruns agree. The place in line comes from counts by (source, size class, salt): no source meets in one task.

    A null source is a source of its own, the last; null, empty and blank texts have size 0; documents of equal
    doc_id are separate rows; an empty table gives an empty result.
    """
    x = F.col("size") + 1
    sized = docs.withColumn("_digits", F.length(F.bin(x)))
    sized = sized.withColumn("_class", F.col("_digits") * 16 + F.expr("int(shiftright((size + 1) * 16, _digits - 1) % 16)"))
    sized = sized.withColumn("_salt", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2), 16, 10).cast("int") % salts)
    targets = source_targets(sized, share, most).select(F.col("source").alias("_s"), "source_size", "target")
    placed = ranked(sized, ["source"], ["_class", "_salt"], [F.col("size"), F.col("doc_id").asc_nulls_last()], "_at", extra=(targets, ["_s"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    placed = placed.withColumn("_rate", rate).withColumn("_u", offset)
    copies = F.floor(F.col("_rate") * (F.col("_at") + 1) + F.col("_u")) - F.floor(F.col("_rate") * F.col("_at") + F.col("_u"))
    return placed.withColumn("copies", copies.cast("long")).drop("_digits", "_class", "_salt", "_at", "_rate", "_u")


def emit(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """The mix itself: each row as many times as its copies say."""
    return mixed.where(F.col(copies) > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(copies)))).drop("_copy")


#: Up to so many keys of repeated rows are broadcast.
FEW_REPEATS = 100_000


def mixed_documents(docs: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of (doc_id, text, source, ...) as the mix takes them, each as often as it does; columns as they are.

    Places are worked out on rows without texts; these meet their texts again by doc_id, source, a hash of the text
    and a number among rows equal in these, so that repeated rows are taken each for itself. Only repeated rows are
    sorted for their numbers.
    """
    key = ["_id", "_h"]
    given = docs.withColumn("_id", F.struct(F.col("doc_id").alias("i"), F.col("source").alias("s"))).withColumn("_h", F.xxhash64("text"))
    slim = materialise(given.select("_id", "_h", "doc_id", "source", word_count(F.col("text")).alias("size")), "mix")
    again = materialise(slim.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(*key), "again")
    repeats = again.count()

    def numbered(rows: DataFrame) -> DataFrame:
        """A number among equal rows: 1 at once for rows that no other equals."""
        first = rows.withColumn("_n", F.lit(1))
        if not repeats:
            return first
        equal = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
        if repeats > FEW_REPEATS:
            return equal
        few = F.broadcast(again.select(F.col("_id").alias("_i2"), F.col("_h").alias("_h2")))
        same = F.col("_id").eqNullSafe(F.col("_i2")) & (F.col("_h") == F.col("_h2"))
        some = rows.join(few, same, "left_semi")
        some = some.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
        return first.join(few, same, "left_anti").unionByName(some)

    copies = numbered(mix(slim, share, most)).where("copies > 0")
    copies = copies.select(F.col("_id").alias("_i"), F.col("_h").alias("_g"), F.col("_n").alias("_m"), F.col("copies").alias("_copies"))
    found = numbered(given).join(copies.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")) & (F.col("_n") == F.col("_m")))
    return emit(found, "_copies").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents, 150% of all words by weights 3, 1, 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    return mix(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][CAST(k % 3 AS INT) + 1] AS weight, 2 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS everything FROM sizes
), lined AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY cap::DOUBLE / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM weighed
), judged AS (
  SELECT *, (everything - capped::DOUBLE) * weight >= cap::DOUBLE * open_w::DOUBLE AS is_full FROM lined
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE weight * (everything - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)::DOUBLE) / (sum(weight) FILTER (WHERE NOT is_full) OVER ())::DOUBLE END AS target FROM judged
), digits AS (
  SELECT *, length(bin(size + 1)) AS d, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2)) AS INT) % 64 AS salt FROM sized
), placed AS (
  SELECT g.doc_id, g.source, g.size, t.source_size, t.target,
         row_number() OVER (PARTITION BY g.source ORDER BY d * 16 + (((g.size + 1) * 16) >> (d - 1)) % 16, salt, g.size, g.doc_id NULLS LAST) - 1 AS pos,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(('0x' || substr(md5('mix|' || coalesce(g.source, '')), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM digits g JOIN targets t ON g.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(floor(rate * (pos + 1) + u) - floor(rate * pos + u) AS BIGINT) * size AS taken FROM placed
"""
