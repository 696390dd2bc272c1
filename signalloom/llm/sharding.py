"""Sharding by Hilbert curve: quantise metadata dimensions, order rows along the curve, cut equal runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.tables import ranked
from signalloom.tables import materialise


@dataclass(frozen=True)
class Dimension:
    """One axis: a column expression giving a non-negative integer; it is clamped to `bits` bits."""

    name: str
    value: Column


def category(col: str, bits: int) -> Dimension:
    """A categorical axis: equal values share a coordinate; null is coordinate 0."""
    cells = (1 << bits) - 1
    return Dimension(col, F.when(F.col(col).isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(F.col(col)), F.lit(cells))))


def magnitude(name: str, value: Column) -> Dimension:
    """A numeric axis on a logarithmic scale: the number of binary digits; null and negatives are coordinate 0."""
    return Dimension(name, F.when(value > 0, F.length(F.bin(value))).otherwise(F.lit(0)))


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """Hilbert state machine for n axes: output digit and next state by state * 2^n + input digit.

    A state is an entry corner and an axis of travel. Within it the sub-cubes are visited in Gray-code order,
    reflected to the entry corner and rotated to the axis; each sub-cube gets its own entry corner and axis.
    """
    size, mask = 1 << n, (1 << n) - 1

    def turn(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & mask

    def visit(gray: int) -> int:
        step = 0
        while gray:
            step ^= gray
            gray >>= 1
        return step

    def entry(step: int) -> int:
        even = 2 * ((step - 1) // 2)
        return even ^ (even >> 1) if step else 0

    def axis(step: int) -> int:
        odd = step if step % 2 else step - 1
        return ((odd ^ (odd + 1)).bit_length() - 1) % n if step else 0

    digits, states = [], []
    for corner in range(size):
        for along in range(n):
            for cell in range(size):
                step = visit(turn(cell ^ corner, n - (along + 1) % n))
                digits.append(step)
                states.append((corner ^ turn(entry(step), along + 1)) * n + (along + axis(step) + 1) % n)
    return digits, states


def curve_index(axes: list[Column], bits: int) -> Column:
    """Position along the Hilbert curve of 2^bits cells a side, from integer coordinates in [0, 2^bits)."""
    n = len(axes)
    digits, states = curve_tables(n)
    out, nxt = F.array(*[F.lit(x) for x in digits]), F.array(*[F.lit(x) for x in states])
    index, state = F.lit(0).cast("long"), F.lit(0)
    # One input digit a level, highest bit first: bit k of every axis.
    planes = []
    for k in reversed(range(bits)):
        digit = F.lit(0)
        for i, a in enumerate(axes):
            digit = digit.bitwiseOR(F.shiftleft(F.shiftright(a.cast("int"), k).bitwiseAND(F.lit(1)), i))
        planes.append(digit)

    def level(acc: Column, digit: Column) -> Column:
        at = acc["state"] * F.lit(1 << n) + digit
        return F.struct((acc["index"] * F.lit(1 << n) + F.get(out, at)).alias("index"), F.get(nxt, at).alias("state"))

    return F.aggregate(F.array(*planes), F.struct(index.alias("index"), state.alias("state")), level, lambda acc: acc["index"])


def hilbert_shards(df: DataFrame, dims: list[Dimension], n_shards: int, tie: list[str], bits: int = 4, salts: int = 64) -> DataFrame:
    """Adds curve (long), shard (int) and slot (long): rows in curve order, cut into runs whose counts are at most one apart.

    slot numbers each shard's rows from 0 without gaps, in curve order. Rows of one curve cell are ordered by a
    salt from the tie columns, then by these; rows equal in all of them are interchangeable. Nulls, empty texts and
    repeated rows are rows like others; an empty table gives an empty result. Columns named curve, shard or slot
    are replaced; other columns are passed on. Fewer rows than shards leave some shards empty.

    Only the counts of curve cells (at most 2^(bits * axes) rows) meet in one task; a cell that holds a third of
    all rows is numbered in `salts` parts.
    """
    top = (1 << bits) - 1
    axes = [F.least(F.greatest(F.coalesce(d.value.cast("int"), F.lit(0)), F.lit(0)), F.lit(top)) for d in dims]
    rows = df.withColumn("curve", curve_index(axes, bits)).withColumn("_salt", F.pmod(F.xxhash64(*tie), F.lit(salts)))
    rows = materialise(rows, "hilbert")
    rows = ranked(rows, ["curve"], ["_salt"], [F.col(c).asc_nulls_last() for c in tie], "_within")
    cells = rows.groupBy("curve").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("curve").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    rows = rows.join(F.broadcast(cells), F.col("curve") == F.col("_c")).withColumn("_at", F.col("_start") + F.col("_within"))
    rows = rows.withColumn("shard", F.expr(f"_at * {n_shards} div _all").cast("int"))
    rows = rows.withColumn("slot", F.col("_at") - F.expr(f"(shard * _all + {n_shards - 1}) div {n_shards}"))
    return rows.drop("_c", "_start", "_all", "_at", "_within", "_salt")


def write_shards(sharded: DataFrame, path: str, stats: list[str]) -> DataFrame:
    """Writes one folder per shard, in slot order, and returns the manifest: each shard's rows and the range of each stats column."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    ranges = [f(c).alias(f"{n}_{c}") for c in stats for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *ranges)


def prune(manifest: DataFrame, **ranges: tuple) -> list[int]:
    """Shards whose ranges overlap all asked ranges, given as column=(low, high); the manifest has a row per shard."""
    for c, (low, high) in ranges.items():
        manifest = manifest.where((F.col(f"max_{c}") >= F.lit(low)) & (F.col(f"min_{c}") <= F.lit(high)))
    return sorted(r["shard"] for r in manifest.select("shard").collect())


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all documents in 40 shards of equal row counts, along source, lang and size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    docs = docs.select("doc_id", "source", "lang", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32"))
    dims = [category("source", 4), category("lang", 4), magnitude("size", F.shiftright(F.col("size"), 4))]
    out = hilbert_shards(docs, dims, 40, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
