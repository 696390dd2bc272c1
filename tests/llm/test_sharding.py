from itertools import product

from pyspark.sql import functions as F

from signalloom.llm import sharding
from signalloom.llm.sharding import Dimension, category, curve_index, hilbert_shards, magnitude, prune, write_shards

SCHEMA = "doc_id long, source string, size long, shard string"


def test_curve_visits_neighbours(spark):
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        cells = spark.createDataFrame(list(product(range(1 << bits), repeat=n)), [f"x{i}" for i in range(n)])
        rows = cells.withColumn("at", curve_index([F.col(f"x{i}") for i in range(n)], bits)).orderBy("at").collect()
        assert [r["at"] for r in rows] == list(range(1 << (bits * n)))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(a[i] - b[i]) for i in range(n)) == 1


def shards(spark, rows, n):
    df = spark.createDataFrame(rows, SCHEMA)
    return hilbert_shards(df, [category("source", 3), magnitude("size", F.col("size"))], n, ["doc_id"], bits=3).collect()


def test_counts_slots_and_odd_rows(spark):
    rows = [(i, "hot" if i % 3 else None, i % 50, "old") for i in range(101)] + [(None, None, None, None)] * 3 + [(7, "hot", 7, "x")] * 5
    got = shards(spark, rows, 8)
    assert len(got) == len(rows)
    per = {}
    for r in got:
        per.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    counts = [len(per.get(k, [])) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    assert shards(spark, [], 8) == []
    assert len({r["shard"] for r in shards(spark, rows[:3], 8)}) == 3


def test_written_shards_can_be_pruned(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i % 4}", i, "") for i in range(200)], SCHEMA)
    out = hilbert_shards(df, [Dimension("size", F.shiftright(F.col("size"), 4)), category("source", 4)], 10, ["doc_id"])
    manifest = write_shards(out, str(tmp_path / "shards"), ["size"])
    kept = prune(manifest, size=(0, 15))
    assert 0 < len(kept) < 10
    assert spark.read.parquet(str(tmp_path / "shards")).where(F.col("shard").isin(kept) & (F.col("size") <= 15)).count() == 16


def test_query_covers_all_documents(spark):
    import zlib

    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = sharding.query(spark, d).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in docs.items()}


def test_shards_and_slots_of_the_query_match_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = sharding.query(spark, d).withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(64))).collect()
    order = sorted(rows, key=lambda r: (r["curve"], r["salt"], r["doc_id"]))
    n = len(order)
    first = [-(-k * n // 40) for k in range(40)]
    assert [(r["shard"], r["slot"]) for r in order] == [(i * 40 // n, i - first[i * 40 // n]) for i in range(n)]
    assert {r["law"] for r in rows} == {"rows"} and all(r["grown_shard"] is None for r in rows)


def test_long_texts_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 10**15, "s", 5, 6), (2, None, -3, None, 7, 8)], SCHEMA + ", curve long, slot long")
    got = hilbert_shards(df, [category("source", 3), magnitude("size", F.col("size"))], 2, ["doc_id"], bits=3).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (1, 0)]
