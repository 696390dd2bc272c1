import math
import random

from pyspark.sql import functions as F

from signalloom.llm.search import boxes, quantised, reachable, sharded, top_k


def brute(rows, asked, k):
    """All rows are candidates but the query's own; a row without an id comes last of its score."""
    ok = [(n, i, [math.floor(1024 * float(x)) for x in v]) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, q, w in ok:
        if q in asked and q is not None:
            found = sorted((-sum(a * b for a, b in zip(w, v)), i is None, i or 0) for m, i, v in ok if m != n and len(v) == len(w))[:k]
            out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(found)]
    return sorted(out, key=str)


def run(spark, rows, asked, **options):
    df = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    return sorted((tuple(r) for r in top_k(df, df.vec_id.isin(asked), **options).collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(900, None), (901, []), (902, [math.nan] * 8), (903, [math.inf] * 8), (904, [None] * 8), (905, [1.0, 2.0]), (906, [2.0, 1.0])]
    asked = [0, 7, 401, 900, 902, 905]
    assert run(spark, rows, asked, k=10, shard_rows=60, block_rows=2) == brute(rows, asked, 10)


def test_large_components_and_few_rows(spark):
    rows = [(i, [4e5 * (i + 1), -3e5 + i]) for i in range(5)]
    assert run(spark, rows, [0, 3]) == brute(rows, [0, 3], 10)
    assert run(spark, rows[:1], [0]) == []
    assert run(spark, rows, []) == []


def test_repeated_and_missing_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [3.0, 1.0]), (None, [5.0, 5.0]), (None, None), (2, [0.5, 0.5])]
    assert run(spark, rows, [1], k=2) == brute(rows, [1], 2)
    assert len(run(spark, rows, [1])) == 3 * 4


def test_a_hot_vector_and_clustered_rows(spark):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 4) for _ in range(6)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(600)] + [(600 + i, centres[0]) for i in range(300)]
    asked = list(range(0, 900, 50))
    assert run(spark, rows, asked, k=10, shard_rows=40, block_rows=4, sample=500) == brute(rows, asked, 10)


def test_far_shards_are_left_out(spark):
    rng = random.Random(4)
    rows = [(i, [100.0 * (i % 16) + rng.random(), rng.random()]) for i in range(800)]
    df = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    placed = sharded(df.select(df.vec_id.alias("row"), "vec_id", "v", F.lit(False).alias("asked")), 50, 800)
    boxed = boxes(placed)
    asked = spark.createDataFrame([(0, [1024, 0], 2, 1500 * 1024 * 1024 + 1)], "q long, v array<bigint>, dim int, least long")
    assert placed.count() == 800 and boxed.count() >= 16
    assert 0 < reachable(asked, boxed).count() <= boxed.count() // 8


def test_extra_columns_do_no_harm(spark):
    df = quantised(spark.createDataFrame([(1, [1.0], 5, 6), (2, [2.0], 5, 6)], "vec_id long, embedding array<double>, row int, asked int"))
    assert [tuple(r) for r in top_k(df, df.vec_id == 1).collect()] == [(1, 1, 2, 2 * 1024 * 1024)]
