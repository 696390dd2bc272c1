from math import isclose

from pyspark.sql import functions as F

from signalloom.llm.mixing import emit, mix, source_targets, word_count

SCHEMA = "doc_id long, source string, size long"


def brute_targets(sizes, share, most, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_ and left > 1e-9:
        total, over = sum(w[s] for s in open_), left
        for s in list(open_):
            target[s] += over * w[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_targets_match_sharing_by_rounds(spark):
    sizes = {"a": 5, "b": 900, "c": 100, "d": 0, None: 400, "é": 77}
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], SCHEMA)
    got = {r["source"]: r["target"] for r in source_targets(df, 1.5, 2).collect()}
    want = brute_targets(sizes, 1.5, 2)
    assert all(isclose(got[s], want[s], abs_tol=1e-6) for s in sizes)


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, ["hot", "hot", "b", "c", None][i % 5], (i * 7919) % 300) for i in range(3000)] + [(None, "b", 10), (5, "hot", 10), (5, "hot", 10)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 2 for r in got)
    taken, target = {}, {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 600 for s in taken)
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(3)).collect()))
    assert emit(mix(df)).count() == sum(r["copies"] for r in got)
    assert mix(df.limit(0)).collect() == []


def test_word_count(spark):
    df = spark.createDataFrame([("a b c\td\x0be",), ("",), (" \n",), (None,)], "text string")
    assert [r[0] for r in df.select(word_count(F.col("text"))).collect()] == [4, 0, 0, 0]
