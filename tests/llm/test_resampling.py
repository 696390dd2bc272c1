import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from signalloom.llm import resampling


def brute(docs, target, buckets=10000, longest=1, percent=10, least=20):
    """Every row's (doc_id, n_features, weight, score, rank) by the definition, over characters."""

    def words(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    def grams(ws):
        return [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    own = [grams(words(t)) for _, t in docs]
    s, t = Counter(b for g in own for b in g), Counter(b for x in target for b in grams(words(x)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for (d, text), g in zip(docs, own):
        h = int(sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, g))
        rows.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("longest, block", [(1, 250_000), (2, 40)])
def test_equals_the_definition(spark, monkeypatch, longest, block):
    monkeypatch.setattr(resampling.weights, "__defaults__", (block,))
    rng = random.Random(longest)
    vocabulary = ["the", "The", "über", "日本", "a1", "x" * 90] + [f"w{i}" for i in range(400)]
    text = lambda n: rng.choice([" ", "\n", "_-"]).join(rng.choice(vocabulary[: rng.choice([3, 50, 406])]) for _ in range(n))
    docs = [(i, text(rng.choice([5, 19, 20, 21, 60, 400]))) for i in range(300)]
    docs += [(1000 + i, "the the the " * 10) for i in range(150)]  # a bucket that half of the rows have
    docs += [(7, "seven again " * 12), (7, "seven again " * 12), (None, "no id " * 20), (None, "no id " * 20), (None, None), (2000, ""), (2001, "!!! \x00"), (2002, None), (2**63 - 1, "last " * 30), (2003, text(60_000))]
    target = [text(40) for _ in range(9)] + [None, "", "nowhere else"]
    df = spark.createDataFrame([(d, t, 1.0, 0) for d, t in docs], "doc_id long, text string, weight double, rank int").repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest)
    assert rows_of(got) == brute(docs, target, longest=longest)


def test_empty_tables(spark):
    docs = [(i, f"words of document number {i} " * 6) for i in range(30)]
    full, none = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert rows_of(resampling.resample(full, none)) == brute(docs, [])
    assert resampling.resample(full.limit(0), none).collect() == []
    assert resampling.resample(full.limit(0), full.select("text")).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{d}/benchmark.parquet").select("text").collect()]
    got = rows_of(resampling.query(spark, d))
    assert got == brute(docs, target) and sum(r[4] is not None for r in got) > 10
