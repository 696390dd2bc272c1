import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalloom.llm.automata import Automaton, substring_dedup


def brute(rows, width):
    texts = [(t or "").encode().split() for _, t in rows]
    least = {}
    order = lambda d: 2**63 if d is None else d
    for (d, _), ws in zip(rows, texts):
        for i in range(len(ws) - width + 1):
            k = tuple(ws[i : i + width])
            least[k] = min(least.get(k, 2**64), order(d))
    out = []
    for (d, _), ws in zip(rows, texts):
        gone = {i + j for i in range(len(ws) - width + 1) if least[tuple(ws[i : i + width])] < order(d) for j in range(width)}
        kept = b" ".join(x for i, x in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode() if gone else _))
    return sorted(out, key=str)


def run(spark, rows, width, **options):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, found string")
    got = substring_dedup(df, width, rest=["found"], **options).collect()
    assert all(r["rest"]["found"] == "x" for r in got)
    assert all(r["n_removed"] == sum(x["e"] - x["s"] for x in r["spans"]) for r in got)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["text"]) for r in got), key=str)


def corpus(seed, vocabulary, n=40):
    rng = random.Random(seed)
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [some(rng.randint(20, 120)) for _ in range(4)]
    rows = []
    for i in range(n):
        ws = some(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            ws += p[a : a + rng.randint(1, len(p))] + some(3)
        rows.append((rng.randint(-50, 500), rng.choice([" ", "\n", "\t "]).join(ws)))
    return rows + [(600, rows[0][1]), (-60, rows[1][1]), (601, ""), (602, None), (603, "a " * 700), (604, "a b " * 300), (None, rows[2][1]), (rows[3][0], rows[3][1]), (rows[3][0], rows[3][1] + " x"), (605, " ".join(passages[0] * 3))]


@pytest.mark.parametrize("seed,width,heavy", [(1, 20, 20_000), (2, 20, 3), (3, 50, 20_000), (4, 4, 20_000)])
def test_matches_brute_force(spark, seed, width, heavy):
    rows = corpus(seed, [f"w{i}" for i in range(300)] + ["é", "ñandú"])
    assert run(spark, rows, width, heavy=heavy) == brute(rows, width)


def test_few_words_of_vocabulary(spark):
    rows = corpus(5, ["a", "b"], 15)
    assert run(spark, rows, 16) == brute(rows, 16)


def test_nul_inside_words(spark):
    rows = corpus(6, [f"w{i}" for i in range(300)] + ["\0", "a\0b", "\0\0c"] * 20)
    rows += [(700 + i, " ".join(f"n{i % 2}\0{k}" for k in range(60))) for i in range(6)]
    assert run(spark, rows, 20) == brute(rows, 20)


def test_empty(spark):
    assert run(spark, [], 50) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=12), max_size=6), st.text(alphabet="ab", max_size=14), st.integers(1, 4))
def test_automaton_knows_the_first_document(passages, stream, width):
    a = Automaton()
    for d, p in enumerate(passages):
        a.add(list(p), d)
    want = [next((d for d, p in enumerate(passages) if stream[i : i + width] in p), None) for i in range(len(stream) - width + 1)]
    assert a.earliest(list(stream), width) == want
