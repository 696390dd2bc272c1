import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalloom.llm.anchors import keyed
from signalloom.llm.jaccard import Forest, frequent_marks, is_marked, jaccard_join, linked_sets, names_of, needed, needed_texts, signatures, spanning_links
from signalloom.llm.shingles import Sets
from signalloom.operators.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    ws = WORD.findall((text or "").encode())
    ws = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in ws]
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    order = lambda d: 2**63 - 1 if d is None else d
    f = Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and (100 * inter >= 75 * len(sets[i] | sets[j]) or rows[i][0] is not None and rows[i][0] == rows[j][0]):
                f.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[f.root(i)] = min(least.get(f.root(i), 2**64), order(d))
    comp = [least[f.root(i)] if sets[i] else order(d) for i, (d, _) in enumerate(rows)]
    return sorted(((d, len(s), None if c == 2**63 - 1 else c) for (d, _), s, c in zip(rows, sets, comp)), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long")
    return sorted((tuple(r) for r in jaccard_join(df, **options).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    some = lambda k: [f"w{rng.randint(0, 4000)}" for _ in range(k)]
    line = some(25)
    rows = []
    for g in range(6):
        base = some(rng.choice([6, 15, 18, 40, 90, 200, 300]))
        for _ in range(rng.randint(1, 25)):
            ws = list(base)
            for _ in range(rng.randint(0, max(1, len(ws) // 25))):
                ws[rng.randrange(len(ws))] = f"x{rng.randint(0, 10**6)}"
            rows.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in ws))
    rows += [" ".join(some(rng.randint(0, 30)) + line + some(rng.randint(0, 30))) for _ in range(30)]
    rows += [rows[0]] * 4 + ["", None, "  ", "one two", "one two", "One two", "one two three", "a " * 50, "a " * 900, "b"]
    rng.shuffle(rows)
    out = [(i - 5, t) for i, t in enumerate(rows)]
    return out + [(None, rows[3]), (out[7][0], out[7][1]), (out[9][0], "quite another text of seven words here")]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"frequent": 3}), (3, {"frequent": 2, "few": 4, "block": 500}), (4, {"frequent": 1, "few": 3, "block": 2000})])
def test_matches_brute_force(spark, seed, options):
    rows = corpus(seed)
    assert run(spark, rows, **options) == brute(rows)


@pytest.mark.parametrize("most,least", [(1 << 24, 2), (40, 2), (3, 2)])
def test_marks_are_those_of_tokens_of_many_sets(spark, most, least):
    """Where more tokens are frequent than the table may hold, it takes those of twice, four times as many sets."""
    rng = random.Random(8)
    lines = [" ".join(f"l{k}w{i}" for i in range(9)) for k in range(12)]
    texts = list({" ".join([f"u{i}a u{i}b", *rng.sample(lines, rng.randint(1, 6) if i % 2 else 1)]) for i in range(90)})
    df = keyed(spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:20])], "doc_id long, text string").repartition(1))
    s = Sets(pa.array(texts))
    values, counts = np.unique(s.values, return_counts=True)
    while (counts >= least).sum() > most:
        least *= 2
    bits = frequent_marks(df, len(s.values), 2, most)
    shift = np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    mark = (values >> shift).astype(np.int64)
    assert list(is_marked(bits, mark)) == list(np.isin(mark, mark[counts >= least]))
    assert len(bits) * 8 >= 1 << 20


def test_sets_of_one_print_go_by_the_other():
    f1, f2 = np.array([5, 5, 6]), np.array([8, 9, 10])
    assert list(names_of(f1, f2, np.array([5]))) == [8, 9, 6] and names_of(f1, f2, np.zeros(0, np.int64)) is f1


def test_rows_without_an_id_are_grouped_by_their_texts(spark):
    rng = random.Random(6)
    some = lambda k: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(k))
    a, b, c = some(60), some(60), some(60)
    rows = [(3, a), (None, a + " end"), (7, b), (None, b + " end"), (None, c), (None, c + " end")]
    assert run(spark, rows) == brute(rows)
    assert {r[2] for r in run(spark, rows) if r[0] == 7} == {7}


def test_one_text_a_set_is_carried(spark):
    """Many copies of one row and one near copy of it: two sets, two texts."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text)] * 1500 + [(None, text + " end")] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    every, known, reps, links = linked_sets(keyed(df), 2, 2, 500)
    assert known.count() == 2 == reps.count() == needed_texts(keyed(df), reps).count() and len(links.collect()) >= 1
    assert {r[2] for r in run(spark, rows)} == {1}


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1)]


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 160), st.data())
def test_linked_sets_share_a_signature(n, data):
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    often = set(pool[: data.draw(st.integers(0, 400))].tolist())
    a = rng.choice(pool, n, replace=False)
    lost = data.draw(st.integers(0, n - 1))
    b = np.concatenate([a[lost:], rng.choice(np.setdiff1d(pool, a), data.draw(st.integers(0, min(60, 400 - n))), replace=False)])
    a, b = np.sort(a), np.sort(b)
    inter = len(np.intersect1d(a, b))
    sign = lambda s: signatures(s, np.array([x in often for x in s.tolist()], bool))
    if inter >= needed(len(a), len(b)):
        assert len(np.intersect1d(sign(a), sign(b)))
    assert (inter >= needed(len(a), len(b))) == (100 * inter >= 75 * (len(a) + len(b) - inter))


def test_spanning_links():
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 2**63, 40).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[k % 4 :], rng.integers(0, 2**63, k % 7).astype(np.uint64)])) for k in range(30)] + [np.zeros(0, np.uint64)]
    want, got, cross = Forest(31), Forest(31), Forest(31)
    for i in range(31):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                want.join(i, j)
    links = spanning_links(sets, None)
    assert len(links) < 31 and all(got.join(i, j) for i, j in links)
    for i, j in spanning_links(sets[:12], None) + [(i, j) for i, j in spanning_links(sets[:12], sets[12:])] + [(i + 12, j + 12) for i, j in spanning_links(sets[12:], None)]:
        cross.join(i, j)
    assert [want.root(i) for i in range(31)] == [got.root(i) for i in range(31)] == [cross.root(i) for i in range(31)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200), (102, 100)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
