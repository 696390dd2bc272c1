import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalloom.llm.anchors import HEAVY, Windows, segments
from signalloom.llm.suffixes import LoserTree, Run, common_prefixes, encode_runs, finder, suffix_dedup


def brute(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def run(spark, rows, width, **options):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string")
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["text"])) for r in suffix_dedup(df, width, **options).collect()), key=str)


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(1, len(p))], word()]
        rows.append((i, " ".join(parts)))
    return rows + [(100, rows[0][1]), (101, rows[0][1]), (102, ""), (103, None), (104, "a" * 3000), (105, "ab" * 900), (None, rows[1][1]), (3, rows[3][1]), (106, passages[0] * 3)]


@pytest.mark.parametrize("seed,heavy", [(1, 20_000), (2, 20_000), (2, 3)])
def test_matches_brute_force(spark, seed, heavy):
    rows = corpus(seed)
    assert run(spark, rows, 48, heavy=heavy) == brute(rows, 48)


def test_short_windows_and_empty(spark):
    rows = [(1, "abcabc"), (2, "xbcx"), (3, "q")]
    assert run(spark, rows, 3) == brute(rows, 3)
    assert run(spark, [], 200) == []


def test_production_width(spark):
    rows = corpus(7, 15)
    assert run(spark, rows, 200) == brute(rows, 200)


def test_a_passage_of_more_documents_than_heavy_at_production_width(spark):
    rng = random.Random(5)
    hot = "".join(rng.choice("abcdefg ") for _ in range(230))
    rows = []
    for i in range(HEAVY + 300):
        cut = hot[rng.choice((0, 0, 0, 3, 17)) :]
        rows.append((i, f"{i} {cut}" if i % 3 else f"{cut[: rng.choice((199, 205, 230))]} {i * 7919 % 10007}"))
    rows += [(HEAVY + 400, f"{hot} - {hot}"), (None, hot), (HEAVY + 401, "x" * 500)]
    assert run(spark, rows, 200) == brute(rows, 200)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(c % 3 for c in b)), max_size=12), min_size=1, max_size=6))
def test_loser_tree_sorts_and_knows_prefixes(lists):
    runs = [sorted(x) for x in lists if x]
    if not runs:
        return
    coded = [Run(encode_runs(x, [b""] * len(x), [1] * len(x), [(0, 0, 0)] * len(x), [(0, len(x))])[0]) for x in runs]
    got = list(LoserTree(coded).merged())
    strings = [runs[r][p] for r, p, _ in got]
    assert strings == sorted(s for x in runs for s in x)
    assert [n for _, _, n in got][1:] == list(common_prefixes(strings))[1:]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=70), max_size=5), st.sampled_from([Windows(7, 3, 1), Windows(8, 3, 4), Windows(6, 2, 3), Windows(3, 1, 1)]))
def test_each_window_is_in_one_segment(texts, w):
    raw = [t.encode() for t in texts]
    joined = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    ends = np.cumsum([len(t) for t in raw]).astype(np.int64) if raw else np.zeros(0, np.int64)
    starts = ends - np.array([len(t) for t in raw], np.int64) if raw else ends
    from signalloom.llm.words import grams

    s = segments(w, grams(joined, w.gram), joined, starts, ends)
    got = Counter((int(t), i) for t, a, b in zip(s.text, s.first, s.last) for i in range(a, b + 1))
    assert got == Counter((k, i) for k, t in enumerate(raw) for i in range(len(t) - w.width + 1))
    keys = {}
    for t, a, b, k, c in zip(s.text, s.first, s.last, s.key, s.core):
        for i in range(a, b + 1):
            assert keys.setdefault(raw[t][i : i + w.width], (int(k), int(c) - i)) == (int(k), int(c) - i)


def test_finder_takes_nulls():
    assert len(finder(200)(pa.array([None, "", "short"]))) == 0
