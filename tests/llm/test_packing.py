import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from signalloom.llm.packing import Encoder, best_fit_pack, default_tokenizer, pack, pieces_of, plan, sequences, tokenised


def one_by_one(lengths, most):
    rooms, n = Counter(), 0
    for x in sorted(lengths, reverse=True):
        room = min((r for r in rooms if r >= x and rooms[r]), default=None)
        if room is None:
            room, n = most, n + 1
        else:
            rooms[room] -= 1
        rooms[room - x] += 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_equals_best_fit_one_by_one(lengths):
    runs, n = plan(Counter(lengths), 40)
    assert n == one_by_one(lengths, 40)
    ranks, cells = Counter(), Counter()
    for length, first, count, sequence, offset in runs:
        for k in range(count):
            ranks[length, first + k] += 1
            for p in range(offset, offset + length):
                cells[sequence + k, p] += 1
                assert p < 40
    assert set(ranks) == {(x, k) for x, n in Counter(lengths).items() for k in range(n)} and max(ranks.values(), default=1) == 1
    assert max(cells.values(), default=1) == 1
    for s in {s for s, _ in cells}:
        assert sorted(p for q, p in cells if q == s) == list(range(sum(1 for q, _ in cells if q == s)))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sé \x85\x1c-1a"), st.characters(codec="utf-8")), max_size=40))
def test_encoder_matches_tokenizer(text):
    enc = ENC
    assert list(np.frombuffer(enc.encode(text), "<u4")) == TOK.encode(text, add_special_tokens=False).ids


TOK, ENC = Tokenizer.from_file(default_tokenizer()), Encoder(default_tokenizer())


def test_long_pieces_and_whole_documents(spark):
    assert ENC.ranks is not None
    texts = ["a" * 30_000, " " * 5000, "\n" * 3000, "ab" * 9000 + "é" * 2000, "1" * 5000, "!" * 5000]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        assert list(np.frombuffer(ENC.encode(text), "<u4")) == TOK.encode(text, add_special_tokens=False).ids


def test_special_token_string():
    text = "a <|endoftext|> b"
    assert list(np.frombuffer(ENC.encode(text), "<u4")) == TOK.encode(text, add_special_tokens=False).ids


def test_packed_documents_round_trip(spark):
    rng = random.Random(5)
    texts = ["word " * rng.randint(0, 90) + str(i) for i in range(60)] + ["", None, "long text " * 700, "same"] + ["same"] * 9
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    packed = best_fit_pack(docs, default_tokenizer(), 64)
    rows = packed.collect()
    want = {i: TOK.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in parts] == pieces_of(len(want[i]), 64)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(want[i][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in parts)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert len(by_seq) == one_by_one([r["length"] for r in rows], 64)
    out = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in sequences(packed, tokenised(docs, default_tokenizer(), 64, ids=True)).collect()}
    for r in rows:
        assert list(out[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]) == want[r["doc_id"]][r["start"] : r["start"] + r["length"]]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    rows = best_fit_pack(docs, default_tokenizer(), 8).collect()
    assert sorted(r["length"] for r in rows) == [1, 2, 3, 3]
    assert best_fit_pack(docs.limit(0), default_tokenizer(), 8).collect() == []
    assert pack(spark.createDataFrame([], "doc_id long, piece int, start long, length long, ids_crc32 long")).collect() == []


def test_ranks_give_the_tokenizers_ids_over_a_whole_table(spark):
    enc = Encoder(default_tokenizer())
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").distinct().collect() if r["text"]]
    assert len(texts) > 5000
    for a in range(0, len(texts), 500):
        for text, want in zip(texts[a : a + 500], enc.tokenizer.encode_batch(texts[a : a + 500], add_special_tokens=False)):
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == want.ids
