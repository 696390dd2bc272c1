import base64
import random
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from signalloom.llm import bpe

PATH = bpe.default_vocabulary()


def ranks_of(path):
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(ranks, name="test"):
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


KNOWN = encoding(ranks_of(PATH))


def ids(text, path=PATH):
    got = bpe.coder(path, public_tokenizers.PATTERN).encode(text)
    return [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("ab 'st\n\t"), st.text("aàáâéñ中文あ😀 1²½　\x1c\x85"), st.lists(st.sampled_from(["the", " in", "ing", "tion", "'re", "  ", "\n\n", "ñandú", "пример", "日本"])).map("".join)))
def test_ids_are_those_of_the_merges(text):
    assert ids(text) == KNOWN.encode_ordinary(text)


def test_every_character_alone_and_between_letters():
    points = [*range(0x3000), *range(0xA000, 0xB000), *range(0x1E000, 0x20000), *range(0x2EB00, 0x2F000), *range(0x30000, 0x31500, 7), 0x10FFFF]
    for a in range(0, len(points), 512):
        text = "".join(f"a{chr(i)}b {chr(i)}{chr(i)}1" for i in points[a : a + 512] if not 0xD800 <= i < 0xE000)
        assert ids(text) == KNOWN.encode_ordinary(text)


def test_other_vocabulary_and_long_runs(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    other = encoding(ranks_of(path), "other")
    rng = random.Random(3)
    texts = ["a" * 5000, "ab" * 3000, " " * 999 + "x", "".join(rng.choice("etaoinshr") for _ in range(20_000)), "word " * 9000, "=-" * 400]
    monkeypatch.setattr(bpe, "_RUN", 1000)
    monkeypatch.setattr(bpe, "PIECES", 50)
    monkeypatch.setattr(bpe, "PAIRS", 50)
    for text in texts:
        assert ids(text, path) == other.encode_ordinary(text) and ids(text) == KNOWN.encode_ordinary(text)


def test_made_up_merges_that_go_back():
    """Vocabularies trained on little, of few letters, where the longest match is often wrong."""
    rng = random.Random(11)
    for seed in range(25):
        ranks = {bytes([i]): i for i in range(256)}
        corpus = [[bytes([c]) for c in "".join(rng.choice("abc") for _ in range(60)).encode()] for _ in range(4)]
        while len(ranks) < 256 + 30:
            pairs = [(x, y) for row in corpus for x, y in zip(row, row[1:]) if x + y not in ranks]
            if not pairs:
                break
            x, y = rng.choice(pairs)
            ranks[x + y] = len(ranks)
            for row in corpus:
                i = 0
                while i < len(row) - 1:
                    if row[i] + row[i + 1] == x + y:
                        row[i : i + 2] = [x + y]
                    i += 1
        own, other = bpe.Vocabulary(ranks), encoding(ranks, f"made {seed}")
        for _ in range(40):
            piece = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 60)))
            assert own.encode(piece.encode()) == other.encode_ordinary(piece), (seed, piece)


def test_rows(spark):
    long = "lorem ipsum dolor " * 40_000 + "z" * 3000
    rows = [(1, "Hello, World!", "x"), (1, "Hello, World!", "x"), (2, None, "n"), (None, "null id", "n"), (3, "", None), (4, long, "l"), (2**63 - 1, "Ünïcode 日本語 😀\x00", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string").withColumnRenamed("decoded", "n_tokens")
    enc = bpe.encode(df, PATH, ["doc_id", "n_tokens"])
    back = bpe.decode(enc, PATH, ["doc_id", "n_tokens", "ids"]).collect()
    want = sorted((str(d), str(k), len(KNOWN.encode_ordinary(t or "")), (t or "").encode()) for d, t, k in rows)
    assert sorted((str(r["doc_id"]), str(r["n_tokens"]), len(r["ids"]) // 4, bytes(r["decoded"])) for r in back) == want
    assert bpe.decode(bpe.encode(df.limit(0), PATH, ["doc_id"]), PATH, ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        bpe.encode(df.withColumnRenamed("n_tokens", "ids"), PATH, ["ids"])


def test_query_over_all_documents(spark):
    d = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.query(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    for r in docs:
        body = KNOWN.encode_ordinary(r["text"] or "")
        packed = b"".join(i.to_bytes(4, "little") for i in body)
        assert got[r["doc_id"]] == (len(body), sha256(packed).hexdigest(), sha256(KNOWN.decode_bytes(body)).hexdigest())
    assert len(got) == len(docs)
