"""Byte-level BPE by backtracking over longest matches, and its decoding.

A run of tokens is what the merges give exactly when each token is its own encoding and each two neighbours are the
encoding of their joined bytes. So an encoder takes the longest token at each place, keeps it if it agrees with the one
before, else the next shorter one, and goes back a token where none is left. A place from which nothing went on is never
tried again, which makes the work linear in the bytes.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.words import chunks

#: Pieces and pairs of tokens remembered by a worker, and the longest piece remembered.
PIECES, PAIRS, LONG_PIECE = 200_000, 500_000, 64
#: Pieces of a text looked at in one go.
_RUN = 200_000
#: Character classes that a splitting pattern may name.
_CLASSES = (r"\p{L}", r"\p{N}", r"\s")


def _ranges(name: str) -> list[tuple[int, int]]:
    """The code points of a character class as the library has them, which may be of another Unicode version than Python's."""
    import tiktoken

    probe = tiktoken.Encoding(f"class {name}", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    points = np.frombuffer(bytes(probe.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4").astype(np.int64)
    cut = np.flatnonzero(np.diff(points) > 1)
    return list(zip(points[np.append(0, cut + 1)].tolist(), points[np.append(cut, len(points) - 1)].tolist()))


class Splitter:
    """Cuts texts by a pattern with the classes above, spelt out as ranges for `re`; the rest of it must mean the same to `re`.

    Texts of ASCII alone, and those up to U+FFFF, go by shorter ranges.
    """

    def __init__(self, pattern: str):
        found = {name: _ranges(name) for name in _CLASSES}
        self.by_top = [re.compile(self._spelt(pattern, found, top)) for top in (0x7F, 0xFFFF, 0x10FFFF)]

    @staticmethod
    def _spelt(pattern: str, found: dict[str, list[tuple[int, int]]], top: int) -> str:
        inside = {name: "".join(f"\\U{a:08x}-\\U{min(b, top):08x}" for a, b in rows if a <= top) for name, rows in found.items()}
        inside[r"\S"] = None
        out, at, bracket = "", 0, False
        while at < len(pattern):
            name = next((n for n in inside if pattern.startswith(n, at)), None)
            if name == r"\S" and not bracket:
                out += f"[^{inside[chr(92) + 's']}]"
            elif name in _CLASSES:
                out += inside[name] if bracket else f"[{inside[name]}]"
            elif pattern[at] == "\\":
                raise ValueError(f"the splitting pattern has an escape that is not known here: {pattern[at : at + 2]}")
            else:
                bracket = pattern[at] == "[" or bracket and pattern[at] != "]"
                out += pattern[at]
            at += len(name) if name else 1
        return out

    def of(self, text: str) -> re.Pattern:
        if text.isascii():
            return self.by_top[0]
        return self.by_top[1 if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else 2]

    def runs(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text; a long text's come in runs, so that they are never all held."""
        pattern = self.of(text)
        if len(text) <= _RUN:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while run := list(islice(found, _RUN)):
            yield run


class Vocabulary:
    """Tokens by rank, as a file of base64 tokens and ranks has them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {lacking[:5]}")
        self.base = max(self.token) + 1
        self.pairs: dict[int, bool] = {}  # by a * base + b
        self.places = ahocorasick.Automaton()
        # A token that the merges cannot make stands only where it is a whole piece.
        own = {t: i for t, i in ranks.items() if len(t) == 1 or self.merged(t) == [i]}
        self.size, self.shorter = [0] * self.base, [-1] * self.base
        for t, i in own.items():
            self.places.add_word(t.decode("latin-1"), (i, len(t)))
            self.size[i] = len(t)
            self.shorter[i] = next((own[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in own), -1)
        self.places.make_automaton()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, piece: bytes) -> list[int]:
        """The definition: of all neighbours the pair of least rank is joined, the first of equal ones, until no pair has a rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, self.base) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == self.base:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def agree(self, a: int, b: int) -> bool:
        """Whether two tokens can be neighbours: the joined bytes merge into just these two."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[a * self.base + b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return found

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece of text; a piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * (n + 1)
        for end, (token, size) in self.places.iter(piece.decode("latin-1")):
            longest[end + 1 - size] = token  # later ends are longer
        size, shorter, known, base = self.size, self.shorter, self.pairs.get, self.base
        out: list[int] = []
        barren, at, token, last = bytearray(n + 1), 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + size[token]
                if not barren[end]:
                    if last < 0:
                        break
                    fits = known(last * base + token)
                    if fits or fits is None and self.agree(last, token):
                        break
                token = shorter[token]
            if token < 0:  # nothing goes on from here
                barren[at] = 1
                out.pop()
                at -= size[last]
                token, last = shorter[last], out[-1] if out else -1
            else:
                out.append(token)
                at, token, last = end, longest[end], token
        return out


class Coder(dict):
    """Ids of pieces as little-endian 32-bit bytes; a dictionary of the pieces met lately, emptied when it is full."""

    def __init__(self, path: str, pattern: str):
        self.words, self.cut = Vocabulary.read(path), Splitter(pattern)
        self.token = self.words.token

    def __missing__(self, piece: str) -> bytes:
        found = self.words.encode(piece.encode("utf-8", "replace"))
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= LONG_PIECE:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(b"".join(map(self.__getitem__, run)) for run in self.cut.runs(text))

    def decode(self, ids: bytes) -> bytes:
        size = 4 * _RUN
        return b"".join(b"".join(map(self.token.__getitem__, np.frombuffer(ids[at : at + size], "<u4").tolist())) for at in range(0, len(ids), size))


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _columns(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def encode(docs: DataFrame, path: str, keys: list[str], pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The key columns with `ids`: the token ids of `text` as little-endian 32-bit bytes, equal to those of the merges.

    The file at `path` has to be on every machine. A null text is an empty one and has no ids; bytes that are not UTF-8
    count as U+FFFD. Rows are taken one by one, so repeated rows, ties and null keys give a row each; columns that are
    no keys are left out, and a key may not be called `ids`.
    """
    if "ids" in keys:
        raise ValueError("a key is called ids, as the result is")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for rows in chunks(batches):
            texts = rows.column("text").cast(pa.binary()).to_pylist()
            ids = [own.encode(t.decode("utf-8", "replace")) if t else b"" for t in texts]
            yield pa.RecordBatch.from_pydict({**{k: rows.column(k) for k in keys}, "ids": pa.array(ids, pa.binary())})

    # The text goes last: a key may be the text itself.
    return docs.select(*[k for k in keys if k != "text"], "text").mapInArrow(run, f"{_columns(docs, keys)}ids binary")


def decode(encoded: DataFrame, path: str, keys: list[str], pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The key columns with `decoded`: the bytes of the tokens in `ids`, one after the other; null ids give no bytes.

    An id that no token has raises an error.
    """
    if "decoded" in keys:
        raise ValueError("a key is called decoded, as the result is")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            texts = [own.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({**{k: batch.column(k) for k in keys}, "decoded": pa.array(texts, pa.binary())})

    return encoded.select(*dict.fromkeys([*keys, "ids"])).mapInArrow(run, f"{_columns(encoded, keys)}decoded binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every document's text encoded and decoded again."""
    path = default_vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode(docs, path, ["doc_id"])
    digests = ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    back = decode(digests, path, ["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
