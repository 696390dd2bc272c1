"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.tables import ranked
from signalloom.tables import materialise
from signalloom.llm.words import chunks

#: A text on which both libraries must agree before the quicker one is used.
_PROBE = "It's a probe,  with numbers 1234 &\nlines\t... and Ünïcode  \n\n end "


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes.

    The tokenizer's own file decides. Where a file of the same vocabulary as ranks lies beside it, texts up to Latin
    Extended-A without a special token's string go through these ranks, which give the same ids in a quarter of the
    time; all other texts go to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = self._ranks(path.removesuffix(".json") + ".tiktoken")
        if self.ranks and self.ranks.encode_ordinary(_PROBE) != self.tokenizer.encode(_PROBE, add_special_tokens=False).ids:
            self.ranks = None

    @staticmethod
    def _ranks(path: str):
        if not os.path.exists(path):
            return None
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.ranks is None or (not text.isascii() and max(text) > "ſ") or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces_of(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n tokens: the first piece takes what whole pieces leave."""
    first = n % most or most
    return [(0, first)] + [(at, most) for at in range(first, n, most)]


def tokenised(docs: DataFrame, path: str, most: int = 2048, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of (doc_id, text): each document's ids and a closing 0, cut into pieces.

    A null text is empty: its one id is 0.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for rows in chunks(batches):
            out: dict[str, list] = {k: [] for k in ("at", "piece", "start", "length", "ids_crc32", "ids")}
            for i, text in enumerate(rows.column("text").to_pylist()):
                body = enc.encode(text or "") + b"\0\0\0\0"
                for k, (start, n) in enumerate(pieces_of(len(body) // 4, most)):
                    part = body[4 * start : 4 * (start + n)]
                    for name, value in zip(out, (i, k, start, n, zlib.crc32(part), part if ids else None)):
                        out[name].append(value)
            columns = {"doc_id": rows.column("doc_id").take(pa.array(out["at"], pa.int64())), "piece": pa.array(out["piece"], pa.int32())}
            columns |= {k: pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")}
            if ids:
                columns["ids"] = pa.array(out["ids"], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def plan(histogram: dict[int, int], most: int = 2048) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit, longest first, over counts: runs (length, first rank, count, first sequence, offset), and the number of sequences.

    Sequences with equal room form groups of consecutive numbers; a run puts one piece into each sequence of (a part
    of) a group. A length's pieces go to the smallest room that holds them, and go on filling it while they fit,
    as best fit does one by one. The work depends on the number of lengths and groups, not of documents.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    runs, sequences = [], 0

    def put(length: int, rank: int, first: int, count: int, room: int, per: int) -> None:
        for k in range(per):
            runs.append((length, rank + k * count, count, first, most - room + k * length))
        if left := room - per * length:
            rooms.setdefault(left, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = next((r for r in range(length, most) if rooms.get(r)), most)
            per = room // length
            if room == most:
                first, count = sequences, max(1, left // per)
                sequences += count
            else:
                first, count = rooms[room].pop()
                if count > max(1, left // per):
                    part = max(1, left // per)
                    rooms[room].append((first + part, count - part))
                    count = part
            per = min(per, left // count)
            put(length, rank, first, count, room, per)
            rank += per * count
            left -= per * count
    return runs, sequences


#: Up to so many runs of slots (40 bytes each) are broadcast; more are joined by length.
FEW_RUNS = 100_000


def pack(pieces: DataFrame, most: int = 2048, salts: int = 64) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to `most` tokens.

    The driver gets the histogram of lengths (at most `most` rows) and returns runs of planned slots; a piece takes
    the slot of its rank among the pieces of its length. Ranks come from counts by (length, salt), so that a common
    length meets in no task. Pieces of one length are interchangeable: repeated rows are packed each, and an empty
    table gives an empty result.
    """
    spark = pieces.sparkSession
    found = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(found, most)
    slots = spark.createDataFrame(runs, "_length long, _from long, _count long, _sequence long, offset long")
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)))
    placed = ranked(salted, ["length"], ["_salt"], [F.col(c).asc_nulls_last() for c in ("doc_id", "piece", "ids_crc32")], "_rank")
    fits = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_count"))
    return placed.join(F.broadcast(slots) if len(runs) <= FEW_RUNS else slots, fits).withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_from")).drop("_length", "_from", "_count", "_sequence", "_rank", "_salt")


def best_fit_pack(docs: DataFrame, path: str, most: int = 2048) -> DataFrame:
    """All pieces of (doc_id, text) rows with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialise(tokenised(docs, path, most), "pieces")
    return pack(pieces, most).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame, tokens: DataFrame) -> DataFrame:
    """The packed sequences themselves, (sequence_id, ids): pieces with `ids` (tokenised with ids=True) joined to their places and put in order.

    doc_id must be unique here. A sequence has at most as many pieces as tokens.
    """
    rows = packed.join(tokens.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return parts.select("sequence_id", F.aggregate("_p", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """op6: all documents in sequences of at most 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return best_fit_pack(docs, path or default_tokenizer())
