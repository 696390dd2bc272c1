"""Windows that may repeat, found through content-chosen anchors.

A window is a run of `width` tokens (bytes or words). Each window picks an anchor among its token grams by their
hashes alone, so equal windows pick the same place in themselves. Consecutive windows with one anchor form a
segment. A segment's key hashes the half window of tokens next to its anchor that all its windows hold, so that
windows of different keys differ: whatever compares windows exactly needs to look at the segments of one key only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.tables import NULL_ID
from signalloom.llm.words import U, chunks, scramble, window_hashes
from signalloom.tables import materialise


@dataclass(frozen=True)
class Windows:
    """width: tokens of a window; gram: tokens of an anchor; one gram in `rate` may be an anchor; step: tokens under one hashed value."""

    width: int
    gram: int
    rate: int
    step: int = 1

    @property
    def places(self) -> int:
        """Grams of a window."""
        return self.width - self.gram + 1

    @property
    def half(self) -> int:
        """Windows whose anchor is at most this far in have their key right of it, the others left of it."""
        return (self.places - 1) // 2

    @property
    def context(self) -> int:
        """Tokens of a key: held by all windows of a segment, on either side."""
        return min(self.width - self.half, self.half + 1 + self.gram) // self.step * self.step


@dataclass
class Segments:
    """Per segment: its text; in tokens from the text's start the first and last window start and the start of the key's context; the key."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    core: np.ndarray
    key: np.ndarray

    def __len__(self) -> int:
        return len(self.text)


def _near_smaller(g: np.ndarray, pos: np.ndarray, reach: int, step: int) -> np.ndarray:
    """Place of the nearest anchor candidate on one side (step -1 or 1) that beats each, or far beyond reach.

    To the left an equal hash beats, to the right only a smaller one: the leftmost of equals wins.
    """
    n = len(g)
    far = np.int64(1) << 60
    out = np.full(n, step * far, np.int64)
    live = np.arange(n)
    d = 0
    while len(live):
        d += 1
        other = live + step * d
        ok = (other >= 0) & (other < n)
        live, other = live[ok], other[ok]
        ok = np.abs(pos[other] - pos[live]) <= reach
        live, other = live[ok], other[ok]
        beat = g[other] <= g[live] if step < 0 else g[other] < g[live]
        out[live[beat]] = pos[other[beat]]
        live = live[~beat]
    return out


def segments(w: Windows, gram_hash: np.ndarray, tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Segments:
    """All windows of the texts (token places starts to ends) as segments; tokens are hashes or values to key on."""
    long = ends - starts >= w.width
    text_of = np.flatnonzero(long)
    lo_of, hi_of = starts[long], ends[long]
    pos = np.flatnonzero(gram_hash < U((1 << 64) // w.rate) if w.rate > 1 else np.ones(len(gram_hash), bool))
    k = np.searchsorted(lo_of, pos, side="right") - 1
    ok = k >= 0
    pos, k = pos[ok], k[ok]
    ok = pos + w.gram <= hi_of[k]
    pos, k = pos[ok], k[ok]
    g = gram_hash[pos]
    prev, nxt = _near_smaller(g, pos, w.places - 1, -1), _near_smaller(g, pos, w.places - 1, 1)
    first = np.maximum(np.maximum(prev + 1, pos - w.places + 1), lo_of[k])
    last = np.minimum(np.minimum(nxt - w.places, pos), hi_of[k] - w.width)
    ok = first <= last
    pos, k, first, last = pos[ok], k[ok], first[ok], last[ok]
    # Right of the anchor: windows that start at most `half` before it. Left of it: the others.
    right_first = np.maximum(first, pos - w.half)
    left_last = np.minimum(last, pos - w.half - 1)
    r, l = right_first <= last, first <= left_last
    left_core = pos - w.half - 1
    parts = [(k[r], right_first[r], last[r], pos[r], np.zeros(int(r.sum()), np.int64)), (k[l], first[l], left_last[l], left_core[l], np.ones(int(l.sum()), np.int64))]
    kk, ff, ll, cc, side = (np.concatenate(x) for x in zip(*parts))
    key = window_hashes(tokens, cc, w.context, w.step) + side.astype(U)
    # Windows without any candidate stand alone, keyed by all their tokens.
    lone = np.concatenate([np.arange(a, b) for a, b in zip(*_gaps(w, pos, k, first, last, lo_of, hi_of))] or [np.zeros(0, np.int64)])
    lone_k = np.searchsorted(lo_of, lone, side="right") - 1
    lone_key = window_hashes(tokens, lone, w.width, w.step) + U(2)
    owner = np.concatenate([kk, lone_k])
    base = lo_of[owner]
    places = (np.concatenate([x, lone]) - base for x in (ff, ll, cc))
    return Segments(text_of[owner], *places, scramble(np.concatenate([key, lone_key])))


def _gaps(w: Windows, pos: np.ndarray, k: np.ndarray, first: np.ndarray, last: np.ndarray, lo_of: np.ndarray, hi_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of window starts [a, b) that no anchor's segment covers."""
    n = len(lo_of)
    order = np.lexsort((first, k))
    kk = np.concatenate([k[order], np.arange(n)])
    a = np.concatenate([last[order] + 1, lo_of])
    rank = np.lexsort((a, kk))
    a, kk = a[rank], kk[rank]
    # The next segment of the same text starts where the gap after this one ends.
    b = np.concatenate([first[order], hi_of - w.width + 1])
    kb = np.concatenate([k[order], np.arange(n)])
    b = b[np.lexsort((b, kb))]
    ok = a < b
    return a[ok], b[ok]


def deltas(values: np.ndarray) -> bytes:
    """Sorted values as their steps, byte planes apart."""
    steps = np.diff(values, prepend=values.dtype.type(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def undeltas(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=U)


_ZSTD: dict[int, zstandard.ZstdCompressor] = {}


def compress(raw: bytes, level: int = 1) -> bytes:
    """A compressed block; a worker makes each compressor once, as that costs more than a small block."""
    if level not in _ZSTD:
        _ZSTD[level] = zstandard.ZstdCompressor(level=level)
    return _ZSTD[level].compress(raw)


def decompress(block: bytes) -> bytes:
    if 0 not in _ZSTD:
        _ZSTD[0] = zstandard.ZstdDecompressor()
    return _ZSTD[0].decompress(block)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, the first sorted, as one compressed block."""
    n = len(arrays[0])
    planes = [deltas(arrays[0].astype(U))] + [np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes() for x in arrays[1:]]
    return n.to_bytes(8, "little") + compress(b"".join(planes))


def unpack_arrays(block: bytes, count: int) -> list[np.ndarray]:
    n = int.from_bytes(block[:8], "little")
    raw = decompress(block[8:])
    out = [undeltas(raw[: 8 * n])]
    for i in range(1, count):
        out.append(np.ascontiguousarray(np.frombuffer(raw[8 * n * i : 8 * n * (i + 1)], np.uint8).reshape(8, -1).T).view("<i8").ravel())
    return out


def keyed(docs: DataFrame, rest: list[str] | None = None) -> DataFrame:
    """doc_id (null as NULL_ID), h (a hash of the text) and text: rows equal in both ids are equal rows. The columns of rest go along as one struct."""
    more = [F.struct(*rest).alias("rest")] if rest else []
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("h"), "text", *more)


#: A key found this often is heavy: its windows are then compared one by one, each under its own hash.
HEAVY = 20_000

#: Text whose keys meet in one part, and segments that are compared in one; a part is what one Python call holds.
PART_BYTES, PART_SEGMENTS = 16 << 20, 250_000
#: Parts of a small table, so that many machines have work.
LEAST_PARTS = 32


def parts_of(amount: int, each: int) -> int:
    """Parts by the amount of data, not by the number of shuffle partitions: each holds about the same at any size."""
    return max(LEAST_PARTS, -(-amount // each))


FOUND = "doc_id long, h long, first long, last long, core long, key long, total long"


def repeated(docs: DataFrame, find: Callable[[pa.Array], Segments], name: str) -> DataFrame:
    """Segments whose key occurs at least twice, as a written table: FOUND. docs comes from keyed().

    A task counts its own keys first and sends one row per key, so a key that a third of all documents hold costs
    a row per task where keys meet; rows whose key repeats inside a task are found right there. Keys are dealt by
    their hash into parts of about PART_BYTES of text.
    """
    parts = parts_of(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, PART_BYTES)
    columns = ("doc_id", "h", "first", "last", "core", "total")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, *rest = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key, kind="stable")
            key, rest = key[order], [x[order] for x in rest]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            where = np.flatnonzero(new)
            count = np.diff(np.append(where, len(key)))
            rest.append(np.repeat(count, count))
            out: dict[str, list] = {"part": [], "block": []}
            for mask, base in ((new, 0), (~new, parts)):
                mine, cols = key[mask], [x[mask] for x in rest]
                for p, a, b in blocks_by_part(parts, mine):
                    out["part"].append(base + p)
                    out["block"].append(pack_arrays(mine[a:b], *[x[a:b] for x in cols]))
            yield pa.RecordBatch.from_pydict({"part": pa.array(out["part"], pa.int32()), "block": pa.array(out["block"], pa.binary())})

        for rows in chunks(batches):
            s = find(rows.column("text"))
            ids, hs = rows.column("doc_id").to_numpy(), rows.column("h").to_numpy()
            held.append((s.key, ids[s.text], hs[s.text], s.first, s.last, s.core))
            size += len(s)
            if size >= 1_500_000:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    out = pa.schema([(c, pa.int64()) for c in (*columns[:5], "key", "total")])

    def meet(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        key, *rest = (np.concatenate(x) for x in zip(*(unpack_arrays(b, 7) for b in table.column("block").to_pylist())))
        if part < parts:  # one row per key and task: kept if the key was seen twice anywhere
            order = np.argsort(key, kind="stable")
            key, rest = key[order], [x[order] for x in rest]
            where = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            total = np.repeat(np.add.reduceat(rest[5], where), np.diff(np.append(where, len(key))))
            keep = total >= 2
            key, rest = key[keep], [x[keep] for x in rest[:5]] + [total[keep]]
        names = {**dict(zip(columns[:5], rest[:5])), "key": key.view(np.int64), "total": rest[5]}
        return pa.table({f.name: names[f.name] for f in out}, schema=out)

    sent = docs.mapInArrow(send, "part int, block binary")
    return materialise(sent.groupBy("part").applyInArrow(meet, FOUND), name)


#: Up to so many heavy keys (8 bytes each) are broadcast; more are joined by key.
FEW_HEAVY = 1_000_000


def marked(found: DataFrame, least: int = HEAVY) -> DataFrame:
    """found with `hot`: whether the segment's key is that of at least `least` segments."""
    heavy = found.where(F.col("total") >= least).select("key").distinct()
    n = heavy.count()
    if not n:
        return found.withColumn("hot", F.lit(False))
    heavy = heavy.select("key", F.lit(True).alias("hot"))
    return found.join(F.broadcast(heavy) if n <= FEW_HEAVY else heavy, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def with_found(docs: DataFrame, found: DataFrame) -> DataFrame:
    """keyed() rows that have repeated segments, with these as an array `found` of (first, last, core, key, hot)."""
    per = found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "last", "core", "key", "hot")).alias("found"))
    return docs.join(per.hint("shuffle_hash"), ["doc_id", "h"])


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """keyed() rows, each with its spans (array of start and end, null if none)."""
    per = spans.groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return docs.join(per.hint("shuffle_hash"), ["doc_id", "h"], "left")


def struct_columns(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and flat numpy columns of an array-of-struct column; a null array is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    flat = column.flatten()
    return np.append(0, np.cumsum(lengths)), [flat.field(n).to_numpy(zero_copy_only=False) for n in names]


def union(offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of each list's spans: owner, start, end; touching spans join."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((starts, owner))
    owner, starts, ends = owner[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    if not len(owner):
        return owner, starts, ends
    far = int(ends.max()) + 2
    reach = np.maximum.accumulate(ends + owner * far)
    new = np.ones(len(owner), bool)
    new[1:] = starts[1:] + owner[1:] * far > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(owner)) - 1
    return owner[at], starts[at], reach[last] - owner[at] * far


def window_keys(values: np.ndarray, at: np.ndarray, w: Windows) -> np.ndarray:
    """Keys of single windows, for the windows of heavy keys."""
    return scramble(window_hashes(values, at, w.width, w.step) + U(3))


def blocks_by_part(parts: int, keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted keys, by equal ranges of the key space."""
    cut = np.searchsorted(keys, np.array([(p << 64) // parts for p in range(1, parts)], U)) if parts > 1 else []
    return [(p, int(a), int(b)) for p, (a, b) in enumerate(zip([0, *cut], [*cut, len(keys)])) if b > a]
