"""Suffix-array dedup of byte strings by a common-prefix-aware distributed merge sort.

Only suffixes that begin at a segment's context (see anchors) are sorted: one for about 70 bytes of text that may
repeat. A task sorts the suffixes of its documents into runs, front-codes them and sends each range of keys to the
task that merges it; a loser tree merges the runs, comparing two suffixes only from the prefix they are known to
share, and so gives the common prefix of neighbours, the sparse suffix array's LCP, as it goes. Two windows are equal
if their suffixes share enough to the right and their left contexts, sorted in the same way, share the rest.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.anchors import (
    NULL_ID, PART_SEGMENTS, Segments, Windows, blocks_by_part, compress, decompress, keyed, marked, parts_of, repeated, segments, struct_columns, union, window_keys, with_found, with_spans,
)
from signalloom.llm.words import U, Texts, chunks, scramble

#: Suffixes that a task sorts at a time.
RUN = 150_000


def eight(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as a number."""
    n = max(0, len(buf) - 7)
    return np.ndarray((n,), dtype="<u8", buffer=np.ascontiguousarray(buf).data, strides=(1,)) if n else np.zeros(0, U)


def windows(width: int) -> Windows:
    return Windows(width, 8, 16, 8) if width >= 24 and width % 8 == 0 else Windows(width, 1, 1, 1)


def finder(width: int):
    w = windows(width)

    def find(column: pa.Array) -> Segments:
        t = Texts(column)
        values = eight(t.buf) if w.step == 8 else t.buf.astype(U)
        return segments(w, scramble(values + U(1)), values, t.starts, t.ends)

    return find


def common_prefixes(strings: list[bytes]) -> np.ndarray:
    """Common prefix of each string with the one before it; 0 for the first."""
    out = np.zeros(len(strings), np.int64)
    for a in range(1, len(strings), 8192):
        part = strings[a - 1 : a + 8192]
        size = np.array([len(s) for s in part])
        wide = int(size.max())
        grid = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in part), np.uint8).reshape(len(part), wide) if wide else np.zeros((len(part), 0), np.uint8)
        differ = np.concatenate([grid[1:] != grid[:-1], np.ones((len(part) - 1, 1), bool)], axis=1)
        out[a : a + len(part) - 1] = np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1]))
    return out


def encode_runs(suffixes: list[bytes], lefts: list[bytes], times: list[int], owners: list[tuple[int, int, int]], cuts: list[tuple[int, int]]) -> list[bytes]:
    """Sorted suffixes as one run for each cut [a, b), front-coded and compressed: shared prefixes, what follows them,
    left contexts, how often, and owners (doc_id, h, core; core -1: none)."""
    shared = common_prefixes(suffixes)
    shared[[a for a, _ in cuts]] = 0
    rest = [s[n:] for s, n in zip(suffixes, shared.tolist())]
    who = np.array(owners, "<i8").reshape(-1, 3)
    times = np.array(times, "<u4")
    rest_size, left_size = (np.array([len(x) for x in y], "<u2") for y in (rest, lefts))
    shared = shared.astype("<u2")
    out = []
    for a, b in cuts:
        body = (shared[a:b].tobytes(), rest_size[a:b].tobytes(), b"".join(rest[a:b]), left_size[a:b].tobytes(), b"".join(lefts[a:b]), times[a:b].tobytes(), who[a:b].T.tobytes())
        out.append(compress(pickle.dumps(body, protocol=5), 3))
    return out


class Run:
    """A decoded run; strings are put together as the merge reaches them."""

    def __init__(self, block: bytes):
        shared, size, rest, left_size, left, times, owners = pickle.loads(decompress(block))
        self.shared = np.frombuffer(shared, "<u2").tolist()
        self.times = np.frombuffer(times, "<u4").astype(np.int64)
        self.owners = np.frombuffer(owners, "<i8").reshape(3, -1)
        self.rest, self.lefts = _slices(rest, size), _slices(left, left_size)

    def __len__(self) -> int:
        return len(self.shared)


def _slices(joined: bytes, sizes: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, "<u2"), dtype=np.int64).tolist()
    return [joined[a:b] for a, b in zip([0, *ends], ends)]


def shared_from(a: bytes, b: bytes, at: int) -> int:
    """The common prefix of two strings known to share `at` bytes."""
    end = min(len(a), len(b))
    step = 8
    while at < end:
        x, y = a[at : at + step], b[at : at + step]
        if x != y:
            n = min(len(x), len(y))
            diff = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return at + (n - (diff.bit_length() + 7) // 8 if diff else n)
        at += step
        step = 64
    return end


class LoserTree:
    """Merges sorted runs of strings whose prefixes shared with their forerunners are known.

    Each contender knows the prefix it shares with the last string put out. Of two contenders, the one that shares
    more is smaller; only when they share equally are they compared, from that prefix on, and the loser then knows
    what it shares with the winner. No prefix is compared twice.
    """

    def __init__(self, runs: list[Run]):
        self.runs = runs
        n = 1
        while n < max(1, len(runs)):
            n *= 2
        self.size = n
        self.at = [0] * n
        self.text: list[bytes | None] = [r.rest[0] if len(r) else None for r in runs] + [None] * (n - len(runs))
        self.known = [0] * n
        self.loser = [0] * n
        winners = [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.loser[node] = self.play(a, b)
        self.top = winners[1] if n > 1 else 0

    def play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        text, known = self.text, self.known
        s, t = text[a], text[b]
        if s is None or t is None:
            return (b, a) if s is None else (a, b)
        i, j = known[a], known[b]
        if i != j:
            return (a, b) if i > j else (b, a)
        n = shared_from(s, t, i)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def merged(self) -> Iterator[tuple[int, int, int]]:
        """(run, place in it, prefix shared with the string before) in sorted order."""
        runs, text, known, at, loser, play = self.runs, self.text, self.known, self.at, self.loser, self.play
        top = self.top
        while text[top] is not None:
            place = at[top]
            yield top, place, known[top]
            place += 1
            at[top] = place
            run = runs[top]
            if place < len(run):
                n = run.shared[place]
                text[top] = text[top][:n] + run.rest[place]
                known[top] = n
            else:
                text[top] = None
            node = (self.size + top) >> 1
            while node:
                top, loser[node] = play(top, loser[node])
                node >>= 1


def repeated_windows(width: int, shared: np.ndarray, size: np.ndarray, lefts: list[bytes], times: np.ndarray) -> np.ndarray:
    """Per suffix (in sorted order) and distance b of a window's start left of the suffix: whether that window occurs twice.

    shared and size are of the text after the 8 bytes of key; a suffix has the windows b from width - size to the
    length of its left context.
    """
    n = len(shared)
    low, high = width - size, np.array([len(x) for x in lefts], np.int64)
    out = np.zeros((n, int(high.max(initial=0)) + 1), bool)
    by_left = np.array(sorted(range(n), key=lefts.__getitem__), np.int64)
    left_shared = common_prefixes([lefts[i] for i in by_left])
    for b in range(out.shape[1]):
        mine = np.flatnonzero((low <= b) & (b <= high))
        if not len(mine):
            continue
        right = np.cumsum(shared < width - b)
        left = np.empty(n, np.int64)
        left[by_left] = np.cumsum(left_shared < b)
        pair = right[mine] * (n + 1) + left[mine]
        order = np.argsort(pair, kind="stable")
        new = np.concatenate([[True], pair[order][1:] != pair[order][:-1]])
        where = np.flatnonzero(new)
        total = np.add.reduceat(times[mine][order], where)
        out[mine[order], b] = np.repeat(total >= 2, np.diff(np.append(where, len(mine))))
    return out


SPANS = "doc_id long, h long, s long, e long"
_SPAN_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "h", "s", "e")])


def repeated_spans(docs: DataFrame, width: int, heavy: int) -> DataFrame:
    """SPANS of the bytes that a window found twice covers, for rows of keyed()."""
    w = windows(width)
    found = repeated(docs, finder(width), "suffix-keys")
    parts = parts_of(found.count(), PART_SEGMENTS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By suffix and left context: how often, and the owners (doc_id, h, core).
        held: dict[tuple[bytes, bytes], list] = {}
        # By text of a heavy key's segment: the owners (doc_id, h, first).
        hot_held: dict[bytes, list[tuple[int, int, int]]] = {}
        count = 0

        def flush() -> pa.RecordBatch:
            sure = []
            for text, own in hot_held.items():
                # The windows of one text are cut once, however many documents hold it.
                if len(own) > 1:
                    sure += [(d, h, at, at + len(text)) for d, h, at in own]
                n = len(text) - width + 1
                one = np.frombuffer(text, np.uint8)
                for k, x in enumerate(window_keys(eight(one) if w.step == 8 else one.astype(U), np.arange(n), w).tolist()):
                    mine = held.setdefault((x.to_bytes(8, "big") + text[k : k + width], b""), [0])
                    mine[0] += len(own)
                    if len(own) == 1:
                        mine.append((own[0][0], own[0][1], own[0][2] + k))
            order = sorted(held)
            keys = np.array([int.from_bytes(k[0][:8], "big") for k in order], U)
            cuts = blocks_by_part(parts, keys)
            # A segment that this task holds twice is repeated whole: its owners need no merge, only others do.
            own = [held[k] for k in order]
            alone = [x[1] if x[0] == 1 else (0, 0, -1) for x in own]
            part = [p for p, _, _ in cuts]
            block = encode_runs([k[0] for k in order], [k[1] for k in order], [min(x[0], 2) for x in own], alone, [(a, b) for _, a, b in cuts])
            sure += [(d, h, c - len(k[1]), c + len(k[0]) - 8) for k, x in zip(order, own) if x[0] > 1 for d, h, c in x[1:]]
            if sure:
                part.append(parts + len(order) % parts)
                block.append(compress(np.array(sure, "<i8").T.tobytes()))
            held.clear()
            hot_held.clear()
            return pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "block": pa.array(block, pa.binary())})

        for rows in chunks(batches):
            t = Texts(rows.column("text"))
            ids, hs = rows.column("doc_id").to_pylist(), rows.column("h").to_pylist()
            offsets, (first, last, core, key, hot) = struct_columns(rows.column("found"), ("first", "last", "core", "key", "hot"))
            prefix = [x.to_bytes(8, "big") for x in key.astype(np.int64).view(U).tolist()]
            first, last, core, hot = first.tolist(), last.tolist(), core.tolist(), hot.tolist()
            for i in range(len(t)):
                text = t.text(i)
                for j in range(offsets[i], offsets[i + 1]):
                    if hot[j]:
                        piece = text[first[j] : last[j] + width]
                        if piece not in hot_held:
                            hot_held[piece] = []
                            count += len(piece) - width
                        hot_held[piece].append((ids[i], hs[i], first[j]))
                    else:
                        c = core[j]
                        mine = held.setdefault((prefix[j] + text[c : last[j] + width], text[first[j] : c][::-1]), [0])
                        mine[0] += 1
                        mine.append((ids[i], hs[i], c))
                    count += 1
                    if count >= RUN:
                        yield flush()
                        count = 0
        if count:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        if table.column("part")[0].as_py() >= parts:
            raw = [np.frombuffer(decompress(b), "<i8").reshape(4, -1) for b in blocks]
            return pa.table(list(np.concatenate(raw, axis=1)), schema=_SPAN_SCHEMA)
        runs = [Run(b) for b in blocks]
        run, place, shared = (np.array(x, np.int64) for x in zip(*LoserTree(runs).merged()))
        size = np.empty(len(run), np.int64)
        times, owners = np.empty(len(run), np.int64), np.empty((3, len(run)), np.int64)
        lefts: list[bytes] = [b""] * len(run)
        for k, r in enumerate(runs):
            mine = np.flatnonzero(run == k)
            size[mine] = np.array(r.shared) + np.array([len(x) for x in r.rest])
            times[mine], owners[:, mine] = r.times, r.owners
            for at, left in zip(mine.tolist(), r.lefts):
                lefts[at] = left
        # Suffixes that share their key with no other and are held once repeat nothing.
        near = np.zeros(len(run) + 1, bool)
        near[1:-1] = shared[1:] >= 8 + w.context
        keep = near[:-1] | near[1:] | (times > 1)
        at = np.flatnonzero(keep)
        # What a kept suffix shares with the kept one before: the least on the way; the suffixes between share no key with either.
        cut = np.where(np.diff(at, prepend=-1) == 1, shared[at], 0)
        size, times, owners = size[at] - 8, times[at], owners[:, at]
        grid = repeated_windows(width, np.maximum(cut - 8, -1), size, [lefts[i] for i in at], times)
        edge = np.zeros((len(at), grid.shape[1] + 2), np.int8)
        edge[:, 1:-1] = grid
        step = np.diff(edge, axis=1)
        row, low = np.nonzero(step == 1)
        _, high = np.nonzero(step == -1)
        core = owners[2][row]
        own = core >= 0
        row, low, high, core = row[own], low[own], high[own], core[own]
        return pa.table([owners[0][row], owners[1][row], core - high + 1, core - low + width], schema=_SPAN_SCHEMA)

    sent = with_found(docs, marked(found, heavy)).mapInArrow(send, "part int, block binary")
    return sent.groupBy("part").applyInArrow(merge, SPANS)


def suffix_dedup(docs: DataFrame, width: int = 200, heavy: int = 20_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) of (doc_id, text): text without repeated windows.

    A byte goes if a window of `width` bytes that covers it also begins anywhere else, in the same document or
    another; overlapping windows count, and all windows are judged on the input. All occurrences go, the first too.
    n_spans counts maximal removed runs; text has the remaining bytes as binary. A null or empty text gives zeros
    and empty bytes; texts shorter than a window keep all; repeated rows are occurrences of each other, and each
    gets its result; a null doc_id is an id like others; an empty table gives an empty result.
    """
    rows = keyed(docs)
    joined = with_spans(rows, repeated_spans(rows, width, heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            t = Texts(part.column("text"))
            offsets, (s, e) = struct_columns(part.column("spans"), ("s", "e"))
            owner, s, e = union(offsets, s, e)
            bounds = np.searchsorted(owner, np.arange(len(t) + 1))
            removed = np.bincount(owner, weights=e - s, minlength=len(t)).astype(np.int64)
            kept, digest = [], []
            for i in range(len(t)):
                text = t.text(i)
                a, b = bounds[i], bounds[i + 1]
                if b > a:
                    text = b"".join(text[x:y] for x, y in zip([0, *e[a:b].tolist()], [*s[a:b].tolist(), len(text)]))
                kept.append(text)
                digest.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_bytes": t.ends - t.starts, "n_removed": removed, "n_spans": np.diff(bounds).astype(np.int64),
                "kept_sha256": pa.array(digest, pa.string()), "text": pa.array(kept, pa.binary()),
            })

    out = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all documents, windows of 200 bytes."""
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
