"""Substring dedup with suffix automata of reference shards.

Windows that may repeat are found through anchors (see anchors). Their segments are dealt by key into reference
shards of bounded size, each task building the suffix automaton of one shard at a time and streaming the shard's
segments through it for matching statistics. A shard holds all segments of its keys, so an automaton meets all the
documents that can match it, and no others; the automata of a whole corpus would have no size bound to broadcast
under.
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
from signalloom.llm.words import U, Texts, Words, chunks, grams

#: Segments that a task gathers at a time, and words of a reference shard.
RUN, SHARD_WORDS = 150_000, 60_000


def windows(width: int) -> Windows:
    return Windows(width, 5, 4) if width >= 16 else Windows(width, 1, 1)


def finder(width: int):
    w = windows(width)

    def find(column: pa.Array) -> Segments:
        words = Words(Texts(column))
        tokens = words.hashes()
        return segments(w, grams(tokens, w.gram), tokens, words.bounds[:-1], words.bounds[1:])

    return find


class Automaton:
    """Suffix automaton of passages added one after another; each state knows the first passage's document that had it."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.long, self.first = [-1], [0], [-1]

    def add(self, passage: list, doc: int) -> None:
        """Adds a passage; documents must come in ascending order, so that the first to have a state is its least."""
        nxt, link, long, first = self.next, self.link, self.long, self.first
        last = 0
        for c in passage:
            q = nxt[last].get(c)
            if q is not None:  # known from an earlier passage: go on from that state, or a copy with the right length
                if long[q] == long[last] + 1:
                    last = q
                else:
                    last = self._copy(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            long.append(long[last] + 1)
            first.append(doc)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if long[q] == long[p] + 1 else self._copy(p, c, q)
            last = cur

    def _copy(self, p: int, c, q: int) -> int:
        nxt, link, long = self.next, self.link, self.long
        copy = len(nxt)
        nxt.append(nxt[q].copy())
        long.append(long[p] + 1)
        link.append(link[q])
        self.first.append(self.first[q])
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def earliest(self, passage: list, width: int) -> list[int | None]:
        """For each window of the passage, the least document among the passages added that has it; None for none."""
        nxt, link, long, first = self.next, self.link, self.long, self.first
        out = []
        state = matched = 0
        for j, c in enumerate(passage):
            while state and c not in nxt[state]:
                state = link[state]
                matched = long[state]
            to = nxt[state].get(c)
            if to is None:
                matched = 0
            else:
                state = to
                matched += 1
            if j >= width - 1:
                if matched < width:
                    out.append(None)
                else:
                    u = state
                    while long[link[u]] >= width:
                        u = link[u]
                    out.append(first[u])
        return out


SPANS = "doc_id long, h long, s long, e long"
_SPAN_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "h", "s", "e")])


def _encode(passages: list[bytes], sizes: list[int], owners: list[tuple[int, int, int]]) -> bytes:
    # Words hold any byte but white space, NUL too.
    body = (b"\n".join(passages), np.array(sizes, "<i8").tobytes(), np.array(owners, "<i8").reshape(-1, 3).T.tobytes())
    return compress(pickle.dumps(body, protocol=5), 3)


def later_spans(docs: DataFrame, width: int, heavy: int) -> DataFrame:
    """SPANS, in words, of windows that also start in a document of smaller doc_id, for rows of keyed()."""
    w = windows(width)
    found = repeated(docs, finder(width), "passage-keys")
    parts = parts_of(found.count(), PART_SEGMENTS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By key and passage: the places (doc_id, h, first) that have it.
        held: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        sizes: dict[bytes, int] = {}
        # By passage of a heavy key: its windows' keys, and the places that have it.
        hot_held: dict[bytes, tuple[list[int], list[tuple[int, int, int]]]] = {}
        count = 0

        def flush() -> pa.RecordBatch:
            part, block, sure = [], [], []
            for passage, (keys, own) in hot_held.items():
                least = min(own)[0]
                sure += [(d, h, at, at + len(keys) - 1 + width) for d, h, at in own if d != least]
                own = [x for x in own if x[0] == least]
                ws = passage.split(b" ")
                for k, key in enumerate(keys):
                    window = b" ".join(ws[k : k + width])
                    sizes[window] = width
                    held.setdefault((key, window), []).extend((d, h, at + k) for d, h, at in own)
            order = sorted(held)
            for p, a, b in blocks_by_part(parts, np.array([k for k, _ in order], U)):
                passages, many, owners = [], [], []
                for k in order[a:b]:
                    least = min(held[k])[0]
                    # The least document goes on; later ones of this task are known to repeat it whole.
                    mine = [x for x in held[k] if x[0] == least]
                    sure += [(d, h, at, at + sizes[k[1]]) for d, h, at in held[k] if d != least]
                    passages.append(k[0].to_bytes(8, "big").hex().encode() + b" " + k[1])
                    many.append(len(mine))
                    owners += mine
                part.append(p)
                block.append(_encode(passages, many, owners))
            if sure:
                part.append(parts + len(order) % parts)
                block.append(compress(np.array(sure, "<i8").T.tobytes()))
            held.clear()
            sizes.clear()
            hot_held.clear()
            return pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "block": pa.array(block, pa.binary())})

        for rows in chunks(batches):
            t = Texts(rows.column("text"))
            ids, hs = rows.column("doc_id").to_pylist(), rows.column("h").to_pylist()
            offsets, (first, last, _, key, hot) = struct_columns(rows.column("found"), ("first", "last", "core", "key", "hot"))
            tokens, bounds = (None, None)
            if hot.any():
                words = Words(t)
                tokens, bounds = words.hashes(), words.bounds
            key, first, last, hot = key.astype(np.int64).view(U).tolist(), first.tolist(), last.tolist(), hot.tolist()
            for i in range(len(t)):
                ws = t.text(i).split()
                for j in range(offsets[i], offsets[i + 1]):
                    a, b = first[j], last[j] + width
                    passage = b" ".join(ws[a:b])
                    if hot[j]:
                        if passage not in hot_held:
                            # The windows of one passage are cut once, however many documents hold it.
                            hot_held[passage] = window_keys(tokens, np.arange(a, b - width + 1) + bounds[i], w).tolist(), []
                            count += b - a - width
                        hot_held[passage][1].append((ids[i], hs[i], a))
                    else:
                        sizes[passage] = b - a
                        held.setdefault((key[j], passage), []).append((ids[i], hs[i], a))
                    count += 1
                    if count >= RUN:
                        yield flush()
                        count = 0
        if count:
            yield flush()

    def match(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        raw = [decompress(b) for b in blocks]
        if table.column("part")[0].as_py() >= parts:
            return pa.table(list(np.concatenate([np.frombuffer(x, "<i8").reshape(4, -1) for x in raw], axis=1)), schema=_SPAN_SCHEMA)
        places: dict[bytes, list[tuple[int, int, int]]] = {}
        for x in raw:
            joined, many, owners = pickle.loads(x)
            who = list(zip(*np.frombuffer(owners, "<i8").reshape(3, -1).tolist()))
            at = 0
            for passage, n in zip(joined.split(b"\n"), np.frombuffer(many, "<i8").tolist(), strict=True):
                places.setdefault(passage, []).extend(who[at : at + n])
                at += n
        spans: list[tuple[int, int, int, int]] = []
        shard: list[tuple[int, list[bytes], list[tuple[int, int, int]]]] = []
        words, before = 0, b""
        for passage in sorted(places):
            name, _, text = passage.partition(b" ")
            if words >= SHARD_WORDS and name != before:
                _through(shard, width, spans)
                shard, words = [], 0
            ws = text.split(b" ")
            shard.append((min(places[passage])[0], ws, places[passage]))
            words, before = words + len(ws), name
        _through(shard, width, spans)
        columns = list(zip(*spans)) or [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=_SPAN_SCHEMA)

    sent = with_found(docs, marked(found, heavy)).mapInArrow(send, "part int, block binary")
    return sent.groupBy("part").applyInArrow(match, SPANS)


def _through(shard: list[tuple[int, list[bytes], list[tuple[int, int, int]]]], width: int, spans: list[tuple[int, int, int, int]]) -> None:
    """Streams a shard's passages, the least documents first, through the automaton of those before them."""
    shard.sort(key=lambda x: x[0])
    automaton = Automaton()
    for doc, ws, owners in shard:
        least = automaton.earliest(ws, width)
        if None in least:
            automaton.add(ws, doc)
            least = [doc if x is None else x for x in least]
        for d, h, first in owners:
            start = None
            for k, x in enumerate(least):
                if x < d:
                    if start is None:
                        start = k
                elif start is not None:
                    spans.append((d, h, first + start, first + k - 1 + width))
                    start = None
            if start is not None:
                spans.append((d, h, first + start, first + len(least) - 1 + width))


def substring_dedup(docs: DataFrame, width: int = 50, heavy: int = 20_000, rest: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, text, spans[, rest]) of (doc_id, text): text without passages that smaller documents have.

    A word goes if a window of `width` words that covers it also starts in a document of smaller doc_id; windows are
    judged on the input. spans lists the maximal removed runs of words; text is the kept words joined by one space,
    or the text as it is where nothing goes. The columns named in rest go along as a struct of that name.
    A null, empty or blank text has no words; one shorter than a window keeps all; rows of equal doc_id never remove
    from each other, and each gets its result; a null doc_id comes after all others; an empty table gives an empty result.
    """
    rows = keyed(docs, rest)
    joined = with_spans(rows, later_spans(rows, width, heavy))
    kind = f", rest {rows.schema['rest'].dataType.simpleString()}" if rest else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            t = Texts(part.column("text"))
            offsets, (s, e) = struct_columns(part.column("spans"), ("s", "e"))
            owner, s, e = union(offsets, s, e)
            bounds = np.searchsorted(owner, np.arange(len(t) + 1))
            s, e = s.tolist(), e.tolist()
            n_words, removed, digest, kept, spans = [], [], [], [], []
            for i in range(len(t)):
                ws = t.text(i).split()
                n_words.append(len(ws))
                a, b = bounds[i], bounds[i + 1]
                if b > a:
                    ws = [x for p, q in zip([0, *e[a:b]], [*s[a:b], len(ws)]) for x in ws[p:q]]
                removed.append(n_words[-1] - len(ws))
                joined_words = b" ".join(ws)
                digest.append(hashlib.sha256(joined_words).hexdigest())
                kept.append(joined_words if b > a else None if t.null[i] else t.text(i))
                spans.append([{"s": p, "e": q} for p, q in zip(s[a:b], e[a:b])])
            columns = {
                "doc_id": part.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array(digest, pa.string()), "text": pa.array(kept, pa.binary()).cast(pa.string()),
                "spans": pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
            }
            if rest:
                columns["rest"] = part.column("rest")
            yield pa.RecordBatch.from_pydict(columns)

    out = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string, spans array<struct<s:long,e:long>>" + kind)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all documents, windows of 50 words."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text", "spans")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, list_aggregate(ws[i : i + 49], 'string_agg', ' ') AS t
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), hashed AS (
  SELECT doc_id, i, md5(t) AS t FROM windows
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS least FROM hashed) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM later CROSS JOIN (SELECT unnest(range(0, 50)) AS k)
), kept AS (
  SELECT w.doc_id, len(w.ws) AS n, g.gone, list_filter(w.ws, lambda x, i: g.gone IS NULL OR NOT list_contains(g.gone, i)) AS k
  FROM w LEFT JOIN (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id) g ON w.doc_id = g.doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
