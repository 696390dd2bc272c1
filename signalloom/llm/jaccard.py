"""N-gram Jaccard join with token-combination prefixes.

A document is its set of word shingles (tokens). Tokens that few documents have come first in the global order,
frequent ones last. A document's prefix is extended until losing all its signatures would take more misses than
the similarity allows; its signatures are its rare tokens singly and its frequent ones in pairs (of one subset of the
frequent tokens), so a frequent token alone brings no documents together. Candidates are then verified on whole
sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.anchors import NULL_ID, blocks_by_part, keyed, pack_arrays, parts_of, unpack_arrays
from signalloom.operators.graph import components
from signalloom.llm.shingles import Sets
from signalloom.tables import materialise, tasks
from signalloom.llm.words import U, chunks, scramble

#: Least similarity, as 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A token is frequent from this many documents on, or more, if more tokens than MOST_MARKED would be: their marks are broadcast.
FREQUENT, MOST_MARKED = 8, 1 << 24
#: Bits of marks for each frequent token (a token shares its mark with others), which bounds the table at 64 MB.
BITS_EACH = 32
#: Bits of the table that tells which documents' texts are needed.
MARKS = 1 << 26
#: Tokens that are counted, and signatures that meet, in one part.
PART_TOKENS = 2_500_000
#: What is sent with a set's signatures: its print, size and least signature.
_NAME = np.dtype([("name", "<i8"), ("size", "<i8"), ("least", "<u8")])
#: Cells of a set's histogram, which bounds intersections from above.
CELLS = 256
#: Candidates of a signature are paired off up to this many; more form a family.
FEW = 16
#: Tokens of a block of a family.
BLOCK = 1_500_000
#: Sets that share a first print with another one: so many are looked up.
MOST_DOUBLED = 10_000
#: Sets below this size use single tokens only; above, frequent tokens fall into subsets of about this many.
SMALL = 16


def needed(n_a, n_b):
    """Least intersection of linked sets of these sizes: 100 i >= PERCENT (a + b - i)."""
    return -(-PERCENT * (n_a + n_b) // (100 + PERCENT))


def least_size(n: int) -> int:
    return -(-PERCENT * n // 100)


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures of one set of sorted tokens: two linked sets share at least one.

    A linked set misses at most n - least_size(n) of the n tokens. A single token is lost by one miss, the pairs
    of s tokens of a subset by s - 1: the prefix ends where these sum to more than the misses. Subsets depend on the
    set's size by powers of two, and a set signs for the power of its least partner too.
    """
    n = len(tokens)
    if not n:
        return tokens
    need = n - least_size(n) + 1
    rare = tokens[~frequent]
    if len(rare) >= need:
        return scramble(rare[:need])
    often, need = tokens[frequent], need - len(rare)
    out = [scramble(rare)]
    for level in {level_of(n), level_of(least_size(n))}:
        tag = U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        if level == 0:
            out.append(scramble(often[:need] ^ tag))
            continue
        subset = often & U((1 << level) // SMALL - 1)
        new = np.zeros(len(often), bool)
        new[np.unique(subset, return_index=True)[1]] = True
        q = int(np.searchsorted(np.arange(1, len(often) + 1) - np.cumsum(new), need)) + 1
        order = np.argsort(subset[:q], kind="stable")
        t, s = often[:q][order], subset[:q][order]
        for d in range(1, q):
            same = s[d:] == s[:-d]
            if not same.any():
                break
            out.append(scramble(scramble(t[:-d][same] ^ tag) + t[d:][same]))
    return np.unique(np.concatenate(out))


def level_of(n: int) -> int:
    """0 for small sets, else the power of two at or below n."""
    return n.bit_length() - 1 if n >= SMALL else 0


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, f1, f2, cells) of keyed() rows: set size, prints of the set, its histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            s = Sets(rows.column("text"))
            f1, f2 = s.prints()
            cells = np.minimum(s.histograms(CELLS), 255).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column("doc_id"), "h": rows.column("h"), "n": np.diff(s.bounds), "f1": f1.view(np.int64), "f2": f2.view(np.int64),
                "cells": pa.array([c.tobytes() for c in cells], pa.binary()),
            })

    return docs.mapInArrow(run, "doc_id long, h long, n long, f1 long, f2 long, cells binary")


def _once(s: Sets, seen: set) -> list[int]:
    """Indices of the sets that this task has not had before; empty sets are left out."""
    out = []
    for i, pair in enumerate(zip(*(x.tolist() for x in s.prints()))):
        if s.bounds[i + 1] > s.bounds[i] and pair not in seen:
            seen.add(pair)
            out.append(i)
    return out


def frequent_marks(docs: DataFrame, tokens: int, least: int = FREQUENT, most: int = MOST_MARKED) -> np.ndarray:
    """Bits, by the high bits of a token: set where tokens of at least `least` different sets fall.

    Every token of every document is counted (copies inside a task once), by 48-bit buckets, in parts of about
    PART_TOKENS of the `tokens` there are. Where more than `most` buckets are frequent, `least` is doubled until
    they are not; the table is sized by those that are left, so it has at most the power of two above most * BITS_EACH bits.
    """
    parts = 1 << min(20, (parts_of(tokens, PART_TOKENS) - 1).bit_length())
    classes = 48

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def flush() -> pa.RecordBatch:
            bucket, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = blocks_by_part(parts, bucket << U(16))
            return pa.RecordBatch.from_pydict({"part": pa.array([p for p, _, _ in cuts], pa.int32()), "block": pa.array([pack_arrays(bucket[a:b], n[a:b]) for _, a, b in cuts], pa.binary())})

        for rows in chunks(batches):
            s = Sets(rows.column("text"))
            for i in _once(s, seen):
                held.append(s[i] >> U(16))
                size += len(held[-1])
            if size >= 4_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counted = pa.schema([("part", pa.int32()), ("block", pa.binary()), ("sizes", pa.list_(pa.int64()))])

    def count(table: pa.Table) -> pa.Table:
        bucket, n = (np.concatenate(x) for x in zip(*(unpack_arrays(b, 2) for b in table.column("block").to_pylist())))
        order = np.argsort(bucket, kind="stable")
        bucket, n = bucket[order], n[order]
        where = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        total = np.add.reduceat(n, where)
        often = total >= least
        # Class k: counts of least * 2^k and more, below the next.
        level = np.floor(np.log2(total[often] / least)).astype(np.int64)
        sizes = np.bincount(level, minlength=classes).tolist()
        return pa.table([table.column("part").slice(0, 1), pa.array([pack_arrays(bucket[where][often], level)], pa.binary()), pa.array([sizes], pa.list_(pa.int64()))], schema=counted)

    found = materialise(docs.mapInArrow(send, "part int, block binary").groupBy("part").applyInArrow(count, "part int, block binary, sizes array<bigint>"), "frequent")
    sizes = np.array(found.agg(F.array(*[F.coalesce(F.sum(F.get("sizes", F.lit(k))), F.lit(0)) for k in range(classes)]).alias("s")).first()["s"], np.int64)
    left = np.cumsum(sizes[::-1])[::-1]
    first = int(np.argmax(left <= most))
    marks = max(parts * 8, 1 << max(20, (int(left[first]) * BITS_EACH - 1).bit_length()))
    out = pa.schema([("part", pa.int32()), ("bits", pa.binary())])

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part, block in zip(rows.column("part").to_pylist(), rows.column("block").to_pylist()):
                bucket, level = unpack_arrays(block, 2)
                bits = np.zeros(marks // parts, bool)
                bits[(bucket[level >= first] >> U(48 - (marks.bit_length() - 1))).astype(np.int64) - part * (marks // parts)] = True
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())}, schema=out)

    all_bits = np.zeros((parts, marks // parts // 8), np.uint8)
    for r in found.select("part", "block").mapInArrow(bits_of, "part int, bits binary").toLocalIterator():
        all_bits[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return all_bits.ravel()


def is_marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def names_of(f1: np.ndarray, f2: np.ndarray, doubled: np.ndarray) -> np.ndarray:
    """What a set is called: its first print, or its second where other sets have the first too."""
    return np.where(np.isin(f1, doubled), f2, f1) if len(doubled) else f1


def candidates(docs: DataFrame, bits: np.ndarray, tokens: int, few: int = FEW, doubled: np.ndarray = np.zeros(0, np.int64)) -> DataFrame:
    """(a, b, family): sets (by name) that share a signature. Up to `few` of a signature are paired off; of more, each is
    tied to one of them, with family true: all pairs of a family's sets are then candidates.

    Sets whose least signature is the same one meet there alone, as like sets would else meet at each of the many
    signatures they share.
    """
    spark = docs.sparkSession
    parts = parts_of(tokens, PART_TOKENS)
    shared = spark.sparkContext.broadcast(bits)
    shift = U(64 - (len(bits) * 8).bit_length() + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, names, count, seen = [], [], 0, set()

        def flush() -> pa.RecordBatch:
            sig = np.concatenate(sigs)
            about = np.array(names, _NAME)
            who = np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])
            order = np.argsort(sig, kind="stable")
            sig, who = sig[order], who[order]
            out: dict[str, list] = {"part": [], "block": [], "names": []}
            for p, a, b in blocks_by_part(parts, sig):
                used, local = np.unique(who[a:b], return_inverse=True)
                out["part"].append(p)
                out["block"].append(pack_arrays(sig[a:b] >> U(16), local))
                out["names"].append(about[used].tobytes())
            return pa.RecordBatch.from_pydict({"part": pa.array(out["part"], pa.int32()), "block": pa.array(out["block"], pa.binary()), "names": pa.array(out["names"], pa.binary())})

        for rows in chunks(batches):
            s = Sets(rows.column("text"))
            marked = is_marked(shared.value, (s.values >> shift).astype(np.int64))
            f1 = names_of(*(x.view(np.int64) for x in s.prints()), doubled)
            for i in _once(s, seen):
                sigs.append(signatures(s[i], marked[s.bounds[i] : s.bounds[i + 1]]))
                names.append((int(f1[i]), len(s[i]), int(sigs[-1].min())))
                count += len(sigs[-1])
            if count >= 3_000_000:
                yield flush()
                sigs, names, count = [], [], 0
        if sigs:
            yield flush()

    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("family", pa.bool_())])

    def meet(table: pa.Table) -> pa.Table:
        held = [(*unpack_arrays(b, 2), np.frombuffer(n, _NAME)) for b, n in zip(table.column("block").to_pylist(), table.column("names").to_pylist())]
        sig = np.concatenate([x[0] for x in held])
        name, size, least = (np.concatenate([x[2][c][x[1]] for x in held]) for c in ("name", "size", "least"))
        order = np.lexsort((name, sig))
        sig, name, size, least = sig[order], name[order], size[order], least[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])])
        sig, name, size, least = sig[new], name[new], size[new], least[new]
        where = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        many = np.repeat(np.diff(np.append(where, len(sig))), np.diff(np.append(where, len(sig))))
        pairs = [np.zeros((2, 0), np.int64)]
        for d in range(1, few):
            i = np.flatnonzero((sig[d:] == sig[:-d]) & (many[d:] <= few))
            small, large = np.minimum(size[i], size[i + d]), np.maximum(size[i], size[i + d])
            elsewhere = (least[i] == least[i + d]) & (least[i] >> U(16) != sig[i])
            i = i[(100 * small >= PERCENT * large) & ~elsewhere]
            pairs.append(np.stack([name[i], name[i + d]]))
        pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
        head = np.repeat(where, np.diff(np.append(where, len(sig))))
        big = np.flatnonzero(many > few)
        # More than `few` here of one least signature are a family there: one of them stands for all.
        order = np.lexsort((least[big], head[big]))
        big = big[order]
        start = np.flatnonzero(np.concatenate([[True], (head[big][1:] != head[big][:-1]) | (least[big][1:] != least[big][:-1])])) if len(big) else big
        alike = np.diff(np.append(start, len(big)))
        alone = np.repeat(alike <= few, alike) | (least[big] >> U(16) == sig[big])
        alone[start] = True
        big = big[alone]
        big = big[head[big] != big]
        ties = np.unique(np.stack([name[head[big]], name[big]]), axis=1)
        both = np.concatenate([pairs, ties], axis=1)
        return pa.table([both[0], both[1], np.arange(both.shape[1]) >= pairs.shape[1]], schema=out)

    sent = docs.mapInArrow(send, "part int, block binary, names binary")
    return sent.groupBy("part").applyInArrow(meet, "a long, b long, family boolean").distinct()


def possible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) whose histograms leave room for the intersection they need; with f1, n and cells from `known`."""
    side = lambda x: known.select(F.col("f1").alias(x), F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"cells_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in ("cells_a", "cells_b"))
            both = np.minimum(a, b)
            full = (both == 255).any(axis=1)
            keep = full | (both.sum(axis=1, dtype=np.int64) >= needed(rows.column("n_a").to_numpy(), rows.column("n_b").to_numpy()))
            yield rows.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    return joined.select("a", "b", "n_a", "n_b", "cells_a", "cells_b").mapInArrow(run, "a long, b long")


def needed_texts(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(f1, text) of the sets in reps (f1, doc_id, h), one document each.

    One text a set, however often its row comes. Only documents that a bounded table of bits lets pass are shuffled; the bits are those of reps' keys, and let pass
    more documents than needed at most.
    """
    spark = docs.sparkSession
    slot = F.pmod(F.xxhash64("doc_id", "h"), F.lit(MARKS))
    parts = 64
    out = pa.schema([("part", pa.int32()), ("bits", pa.binary())])

    def slice_of(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        bits = np.zeros(MARKS // parts, bool)
        bits[table.column("slot").to_numpy() - part * (MARKS // parts)] = True
        return pa.table([pa.array([part], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], schema=out)

    slots = reps.select(slot.alias("slot")).distinct().withColumn("part", F.expr(f"int(slot div {MARKS // parts})"))
    bits = np.zeros((parts, MARKS // parts // 8), np.uint8)
    for r in slots.groupBy("part").applyInArrow(slice_of, "part int, bits binary").collect():
        bits[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast(bits.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for rows in batches:
            keep = is_marked(shared.value, rows.column("slot").to_numpy())
            ids, hashes = rows.column("doc_id").to_numpy(), rows.column("h").to_numpy()
            for i in np.flatnonzero(keep).tolist():
                key = int(ids[i]), int(hashes[i])
                keep[i] = key not in seen
                seen.add(key)
            yield rows.filter(pa.array(keep))

    schema = "doc_id long, h long, text string, slot long"
    passed = docs.select("doc_id", "h", "text", slot.alias("slot")).mapInArrow(run, schema)
    found = materialise(passed.join(reps.hint("shuffle_hash"), ["doc_id", "h"]).select("f1", "text"), "texts")
    # A row that comes again is passed on once a task at most; only then is there more than a text a set.
    return found if found.count() == reps.count() else materialise(found.dropDuplicates(["f1"]), "texts")


LINKS = "a long, b long"


def verify(pairs: DataFrame, texts: DataFrame, most: int = 512) -> DataFrame:
    """The pairs (a, b) that are linked. Rows of one `a` are dealt into parts of about `most`, each with a's text."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    others = pairs.join(degree, "a").withColumn("part", F.expr("pmod(xxhash64(b), parts)").cast("int")).join(texts.withColumnRenamed("f1", "b"), "b").select("a", "part", "b", "text")
    heads = degree.join(texts.withColumnRenamed("f1", "a"), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.union(others).repartition(tasks(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, U)
        for rows in chunks(batches):
            s = Sets(rows.column("text"))
            links = []
            for i, (a, b) in enumerate(zip(rows.column("a").to_pylist(), rows.column("b").to_pylist())):
                if b is None:
                    head = s[i]
                elif len(np.intersect1d(head, s[i], assume_unique=True)) >= needed(len(head), len(s[i])):
                    links.append((a, b))
            columns = list(zip(*links)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return rows.mapInArrow(run, LINKS)


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def spanning_links(left: list[np.ndarray], right: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """Links between sets of left and right (or within left), just enough to connect what links connect; right's places follow left's.

    Intersections are counted through the right sets' inverted lists, whole sets against whole sets.
    """
    sets = left if right is None else right
    base = 0 if right is None else len(left)
    values = np.concatenate(sets) if sets else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    sizes = np.array([len(s) for s in sets], np.int64)
    forest, links = Forest(len(left) + (0 if right is None else len(right))), []
    for i, s in enumerate(left):
        a, b = np.searchsorted(values, s), np.searchsorted(values, s, side="right")
        total = np.zeros(len(sets), np.int64)
        # Inverted lists in slices of bounded length.
        long = np.cumsum(b - a)
        cuts = [0, *np.searchsorted(long, np.arange(2_000_000, int(long[-1]) if len(long) else 0, 2_000_000)).tolist(), len(s)]
        for x, y in zip(cuts, cuts[1:]):
            n = b[x:y] - a[x:y]
            if n.sum():
                at = np.repeat(a[x:y] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                total += np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero((total >= needed(len(s), sizes)) & (total > 0)).tolist():
            if (right is not None or j > i) and forest.join(i, base + j):
                links.append((i, base + j))
    return links


def family_links(families: DataFrame, known: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links within families (node, component) that connect what all their links connect.

    A family is cut into blocks of about `block` tokens and each pair of its blocks is compared in a task of its own.
    """
    sized = families.join(known.select(F.col("f1").alias("node"), "n"), "node")
    blocks = sized.groupBy("component").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    dealt = sized.join(blocks, "component").withColumn("own", F.expr("pmod(xxhash64(node), blocks)").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    rows = dealt.join(texts.withColumnRenamed("f1", "node"), "node")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        nodes, own = table.column("node").to_numpy(), table.column("own").to_numpy()
        s = [x for rows in chunks(iter(table.select(["text"]).to_batches())) for sets in [Sets(rows.column("text"))] for x in (sets[i] for i in range(len(sets)))]
        at = [np.flatnonzero(own == low), np.flatnonzero(own == high)]
        if low == high:
            links, places = spanning_links([s[i] for i in at[0]], None), at[0]
        else:
            links, places = spanning_links([s[i] for i in at[0]], [s[i] for i in at[1]]), np.concatenate(at)
        columns = list(zip(*[(int(nodes[places[i]]), int(nodes[places[j]])) for i, j in links])) or [[], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=out)

    return rows.groupBy("component", "low", "high").applyInArrow(run, LINKS)


def linked_sets(rows: DataFrame, frequent: int, few: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of keyed() rows: classes(); the known sets (f1, f2, n, doc_id, h), each with its least row; those (f1, doc_id, h)
    that may be linked; links (a, b) of f1 that connect what all links connect."""
    every = materialise(classes(rows), "classes")
    tokens = every.agg(F.sum("n")).first()[0] or 0
    known = every.where("n > 0").groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.first("cells").alias("cells"))
    known = materialise(known.select("f1", "f2", "n", "rep.doc_id", "rep.h", "cells"), "known")
    # Of a billion sets, one pair in thirty may have one first print; so these, a handful, go by their second.
    doubled = [r["f1"] for r in known.groupBy("f1").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("f1").limit(MOST_DOUBLED + 1).collect()]
    if len(doubled) > MOST_DOUBLED:
        raise RuntimeError("more sets share a print than chance allows")
    if doubled:
        every, known = (x.withColumn("f1", F.when(F.col("f1").isin(doubled), F.col("f2")).otherwise(F.col("f1"))) for x in (every, known))
    bits = frequent_marks(rows, tokens, frequent)
    found = materialise(candidates(rows, bits, tokens, few, np.array(doubled, np.int64)), "candidates")
    pairs = materialise(possible(found.where("not family").select("a", "b"), known), "pairs")
    families = materialise(components(found.where("family").select("a", "b")), "families")
    nodes = pairs.select(F.col("a").alias("f1")).union(pairs.select("b")).union(families.select("node")).distinct()
    reps = materialise(nodes.join(known, "f1").select("f1", "doc_id", "h"), "reps")
    texts = needed_texts(rows, reps)
    return every, known, reps, verify(pairs, texts).union(family_links(families, known, texts, block))


def first_rows(docs: DataFrame, frequent: int = FREQUENT, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """(doc_id, h), as keyed() has them, of the least row of each group of like texts.

    Texts are grouped by links of their sets alone: rows of one doc_id, or without one, are as many documents as they
    have texts. A null doc_id comes after all others; of one doc_id the least hash of the text is first. A text without
    shingles stands alone.
    """
    every, known, _, links = linked_sets(keyed(docs), frequent, few, block)
    joined = known.join(components(links), F.col("f1") == F.col("node"), "left").groupBy(F.coalesce("component", "f1")).agg(F.min(F.struct("doc_id", "h")).alias("first"))
    return joined.select("first.doc_id", "first.h").union(every.where("n = 0").select("doc_id", "h").distinct())


def jaccard_join(docs: DataFrame, frequent: int = FREQUENT, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of (doc_id, text): set size and the least doc_id reachable by links.

    Two documents link if 100 * intersection >= 75 * union of their sets of 5-word shingles, words lower-cased. Equal
    sets are one class, and classes are what is compared and linked. A null, empty or blank text has no shingles and
    stands alone. Rows of equal doc_id are one document of several texts: they share a component. Rows without a doc_id
    are each a document of its own, grouped by its text alone; a component of such rows only has no component_id. An
    empty table gives an empty result.
    """
    every, known, _, links = linked_sets(keyed(docs), frequent, few, block)
    several = every.where((F.col("n") > 0) & (F.col("doc_id") != NULL_ID)).groupBy("doc_id").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).where("low <> high")
    tied = every.where("n > 0").join(several, "doc_id").where("f1 <> low").select(F.col("f1").alias("a"), F.col("low").alias("b"))
    grouped = known.select("f1", "f2", "n", "doc_id").join(components(links.union(tied)), F.col("f1") == F.col("node"), "left").withColumn("g", F.coalesce("component", "f1"))
    least = grouped.groupBy("g").agg(F.min("doc_id").alias("least"))
    labels = grouped.join(least, "g").select("f1", "f2", "n", "least")
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    shaped = lambda rows, c: rows.select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), real(c).alias("component_id"))
    return shaped(every.where("n > 0").join(labels, ["f1", "f2", "n"]), "least").union(shaped(every.where("n = 0"), "doc_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all documents."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS c FROM sets UNION SELECT e.y, r.c FROM reach r JOIN edges e ON r.doc_id = e.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id FROM sets s JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) r ON s.doc_id = r.doc_id
"""
