"""Exact top-k by inner product: shards by median splits, a KD-tree in each, best-first search, the kth score passed on.

A query goes only to shards whose tight box can reach its kth score so far, those of the largest bound first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.tables import materialise


def quantised(df: DataFrame, column: str = "embedding", scale: int = 1024) -> DataFrame:
    """Rows with whole, finite, non-empty vectors, as `v`: floor(scale * x) of each component as double."""
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(False)))
    return rows.withColumn("v", F.transform(F.col(column), lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


class Tree:
    """A KD-tree: median splits along the widest side, with the tight box of each node. keys (names, then ties) order equal scores."""

    def __init__(self, keys: list[tuple[int, ...]], points: np.ndarray, exact: bool, leaf: int = 64):
        self.lows, self.highs, self.kids, self.spans = [], [], [], []
        order = np.arange(len(keys))
        todo = [(0, len(keys), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = points[order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            me = len(self.spans)
            self.lows.append(low)
            self.highs.append(high)
            self.kids.append([-1, -1])
            self.spans.append((a, b))
            if parent >= 0:
                self.kids[parent][side] = me
            wide = int(np.argmax(high - low))
            if b - a > leaf and high[wide] > low[wide]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide], mid)]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.keys = [keys[i] for i in order.tolist()]
        self.points = numbers(points[order], exact)
        self.lows, self.highs = numbers(np.array(self.lows), exact), numbers(np.array(self.highs), exact)

    def best(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, least) -> list[tuple]:
        """Up to k (score, key) of points that reach `least`, but for row `own`; nodes are opened by falling bound, until none can."""
        top: list[tuple] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            floor = top[0][0] if len(top) == k else least
            if floor is not None and -bound < floor:
                break
            left, right = self.kids[node]
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
                continue
            a, b = self.spans[node]
            scores = self.points[a:b] @ query
            for i in np.flatnonzero(scores >= floor) if floor is not None else range(b - a):
                key = self.keys[a + i]
                if -key[-1] == own:
                    continue
                found = (int(scores[i]), key)
                if len(top) < k:
                    heapq.heappush(top, found)
                elif found > top[0]:
                    heapq.heapreplace(top, found)
        return top


def numbers(x: np.ndarray, exact: bool) -> np.ndarray:
    return x.astype(np.float64) if exact else x.astype(np.int64).astype(object)


def fits_double(*arrays: np.ndarray) -> bool:
    """Whether sums of products stay exact in double, below 2^53; other vectors are kept as Python integers."""
    most = [int(np.abs(x.astype(np.float64)).max(initial=0)) for x in arrays]
    return arrays[0].shape[1] * max(most) ** 2 < 2**52


def bounds(queries: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """For each query and box, the largest inner product that a point of the box can have."""
    return np.maximum(queries, 0) @ highs.T + np.minimum(queries, 0) @ lows.T


def matrix(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def split_tree(points: np.ndarray, depth: int, fewest: int = 8) -> list[tuple[int, float, int, int]]:
    """Median splits of sampled points along their widest side: nodes (side, cut, left, right), a leaf as (-1, 0, its number, 0)."""
    nodes: list[tuple[int, float, int, int]] = []
    leaves = 0

    def grow(own: np.ndarray, left: int) -> int:
        nonlocal leaves
        me = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        wide = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
        cut = float(np.median(own[:, wide])) if len(own) else 0.0
        below = own[:, wide] < cut if len(own) else np.zeros(0, bool)
        if not left or len(own) < 2 * fewest or not below.any():
            nodes[me] = (-1, 0.0, leaves, 0)
            leaves += 1
        else:
            nodes[me] = (wide, cut, grow(own[below], left - 1), grow(own[~below], left - 1))
        return me

    grow(points, depth)
    return nodes


def leaf_of(nodes: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    side, cut, left, right = (np.array(x) for x in zip(*nodes))
    at = np.zeros(len(points), np.int64)
    while True:
        open_ = np.flatnonzero(side[at] >= 0)
        if not len(open_):
            return left[at]
        n = at[open_]
        at[open_] = np.where(points[open_, side[n]] < cut[n], left[n], right[n])


SHARD = ("dim", "leaf", "piece")


def sharded(vectors: DataFrame, shard_rows: int, sample: int) -> DataFrame:
    """Rows with their shard: dim (length of v), leaf and piece, as a written table.

    Leaves are regions of space, from median splits of at most `sample` rows, chosen by hash; all rows are placed.
    A leaf with more than `shard_rows` rows, as where one vector is very common, is dealt into pieces.
    """
    rows = vectors.count()
    key = F.xxhash64("row")
    some = vectors.where(F.pmod(key, F.lit(1 << 20)) <= F.lit((1 << 20) * 2 * sample // max(rows, 1))).orderBy(key).select("v").limit(sample).collect()
    by_dim: dict[int, list] = {}
    for r in some:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    # As many leaves of a dim as its share of the rows asks for.
    trees = {d: split_tree(np.array(x, np.float64), max(0, (-(-rows * len(x) // len(some) // shard_rows) - 1).bit_length())) for d, x in by_dim.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(v) for v in batch.column("v").to_pylist()])
            leaf = np.zeros(len(dims), np.int32)
            for d in set(dims.tolist()) & set(trees):
                mine = np.flatnonzero(dims == d)
                leaf[mine] = leaf_of(trees[d], matrix(pa.Table.from_batches([batch]).take(mine), "v").astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(leaf, pa.int32())], [*batch.schema.names, "dim", "leaf"])

    placed = vectors.mapInArrow(place, "row long, vec_id long, v array<bigint>, asked boolean, dim int, leaf int")
    placed = materialise(placed, "placed")
    pieces = placed.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("_pieces"))
    return placed.join(pieces, ["dim", "leaf"]).withColumn("piece", F.pmod(F.xxhash64("row"), F.col("_pieces")).cast("int")).drop("_pieces")


def boxes(shards: DataFrame) -> DataFrame:
    """(dim, leaf, piece, low, high): the tight box of each shard."""

    def box(table: pa.Table) -> pa.Table:
        v = matrix(table, "v")
        one = {k: pa.array([table.column(k)[0].as_py()], pa.int32()) for k in SHARD}
        return pa.table({**one, "low": [v.min(axis=0).tolist()], "high": [v.max(axis=0).tolist()]})

    return shards.select(*SHARD, "v").groupBy(*SHARD).applyInArrow(box, "dim int, leaf int, piece int, low array<bigint>, high array<bigint>")


def reachable(asked: DataFrame, boxed: DataFrame, chunk_rows: int = 2048, block_rows: int = 4096) -> DataFrame:
    """(q, dim, leaf, piece, bound) of queries (q, v, dim, least) and the shards whose box reaches their kth score.

    Blocks of queries meet chunks of boxes, each pair in a task of its own.
    """
    chunks, blocks = max(1, -(-boxed.count() // chunk_rows)), max(1, -(-asked.count() // block_rows))
    left = asked.withColumn("_b", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = boxed.withColumn("_c", F.pmod(F.xxhash64("leaf", "piece"), F.lit(chunks)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    out = pa.schema([("q", pa.int64()), ("dim", pa.int32()), ("leaf", pa.int32()), ("piece", pa.int32()), ("bound", pa.float64())])

    def reach(queries: pa.Table, some: pa.Table) -> pa.Table:
        if not queries.num_rows or not some.num_rows:
            return out.empty_table()
        v, low, high = matrix(queries, "v"), matrix(some, "low"), matrix(some, "high")
        exact = fits_double(v, low, high)
        found = bounds(numbers(v, exact), numbers(low, exact), numbers(high, exact)).astype(np.float64)
        if not exact:  # rounded to double: a little more lets no shard be missed
            found += np.abs(found) * 1e-12
        least = np.array([-np.inf if x is None else float(x) for x in queries.column("least").to_pylist()])
        i, j = np.nonzero(found >= (least - np.where(np.isfinite(least), np.abs(least) * 1e-12, 0))[:, None])
        names = [queries.column("q").take(i), *[some.column(k).take(j) for k in SHARD], pa.array(found[i, j])]
        return pa.table(names, schema=out)

    return left.groupBy("dim", "_c", "_b").cogroup(right.groupBy("dim", "_c", "_b")).applyInArrow(reach, "q long, dim int, leaf int, piece int, bound double")


def searched(asked: DataFrame, shards: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(q, row, vec_id, score): for each (q, v, least) sent to a shard, its k best there that reach `least`.

    A shard's rows go to as many tasks as it has blocks of `block_rows` queries.
    """
    need = asked.groupBy(*SHARD).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks"))
    left = asked.join(need, list(SHARD)).withColumn("block", F.pmod(F.xxhash64("q"), F.col("_blocks")).cast("int")).select("q", "v", "least", *SHARD, "block")
    right = shards.join(need, list(SHARD)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("row", "vec_id", "v", *SHARD, "block")
    out = pa.schema([("q", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(queries: pa.Table, points: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if queries.num_rows and points.num_rows:
            v, raw = matrix(points, "v"), matrix(queries, "v")
            exact = fits_double(v, raw)
            # Of equal scores, smaller ids are better, rows without one last.
            keys = [(i is not None, -(i or 0), -row) for i, row in zip(points.column("vec_id").to_pylist(), points.column("row").to_pylist())]
            tree = Tree(keys, v, exact)
            q, least = queries.column("q").to_pylist(), queries.column("least").to_pylist()
            for a in range(0, len(q), 256):
                some = numbers(raw[a : a + 256], exact)
                for i, reach in enumerate(bounds(some, tree.lows, tree.highs)):
                    found += [(q[a + i], -key[2], -key[1] if key[0] else None, score) for score, key in tree.best(some[i], reach, q[a + i], k, least[a + i])]
        columns = list(zip(*found)) or [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=out)

    keys = (*SHARD, "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "q long, row long, vec_id long, score long")


def top_k(vectors: DataFrame, asked: Column, k: int = 10, shard_rows: int = 4096, block_rows: int = 4096, nearest: int = 2, sample: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row that `asked` marks with all rows but itself.

    vectors have vec_id and v, a whole vector of integers; ties go to the smaller vec_id. Rows lie in shards by
    region (sharded). A query first searches the shard that it lies in, then the `nearest` shards of largest bound,
    then all others whose box still reaches its kth score: that score goes with the query each time. Every shard that
    is left out can hold no row of the result. Vectors of another length than the query's take no part. Rows of one
    vec_id are rows like others: each is a candidate of the others, and each that is asked gets its own ranks. A null
    vec_id is a candidate, after all ids, and asks nothing. Empty tables give an empty result.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = materialise(rows, "vectors")
    shards = materialise(sharded(rows, shard_rows, sample), "shards")
    queries = materialise(shards.where("asked").select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), "v", *SHARD), "queries")
    none = F.lit(None).cast("long").alias("least")
    home = materialise(searched(queries.select("q", "v", none, *SHARD), shards, k, block_rows), "home")

    def kth(found: DataFrame) -> DataFrame:
        scores = F.sort_array(F.collect_list("score"), asc=False)
        return found.groupBy("q").agg(F.get(scores, F.lit(k - 1)).alias("least"))

    reach = reachable(queries.select("q", "v", "dim").join(kth(home), "q", "left"), boxes(shards), block_rows=block_rows)
    own = queries.select("q", *SHARD)
    order = Window.partitionBy("q").orderBy(F.col("bound").desc(), "leaf", "piece")
    reach = materialise(reach.join(own, ["q", *SHARD], "left_anti").withColumn("_r", F.row_number().over(order)), "reach")
    sent = lambda some, found: some.join(queries.select("q", "v"), "q").join(kth(found), "q", "left").where("least IS NULL OR bound >= least - abs(least) * 1e-12").select("q", "v", "least", *SHARD)
    some = home.union(materialise(searched(sent(reach.where(F.col("_r") <= nearest), home), shards, k, block_rows), "near"))
    rest = searched(sent(reach.where(F.col("_r") > nearest), some), shards, k, block_rows)
    rank = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    best = some.union(rest).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return best.join(queries.select("q", "query_id"), "q").select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the rows whose vec_id is divisible by 100, against all rows."""
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(rows, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), best AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM best WHERE rank <= 10
"""
