"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from signalloom.tables import discard, materialise


#: A node of more edges than _HEAVY, and than a _SHARE-th of all edges, is heavy: at most _SHARE nodes of any graph are.
_HEAVY, _SHARE = 20000, 1000


def _with_least(edges: DataFrame, key: str, least: DataFrame, degrees: DataFrame, count: int) -> DataFrame:
    """Edges with m, the least neighbour of the node in `key`, or null where `least` has none.

    Heavy nodes, at most _SHARE of them, bring their m by a broadcast, so that no task gathers their edges; a graph of
    no more than _HEAVY edges has none.
    """
    renamed = least.select(F.col("node").alias(key), "m")
    if count <= _HEAVY:
        return edges.join(renamed, key, "left")
    heavy = degrees.where(F.col("n") > max(_HEAVY, count // _SHARE)).select("node").join(least, "node", "left")
    heavy = heavy.select(F.col("node").alias(key), F.col("m").alias("_m"), F.lit(True).alias("_heavy"))
    marked = edges.join(F.broadcast(heavy), key, "left")
    here = marked.where("_heavy").select("a", "b", F.col("_m").alias("m"))
    return here.unionByName(marked.where("_heavy IS NULL").select("a", "b").join(renamed, key, "left").select("a", "b", "m"))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Links each node's larger neighbours to the least of its neighbourhood; edges have a > b.

    Seen from its smaller end, an edge needs that node's least smaller neighbour only; a node without one is the least itself.
    """
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    degrees = edges.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return _with_least(edges, "b", least, degrees, count).select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """Links each node and its smaller neighbours to the least of these; edges have a > b."""
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    met = _with_least(edges, "a", least.select("node", "m"), least.select("node", "n"), count)
    moved = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, Decimal, Decimal]]:
    """The edges as a table, with their count and two sums of whole 64-bit hashes, taken while they are written."""
    seen = Observation()
    whole = lambda *of: F.coalesce(F.sum(F.xxhash64(*of).cast("decimal(38,0)")), F.lit(0))
    told = edges.observe(seen, F.count(F.lit(1)).alias("n"), whole("a", "b").alias("h"), whole(F.lit(1), "b", "a").alias("h2"))
    table = materialise(told, "edges")
    return table, (seen.get["n"], seen.get["h"], seen.get["h2"])


def components(edges: DataFrame, most: int = 60, stored: bool = False) -> DataFrame:
    """(node, component) of all nodes of (a, b) edges: component is the least node reachable.

    Each round writes the edges anew and compares their count and sums of hashes with the round before; the rounds
    grow with the logarithm of the longest path. Loops and repeated edges do no harm; no edges give no rows. Edges that
    are stored already are not written once more.
    """
    if stored:
        seen = (edges.count(),)
    else:
        edges, seen = _written(edges.select("a", "b").distinct())
    loops = edges.where("a = b").select("a").distinct()
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    for _ in range(most):
        if not seen[0]:
            break
        before, then = now, seen
        now, seen = _written(_small_star(_large_star(now, seen[0]), seen[0]))
        if hasattr(before, "_written"):  # a round's edges are not read once the next ones are written
            discard(before)
        if then == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select("component").distinct().select(F.col("component").alias("node"), "component")
    found = stars.union(roots)
    alone = loops.join(found, F.col("a") == F.col("node"), "left_anti").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return found.union(alone)
