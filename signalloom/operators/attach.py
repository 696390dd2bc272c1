"""Clusters attached to incidents in their order, many at a time.

A cluster joins the nearest open incident, or opens one; what it joins moves, and the next cluster meets it where it
then is. Two clusters can touch the same incident only when their centres are within twice the radius. So a cluster
waits for the earlier ones that near, and for no others: in each round all clusters decide whose earlier neighbours have
decided. The result is that of going through all clusters one by one; the rounds are as many as the longest chain of
neighbours in falling order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.operators import cluster, score
from signalloom.tables import counted, discard, materialise, numbered

#: Distances are good to a few parts in a hundred thousand; waiting for one too many does no harm.
_SLACK = 1.001


@dataclass
class Attached:
    """targets: cluster_id, incident_id, lat2, lon2 (where the incident was), created; of the clusters that were not deferred."""

    targets: DataFrame
    rounds: int
    clusters: int


def cluster_order(members: DataFrame) -> DataFrame:
    """(cluster_id, _c, _t, _i): clusters go by their most confident signal, then the older, then the smaller id."""
    best = members.groupBy("cluster_id").agg(F.min(F.struct(-F.col("confidence").cast("double"), "ts", "id")).alias("_b"))
    return best.select("cluster_id", F.col("_b.col1").alias("_c"), F.col("_b.ts").alias("_t"), F.col("_b.id").alias("_i"))


def _moved(signals: DataFrame) -> DataFrame:
    """Incidents as a cluster meets them: where their signals put them, and whether these leave them open."""
    seen = signals.groupBy("incident_id").agg(F.max("family").alias("family"), F.coalesce(F.max(F.when(F.col("lat").isNotNull(), F.col("ts"))), F.max("ts")).alias("last_seen_at"))
    return seen.join(score.centroids(signals), "incident_id").join(score.incident_statuses(signals).drop("resolved_at"), "incident_id")


def in_order(judged: DataFrame, members: DataFrame, incidents: DataFrame, links: DataFrame, signals: DataFrame, metres: float, since, top: int, most: int = 10_000) -> Attached:
    """judged: cluster_id, family, lat, lon, opens, and the columns of cluster_order; members: the signals of clusters, with family.

    Incidents are taken to stand at the centre of their linked signals, as refreshing leaves them. New ones get numbers
    after `top` in the order of their clusters.
    """
    state = incidents.select("incident_id", "family", "status", "last_seen_at", "lat", "lon")
    rows, told = counted(numbered(judged, ["_c", "_t", "_i"], "number"), "clusters", n=F.count(F.lit(1)))
    near = cluster.pairs_within(rows.select(F.col("number").alias("id"), "family", "lat", "lon"), ["family"], 2 * metres * _SLACK)
    waits, pairs = counted(near.select("a", "b"), "waits", n=F.count(F.lit(1)))
    tied, left = pairs["n"] > 0, told["n"]
    history = _history(rows, waits, state, links, signals, metres, since) if tied else None
    done: list[DataFrame] = []
    waiting, rounds = rows, 0
    while left:
        if rounds == most:
            raise RuntimeError(f"clusters wait for one another in chains of more than {most}")
        rounds += 1
        ready = waiting.join(waits.select(F.col("b").alias("number")).distinct(), "number", "left_anti") if tied else waiting
        nearest = cluster.nearest_open(ready.select("cluster_id", "family", "lat", "lon"), state, metres, since).select("cluster_id", "incident_id")
        nearest = nearest.join(state.select("incident_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "incident_id")
        met = ready.join(nearest, "cluster_id", "left")
        created = F.col("incident_id").isNull() & F.col("opens")
        decided = met.select("cluster_id", "number", F.when(created, F.col("number") + top).otherwise(F.col("incident_id")).alias("incident_id"), F.coalesce("_lat", "lat").alias("lat2"), F.coalesce("_lon", "lon").alias("lon2"), created.alias("created"))
        decided, told = counted(decided, "decided", n=F.count(F.lit(1)))
        done.append(decided)
        left -= told["n"]
        if not left:
            break
        # What these clusters moved or opened matters where others still wait for them.
        finished = decided.select(F.col("number").alias("a"))
        eager = waits.join(finished, "a", "left_semi").select(F.col("a").alias("number")).distinct()
        joined = decided.where("incident_id IS NOT NULL").join(eager, "number", "left_semi").select("cluster_id", "incident_id")
        history, then = materialise(history.unionByName(members.join(joined, "cluster_id").select(*_OWN)), "history"), history
        touched = joined.select("incident_id").distinct()
        moved = _moved(history.join(touched, "incident_id", "left_semi"))
        state, before = materialise(state.join(touched, "incident_id", "left_anti").unionByName(moved.select(*state.columns)), "state"), state
        waits, freed = materialise(waits.join(finished, "a", "left_anti").select("a", "b"), "waits"), waits
        waiting = rows.join(_all(done).select("number"), "number", "left_anti")
        for table in (then, before, freed):
            if hasattr(table, "_written"):
                discard(table)
    if not done:
        return Attached(judged.sparkSession.createDataFrame([], "cluster_id long, incident_id long, lat2 double, lon2 double, created boolean"), 0, 0)
    everything = _all(done)
    opened = numbered(everything.where("created").select("number"), ["number"], "_n").select((F.col("number") + top).alias("incident_id"), (F.col("_n") + top).alias("_new"))
    final = everything.where("incident_id IS NOT NULL").join(opened, "incident_id", "left")
    final = final.select("cluster_id", F.coalesce("_new", "incident_id").cast("long").alias("incident_id"), "lat2", "lon2", "created")
    return Attached(materialise(final, "targets"), rounds, rows.count())


_OWN = ["incident_id", "family", "id", "ts", "source", "lat", "lon", "confidence", "state"]


def _history(rows: DataFrame, waits: DataFrame, state: DataFrame, links: DataFrame, signals: DataFrame, metres: float, since) -> DataFrame:
    """Signals of the incidents that clusters with neighbours can reach: only these can move under another cluster's eyes."""
    tangled = rows.join(waits.select(F.explode(F.array("a", "b")).alias("number")).distinct(), "number", "left_semi")
    reached = cluster.reachable(tangled.select("cluster_id", "family", "lat", "lon"), state, metres * _SLACK, since).select("incident_id").distinct()
    known = links.where("link_method = 'spatial'").select("incident_id", F.col("event_id").alias("id"))
    held = known.join(reached, "incident_id", "left_semi").join(state.select("incident_id", "family"), "incident_id")
    return materialise(held.join(signals.select("id", "ts", "source", "lat", "lon", "confidence", "state"), "id").select(*_OWN), "history")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
