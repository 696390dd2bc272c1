"""Spatial clusters and joins: grid cells as join keys, exact distances after."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom import policy as P
from signalloom.functions import cases, geo
from signalloom.operators.graph import components
from signalloom.operators.score import centroids
from signalloom.tables import materialise

#: Degrees of latitude of a metre, at the equator where they are most, a little over.
_DEGREE = 1.0 / 110500.0


def projected(df: DataFrame) -> DataFrame:
    east, north = geo.utm("lat", "lon")
    return df.withColumn("x", F.expr(east)).withColumn("y", F.expr(north))


#: Boxes a side of a cell of clusters().
_BOXES = 8


def _box_pairs(left: DataFrame, right: DataFrame, on, metres: float) -> DataFrame:
    """(a, b, sure) of pairs of boxes that can hold points at most `metres` apart; sure where all their points are."""
    l, r = left.alias("l"), right.alias("r")
    square = lambda x, y: F.pow(x, F.lit(2)) + F.pow(y, F.lit(2))
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"l.{c}1") - F.col(f"r.{c}2"), F.col(f"r.{c}1") - F.col(f"l.{c}2"))
    span = lambda c: F.greatest(F.col(f"l.{c}2") - F.col(f"r.{c}1"), F.col(f"r.{c}2") - F.col(f"l.{c}1"))
    return l.join(r, on).where(square(gap("x"), gap("y")) <= metres * metres).withColumn("sure", square(span("x"), span("y")) <= metres * metres)


def _compared(near: DataFrame, places: DataFrame, metres: float) -> DataFrame:
    """(a, b) of pairs of boxes with two places at most `metres` apart."""
    others = places.select("family", F.col("sx").alias("sx2"), F.col("sy").alias("sy2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = near.join(places, ["family", "sx", "sy"]).join(others, ["family", "sx2", "sy2"])
    return pairs.where(F.pow(F.col("x") - F.col("x2"), F.lit(2)) + F.pow(F.col("y") - F.col("y2"), F.lit(2)) <= metres * metres).select("a", "b")


#: Pairs of boxes with more pairs of places than _FEW are split; what _DEEPEST splits leave is compared as it is.
_FEW, _DEEPEST = 1 << 16, 40


def split_boxes(near: DataFrame, points: DataFrame, side: float, metres: float) -> tuple[list[DataFrame], list[tuple[DataFrame, DataFrame]]]:
    """Pairs of boxes that their bounds leave open, split in four by four until bounds tell or few places are left.

    near: a, b, family, sx, sy, n, sx2, sy2, n2 with numbers of places, which may be too high at first. Gives tables of
    (a, b) that are tied, and pairs to compare, each with the places of its boxes. Two spots at the radius' distance
    leave only boxes open that face each other, so the pairs of places do not grow with the product of the spots.
    """
    tied, left, level = [], [], 0
    many = F.col("n") * F.col("n2") > _FEW
    places = points.select("family", "sx", "sy", "x", "y")
    left.append((near.where(~many), places.distinct()))
    near = near.where(many)
    keys = [F.col(c) for c in ("family", "sx", "sy")]
    while not near.isEmpty():
        level += 1
        used = near.select(*keys).union(near.select("family", "sx2", "sy2")).distinct()
        index = lambda c: F.floor(F.col(c) / (side / 2**level))
        places = places.join(used, ["family", "sx", "sy"], "left_semi").select("family", index("x").alias("sx"), index("y").alias("sy"), "x", "y")
        places = materialise(places.distinct() if level == 1 else places, "places")
        bounds = [f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in ((1, F.min), (2, F.max))]
        inner = places.groupBy("family", "sx", "sy").agg(F.count(F.lit(1)).alias("n"), *bounds)
        inner = inner.withColumns({"px": F.floor(F.col("sx") / 2), "py": F.floor(F.col("sy") / 2)})
        outer = near.select("a", "b", "family", F.col("sx").alias("px"), F.col("sy").alias("py"), "sx2", "sy2")
        same = (F.col("l.family") == F.col("r.family")) & (F.col("l.sx2") == F.col("r.px")) & (F.col("l.sy2") == F.col("r.py"))
        met = _box_pairs(outer.join(inner, ["family", "px", "py"]), inner, same, metres)
        met = met.select("l.a", "l.b", "l.family", "l.sx", "l.sy", "l.n", F.col("r.sx").alias("sx2"), F.col("r.sy").alias("sy2"), F.col("r.n").alias("n2"), "sure")
        met = materialise(met, "split")
        tied.append(met.where("sure").select("a", "b").distinct())
        near = met.where("NOT sure").drop("sure").join(tied[-1], ["a", "b"], "left_anti")
        if level == _DEEPEST:
            left.append((near, places))
            break
        left.append((near.where(~many), places))
        near = near.where(many)
    return tied, left


def _tied_cells(points: DataFrame, boxes: DataFrame, side: float, metres: float) -> DataFrame:
    """(node, component) of the heads of cells tied by points at most `metres` apart.

    Cells of metres / sqrt(2) a side meet those up to two away, box by box: by the tight bounds of two boxes all their
    points are near, or none, or it takes the points to tell. Points are compared only for cells that no boxes tie, in
    boxes that could, split until few are left in them. A box meets a number of boxes that does not grow with the data.
    """
    half = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)]
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in half]))
    moved = boxes.withColumn("_s", shift).withColumns({"cx": F.col("cx") + F.col("_s.i"), "cy": F.col("cy") + F.col("_s.j")}).drop("_s")
    same_cell = (F.col("l.family") == F.col("r.family")) & (F.col("l.cx") == F.col("r.cx")) & (F.col("l.cy") == F.col("r.cy"))
    met = _box_pairs(moved, boxes, same_cell, metres).groupBy(F.col("l.head").alias("a"), F.col("r.head").alias("b")).agg(F.max("sure").alias("sure"))
    met = materialise(met, "met")
    tied, unsure = met.where("sure").select("a", "b"), met.where("NOT sure").select("a", "b")
    if unsure.isEmpty():
        return components(tied, stored=True)
    first = unsure.join(boxes, F.col("a") == F.col("head"))
    near = _box_pairs(first, boxes, F.col("l.b") == F.col("r.head"), metres)
    near = near.select("l.a", "l.b", "l.family", "l.sx", "l.sy", "l.n", F.col("r.sx").alias("sx2"), F.col("r.sy").alias("sy2"), F.col("r.n").alias("n2"))
    sure, left = split_boxes(materialise(near, "near"), points, side, metres)
    for more in [*sure, *[_compared(pairs, places, metres) for pairs, places in left]]:
        tied = tied.unionByName(more)
    return components(tied)


def clusters(signals: DataFrame, metres: float = 1500.0) -> DataFrame:
    """(id, family, cluster_id): density clusters with one point enough, in each family: components of points at most `metres` apart.

    cluster_id is the least id of the cluster; a point without a place is its own.
    """
    points = projected(signals.withColumn("family", F.expr(cases.family("type")))).select("id", "family", "x", "y")
    return point_clusters(points, metres)


def point_clusters(points: DataFrame, metres: float) -> DataFrame:
    """clusters() of points (id, family, x, y) on a plane in metres.

    The points of one cell of metres / sqrt(2) a side are near each other whatever their number, so the graph has a
    node a cell, its least id, and a hot spot makes no pairs.
    """
    side = metres / math.sqrt(2) * (1 - 1e-9) / _BOXES
    placed = (F.abs("x") < 1e15) & (F.abs("y") < 1e15)
    index = lambda c: F.when(placed, F.floor(F.col(c) / side))
    points = materialise(points.withColumns({"sx": index("x"), "sy": index("y")}), "points")
    known = points.where("family IS NOT NULL AND sx IS NOT NULL AND sy IS NOT NULL")
    cell = {"cx": F.floor(F.col("sx") / _BOXES), "cy": F.floor(F.col("sy") / _BOXES)}
    bounds = [f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in ((1, F.min), (2, F.max))]
    boxes = known.groupBy("family", "sx", "sy").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n"), *bounds)
    own = Window.partitionBy("family", "cx", "cy")  # at most _BOXES * _BOXES rows
    boxes = materialise(boxes.withColumns(cell).withColumn("head", F.min("head").over(own)), "boxes")
    joined = _tied_cells(known, boxes, side, metres)
    headed = points.join(boxes.select("family", "sx", "sy", "head"), ["family", "sx", "sy"], "left")
    return headed.join(joined, F.col("head") == F.col("node"), "left").select("id", "family", F.coalesce("component", "head", "id").alias("cluster_id"))


def _cells(df: DataFrame, metres: float) -> DataFrame:
    """Adds the cells of latitude and longitude, at least `metres` a side up to 60 degrees of latitude, as cy and cx."""
    step = metres * _DEGREE
    return df.withColumns({"cy": F.floor(F.col("lat") / step), "cx": F.floor(F.col("lon") / (2 * step))})


def _shifted(df: DataFrame, shifts: list[tuple[int, ...]], cells: list[str]) -> DataFrame:
    """A copy of each row for each shift of its cells; `own` marks the unshifted one."""
    moves = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(cells, s)]) for s in shifts]))
    moved = df.withColumn("_s", moves).withColumns({c: F.col(c) + F.col(f"_s.{c}") for c in cells} | {"own": sum((F.abs(F.col(f"_s.{c}")) for c in cells), F.lit(0)) == 0})
    return moved.drop("_s")


def _close(pairs: DataFrame, metres: float, lat1: str = "lat1", lon1: str = "lon1", lat2: str = "lat2", lon2: str = "lon2") -> DataFrame:
    """Pairs at most `metres` apart, with distance_m; the great circle, good to six thousandths, leaves the far ones out before.

    The distance goes through an array of one, as a filter does not move below explode: in the join's condition the
    formula would stand written out, with each sine many times.
    """
    near = pairs.where(F.expr(geo.haversine(lat1, lon1, lat2, lon2)) <= metres * 1.006)
    away = geo.with_spheroid(near, "_d", lat1, lon1, lat2, lon2).withColumn("distance_m", F.explode(F.array("_d"))).drop("_d")
    return away.where(F.col("distance_m") <= metres)


def reachable(candidates: DataFrame, incidents: DataFrame, metres: float, since) -> DataFrame:
    """(cluster_id, incident_id, distance_m): all open incidents of each cluster's family within `metres`.

    candidates: cluster_id, family, lat, lon; incidents: incident_id, family, status, last_seen_at, lat, lon. The
    incidents, which are fewer, are copied into the cells around.
    """
    opened = incidents.where(F.col("status").isin(*P.OPEN_STATUSES) & (F.col("last_seen_at") >= F.lit(since)) & F.col("lat").isNotNull())
    right = _shifted(_cells(opened.select("incident_id", "family", "lat", "lon"), metres), [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], ["cy", "cx"])
    right = right.withColumnsRenamed({"lat": "lat2", "lon": "lon2"}).drop("own")
    left = _cells(candidates.select("cluster_id", "family", F.col("lat"), F.col("lon")), metres)
    return _close(left.join(right, ["family", "cy", "cx"]), metres, "lat", "lon").select("cluster_id", "incident_id", "distance_m")


def nearest_open(candidates: DataFrame, incidents: DataFrame, metres: float, since) -> DataFrame:
    """(cluster_id, incident_id, distance_m): each cluster's nearest open incident within `metres`; ties go to the smaller incident_id."""
    joined = reachable(candidates, incidents, metres, since)
    return joined.groupBy("cluster_id").agg(F.min(F.struct("distance_m", "incident_id")).alias("_b")).select("cluster_id", "_b.incident_id", "_b.distance_m")


def pairs_within(rows: DataFrame, keys: list[str], metres: float, seconds: int | None = None) -> DataFrame:
    """(a, b, distance_m), a < b: rows (id, lat, lon, keys; t where `seconds` bounds its difference) of equal keys at most `metres` apart.

    Cells of place (and time) are the keys of the join; a row goes to its own cell and to half of those around, so that
    each pair of cells meets once. Both sides are shuffled: Spark's estimate leaves the copies out, and it would gather
    them in the driver for a broadcast.
    """
    rows = _cells(rows, metres)
    cells = ["cy", "cx"]
    if seconds is not None:
        rows, cells = rows.withColumn("ct", F.floor(F.col("t") / seconds)), ["ct", *cells]
    around = [()]
    for _ in cells:
        around = [(*s, i) for s in around for i in (-1, 0, 1)]
    left = _shifted(rows, [s for s in around if s >= (0,) * len(cells)], cells)
    left = left.withColumnsRenamed({"id": "id1", "lat": "lat1", "lon": "lon1", "t": "t1"})
    right = rows.withColumnsRenamed({"id": "id2", "lat": "lat2", "lon": "lon2", "t": "t2"})
    met = left.join(right.hint("merge"), [*keys, *cells]).where(~F.col("own") | (F.col("id1") < F.col("id2")))
    met = met.where(F.abs(F.col("lat1") - F.col("lat2")) <= metres * _DEGREE)
    if seconds is not None:
        met = met.where(F.abs(F.col("t1") - F.col("t2")) <= seconds)
    return _close(met, metres).select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), "distance_m")


def neighbours(signals: DataFrame, metres: float = 2000.0, minutes: float = 60) -> DataFrame:
    """(a, b, distance_m), a < b: signals within `metres` and `minutes` of each other."""
    return pairs_within(signals.where("lat IS NOT NULL").select("id", "lat", "lon", F.unix_timestamp("ts").alias("t")), [], metres, int(minutes * 60))


def merge_pairs(incidents: DataFrame, metres: float, since) -> DataFrame:
    """(a, b), a < b: open incidents of one family seen since, at most `metres` apart."""
    opened = incidents.where(F.col("status").isin(*P.OPEN_STATUSES) & (F.col("last_seen_at") >= F.lit(since)) & F.col("lat").isNotNull())
    return pairs_within(opened.select(F.col("incident_id").alias("id"), "family", "lat", "lon"), ["family"], metres).select("a", "b")


def survivors(pairs: DataFrame) -> DataFrame:
    """(incident_id, kept_id): converging incidents and the least of each group."""
    return components(pairs).select(F.col("node").alias("incident_id"), F.col("component").alias("kept_id"))


def relink(links: DataFrame, kept: DataFrame) -> DataFrame:
    """Links with dropped incidents replaced by survivors; an event linked to both keeps the survivor's link."""
    moved = links.join(kept, "incident_id", "left").withColumn("_own", F.coalesce(F.col("kept_id") == F.col("incident_id"), F.lit(True)))
    moved = moved.withColumn("incident_id", F.coalesce("kept_id", "incident_id"))
    first = Window.partitionBy("incident_id", "event_id").orderBy(F.col("_own").desc(), "distance_m")
    return moved.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_own", "kept_id")


def open_or_defer(members: DataFrame, min_signals: int = 1) -> DataFrame:
    """(cluster_id, signals, opens): a cluster opens an incident with a confirming source or enough signals."""
    sure = F.expr(cases.rule("source", "confirming"))
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("signals"), (F.max(sure) | (F.count(F.lit(1)) >= min_signals)).alias("opens"))


def cluster_centroids(members: DataFrame) -> DataFrame:
    return centroids(members, "cluster_id")
