import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalloom import policy as P
from signalloom.functions import cases
from signalloom.operators import attach, cluster
from signalloom.plans import passes

T = datetime(2024, 1, 30)
FIELDS = "id long, ts timestamp, source string, type string, lat double, lon double, confidence float, text string, commune string, province string, state string, incident_id long, updated_at timestamp, clients long, external_id string"
R = 1500.0


def row(id, lat, lon, source="waze", confidence=0.5, type="smoke", ts=T, incident=None, state=None):
    return (id, ts, source, type, lat, lon, confidence, None, None, None, state, incident, ts, None, f"e{id}")


def metres(p, q):
    """Length of the geodesic on WGS84, by iteration."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    (la, lo), (lb, ob) = p, q
    if p == q:
        return 0.0
    u, v, far = math.atan((1 - f) * math.tan(math.radians(la))), math.atan((1 - f) * math.tan(math.radians(lb))), math.radians(ob - lo)
    lam = far
    for _ in range(50):
        ss = math.hypot(math.cos(v) * math.sin(lam), math.cos(u) * math.sin(v) - math.sin(u) * math.cos(v) * math.cos(lam))
        cs = math.sin(u) * math.sin(v) + math.cos(u) * math.cos(v) * math.cos(lam)
        arc, sa = math.atan2(ss, cs), math.cos(u) * math.cos(v) * math.sin(lam) / ss
        ca2 = 1 - sa * sa
        cm = cs - 2 * math.sin(u) * math.sin(v) / ca2 if ca2 else 0.0
        c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
        lam = far + (1 - c) * f * sa * (arc + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
    w = ca2 * (a * a - b * b) / (b * b)
    big, small = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))), w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
    less = small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    return b * big * (arc - less)


def centre(rows):
    w = [max(r[6], 0.01) for r in rows]
    return tuple(sum(x * r[k] for x, r in zip(w, rows)) / sum(w) for k in (4, 5))


def closed(rows):
    """Whether the last word of a confirming source ends an incident."""
    said = sorted((r[1], -r[6], r[0], r[10]) for r in rows if r[2] == "conaf" and r[10])
    return bool(said) and said[-1][3] == "Extinguido"


def one_by_one(clusters, incidents, top, least=1):
    """{cluster: incident} by going through the clusters in order; incidents: {id: rows}."""
    incidents, out = {i: list(rows) for i, rows in incidents.items()}, {}
    for name, rows in sorted(clusters.items(), key=lambda x: min((-r[6], r[1], r[0]) for r in x[1])):
        near = sorted((metres(centre(rows), centre(held)), i) for i, held in incidents.items() if not closed(held))
        if near and near[0][0] <= R:
            into = near[0][1]
        elif len(rows) >= least or any(r[2] == "conaf" for r in rows):
            top += 1
            into = top
        else:
            continue
        incidents.setdefault(into, []).extend(rows)
        out[name] = into
    return out


def in_spark(spark, clusters, incidents, top, least=1):
    held = [(*r[:11], i, *r[12:]) for i, rows in incidents.items() for r in rows]
    said = [r for rows in clusters.values() for r in rows]
    names = spark.createDataFrame([(r[0], c) for c, rows in clusters.items() for r in rows], "id long, cluster_id long")
    signals = spark.createDataFrame(held + said, FIELDS)
    members = signals.join(names, "id").withColumn("family", F.expr(cases.family("type"))).drop("incident_id")
    state = spark.createDataFrame([(i, "fire", "extinguished" if closed(rows) else "active", max(r[1] for r in rows), *centre(rows)) for i, rows in incidents.items()], "incident_id long, family string, status string, last_seen_at timestamp, lat double, lon double")
    links = spark.createDataFrame([(i, r[0], "spatial") for i, rows in incidents.items() for r in rows], "incident_id long, event_id long, link_method string")
    places = cluster.cluster_centroids(members).join(members.select("cluster_id", "family").distinct(), "cluster_id")
    judged = cluster.open_or_defer(members, least).join(places, "cluster_id").join(attach.cluster_order(members), "cluster_id")
    done = attach.in_order(judged, members, state, links, signals, R, F.lit(T - timedelta(days=2)), top)
    return {r["cluster_id"]: r["incident_id"] for r in done.targets.collect()}, done.rounds


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_going_one_by_one(spark, seed):
    """Clusters and incidents so dense that what one moves or ends decides where others go."""
    rng = random.Random(seed)
    place = lambda: (-33 + rng.random() * 0.1, -71.5 + rng.random() * 0.13)
    n, clusters, incidents = 0, {}, {}
    for i in range(1, 16):
        la, lo = place()
        incidents[i] = []
        for _ in range(rng.randrange(1, 4)):
            n += 1
            incidents[i].append(row(n, la + rng.random() * 0.002, lo, confidence=rng.choice([0.3, 0.5]), ts=T - timedelta(hours=rng.random() * 5)))
    for c in range(100, 150):
        la, lo = place()
        clusters[c] = []
        for _ in range(rng.randrange(1, 4)):
            n += 1
            source = rng.choice(["waze", "waze", "conaf"])
            clusters[c].append(row(n, la + rng.random() * 0.003, lo, source, rng.choice([0.25, 0.5, 0.75, 1.0]), ts=T - timedelta(minutes=rng.randrange(90)), state="Extinguido" if source == "conaf" and rng.random() < 0.4 else None))
    got, rounds = in_spark(spark, clusters, incidents, 15, 2)
    assert got == one_by_one(clusters, incidents, 15, 2)
    assert 2 <= rounds <= 30


def test_a_chain_is_walked_and_far_clusters_are_not(spark):
    # Each cluster is 1.2 km from the next and less credible: it joins what the one before has opened or moved.
    step = 1200 / 111195
    clusters = {i: [row(i, -33 + i * step, -71.5, confidence=0.9 - i / 100)] for i in range(6)}
    clusters |= {100 + i: [row(100 + i, -35.0 - i, -71.5)] for i in range(20)}
    got, rounds = in_spark(spark, clusters, {}, 0)
    assert got == one_by_one(clusters, {}, 0) and rounds == 6
    assert in_spark(spark, {1: [row(1, -33.0, -71.5)]}, {7: [row(2, -40.0, -71.5)]}, 7) == ({1: 8}, 1)


def test_a_later_cluster_joins_what_the_same_pass_opened(spark):
    """Two clusters apart by more than the radius between signals, but not between centres and incident: one incident."""
    rows = [row(1, -33.0, -71.5, "conaf", 1.0, "wildfire"), row(2, -33.0, -71.5 + 1450 / 93300, confidence=0.9), row(3, -33.0, -71.5 + 2900 / 93300, confidence=0.2)]
    got = passes.first_pass(spark, spark.createDataFrame(rows, FIELDS), "2024-01-30 01:00:00", P.Policy(window_h=48, match_window_h=48))
    assert got.metrics["clusters"] == 1
    rows = [row(1, -33.0, -71.5, confidence=0.9), row(2, -33.0, -71.5 + 2000 / 93300, confidence=0.8), row(3, -33.0, -71.5 + 3000 / 93300, confidence=0.8)]
    got = passes.first_pass(spark, spark.createDataFrame(rows, FIELDS), "2024-01-30 01:00:00", P.Policy(window_h=48, match_window_h=48))
    assert got.metrics["clusters"] == 2 == got.metrics["incidents_created"] and got.metrics["incidents_merged"] == 0


def test_empty(spark):
    empty = spark.createDataFrame([], FIELDS)
    got = passes.first_pass(spark, empty, "2024-01-30 01:00:00")
    assert got.incidents.collect() == [] and got.metrics["clusters"] == got.metrics["rounds"] == 0 and got.warnings == ["no free signals with a place"]
