import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalloom import policy as P
from signalloom.functions import geo
from signalloom.operators import alerts, cluster, graph, lifecycle, score, store
from signalloom.operators.versions import SIGNALS, Versions
from signalloom.plans import catalog, passes
from signalloom.streaming import ingest
from signalloom.tables import numbered

T = datetime(2024, 1, 30)
FIELDS = "id long, ts timestamp, source string, type string, lat double, lon double, confidence float, text string, commune string, province string, state string, incident_id long, updated_at timestamp, clients long, external_id string"


def signal(id, source, confidence=0.5, type="smoke", ts=T, lat=-33.0, lon=-71.5, **more):
    row = {"id": id, "ts": ts, "source": source, "type": type, "lat": lat, "lon": lon, "confidence": confidence, "updated_at": ts, **more}
    return tuple(row.get(f.split()[0]) for f in FIELDS.split(", "))


@pytest.mark.parametrize(
    "said, confidence, official",
    [
        ([("nasa_firms", 0.4)], 0.40, False), ([("nasa_firms", 0.4)] * 2, 0.54, False), ([("nasa_firms", 0.4)] * 20, 0.55, False),
        ([("citizen", 0.4)] * 2, 0.58, False), ([("citizen", 0.4)] * 3, 0.661, False), ([("citizen", 0.4)] * 10, 0.727, False), ([("citizen", 0.25)], 0.25, False),
        ([("nasa_firms", 0.4), ("citizen", 0.25)], 0.65, False), ([("nasa_firms", 0.4), ("citizen", 0.4)], 0.80, False),
        ([("waze", 0.4)] * 3, 0.624, False), ([("transporte_informa", 0.8), ("waze", 0.4)], 0.95, False), ([("waze", 0.4), ("conaf", 1.0)], 1.0, True), ([("usgs", 1.0)], 0.0, False),
    ],
)
def test_scores(spark, said, confidence, official):
    df = spark.createDataFrame([signal(i, s, c, incident_id=1) for i, (s, c) in enumerate(said)], FIELDS)
    r = score.score(df).first()
    assert (r["confidence"], r["is_official_confirmed"], r["event_count"]) == (pytest.approx(confidence, abs=1e-4), official, len(said))


def test_dispatches_and_many_signals(spark):
    rows = [signal(i, "broadcastify", 0.65, "dispatch", incident_id=1) for i in range(2)] + [signal(100 + i, "social_media", 0.35, incident_id=2) for i in range(3000)]
    got = {r["incident_id"]: r for r in score.score(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got[1]["confidence"] == 0.90 and got[2]["confidence"] == 0.55 and got[2]["event_count"] == 3000


def test_last_word_of_a_confirming_source(spark):
    rows = [signal(1, "conaf", 1.0, state="En combate", incident_id=1), signal(2, "conaf", 1.0, ts=T + timedelta(hours=1), state="Extinguido", incident_id=1), signal(3, "citizen", ts=T + timedelta(hours=2), state="Activo", incident_id=1), signal(4, "conaf", 1.0, incident_id=2)]
    got = {r["incident_id"]: (r["status"], r["resolved_at"]) for r in score.incident_statuses(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == {1: ("extinguished", T + timedelta(hours=1)), 2: ("active", None)}


def test_distances_and_shapes(spark):
    one = lambda e: spark.sql(f"SELECT {e}").first()[0]
    assert one(geo.haversine("0e0", "0e0", "1e0", "0e0")) == pytest.approx(111195.08, abs=0.01)
    assert one(geo.haversine("-33.0245e0", "-71.5518e0", "-33.0367e0", "-71.6297e0")) == pytest.approx(7387.74, abs=0.01)
    for m, depth, reach in ((5.4, 42.5, 267.877), (3.1, 98.2, None), (5.8, 42.3, 400), (4.0, "NULL", 51.997)):
        got = one(geo.perception_radius(f"{m}e0", f"{depth}" if depth == "NULL" else f"{depth}e0"))
        assert got is None if reach is None else got == pytest.approx(reach, abs=0.001)
    for v, long, half in ((5, 0.8, 42.5), (10, 1, 40), (40, 4, 25), (60, 6, 15), (300, 25, 12)):
        cone = geo.wind_cone(f"{v}e0", "90e0")
        assert (one(cone["length_km"]), one(cone["half_angle"]), one(cone["bearing"])) == (pytest.approx(long), half, 270)


def _brute_clusters(df, metres):
    at = {r["id"]: (r["type"], r["x"], r["y"]) for r in cluster.projected(df).collect()}
    up = {i: i for i in at}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(at)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if at[i][0] == at[j][0] and math.dist(at[i][1:], at[j][1:]) <= metres:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


def test_clusters_match_brute_force(spark):
    rng = random.Random(5)
    rows = [signal(i, "citizen", type=rng.choice(["smoke", "accident"]), lat=-33 + rng.random() * 0.2, lon=-71.5 + rng.random() * 0.2) for i in range(250)]
    rows += [signal(1000 + i, "citizen", lat=-33.05, lon=-71.45) for i in range(50)]
    df = spark.createDataFrame(rows, FIELDS)
    assert {r["id"]: r["cluster_id"] for r in cluster.clusters(df).collect()} == _brute_clusters(df, 1500)
    assert cluster.clusters(df.limit(0)).collect() == []
    nowhere = spark.createDataFrame([signal(i, "citizen", lat=None, lon=None) for i in (7, 8)], FIELDS)
    assert {r["id"]: r["cluster_id"] for r in cluster.clusters(nowhere).collect()} == {7: 7, 8: 8}


@pytest.mark.parametrize(("metres", "few", "deepest"), [(1000, 1 << 16, 40), (1100, 1 << 16, 40), (1000, 3, 40), (1100, 0, 40), (1000, 0, 2)])
def test_dense_spots_are_told_apart_by_their_points(spark, monkeypatch, metres, few, deepest):
    """Spots of a few hundred metres, about a kilometre apart: boxes alone decide neither all of them nor none."""
    monkeypatch.setattr(cluster, "_FEW", few)
    monkeypatch.setattr(cluster, "_DEEPEST", deepest)
    rng = random.Random(metres)
    rows, n = [], 0
    for spot in range(12):
        for _ in range(25):
            n += 1
            rows.append(signal(n * 7 % 311, "citizen", type="smoke", lat=-33 + (spot % 4) * 0.0116 + rng.random() * 0.0022, lon=-71.5 + (spot // 4) * 0.0131 + rng.random() * 0.0022))
    df = spark.createDataFrame(rows, FIELDS)
    assert {r["id"]: r["cluster_id"] for r in cluster.clusters(df, metres).collect()} == _brute_clusters(df, metres)


@pytest.mark.parametrize(("gap", "together"), [(1500.01, False), (1499.99, True)])
def test_two_crowded_spots_at_the_radius(spark, monkeypatch, gap, together):
    """10^5 places each in two discs whose rims are the radius apart along the diagonal: bounds tell but for those that face each other."""
    compared = []

    def counted(near, points, side, metres):
        tied, left = split(near, points, side, metres)
        compared.extend(pairs.agg(F.sum(F.col("n") * F.col("n2"))).first()[0] or 0 for pairs, _ in left)
        return tied, left

    split = cluster.split_boxes
    monkeypatch.setattr(cluster, "split_boxes", counted)
    n, r = 100_000, 40.0
    far = (gap + 2 * r) / math.sqrt(2)
    spot = F.col("id") % 2
    around, out = 2 * math.pi * F.rand(1), r * F.sqrt(F.rand(2))
    rim = F.col("id") < 2  # the two points that face each other
    x = F.when(rim, r / math.sqrt(2) * (1 - 2 * spot)).otherwise(out * F.cos(around)) + spot * far + 60
    y = F.when(rim, r / math.sqrt(2) * (1 - 2 * spot)).otherwise(out * F.sin(around)) + spot * far + 60
    copies = spark.range(2 * n).union(spark.range(2, 1000)).select("id", F.lit("f").alias("family"), x.alias("x"), y.alias("y"))
    found = {tuple(p) for p in cluster.point_clusters(copies, 1500.0).select(F.col("id") % 2, "cluster_id").distinct().collect()}
    assert found == ({(0, 0), (1, 0)} if together else {(0, 0), (1, 1)})
    assert sum(compared) <= n * 100  # of n * n pairs of places


def test_components_of_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(graph, "_HEAVY", 1000)
    hub = [(5, i) for i in range(100, 2100)] + [(i, 9000) for i in range(100, 1700)]
    chain = [(20000 + i, 20001 + i) for i in range(300)]
    loops = [(70000, 70000), (5, 5), (100, 5)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(hub + chain + loops, "a long, b long")).collect()}
    want = {n: 5 for edge in hub for n in edge} | {n: 20000 for edge in chain for n in edge} | {70000: 70000}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert graph.components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == [(3, 3)]


def test_every_recent_signal_gets_its_nearest_incident(spark):
    d = "/root/testdata/sf0.001"
    got = {r["cluster_id"]: (r["incident_id"], r["distance_m"]) for r in catalog.QUERIES["j02_nearest_open"](spark, d).collect()}
    one = lambda r: (math.radians(r["lat"]), math.radians(r["lon"]))
    since = datetime(2024, 1, 20)
    opened = [r for r in catalog.incidents(spark, d).collect() if r["status"] in P.OPEN_STATUSES and r["last_seen_at"] >= since and r["lat"] is not None]
    checked = 0
    for r in catalog.recent(spark, d).withColumn("family", F.expr(catalog.cases.family("type"))).collect():
        (la, lo), best = one(r), []
        for i in opened:
            if i["family"] == r["family"]:
                lb, ob = one(i)
                h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
                best.append((2 * 6371008.8 * math.asin(math.sqrt(h)), i["incident_id"]))
        best.sort()
        if r["id"] in got:  # the sphere is good to half a percent of the spheroid
            assert got[r["id"]][1] == pytest.approx(best[0][0], rel=6e-3) and got[r["id"]][0] in {i for m, i in best if m <= best[0][0] * 1.012}
            checked += 1
        else:
            assert not best or best[0][0] > 15000 * 0.994
    assert checked == len(got) > 50


def test_alert_matches(spark):
    said = [signal(1, "senapred", type="alert", lat=None, lon=None, text="Alerta Roja por incendio", commune="QUILPUE, Valpo"), signal(2, "senapred", type="alert", lat=None, lon=None, text="Alerta", commune="Viña del Mar Alto"), signal(3, "senapred", type="alert", lat=None, lon=None, text="Alerta en toda la región por fuego", commune="")]
    places = spark.createDataFrame([(10, "Quilpué", "fire"), (11, "Viña del Mar", "traffic"), (12, None, "fire")], "incident_id long, commune string, family string")
    df = spark.createDataFrame(said, FIELDS)
    got = {(r["alert_id"], r["incident_id"]): r["link_confidence"] for r in alerts.match_alerts(df, places).collect()}
    assert got == {(1, 10): 0.70, (2, 11): 0.40}
    assert {(r["alert_id"], r["incident_id"]): r["link_confidence"] for r in alerts.match_alerts(df, places, True).collect()} == {**got, (3, 10): 0.35}


def test_upsert_overwrites_with_nulls_and_is_idempotent(spark):
    stored = spark.createDataFrame([(1, T, "waze", "a", "x"), (2, T, "waze", "b", "y")], "id long, ts timestamp, source string, external_id string, commune string")
    later = T + timedelta(days=1)
    batch = spark.createDataFrame([(later, "waze", "b", None, 5), (later, "waze", "c", "z", 4), (later, "citizen", None, "w", 3)], "ts timestamp, source string, external_id string, commune string, position long")
    once = store.upsert(stored, batch).drop("outcome")
    rows = {r["id"]: (r["ts"], r["external_id"], r["commune"]) for r in once.collect()}
    assert rows == {1: (T, "a", "x"), 2: (T, "b", None), 3: (later, None, "w"), 4: (later, "c", "z")}
    again = store.upsert(once, batch.where("external_id IS NOT NULL"))
    assert {r["id"]: (r["ts"], r["external_id"], r["commune"]) for r in again.collect()} == rows


def test_numbers_are_gapless(spark):
    got = numbered(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")), ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))


def test_expiry(spark):
    rows = [(1, "active", T, T, 0.4, False, ["citizen"]), (2, "active", T, T, 0.58, False, ["citizen"]), (3, "controlled", T, T, 0.4, False, ["waze"]), (4, "active", T, T + timedelta(days=1), 1.0, True, ["conaf"])]
    df = spark.createDataFrame(rows, "incident_id long, status string, first_seen_at timestamp, last_seen_at timestamp, confidence double, is_official_confirmed boolean, sources array<string>")
    got = {r["incident_id"]: r["status"] for r in lifecycle.expire(df, F.lit("2024-01-31 00:10:00").cast("timestamp")).collect()}
    assert got == {1: "dismissed", 2: "stale", 3: "controlled", 4: "active"}


def test_a_second_pass_creates_nothing(spark):
    rows = [signal(1, "conaf", 1.0, "wildfire", commune="Limache"), signal(2, "waze", 0.4, "smoke", lat=-33.005), signal(3, "waze", 0.4, "accident"), signal(4, "senapred", 1.0, "alert", lat=None, lon=None, text="Alerta Roja por incendio", commune="Limache")]
    policy = P.Policy(window_h=48, match_window_h=48, min_signals=1)
    first = passes.first_pass(spark, spark.createDataFrame(rows, FIELDS), "2024-01-30 01:00:00", policy)
    assert first.metrics["incidents_created"] == 2 and first.metrics["spatial_links"] == 3 and first.metrics["alert_links"] == 1
    found = {r["family"]: r for r in first.incidents.collect()}
    assert found["fire"]["alert_level"] == "roja" and found["fire"]["confidence"] == 1.0 and found["traffic"]["alert_level"] is None
    assert lifecycle.violations(first.incidents).collect() == []
    second = passes.correlate(first.signals, first.incidents, first.links, "2024-01-30 01:10:00", policy)
    assert second.metrics["incidents_created"] == 0 and second.incidents.count() == 2


def test_a_pass_takes_all_free_signals(spark):
    rows = [signal(i, "conaf", 1.0, "wildfire", lat=-33.0 + 0.02 * (i % 40), lon=-71.5) for i in range(5100)]
    policy = P.Policy(window_h=48, match_window_h=48)
    df = spark.createDataFrame(rows, FIELDS)
    got = passes.first_pass(spark, df, "2024-01-30 01:00:00", policy)
    assert got.metrics["events_considered"] == 5100 and got.metrics["clusters"] == 40 and got.metrics["incidents_without_commune"] == 40
    assert got.metrics["incidents_created"] == 40 and got.metrics["spatial_links"] == 5100
    assert got.signals.where("incident_id IS NULL").count() == 0
    assert sorted(r["incident_id"] for r in got.incidents.collect()) == list(range(1, 41))


def test_codes_are_numbered_in_ranges(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 1009).alias("incident_id"), F.expr("timestamp_seconds(1706572800 + id % 7)").alias("first_seen_at"))
    got = lifecycle.with_codes(rows, 2024, 41)
    windows = [x for x in got._jdf.queryExecution().toString().splitlines() if "row_number()" in x and "windowspecdefinition" in x]
    assert windows and all("2024" not in x.split("windowspecdefinition")[1].split("incident_id")[0] for x in windows)
    order = sorted(got.collect(), key=lambda r: (r["first_seen_at"], r["incident_id"]))
    assert [r["code"] for r in order] == [f"INC-2024-{i:05d}" for i in range(42, 542)]


def test_rate_limits(spark):
    calls = spark.createDataFrame([("a", 0.0), ("a", 599.0), ("a", 600.0), ("b", 5.0), ("a", 700.5)], "key string, at double")
    got = {(r["key"], r["at"]): (r["allowed"], r["retry_after"]) for r in ingest.limit_batch(calls).collect()}
    assert got == {("a", 0.0): (True, 0), ("a", 599.0): (False, 1), ("a", 600.0): (True, 0), ("b", 5.0): (True, 0), ("a", 700.5): (False, 500)}


def test_streamed_ingest(spark, tmp_path):
    import json

    schema = "ts timestamp, source string, type string, lat double, lon double, text string, external_id string, confidence float, commune string"
    source = tmp_path / "in"
    source.mkdir()
    row = {"ts": "2024-01-30T00:00:00Z", "source": "waze", "type": "accident", "lat": -33.0, "lon": -71.5, "external_id": "waze:1", "commune": "A"}
    paths = [str(tmp_path / x) for x in ("table", "checkpoint")]
    for k, commune in enumerate(("A", "B")):
        (source / f"{k}.json").write_text(json.dumps({**row, "commune": commune}) + "\n" + json.dumps({**row, "source": "nobody"}) + "\n")
        ingest.ingest(spark, str(source), schema, *paths, "2024-01-31 00:00:00").awaitTermination()
        rows = Versions(spark, paths[0]).read("signals").collect()
        assert [(r["id"], r["commune"]) for r in rows] == [(1, commune)] and rows[0]["confidence"] == pytest.approx(0.4)


def test_streamed_correlation(spark, tmp_path):
    import json

    schema = "ts timestamp, source string, type string, lat double, lon double, text string, external_id string, confidence float, commune string, province string, state string"
    source = tmp_path / "in"
    source.mkdir()
    paths = [str(tmp_path / x) for x in ("table", "checkpoint")]
    base = {"source": "conaf", "type": "wildfire", "lat": -33.0, "lon": -71.5, "commune": "A"}
    clock = iter(["2024-01-30 01:00:00", "2024-01-30 01:00:00", "2024-01-30 02:00:00", "2024-01-30 02:00:00"])
    for k, rows in enumerate(([{**base, "ts": "2024-01-30T00:00:00Z", "external_id": "conaf:1"}], [{**base, "ts": "2024-01-30T01:30:00Z", "external_id": "conaf:2", "lat": -33.004}, {**base, "ts": "2024-01-30T01:40:00Z", "external_id": "conaf:3", "lat": -34.0}])):
        (source / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        ingest.correlated(spark, str(source), schema, *paths, lambda: next(clock)).awaitTermination()
    table = Versions(spark, paths[0])
    assert table.version() == 5  # the empty tables, and for each batch its merge and its pass
    assert {r["external_id"]: r["incident_id"] for r in table.read("signals").collect()} == {"conaf:1": 1, "conaf:2": 1, "conaf:3": 2}
    assert {r["incident_id"]: r["event_count"] for r in table.read("incidents").collect()} == {1: 2, 2: 1}


def test_names_that_hold_one_another(spark):
    left = ["valparaiso", "san", "limache", "til til", "la calera", "vina del mar", "abcab", ""]
    right = ["valparaiso", "provincia de valparaiso", "san pedro", "lim", "a", "ti", "calera", "mar", "til til", "abcabcab", "limache viejo", ""]
    frame = lambda c, names: spark.createDataFrame([(n,) for n in names], f"{c} string")
    got = {tuple(r) for r in alerts.held_names(frame("p", left), frame("q", right)).collect()}
    assert got == {(p, q) for p in left for q in right if p and q and (p == q or (len(p) >= 5 and (p in q or q in p)))}


def test_ranks_that_count():
    from signalloom import policy

    assert 30 <= score.RANKS <= 100
    slow = policy.Rule(0.1, 0.9, 0.95, 0.9)
    n = score.ranks_that_count({"slow": slow})
    assert 0.9 * sum(0.95**r for r in range(n, n + 5000)) <= 2.0**-59 and n > 500
    assert score.ranks_that_count({"flat": policy.Rule(0.25, 0.5, 1, 0.9)}) == 4
    with pytest.raises(ValueError):
        score.ranks_that_count({"flat": policy.Rule(0, 0.5, 1, 0.9)})


def test_no_folder_of_one_machine_on_a_cluster(spark):
    from types import SimpleNamespace

    from signalloom.tables import shared_dir

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(far)


def test_spheroid_distances(spark):
    # Known lengths of geodesics on WGS84; the ends of an axis have their ways over a pole.
    known = [(0.0, 0.0, 0.0, 1.0, 111319.4908), (0.0, 0.0, 1.0, 0.0, 110574.3886), (-33.0, -71.5, -33.0, -71.5, 0.0), (-33.0, -71.0, -34.0, -71.0, 110913.4), (50.0, 0.0, 50.0, 1.0, 71695.7), (90.0, 0.0, -90.0, 0.0, 20003931.46)]
    df = spark.createDataFrame(known, "lat1 double, lon1 double, lat2 double, lon2 double, want double")
    for r in geo.with_spheroid(df, "got", "lat1", "lon1", "lat2", "lon2").collect():
        assert r["got"] == pytest.approx(r["want"], rel=2e-5, abs=1e-6)
    for lat1, lon1, lat2, lon2, want in known[:-1]:
        got = spark.sql(f"SELECT {geo.spheroid(*(f'{x!r}e0' for x in (lat1, lon1, lat2, lon2)))} AS m").first()["m"]
        assert got == pytest.approx(want, rel=2e-5, abs=1e-6)


def test_a_stored_pass(spark, tmp_path):
    rows = [signal(1, "conaf", 1.0, "wildfire", commune="Limache"), signal(2, "waze", 0.4, "smoke", lat=-33.005, ts=T + timedelta(minutes=9)), signal(3, "waze", 0.4, "accident"), signal(4, "senapred", 1.0, "alert", lat=None, lon=None, text="Alerta Roja por incendio", commune="Quilpué")]
    incidents, links = passes.empty(spark)
    table = Versions(spark, str(tmp_path / "t"), {"signals": SIGNALS})
    signals = spark.createDataFrame(rows, FIELDS).withColumn("processed_at", F.lit(None).cast("timestamp"))
    table.commit({"signals": signals, "incidents": incidents, "links": links})
    with table.lease(), pytest.warns(UserWarning, match="skipped"):
        assert passes.stored_pass(table, "2024-01-30 01:00:00", P.Policy(window_h=48)) is None
    done = passes.stored_pass(table, "2024-01-30 01:00:00", P.Policy(window_h=48))
    assert table.version() == 2 and table.read("incidents").count() == 2 and done.seconds > 0 and done.warnings == ["alerts without an incident"]
    stored = {r["id"]: (r["incident_id"] is not None, str(r["processed_at"])) for r in table.read("signals").collect()}
    assert stored == {i: (True, "2024-01-30 01:00:00") for i in (1, 2, 3)} | {4: (False, "None")}
    fire = table.read("incidents").where("family = 'fire'").first()
    assert (fire["first_seen_at"], fire["last_seen_at"], fire["type"], fire["code"]) == (T, T + timedelta(minutes=9), "wildfire", "INC-2024-00001")
    counters = {"events_considered": 3, "clusters": 2, "incidents_created": 2, "incidents_updated": 2, "spatial_links": 3, "clusters_deferred": 0, "alerts_considered": 1, "alert_links": 0, "incidents_merged": 0, "incidents_stale": 0, "incidents_dismissed": 0, "incidents_without_commune": 1, "rounds": 1}
    assert done.metrics == counters


def test_folios_begin_anew_each_year(spark):
    policy = P.Policy(window_h=48, match_window_h=48)
    first = passes.first_pass(spark, spark.createDataFrame([signal(i, "conaf", 1.0, "wildfire", lat=-33.0 - i) for i in range(3)], FIELDS), "2023-12-31 23:00:00".replace("2023-12-31", "2024-01-30"), policy)
    later = datetime(2025, 1, 2)
    more = first.signals.unionByName(spark.createDataFrame([signal(100 + i, "conaf", 1.0, "wildfire", lat=-33.0 - i, ts=later) for i in range(2)], FIELDS), allowMissingColumns=True)
    second = passes.correlate(more, first.incidents, first.links, "2025-01-02 01:00:00", policy)
    third = passes.correlate(second.signals.unionByName(spark.createDataFrame([signal(200, "conaf", 1.0, "wildfire", lat=-39.0, ts=later)], FIELDS), allowMissingColumns=True), second.incidents, second.links, "2025-01-02 01:00:00", policy)
    assert sorted(r["code"] for r in third.incidents.collect()) == [f"INC-{y}-{i:05d}" for y, n in ((2024, 3), (2025, 3)) for i in range(1, n + 1)]


def test_error_log(spark):
    bad = spark.createDataFrame([(f"s{i}", f"{i:03d}", ["no_time", "source"]) for i in range(60)], "source string, external_id string, errors array<string>")
    got = store.error_log(bad).collect()
    assert len(got) == 50 and got[0]["error"] == "no_time, source"
