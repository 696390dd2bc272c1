import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from signalloom.sources import geojson

T = datetime(2024, 1, 30)


def events(spark, n):
    return spark.range(n).selectExpr("id", "timestamp'2024-01-30' AS ts", "'waze' AS source", "'smoke' AS type", "IF(id % 5 = 0, NULL, -33.0D) AS lat", "IF(id % 5 = 0, NULL, -71.5D) AS lon", "0.4F AS confidence", "concat('humo \"', id, '\" ñ') AS text", "string(NULL) AS commune")


def read(path):
    return {p.name: json.loads(p.read_text(encoding="utf-8")) for p in path.glob("*.geojson")}


def test_each_file_is_a_collection(spark, tmp_path):
    out = tmp_path / "out"
    geojson.write_collections(events(spark, 103).repartition(3), str(out), "events")
    files = read(out)
    assert len(files) == 3 and all(f["type"] == "FeatureCollection" for f in files.values())
    found = {x["properties"]["id"]: x for f in files.values() for x in f["features"]}
    assert sorted(found) == list(range(103)) and found[5]["geometry"] is None and found[6]["geometry"]["coordinates"] == [-71.5, -33.0]
    assert found[6]["properties"]["text"] == 'humo "6" ñ' and found[6]["properties"]["is_confirmed_incident"] is False
    assert json.loads((out / "_collections.json").read_text()) == {k: len(f["features"]) for k, f in files.items()}
    geojson.write_collections(events(spark, 4).coalesce(1), f"file://{out}", "events")
    assert sum(len(f["features"]) for f in read(out).values()) == 107
    geojson.write_collections(events(spark, 4).coalesce(1), str(out), "events", "overwrite")
    assert sum(len(f["features"]) for f in read(out).values()) == 4 and len(json.loads((out / "_collections.json").read_text())) == 1
    assert not list(out.glob("_drafts*"))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    geojson.write_collections(events(spark, 10).coalesce(1), str(out), "events")
    before = read(out)
    bad = events(spark, 1000).repartition(4, "id").withColumn("text", F.when(F.col("id") == 997, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception):
        geojson.write_collections(bad, str(out), "events", "overwrite")
    assert read(out) == before and json.loads((out / "_collections.json").read_text()).keys() == before.keys()


def test_incidents_and_quakes(spark, tmp_path):
    rows = spark.createDataFrame([(7, "INC-2024-00007", "wildfire", "fire", "active", 0.9, True, -33.0, -71.5, T)], "incident_id long, code string, type string, family string, status string, confidence double, is_official_confirmed boolean, lat double, lon double, last_seen_at timestamp")
    geojson.write_collections(rows, str(tmp_path / "i"), "incidents")
    (one,) = next(iter(read(tmp_path / "i").values()))["features"]
    assert one["properties"]["is_confirmed_incident"] is True and one["properties"]["code"] == "INC-2024-00007" and one["properties"]["alert_level"] is None and one["properties"]["confidence_level"] is not None
    quake = spark.createDataFrame([(1, T, 4.5, 30.0, "Sismo", -33.0, -71.5)], "id long, ts timestamp, magnitude double, depth_km double, text string, lat double, lon double")
    geojson.write_collections(quake, str(tmp_path / "q"), "quakes")
    (one,) = next(iter(read(tmp_path / "q").values()))["features"]
    assert (one["properties"]["magnitude"], one["properties"]["depth_km"]) == (4.5, 30.0)
    geojson.write_collections(quake.limit(0), str(tmp_path / "none"), "quakes")
    assert read(tmp_path / "none") == {} and json.loads((tmp_path / "none" / "_collections.json").read_text()) == {}
