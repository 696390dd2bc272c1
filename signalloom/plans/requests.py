"""Registered queries over request parameters, addresses, derived shapes and orders, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalloom.adapter import linked, signals
from signalloom.functions import geo, text
from signalloom.operators import alerts, listing, store
from signalloom.plans.catalog import PRESENT, query, stamp
from signalloom.sources import feeds

_BOXES = "CASE id % 6 WHEN 0 THEN '-72,-34,-70.5,-32' WHEN 1 THEN '-70,-34,-72,-32' WHEN 2 THEN '1,2,3' WHEN 3 THEN 'a,2,3,4' WHEN 4 THEN '' ELSE ' -72 , -33.5,-71 ,-33' END"


@query("p15_box_parameters", f"""SELECT id, CASE WHEN len(string_split(t, ',')) > 0 THEN TRY_CAST(trim(string_split(t, ',')[1]) AS DOUBLE) END AS west,
 CASE WHEN t = '' THEN NULL WHEN len(string_split(t, ',')) <> 4 THEN 'shape' WHEN TRY_CAST(trim(string_split(t, ',')[1]) AS DOUBLE) IS NULL THEN 'number'
  WHEN TRY_CAST(trim(string_split(t, ',')[1]) AS DOUBLE) >= TRY_CAST(trim(string_split(t, ',')[3]) AS DOUBLE) THEN 'inverted' END AS error
 FROM (SELECT id, {_BOXES} AS t FROM signals)""")
def box_parameters(spark, d):
    rows = signals(spark, d).select("id", listing.box_of(F.expr(_BOXES)).alias("b"))
    return rows.select("id", "b.west", "b.error")


@query("p15_near_parameters", "SELECT id, CASE WHEN lat IS NULL AND id % 3 = 0 THEN NULL ELSE lat IS NOT NULL AND id % 3 <> 0 END AS whole FROM signals")
def near_parameters(spark, d):
    return signals(spark, d).select("id", listing.near_of(F.col("lat"), F.col("lon"), F.when(F.col("id") % 3 != 0, 500)).alias("whole"))


_FAR = geo.spheroid("lat", "lon", "-33.0245e0", "-71.5518e0")


@query("f20_spheroid_distance", f"SELECT id, round({_FAR}, 2) AS metres FROM signals WHERE lat IS NOT NULL")
def spheroid_distance(spark, d):
    placed = signals(spark, d).where("lat IS NOT NULL")
    return geo.with_spheroid(placed, "_away", "lat", "lon", F.lit(-33.0245), F.lit(-71.5518)).select("id", F.round("_away", 2).alias("metres"))


@query("f34_winds", "SELECT id, CAST(id % 90 AS DOUBLE) AS wind_speed, CAST((id * 31) % 400 AS DOUBLE) AS wind_direction FROM signals WHERE id % 7 <> 0 AND id % 11 <> 0 AND (id * 31) % 400 <= 360")
def winds(spark, d):
    answer = """CASE WHEN id % 11 = 0 THEN '{"error":true}' ELSE concat('{"current_weather":{"windspeed":', CASE WHEN id % 7 = 0 THEN concat('"', id % 90, '"') ELSE concat(id % 90, '.0') END, ',"winddirection":', (id * 31) % 400, ',"time":"2024-01-31T00:00"}}') END"""
    return feeds.winds(signals(spark, d).select("id", F.expr(answer).alias("payload"))).select("id", "wind_speed", "wind_direction")


_ADDRESSES = {
    "forwarded": "CASE id % 5 WHEN 0 THEN '10.0.' || CAST(id % 200 AS {s}) || '.7, 172.16.0.1' WHEN 1 THEN ' , 172.16.0.1' WHEN 2 THEN '2001:db8:' || CAST(id % 9 AS {s}) || ':1::5' END",
    "real": "CASE WHEN id % 3 = 0 THEN ' 192.168.' || CAST(id % 100 AS {s}) || '.9 ' END",
    "peer": "CASE WHEN id % 2 = 0 THEN 'local' END",
}


@query("f35_addresses", "SELECT id, ip, CASE WHEN contains(ip, ':') THEN CASE WHEN len(string_split(ip, ':')) > 3 THEN array_to_string(string_split(ip, ':')[1:3], ':') || ':···' ELSE ip END WHEN len(string_split(ip, '.')) = 4 THEN split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.×.×' ELSE ip END AS masked"
 " FROM (SELECT id, coalesce(nullif(trim(split_part(forwarded, ',', 1)), ''), nullif(trim(real), ''), nullif(trim(peer), ''), 'desconocida') AS ip FROM (SELECT id, " + ", ".join(f"{v.format(s='VARCHAR')} AS {k}" for k, v in _ADDRESSES.items()) + " FROM signals))")  # fmt: skip
def addresses(spark, d):
    given = signals(spark, d).select("id", *[F.expr(v.format(s="STRING")).alias(k) for k, v in _ADDRESSES.items()])
    found = given.select("id", text.client_ip(F.col("forwarded"), F.col("real"), F.col("peer")).alias("ip"))
    return found.withColumn("masked", text.masked_ip(F.col("ip")))


def _points(features):
    """The corners of polygon features, read back from their JSON."""
    kind = "struct<geometry:struct<coordinates:array<array<array<double>>>>,properties:map<string,string>>"
    rows = features.withColumn("_f", F.from_json("feature", kind)).select("id", "_f.properties", F.posexplode(F.col("_f.geometry.coordinates")[0]).alias("k", "p"))
    return rows.withColumns({"k": F.col("k").cast("long"), "ring_lon": F.round(F.col("p")[0], 6), "ring_lat": F.round(F.col("p")[1], 6)})


_REACH = geo.perception_radius("magnitude", "depth_km")
_EDGE = geo.destination("lat", "lon", "CAST(k % 72 AS DOUBLE) * 5e0", "km * 1e3")


@query("k10_reach", f"SELECT id, k, round({_EDGE[0]}, 6) AS ring_lat, round({_EDGE[1]}, 6) AS ring_lon, CAST(round(km) AS BIGINT) AS radius_km FROM (SELECT *, {_REACH} AS km, unnest(range(73)) AS k FROM signals WHERE type = 'earthquake') WHERE km IS NOT NULL")
def reach(spark, d):
    rows = _points(listing.reach_features(signals(spark, d).where("type = 'earthquake'").select("id", "lat", "lon", "magnitude", "depth_km")))
    return rows.select("id", "k", "ring_lat", "ring_lon", F.col("properties")["radius_km"].cast("long").alias("radius_km"))


_CONE = geo.wind_cone("CAST(id % 90 AS DOUBLE)", "CAST((id * 31) % 360 AS DOUBLE)")
_ARC = geo.destination("lat", "lon", "(bearing - half_angle + 2e0 * half_angle * (k - 1) / 24e0)", "length_km * 1e3")


@query("k10_f31_cones", f"""SELECT id, k, round(CASE WHEN k BETWEEN 1 AND 25 THEN {_ARC[0]} ELSE lat END, 6) AS ring_lat, round(CASE WHEN k BETWEEN 1 AND 25 THEN {_ARC[1]} ELSE lon END, 6) AS ring_lon
 FROM (SELECT id, lat, lon, {", ".join(f"{v} AS {k}" for k, v in _CONE.items())}, unnest(range(27)) AS k FROM signals WHERE type = 'wildfire' AND lat IS NOT NULL) WHERE bearing IS NOT NULL""")
def cones(spark, d):
    fires = signals(spark, d).where("type = 'wildfire'").selectExpr("id", "lat", "lon", "concat('INC-', id) AS code", "CAST(id % 90 AS DOUBLE) AS wind_speed", "CAST((id * 31) % 360 AS DOUBLE) AS wind_direction")
    return _points(listing.cone_features(fires)).select("id", "k", "ring_lat", "ring_lon")


@query("t06_ordered_links", " SELECT incident_id, id AS event_id, row_number() OVER (PARTITION BY incident_id ORDER BY ts + to_minutes(id % 7 * 600), id) AS place FROM linked /* linked */")
def ordered_links(spark, d):
    links = linked(signals(spark, d)).select("incident_id", F.col("id").alias("event_id"), F.expr("ts + make_dt_interval(0, 0, int(id % 7 * 600), 0)").alias("linked_at"))
    return listing.ordered_links(links).select("incident_id", "event_id", "place")


@query("f14_communes_of_payloads", """SELECT id, CASE id % 6 WHEN 0 THEN 'Quilpué' WHEN 1 THEN 'Limache' WHEN 2 THEN 'Olmué' WHEN 3 THEN 'Concón' WHEN 4 THEN NULL ELSE 'Casablanca' END AS commune FROM signals""")
def communes_of_payloads(spark, d):
    rows = signals(spark, d).select("id").selectExpr(
        "id", "CASE id % 6 WHEN 0 THEN ' Quilpué ' WHEN 1 THEN ' ' END AS commune",
        """CASE id % 6 WHEN 0 THEN '{"comuna":"Otra"}' WHEN 1 THEN '{"COMUNA":"Limache y Olmué"}' WHEN 2 THEN '{"Comunas":"Toda la región"}' WHEN 3 THEN '{"nom_comuna":" "}' WHEN 4 THEN '{"x":"y"}' END AS raw""",
        "CASE id % 6 WHEN 2 THEN 'Fuego. Comunas: Olmué, Limache. Fin' WHEN 3 THEN 'Comuna: todas las comunas. Ubicación: Concón' WHEN 5 THEN 'UBICACION: Casablanca; Quillota' ELSE 'Sin lugar' END AS text",
    )
    return alerts.with_commune(rows).select("id", "commune")


@query("j09_assigned", f"SELECT id, CASE WHEN type = 'power_outage' THEN 77 WHEN id % 5 = 0 THEN 5 END AS incident_id, CASE WHEN type = 'power_outage' THEN TIMESTAMP '{PRESENT}' END AS processed_at FROM signals")
def assigned(spark, d):
    rows = signals(spark, d).select("id", "type", F.expr("CASE WHEN id % 5 = 0 THEN 5 END").alias("incident_id"), F.lit(None).cast("timestamp").alias("processed_at"))
    return store.assigned(rows, rows.where("type = 'power_outage'").select("id"), 77, stamp(PRESENT)).select("id", "incident_id", "processed_at")
