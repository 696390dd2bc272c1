from pyspark.sql import functions as F

from signalloom.operators import store


def test_a_part_of_a_second_past_the_tolerance_is_the_future(spark):
    times = {1: "2024-01-29 00:05:00", 2: "2024-01-29 00:05:00.000001", 3: "2024-01-29 00:05:00.9", 4: "2024-01-29 00:05:01", 5: "2024-01-29 00:04:59.999999"}
    rows = spark.createDataFrame(list(times.items()), "id long, t string").selectExpr("id", "CAST(t AS TIMESTAMP) AS ts", "'waze' AS source", "-33D AS lat", "-71D AS lon", "'x' AS text", "'e' AS external_id", "0.5F AS confidence")
    got = {r["id"]: r["errors"] for r in store.validated(rows, F.lit("2024-01-29 00:00:00").cast("timestamp")).collect()}
    assert got == {1: [], 2: ["future"], 3: ["future"], 4: ["future"], 5: []}
