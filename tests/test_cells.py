from datetime import datetime, timedelta

from signalloom.operators import cluster
from signalloom.streaming import follow


def test_the_state_of_neighbours_is_a_row_a_cell(spark, tmp_path):
    schema = "id long, ts timestamp, lat double, lon double"
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=5 * i), -33.0 + i % 3 / 100, -71.5) for i in range(3000)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = follow.streamed_neighbours(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3000, 10)
    query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(180)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < len(rows)
    key = lambda r: (r["a"], r["b"], round(r["distance_m"], 3))
    want = sorted(map(key, cluster.neighbours(spark.createDataFrame(rows, schema), 3000, 10).collect()))
    assert sorted(map(key, spark.read.parquet(str(tmp_path / "out")).collect())) == want and len(want) > 3000
