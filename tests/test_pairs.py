from pyspark.sql import functions as F

from signalloom.operators import cluster


def test_pairs_are_neither_broadcast_nor_filtered_by_a_formula_written_out(spark):
    rows = spark.range(400).selectExpr("id", "timestamp_seconds(id * 60) AS ts", "-33 + id % 20 / 200D AS lat", "-71.5 + id % 17 / 200D AS lon")
    found = cluster.neighbours(rows, 2000.0, 60)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
    assert "ATAN" not in next(line for line in plan.splitlines() if "SortMergeJoin" in line)  # the spheroid's arc is worked out once a pair, after the join
    a, b = (rows.select(*[F.col(c).alias(f"{c}{i}") for c in rows.columns]) for i in (1, 2))
    near = cluster._close(a.crossJoin(b).where("id1 < id2 AND abs(unix_timestamp(ts1) - unix_timestamp(ts2)) <= 3600"), 2000.0)
    want = sorted((r["id1"], r["id2"], round(r["distance_m"], 6)) for r in near.collect())
    assert sorted((r["a"], r["b"], round(r["distance_m"], 6)) for r in found.collect()) == want and len(want) > 100
