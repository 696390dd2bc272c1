import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from signalloom import policy as P
from signalloom.operators import cluster, lifecycle
from signalloom.streaming import follow

T = datetime(2024, 1, 30)


def streamed(spark, tmp_path, batches, schema, make):
    """The rows that a stream gives over files of one batch each; the query is started anew for each batch."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        make(stream).writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination(180)
    return spark.read.parquet(out).collect()


def test_streamed_neighbours_are_those_of_the_finished_table(spark, tmp_path):
    rng = random.Random(9)
    schema = "id long, ts timestamp, lat double, lon double"
    rows = [(i, T + timedelta(minutes=i + rng.randrange(-20, 20)), -33 + rng.random() * 0.1, -71.5 + rng.random() * 0.1) for i in range(240)] + [(999, T + timedelta(minutes=100), None, None)]
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    got = streamed(spark, tmp_path, batches, schema, lambda s: follow.streamed_neighbours(s, 3000, 45, "90 minutes"))
    want = cluster.neighbours(spark.createDataFrame(rows, schema), 3000, 45).collect()
    key = lambda r: (r["a"], r["b"], round(r["distance_m"], 3))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 100


def test_expiry_by_timers_is_that_of_each_instant(spark, tmp_path):
    for k, v in follow.timer_conf().items():
        spark.conf.set(k, v)
    try:
        _replay(spark, tmp_path)
    finally:
        for k in follow.timer_conf():
            spark.conf.unset(k)


def _replay(spark, tmp_path):
    rng = random.Random(3)
    policy = P.Policy(stale_h=2, citizen_ttl_min=5)
    schema = "incident_id long, status string, first_seen_at timestamp, last_seen_at timestamp, confidence double, is_official_confirmed boolean, sources array<string>, seen_at timestamp"
    state, batches, instants = {}, [], []
    stored, want = {}, []
    for k in range(6):
        now = T + timedelta(minutes=37 * k)
        rows = []
        for i in range(12):
            if i not in state or rng.random() < 0.3:
                first = state[i][2] if i in state else now - timedelta(minutes=rng.randrange(4))
                sources = rng.choice([["citizen"], ["citizen"], ["waze"], ["citizen", "conaf"]])
                state[i] = (i, rng.choice(["active", "active", "controlled"]), first, now - timedelta(minutes=rng.randrange(3)), rng.choice([0.3, 0.4, 0.9]), "conaf" in sources, sources, now)
                rows.append(state[i])
        rows.append((1000 + k, "extinguished", now, now, 1.0, True, ["conaf"], now))  # moves the present on
        batches.append(rows)
        instants.append(now)
    # Sequentially: after each batch, and a day after the last, `expire` looks at all that is stored.
    last = T + timedelta(days=1)
    batches.append([(2000, "extinguished", last, last, 1.0, True, ["conaf"], last)])
    instants.append(last)
    for rows, now in zip(batches, instants):
        stored |= {r[0]: r[:7] for r in rows}
        df = spark.createDataFrame(list(stored.values()), schema.rsplit(",", 1)[0])
        for r in lifecycle.expire(df, F.lit(str(now)).cast("timestamp"), policy).collect():
            if r["status"] != stored[r["incident_id"]][1]:
                want.append((r["incident_id"], r["status"]))
                stored[r["incident_id"]] = (r["incident_id"], r["status"], *stored[r["incident_id"]][2:])
    got = streamed(spark, tmp_path, batches, schema, lambda s: follow.expiries(s, policy))
    assert sorted((r["incident_id"], r["status"]) for r in got) == sorted(want) and len(want) > 10
    assert {r["status"] for r in got} == {"dismissed", "stale"} and all(T < r["at"] < last for r in got)
