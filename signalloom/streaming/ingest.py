"""Continuous ingest and correlation with Structured Streaming; rate limiting as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from signalloom import policy as P
from signalloom.operators import store
from signalloom.operators.versions import SIGNALS, Versions
from signalloom.plans import passes
from signalloom.tables import tasks


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, now: str | Callable[[], str], after: Callable[[DataFrame, int], None] | None = None, every: str | None = None, name: str = "ingest") -> StreamingQuery:
    """Merges each batch of new JSON signals under `source` into the table `signals` of the store under `target`, then calls `after` with the stored rows.

    A batch is validated and its last row of each key is kept; only the buckets of its keys are read and written. The
    version that a batch makes has the batch's number, so that one run again after a crash is not merged twice. All that
    is there is taken and the query ends; with `every` (like '1 minute') it goes on until it is stopped. Its second
    writer, if there is one, makes a batch fail with a Conflict, and the batch is run again from its checkpoint.
    """
    table = Versions(spark, target, {"signals": SIGNALS})
    if not table.version():
        table.commit({"signals": spark.createDataFrame([], f"id long, {schema}")})

    def merge(batch: DataFrame, epoch: int) -> None:
        at = now() if callable(now) else now
        good, _ = store.split_valid(store.validated(batch, F.lit(at).cast("timestamp")))
        good = good.withColumn("_seq", F.xxhash64("ts", "source", "external_id", "text"))
        last = store.last_of_batch(good.withColumn("_seq", F.struct("ts", "_seq")), "_seq").drop("_seq")
        if "updated_at" not in last.columns:  # kept where the table has such a column: an alert is vigent while it is told again
            last = last.withColumn("updated_at", F.lit(at).cast("timestamp"))
        table.upsert("signals", last, applied=(name, epoch))
        if after:
            after(table.read("signals"), epoch)

    when = {"processingTime": every} if every else {"availableNow": True}
    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**when).start()


#: Columns that correlation adds to the signals of a stream.
_OWN = "incident_id long, processed_at timestamp, updated_at timestamp"


def correlated(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, now: Callable[[], str], policy: P.Policy = P.Policy(), every: str | None = None) -> StreamingQuery:
    """Ingest with a correlation pass after each batch, over the tables signals, incidents and links of one store.

    schema: the signals' own columns; they need type, province and state too. The merge and the pass are a version each:
    a crash between them leaves signals that the next pass takes up.
    """
    table = Versions(spark, target, {"signals": SIGNALS})
    if not table.version():
        incidents, links = passes.empty(spark)
        table.commit({"signals": spark.createDataFrame([], f"id long, {schema}, {_OWN}"), "incidents": incidents, "links": links})
    return ingest(spark, source, schema, target, checkpoint, now, lambda rows, epoch: passes.stored_pass(table, now(), policy), every, "correlated")


def windowed_counts(stream: DataFrame, late: str = "4 hours", size: str = "1 hour") -> DataFrame:
    """Signals by source and hour, with a watermark for late ones."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "source").agg(F.count(F.lit(1)).alias("signals"), F.avg("confidence").alias("confidence"))


LIMITED = "key string, at double, allowed boolean, retry_after long"


def _decide(last: float | None, times: list[float], interval: float) -> tuple[float | None, list[tuple[float, bool, int]]]:
    """Each call's verdict in order of time, and the last allowed time; a refused call does not extend the wait."""
    out = []
    for at in sorted(times):
        if last is None or at - last >= interval:
            last = at
            out.append((at, True, 0))
        else:
            left = interval - (at - last)
            out.append((at, False, int(left) + (left > int(left))))
    return last, out


def limit_stream(calls: DataFrame, interval: float = 600.0) -> DataFrame:
    """One allowed call a key and interval over a stream of (key, at): state is the last allowed time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = [float(x) for b in batches for x in b["at"]]
        last, out = _decide(state.get[0] if state.exists else None, times, interval)
        state.update((last,))
        state.setTimeoutDuration(int(interval * 2000))
        yield pd.DataFrame({"key": key[0], "at": [o[0] for o in out], "allowed": [o[1] for o in out], "retry_after": [o[2] for o in out]})

    return calls.groupBy("key").applyInPandasWithState(step, LIMITED, "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def limit_batch(calls: DataFrame, interval: float = 600.0) -> DataFrame:
    """The same verdicts over a finished table of (key, at).

    Calls are dealt by key and sorted; a task goes through them with the last allowed time of the key at hand, and
    holds a batch of rows however many calls a key has.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for pdf in batches:
            allowed, wait = [], []
            for key, at in zip(pdf["key"], pdf["at"]):
                if key != now:
                    now, last = key, None
                last, out = _decide(last, [at], interval)
                allowed.append(out[0][1])
                wait.append(out[0][2])
            yield pd.DataFrame({"key": pdf["key"], "at": pdf["at"], "allowed": allowed, "retry_after": wait})

    rows = calls.select(F.col("key").cast("string").alias("key"), F.col("at").cast("double").alias("at")).where("key IS NOT NULL AND at IS NOT NULL")
    return rows.repartition(tasks(calls.sparkSession), "key").sortWithinPartitions("key", "at").mapInPandas(walk, LIMITED)
