"""Neighbours and expiry as streams: state that watermarks and timers let go."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from signalloom import policy as P
from signalloom.functions import geo
from signalloom.operators import cluster


#: Bounds of time, and of place each way, in a cell of streamed_neighbours(): few cells, as each costs Python some milliseconds. Pairs that are compared at once.
_SPANS, _SIDES, _BLOCK = 6, 4, 1 << 18
_MET = "id1 long, lat1 double, lon1 double, id2 long, lat2 double, lon2 double"
_SEEN = np.dtype([("id", "<i8"), ("t", "<i8"), ("lat", "<f8"), ("lon", "<f8"), ("own", "?")])


def _met(left: np.ndarray, right: np.ndarray, seconds: int, metres: float) -> Iterator[pd.DataFrame]:
    """Pairs of a signal of left and one of right, which is in order of time, about `metres` apart: by the great circle, as cluster._close."""
    low, high = np.searchsorted(right["t"], left["t"] - seconds), np.searchsorted(right["t"], left["t"] + seconds, "right")
    ends = np.cumsum(high - low)
    at = 0
    while at < len(left):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + _BLOCK, "right")))
        n = (high - low)[at:to]
        l = left[at:to].repeat(n)
        r = right[np.arange(len(l)) - np.repeat(ends[at:to] - n - done, n) + np.repeat(low[at:to], n)]
        kept = np.where(l["own"], l["id"] < r["id"], l["id"] != r["id"]) & (np.abs(l["lat"] - r["lat"]) <= metres * cluster._DEGREE)
        l, r, at = l[kept], r[kept], to
        half = lambda c: np.sin(np.radians(r[c] - l[c]) / 2) ** 2
        arc = half("lat") + np.cos(np.radians(l["lat"])) * np.cos(np.radians(r["lat"])) * half("lon")
        near = 2 * geo.RADIUS * np.arcsin(np.minimum(1, np.sqrt(arc))) <= metres * 1.006
        if near.any():
            yield pd.DataFrame({f"{c}{i}": x[c][near] for i, x in ((1, l), (2, r)) for c in ("id", "lat", "lon")})


def _meeting(seconds: int, metres: float):
    """What a cell does with a batch: its signals meet those that it has seen, and one another; it keeps those that later ones can meet."""

    def meet(key, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = np.frombuffer(state.get[0], _SEEN) if state.exists else np.empty(0, _SEEN)
        for chunk in chunks:
            new = np.empty(len(chunk), _SEEN)
            for c in _SEEN.names:
                new[c] = chunk[c].to_numpy()
            new = new[np.argsort(new["t"], kind="stable")]
            yield from _met(seen, new[new["own"]], seconds, metres)
            seen = np.concatenate([seen, new])
            seen = seen[np.argsort(seen["t"], kind="stable")]
            yield from _met(new, seen[seen["own"]], seconds, metres)
        present = state.getCurrentWatermarkMs()
        state.update((seen[seen["t"] >= present // 1000 - seconds].tobytes(),))
        state.setTimeoutTimestamp(max((int(key[0]) + 1) * _SPANS * seconds + seconds + 1, present // 1000 + 1) * 1000)

    return meet


def streamed_neighbours(signals: DataFrame, metres: float = 2000.0, minutes: float = 60, late: str = "4 hours") -> DataFrame:
    """(a, b, distance_m), a < b, of a stream of signals (id, ts, lat, lon) within `metres` and `minutes` of each other.

    A cell of time and place keeps the signals in it, and of half of the cells around those within reach of it, packed;
    signals of a cell meet in order of time. What a cell keeps goes when the watermark, `late` behind the
    newest signal, is `minutes` past it. A signal that comes later than that may be left out of pairs; any other pair
    comes once, when its second signal does.
    """
    seconds = int(minutes * 60)
    known = signals.withWatermark("ts", late).where("id IS NOT NULL AND ts IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    rows = known.select(F.col("id").cast("long"), "ts", F.unix_timestamp("ts").alias("t"), F.col("lat").cast("double"), F.col("lon").cast("double"))
    step = metres * cluster._DEGREE * (1 + 1e-9)
    bounds = {"ct": ("t", seconds, _SPANS * seconds), "cy": ("lat", step, _SIDES * step), "cx": ("lon", 2 * step, _SIDES * 2 * step)}
    cells = {c: F.floor(F.col(x) / side) for c, (x, _, side) in bounds.items()}
    rows = rows.withColumns(cells | {f"_{c}": cell for c, cell in cells.items()})
    around = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    moved = cluster._shifted(rows, around, ["cy", "cx", "ct"])
    for c, (x, reach, side) in bounds.items():
        below, above = F.col(x) - F.col(f"_{c}") * side <= reach, (F.col(f"_{c}") + 1) * side - F.col(x) <= reach
        moved = moved.where((F.col(c) == F.col(f"_{c}")) | F.when(F.col(c) < F.col(f"_{c}"), below).otherwise(above))
    moved = moved.select("ct", "cy", "cx", "ts", "id", "t", "lat", "lon", "own")
    met = moved.groupBy("ct", "cy", "cx").applyInPandasWithState(_meeting(seconds, metres), _MET, "seen binary", "append", "EventTimeTimeout")
    return cluster._close(met, metres).select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), "distance_m")


TURNED = "incident_id long, status string, at timestamp"
_STATE = "status string, first_s long, last_s long, lone boolean, seen_us long"


class Expiry(StatefulProcessor):
    """An incident's last row, and one timer for the next thing that silence would make of it."""

    def __init__(self, policy: P.Policy):
        self.citizen_s, self.stale_s = int(policy.citizen_ttl_min * 60), int(policy.stale_h * 3600)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", _STATE)

    def due(self, status: str, first_s: int, last_s: int, lone: bool) -> tuple[int, str] | None:
        """(second, status) that comes first if nothing is heard; of one second the dismissal."""
        found = []
        if lone and status in P.OPEN_STATUSES:
            found.append((first_s + self.citizen_s + 1, "dismissed"))
        if status == "active":
            found.append((last_s + self.stale_s + 1, "stale"))
        return min(found, default=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = self.row.get() if self.row.exists() else None
        for batch in rows:
            for r in batch.itertuples(index=False):
                new = (r.status, int(r.first_s), int(r.last_s), bool(r.lone), int(r.seen_us))
                if best is None or new[4] >= best[4]:
                    best = new
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        yield self.settle(key, best, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.row.exists():
            yield self.settle(key, self.row.get(), timerValues.getCurrentWatermarkInMs())

    def settle(self, key, row: tuple, watermark_ms: int) -> pd.DataFrame:
        """What is due by now, and a timer for what comes after it; nothing is kept of an incident that can turn no more."""
        status, first_s, last_s, lone, seen = row
        out = []
        while (turn := self.due(status, first_s, last_s, lone)) and turn[0] * 1000 <= watermark_ms:
            status = turn[1]
            out.append((key[0], status, datetime.fromtimestamp(turn[0], timezone.utc).replace(tzinfo=None)))
        if turn:
            self.row.update((status, first_s, last_s, lone, seen))
            self.handle.registerTimer(turn[0] * 1000)
        else:
            self.row.clear()
        return pd.DataFrame(out, columns=["incident_id", "status", "at"]).astype({"incident_id": "int64"})

    def close(self) -> None:
        pass


def expiries(incidents: DataFrame, policy: P.Policy = P.Policy(), late: str = "0 seconds") -> DataFrame:
    """(incident_id, status, at) of a stream of incidents as they are refreshed: who is dismissed or goes stale, and from when on.

    incidents: those of lifecycle.expire, and seen_at, the time of the refresh, whose greatest less `late` is the
    present. An incident's last row counts. A timer wakes an incident when it is due, in place of a look at all of them.
    """
    only_citizens = F.size(F.array_except("sources", F.array(F.lit("citizen")))) == 0
    lone = (F.col("confidence") <= policy.citizen_most + P.EPSILON) & ~F.col("is_official_confirmed") & only_citizens
    seconds = lambda c: F.coalesce(F.unix_timestamp(c), F.lit(1 << 40))  # noqa: E731  # an unknown time is never long ago
    rows = incidents.withWatermark("seen_at", late).select(
        "incident_id", "status", "seen_at", seconds("first_seen_at").alias("first_s"), seconds("last_seen_at").alias("last_s"),
        F.coalesce(lone, F.lit(False)).alias("lone"), F.unix_micros("seen_at").alias("seen_us"),
    )
    return rows.groupBy("incident_id").transformWithStateInPandas(Expiry(policy), TURNED, "append", "eventTime")


def timer_conf() -> dict[str, str]:
    """What a session needs for state with timers."""
    return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
