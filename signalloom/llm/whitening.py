"""Whitening of embeddings by block subspace iteration, without a covariance matrix.

Each pass over the vectors multiplies the centred rows by a block of directions and back, X'(XQ); a QR step and a
Rayleigh-Ritz step on the driver turn the block, until the residuals of all wanted components are at rounding level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.search import quantised

#: Rows multiplied at a time, and the largest whole number that sums and doubles hold exactly.
_ROWS, _EXACT = 4096, 2**53


@dataclass
class Moments:
    """n vectors of whole numbers, each dimension's sum, least and largest value."""

    n: int
    sums: list[int]
    least: list[int]
    most: list[int]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """A whole number near each mean and what n times it leaves of the sum, so that n * x - sum is exact in 64 bits."""
        near = [s // self.n for s in self.sums]
        return np.array(near, np.int64), np.array([s - self.n * m for s, m in zip(self.sums, near)], np.int64)

    def largest_deviation(self) -> int:
        """No row's sum of (n * x - sum)^2 is more."""
        return sum(max(self.n * b - s, s - self.n * a) ** 2 for s, a, b in zip(self.sums, self.least, self.most))


@dataclass
class Whitener:
    """Mean and unit components (columns, by falling variance), the trace of the covariance, passes over the data and last residuals."""

    moments: Moments
    components: np.ndarray
    variances: np.ndarray
    trace: float
    passes: int
    residuals: np.ndarray

    def scales(self) -> np.ndarray:
        """1 / sqrt(variance); NaN for components without variance beyond rounding, along which nothing can be whitened."""
        top = self.variances[0] if len(self.variances) else 0.0
        real = self.variances > len(self.components) * np.finfo(float).eps * top
        return np.where(real, 1 / np.sqrt(np.where(real, self.variances, 1.0)), np.nan)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def moments(rows: DataFrame) -> Moments | None:
    """Moments of the vectors `v`; None without rows. Raises a ValueError for vectors of several lengths or values beyond 2^53."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[int]] = {}
            for i, size in enumerate(pc.list_value_length(batch.column("v")).to_numpy()):
                by.setdefault(int(size), []).append(i)
            for size, at in by.items():
                x = _matrix(batch.column("v").take(pa.array(at)))
                low, high = x.min(axis=0), x.max(axis=0)
                if low.min() <= -_EXACT or high.max() >= _EXACT:
                    raise ValueError("a vector's entry is beyond 2^53 after scaling")
                n = len(at)
                yield pa.RecordBatch.from_pydict({"size": pa.array([size] * size, pa.int32()), "dim": pa.array(range(size), pa.int32()), "n": pa.array([n] * size, pa.int64()), "s": x.sum(axis=0), "low": low, "high": high})

    parts = rows.select("v").mapInArrow(run, "size int, dim int, n long, s long, low long, high long")
    sums = parts.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = sums.orderBy("size", "dim").limit(2 * 10**6).collect()  # a row a dimension
    if not found:
        return None
    if len(sizes := {r["size"] for r in found}) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(sizes)[:5]}")
    return Moments(found[0]["n"], [int(r["s"]) for r in found], [r["low"] for r in found], [r["high"] for r in found])


def _centred(x: np.ndarray, n: int, near: np.ndarray, left: np.ndarray) -> np.ndarray:
    """x - sum / n, each entry rounded once."""
    return (n * (x - near) - left) / n


def _summed(rows: DataFrame, product, height: int, width: int) -> np.ndarray:
    """The sum over all rows of product(x), a matrix of height * width doubles.

    A task adds up what it reads and passes on a row of the sum for each of the matrix's rows; these are dealt by their
    place and added up as they come, in the order of tasks, so that reruns agree and no task holds more than the matrix.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for batch in batches:
            x = _matrix(batch.column("v"))
            for a in range(0, len(x), _ROWS):
                total += product(x[a : a + _ROWS])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(height), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), _matrix(batch.column("row"))):
                total[i] = total[i] + row if i in total else row.copy()
        if total:
            yield pa.RecordBatch.from_pydict({"i": pa.array(total, pa.int32()), "row": pa.array(list(total.values()), pa.list_(pa.float64()))})

    kind = "i int, row array<double>"
    parts = rows.select("v").mapInArrow(each, kind).withColumn("part", F.spark_partition_id())
    found = parts.repartition(min(height, 16), "i").sortWithinPartitions("part", "i").select("i", "row").mapInArrow(add, kind)
    out = np.zeros((height, width))
    for r in found.collect():  # the matrix
        out[r["i"]] = r["row"]
    return out


def fit(rows: DataFrame, known: Moments, k: int, spare: int | None = None, tolerance: float = 1e-13, most: int = 500) -> Whitener:
    """The first k components of the covariance of `v` (divisor n), by subspace iteration with `spare` more directions (k of them unless told).

    The error of a component shrinks a pass by the ratio of the first variance outside the block to its own; a block as
    wide as the vectors is done after one. It ends when all k residuals are at most `tolerance` of the largest variance,
    and raises a RuntimeError when `most` passes do not do.
    """
    n, d = known.n, len(known.sums)
    near, left = known.centre()
    k = min(k, d)
    p = min(d, k + (k if spare is None else spare))
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((d, p)))[0]
    for done in range(1, most + 1):

        def product(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            c = _centred(x, n, near, left)
            out = np.empty((d, p + 1))
            out[:, :p] = c.T @ (c @ q)
            out[:, p] = np.einsum("ij,ij->j", c, c)
            return out

        found = _summed(rows, product, d, p + 1) / n
        w, trace = found[:, :p], float(found[:, p].sum())
        h = q.T @ w
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        z, wz = q @ turn, w @ turn
        residuals = np.linalg.norm(wz[:, :k] - z[:, :k] * values[:k], axis=0)
        if (residuals <= tolerance * max(values[0], 0.0)).all():
            break
        q = np.linalg.qr(wz)[0]
    else:
        raise RuntimeError(f"the components did not settle in {most} passes: residuals of {residuals.max():.3g}")
    z = z[:, :k] / np.linalg.norm(z[:, :k], axis=0)
    z *= np.sign(z[np.abs(z).argmax(axis=0), np.arange(k)])  # one sign of the two
    return Whitener(known, z, np.maximum(values[:k], 0.0), trace, done, residuals)


def _whitened(x: np.ndarray, model: Whitener, near: np.ndarray, left: np.ndarray) -> np.ndarray:
    return (_centred(x, model.moments.n, near, left) @ model.components) * model.scales()


def identity_error(rows: DataFrame, model: Whitener) -> float | None:
    """How far the covariance of the whitened rows is from the identity in its worst entry, over components that have variance."""
    near, left = model.moments.centre()
    real = np.flatnonzero(~np.isnan(model.scales()))
    if not len(real):
        return None

    def product(x: np.ndarray) -> np.ndarray:
        y = _whitened(x, model, near, left)[:, real]
        out = np.empty((len(real), len(real) + 1))
        out[:, :-1], out[:, -1] = y.T @ y, y.sum(axis=0)
        return out

    found = _summed(rows, product, len(real), len(real) + 1) / model.moments.n
    covariance = found[:, :-1] - np.outer(found[:, -1], found[:, -1])
    return float(np.abs(covariance - np.eye(len(real))).max())


def transform(rows: DataFrame, model: Whitener, keys: list[str]) -> DataFrame:
    """The key columns with `deviation`, the exact sum of (n * x - sum)^2, and `whitened`, an entry a component (null where it has no variance).

    deviation is a long where the data's bounds keep every row's within one, else decimal(38,0).
    """
    n = model.moments.n
    near, left = model.moments.centre()
    small = model.moments.largest_deviation() < 2**63
    kind = "long" if small else "decimal(38,0)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            if not len(x):
                continue
            off = (n * (x - near) - left) if small else (n * (x.astype(object) - near.astype(object)) - left.astype(object))
            y = _whitened(x, model, near, left)
            flat = pa.array(y.ravel(), mask=np.isnan(y.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), flat)
            total = (off * off).sum(axis=1)
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in keys}, "deviation": pa.array(total) if small else pa.array(map(Decimal, total.tolist()), pa.decimal128(38, 0)), "whitened": lists})

    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keys)
    return rows.select(*keys, "v").mapInArrow(run, f"{schema}deviation {kind}, whitened array<double>")


def whiten(df: DataFrame, keys: list[str], column: str = "embedding", k: int = 32, scale: int = 64, offset: int = 1_000_000) -> tuple[DataFrame, Whitener | None]:
    """(key columns, deviation, whitened) of the vectors that can be used, and what was fitted; None where no row can.

    A component c of a vector counts as the whole number floor(scale * c) + offset. Null vectors, empty ones and those
    that hold null or non-finite entries are left out; all others are fitted and transformed, repeated rows and null
    keys each as a row of its own. Vectors of several lengths and entries beyond 2^53 raise a ValueError. Components
    without variance (one row, equal rows, dependent dimensions) have null in place of a whitened value. Columns that
    are no keys are left out; a key may not be called v, deviation or whitened.
    """
    if clash := {"v", "deviation", "whitened"} & set(keys):
        raise ValueError(f"keys named like the result: {sorted(clash)}")
    rows = quantised(df.select(*keys, F.col(column).alias("_vector")), "_vector", scale).select(*keys, F.transform("v", lambda x: x + F.lit(offset).cast("long")).alias("v"))
    known = moments(rows)
    if known is None:
        return rows.select(*keys, F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).limit(0), None
    model = fit(rows, known, k)
    return transform(rows, model, keys), model


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the first 32 whitened components of every embedding that can be used."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    out, model = whiten(df, ["vec_id"])
    n, error, shares = 0, None, []
    if model:
        n, trace = model.moments.n, model.trace
        rows = quantised(df, "embedding", 64).select(F.transform("v", lambda x: x + F.lit(1_000_000).cast("long")).alias("v"))
        error = identity_error(rows, model)
        shares = [float(e / trace) if trace else None for e in model.variances]
    share = F.array(*[F.lit(x).cast("double") for x in shares]) if shares else F.array().cast("array<double>")
    each = out.select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("_at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
