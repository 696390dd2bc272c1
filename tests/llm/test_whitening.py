import math
from fractions import Fraction

import numpy as np
import pytest

from signalloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, v string, label int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], "v", 1) for i, x in vectors], SCHEMA)


def whole(vectors, scale=64, offset=1_000_000):
    return [(i, [math.floor(scale * float(np.float32(c))) + offset for c in x]) for i, x in vectors]


def exact_covariance(rows):
    """The covariance by fractions, so that nothing is lost to the large offset."""
    n, d = len(rows), len(rows[0][1])
    sums = [sum(x[j] for _, x in rows) for j in range(d)]
    off = [[n * x[j] - sums[j] for j in range(d)] for _, x in rows]
    cov = np.array([[float(Fraction(sum(o[i] * o[j] for o in off), n**3)) for j in range(d)] for i in range(d)])
    return cov, off, sums


def same_up_to_sign(a, b, tolerance):
    return all(min(np.abs(a[:, j] - b[:, j]).max(), np.abs(a[:, j] + b[:, j]).max()) < tolerance for j in range(a.shape[1]))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 40)) @ np.diag(2.0 ** -(np.arange(40) / 6)) + rng.standard_normal(40)
    return [(i, row.astype(np.float32).tolist()) for i, row in enumerate(x)]


def test_equals_the_exact_eigenvectors(spark, vectors):
    odd = [(900, None), (901, [1.0] * 39 + [None]), (902, [math.nan] + [0.0] * 39), (903, [math.inf] * 40), (904, []), (5, vectors[5][1]), (None, vectors[6][1])]
    used = whole([(i, x) for i, x in vectors + odd[5:]])
    cov, off, _ = exact_covariance(used)
    values, components = np.linalg.eigh(cov)
    values, components = values[::-1], components[:, ::-1]
    out, model = whitening.whiten(frame(spark, vectors + odd).repartition(3), ["vec_id"], k=12)
    assert model.moments.n == len(used) and model.passes > 1 and len(model.variances) == 12
    assert np.allclose(model.variances, values[:12], rtol=1e-12) and same_up_to_sign(model.components, components[:, :12], 1e-10)
    assert model.trace == pytest.approx(np.trace(cov), rel=1e-12)
    got = sorted(((str(r["vec_id"]), r["deviation"], r["whitened"]) for r in out.collect()), key=lambda r: (r[0], r[1]))
    want = sorted(((str(i), sum(c * c for c in o)) for (i, _), o in zip(used, off)), key=lambda r: (r[0], r[1]))
    assert [r[:2] for r in got] == want
    y = np.array([r[2] for r in got])
    assert np.abs(np.cov(y.T, bias=True) - np.eye(12)).max() < 1e-9


def test_wide_blocks_need_one_pass_and_narrow_ones_agree(spark, vectors):
    df = frame(spark, vectors)
    rows = whitening.quantised(df, "embedding", 64).select("v")
    known = whitening.moments(rows)
    wide, narrow = whitening.fit(rows, known, 20), whitening.fit(rows, known, 20, spare=12)
    assert wide.passes == 1 < narrow.passes
    assert same_up_to_sign(wide.components, narrow.components, 1e-9)
    with pytest.raises(RuntimeError, match="did not settle"):
        whitening.fit(rows, known, 20, spare=1, most=2)


def test_few_equal_and_wide_rows(spark):
    out, model = whitening.whiten(frame(spark, [(1, None)]), ["vec_id"])
    assert out.collect() == [] and model is None
    out, model = whitening.whiten(frame(spark, [(1, [0.5, 1.5])]), ["vec_id"])
    assert [(r["vec_id"], r["deviation"], r["whitened"]) for r in out.collect()] == [(1, 0, [None, None])]
    line = [(i, [float(i), 2.0 * i, 3.0]) for i in range(10)]
    out, model = whitening.whiten(frame(spark, line), ["vec_id"])
    rows = out.collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in rows)
    assert np.var([r["whitened"][0] for r in rows]) == pytest.approx(1)
    far = [(i, [float(i * 10**9), 1.0]) for i in range(1, 40)]
    out, model = whitening.whiten(frame(spark, far), ["vec_id"])
    off = exact_covariance(whole(far))[1]
    assert {r["vec_id"]: int(r["deviation"]) for r in out.collect()} == {i: sum(c * c for c in o) for (i, _), o in zip(far, off)}
    with pytest.raises(ValueError, match="v"):
        whitening.whiten(frame(spark, far), ["v"])
    with pytest.raises(Exception, match="several lengths"):
        whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]), ["vec_id"])


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = whitening.query(spark, d).collect()
    stored = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    used = whole([(i, x) for i, x in stored if x is not None and len(x) and all(c is not None and math.isfinite(c) for c in x)])
    cov, off, _ = exact_covariance(used)
    values, components = np.linalg.eigh(cov)
    values, components = values[::-1][:32], components[:, ::-1][:, :32]
    n = len(used)
    assert len(got) == 32 * n and {r["n"] for r in got} == {n} and got[0]["identity_error"] < 1e-9
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: sum(c * c for c in o) for (i, _), o in zip(used, off)}
    mine = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    want = (np.array(off, float) / n) @ components / np.sqrt(values)
    ours = np.array([[mine[i, j] for j in range(1, 33)] for i, _ in used])
    assert same_up_to_sign(ours, want, 1e-8)
    assert np.allclose([r["explained"] for r in sorted(got, key=lambda r: (r["vec_id"], r["component"]))[:32]], values / np.trace(cov), rtol=1e-9)
