"""Student's t against numeric integration, and fits of dependent columns against numpy's least-norm solution."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import tdist
from tideline.operators import regression


def tail(t, n):
    """Two-sided p by integrating the density over the angle, where it is a power of the cosine."""
    at = np.linspace(math.atan(abs(t) / math.sqrt(n)), math.pi / 2, 200_001)
    f = np.cos(at) ** (n - 1)
    inner = (at[1] - at[0]) / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())
    return 2 * math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi) * inner


def test_p_values_equal_the_integral(spark):
    rows = [(t, n) for n in (1, 2, 3, 4, 5, 9, 10, 29, 30, 77, 200, 1000, 4999, 9999) for t in (0.0, 1e-6, 0.3, -0.9, 1.0, 1.96, -2.6, 4.2, 9.0, 40.0)]
    df = spark.createDataFrame([(float(t), n) for t, n in rows] + [(None, 5), (1.0, 0), (1.0, None)], "t double, n int")
    got = tdist.with_p_value(df, "t", "n").collect()
    for r in got:
        if r.t is None or not r.n:
            assert r.p is None
        else:
            assert r.p == pytest.approx(tail(r.t, r.n), abs=1e-9), r
    known = {(1, 1.0): 0.5, (2, 4.302652729911275): 0.05, (10, 2.2281388519649385): 0.05, (30, 2.0422724563012373): 0.05}
    df = spark.createDataFrame([(t, n) for n, t in known], "t double, n int")
    for r in tdist.with_p_value(df, "t", "n").collect():
        assert r.p == pytest.approx(known[(r.n, r.t)], abs=1e-10)


def test_one_sample_t_reports_p_or_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("c", 2.0), ("c", 2.0), ("d", None)], "g string, v double")
    got = {r.g: r for r in regression.one_sample_t(df, "v", ["g"]).collect()}
    t = (7 / 3) / (np.std([1, 2, 4], ddof=1) / math.sqrt(3))
    assert got["a"].p == pytest.approx(tail(t, 2), abs=1e-9) and all(got[g].p is None for g in "bcd")


@pytest.mark.parametrize("k, make", [
    (1, lambda x: [x[0] * 0 + 3.0]),
    (2, lambda x: [x[0], 2 * x[0]]),
    (3, lambda x: [x[0], x[1], x[0] - 3 * x[1] + 1]),
    (4, lambda x: [x[0], x[1], x[0] + x[1], x[0] - x[1]]),
    (5, lambda x: [x[0], x[1], x[2], x[0] + 1e-9 * x[1], x[2] * 0 + 0.5]),
])
@pytest.mark.parametrize("intercept", [True, False])
def test_dependent_columns_get_the_least_norm_solution(spark, k, make, intercept):
    rng = np.random.default_rng(k)
    x = make(rng.normal(size=(3, 60)))
    y = 1 + sum((i + 1) * c for i, c in enumerate(x)) + 0.1 * rng.normal(size=60)
    names = [f"x{i}" for i in range(k)]
    rows = [("dep", *map(float, r)) for r in zip(y, *x)]
    free = rng.normal(size=(k, 60))
    rows += [("free", float(v), *map(float, c)) for v, c in zip(free.sum(0) + rng.normal(size=60), free.T)]
    df = spark.createDataFrame(rows, "g string, y double, " + ", ".join(f"{n} double" for n in names))
    got = {r.g: r for r in regression.ols(df, "y", names, ["g"], intercept=intercept).collect()}
    z = np.column_stack(([np.ones(60)] if intercept else []) + list(x))
    want = np.linalg.lstsq(z, y, rcond=1e-6)[0]
    own = ([got["dep"].b0] if intercept else []) + [got["dep"][f"b_{n}"] for n in names]
    if np.linalg.matrix_rank(z, tol=1e-6) < z.shape[1]:
        assert own == pytest.approx(want.tolist(), abs=1e-6)
        assert got["dep"].sse == pytest.approx(((y - z @ want) ** 2).sum(), abs=1e-6) and got["dep"]["se_x0"] is None
    z = np.column_stack(([np.ones(60)] if intercept else []) + list(free))
    want = np.linalg.lstsq(z, free.sum(0) + 0 * free[0], rcond=None)[0]
    assert got["free"]["se_x0"] is not None and len(want) == z.shape[1]


def test_eigenvalues_equal_numpy(spark):
    rng = np.random.default_rng(1)
    for m in (1, 2, 3, 5, 6):
        a = rng.normal(size=(m, m))
        a = a @ a.T
        a[0] *= 1e3
        a[:, 0] *= 1e3
        r = spark.createDataFrame([([float(v) for v in a.ravel()],)], "m array<double>").select(F.expr(regression.jacobi("m", m)).alias("e")).first().e
        got = sorted(np.array(r.a).reshape(m, m).diagonal())
        assert got == pytest.approx(np.linalg.eigvalsh(a).tolist(), rel=1e-9)
        v = np.array(r.v).reshape(m, m)
        assert v.T @ v == pytest.approx(np.eye(m), abs=1e-12)
