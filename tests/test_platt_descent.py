"""Recalibration by descent against a search that knows no derivatives, and its held-out report."""

import numpy as np
import pytest

from tideline.plans import hedging, scurve


def cells(spark, a=0.6, b=-4.2, n=80, noise=0.005):
    rng = np.random.default_rng(7)
    z = rng.uniform(-3, 3, (n, 33))
    real = 1 - (1 - (1 / (1 + np.exp(-(a * z + b)))).mean(1)) ** 12 + noise * rng.normal(size=n)
    rows = [(["trough", "boom"][i % 2], 2.5 + 0.5 * (i % 4), [float(v) for v in z[i]], float(real[i])) for i in range(n)]
    return z, real, spark.createDataFrame([*rows, ("boom", 3.0, [0.0], None)], "span string, coupon double, z array<double>, real double")


def sse(p, z, real):
    return ((1 - (1 - (1 / (1 + np.exp(-(p[0] * z + p[1])))).mean(1)) ** 12 - real) ** 2).sum()


@pytest.mark.parametrize("start", [(1.0, -3.0), (0.1, -8.0), (1.5, -2.0)])
def test_descent_finds_the_optimum(spark, start):
    z, real, df = cells(spark)
    a, b, e, n = scurve.platt_descent(df, "z", "real", start)
    best, step = np.array([0.6, -4.2]), 0.1
    while step > 1e-7:  # pattern search
        moves = [best + step * np.array(m) for m in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1))]
        new = min(moves, key=lambda p: sse(p, z, real))
        best, step = (new, step) if sse(new, z, real) < sse(best, z, real) else (best, step / 2)
    assert (a, b) == pytest.approx(best.tolist(), abs=1e-4) and n == 80 and e == pytest.approx(sse(best, z, real), rel=1e-6)


def test_report_on_cells_the_fit_has_not_seen(spark):
    z, real, df = cells(spark, noise=0.0)
    a, b, _, n = scurve.platt_descent(df.filter("span = 'trough'"), "z", "real")
    assert n == 40 and (a, b) == pytest.approx((0.6, -4.2), abs=1e-6)
    rows = scurve.platt_report(df, "z", "real", a, b, ["span", "coupon"]).collect()
    assert sum(r.n for r in rows) == 80 and all(r.ratio == pytest.approx(1.0, abs=1e-6) for r in rows)
    with pytest.raises(ValueError, match="no cells"):
        scurve.platt_descent(df.filter("coupon > 99"), "z", "real")
    with pytest.raises(ValueError, match="apart"):
        scurve.platt_descent(spark.createDataFrame([([1.0, 1.0], 0.2), ([1.0, 1.0], 0.3)], "z array<double>, real double"), "z", "real")


def test_coupon_vol_is_each_coupons_own(spark):
    df = spark.createDataFrame([(3.0, 0.01), (3.0, 0.03), (3.0, -0.02), (4.0, 0.5), (5.0, 0.1), (5.0, None), (5.0, 0.3)], "coupon double, hedged double")
    got = {r.coupon: r for r in hedging.coupon_vol(df).collect()}
    assert got[3.0].ann_vol == pytest.approx(np.std([0.01, 0.03, -0.02], ddof=1) * 12**0.5)
    assert got[4.0].ann_vol is None and got[5.0].n == 2 and got[5.0].ann_vol == pytest.approx(np.std([0.1, 0.3], ddof=1) * 12**0.5)
