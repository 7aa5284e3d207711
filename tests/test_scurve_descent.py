"""The descent of the curve fit against least squares that know no grid or lattice, the box, and its plan; the memo; the logit fit."""

import numpy as np
import pytest

from test_scurve_zoom import curve, least_squares, sample
from tideline.catalog import memo
from tideline.operators import regression
from tideline.plans import scurve


def cells(spark, x, y, per=10):
    return spark.createDataFrame([(i // per, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "mi int, x double, y double")


@pytest.mark.parametrize("k, x0", [(3.27, 0.47), (7.1, -0.62), (1.4, 0.9)])
def test_every_cutoff_is_the_least_squares_fit_of_its_past(spark, k, x0):
    x, y = sample(3, k, x0)
    fit = {r.mi: r for r in scurve.fit_asof(cells(spark, x, y), "x", "y", steps=scurve.STEPS).collect()}
    zoom = {r.mi: r for r in scurve.fit_asof(cells(spark, x, y), "x", "y", zoom=scurve.ZOOMS).collect()}
    assert set(fit) == set(range(4, 12)) == set(zoom)
    for m, r in fit.items():
        past = slice(0, 10 * m)
        want, sse = least_squares(x[past], y[past], (0.05, 0.2, k, x0))
        own = ((y[past] - curve((r.floor, r.sat, r.k, r.x0), x[past])) ** 2).sum()
        assert r.n == 10 * m and own <= ((y[past] - curve((zoom[m].floor, zoom[m].sat, zoom[m].k, zoom[m].x0), x[past])) ** 2).sum() * (1 + 1e-5)
        if all(lo < v < hi for v, (lo, hi) in zip(want, (scurve.FLOOR_BOX, scurve.SAT_BOX, scurve.K_BOX, scurve.X0_BOX))):
            assert own == pytest.approx(sse, rel=1e-5)
            assert (r.k, r.x0) == pytest.approx((want[2], want[3]), abs=1e-3) and (r.floor, r.sat) == pytest.approx(want[:2], abs=1e-4)


def test_box_holds_and_modes_use_their_own_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-4, 2, 100)
    y = curve((0.3, 0.9, 30.0, 2.8), x) + 0.01 * rng.normal(size=100)  # outside the box in every parameter
    r = max(scurve.fit_asof(cells(spark, x, y), "x", "y", steps=scurve.STEPS).collect(), key=lambda r: r.mi)
    assert r.floor <= 0.15 and r.sat <= 0.60 and 0.2 <= r.k <= 10 and -2 <= r.x0 <= 3
    x, y = sample(5, 3.27, 0.47)
    pin = {r.mi: r for r in scurve.fit_asof(cells(spark, x, y), "x", "y", mode="pinned-fixed", steps=scurve.STEPS).collect()}
    assert all(r.floor == scurve.FIXED_FLOOR for r in pin.values())
    sx, sy = sample(6, 4.6, 0.13)
    old = cells(spark, sx, sy).filter("mi <> 7")
    own = {r.mi: r for r in scurve.fit_asof(cells(spark, x, y), "x", "y", mode="seasoned-fit", seasoned=old, steps=scurve.STEPS).collect()}
    want, _ = least_squares(sx[:70], sy[:70], (0.05, 0.2, 4.6, 0.1))
    assert own[7].n == own[8].n == 70 and (own[7].k, own[7].x0) == pytest.approx((want[2], want[3]), abs=1e-3)


def test_no_cutoff_meets_its_past_rows(spark, monkeypatch):
    x, y = sample(3, 3.27, 0.47)
    plans, cut = [], scurve.cut_lineage
    monkeypatch.setattr(scurve, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    scurve.fit_asof(cells(spark, x, y), "x", "y", steps=3).collect()
    assert len(plans) >= 3 and not any("NestedLoop" in p or "CartesianProduct" in p for p in plans)


def test_logit_fit_refuses_what_has_no_finite_fit(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=300)
    frame = lambda y, b: spark.createDataFrame([(int(v), float(p), float(q)) for v, p, q in zip(y, a, b)], "y int, a double, b double")
    with pytest.raises(ValueError, match="separate"):
        regression.logit_fit(frame(a > 0, rng.normal(size=300)), "y", ["a", "b"])
    with pytest.raises(ValueError, match="depend"):
        regression.logit_fit(frame(rng.random(300) < 0.4, 2 * a), "y", ["a", "b"])
    rare = (rng.random(300) < 1 / (1 + np.exp(-(-6 + 4 * a)))).astype(int)  # full Newton steps overshoot from zero
    b = regression.logit_fit(frame(rare, rng.normal(size=300)), "y", ["a"])
    p = 1 / (1 + np.exp(-(b[0] + b[1] * a)))
    assert abs((rare - p).sum()) < 1e-6 and abs(((rare - p) * a).sum()) < 1e-6


def test_memo_follows_the_files(spark, tmp_path):
    class Tables:
        def __init__(self):
            self.spark, self.sf_dir = spark, str(tmp_path)

    runs = []
    ask = lambda: memo.written(Tables(), "thing", runs.append)
    spark.range(5).write.parquet(str(tmp_path / "t.parquet"))
    assert ask() == ask() and len(runs) == 1
    spark.range(9).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    assert ask() == ask() and len(runs) == 2 and runs[0] != runs[1]
