"""Refined curve fits against an independent damped least squares."""

import numpy as np
import pytest

from tideline.plans import scurve


def curve(p, x):
    f, s, k, x0 = p
    return f + (s - f) / (1 + np.exp(-k * (x - x0)))


def least_squares(x, y, p):
    """Levenberg-Marquardt with a numeric Jacobian; knows no grid."""
    p, damp = np.array(p, float), 1e-3
    sse = ((y - curve(p, x)) ** 2).sum()
    for _ in range(100):
        jac = np.stack([(curve(p + h, x) - curve(p - h, x)) / 2e-6 for h in np.eye(4) * 1e-6], axis=1)
        a = jac.T @ jac
        new = p + np.linalg.solve(a + damp * np.diag(np.diag(a)), jac.T @ (y - curve(p, x)))
        if (now := ((y - curve(new, x)) ** 2).sum()) < sse:
            p, sse, damp = new, now, damp / 5
        else:
            damp *= 5
    return p, sse


def sample(seed, k, x0, n=120):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-4, 2, n)
    return x, curve((0.05, 0.2, k, x0), x) + rng.normal(size=n) * 0.004


@pytest.mark.parametrize("k, x0", [(3.27, 0.47), (7.1, -0.62)])
def test_refined_scope_fit_is_the_least_squares_fit(spark, k, x0):
    x, y = sample(3, k, x0)
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, y)], "s string, x double, y double")
    want, sse = least_squares(x, y, (0.05, 0.2, k, x0))
    r = scurve.fit_by_scope(df, "x", "y", ["s"], zoom=scurve.ZOOMS).first()
    assert ((y - curve((r.floor, r.sat, r.k, r.x0), x)) ** 2).sum() == pytest.approx(sse, rel=1e-6)
    assert (r.k, r.x0) == pytest.approx((want[2], want[3]), abs=1e-3) and (r.floor, r.sat) == pytest.approx(want[:2], abs=1e-5)


def test_refined_asof_and_seasoned_fit_use_the_past_of_their_own_rows(spark):
    x, y = sample(5, 3.27, 0.47)
    sx, sy = sample(6, 4.6, 0.13)
    cells = lambda a, b: spark.createDataFrame([(i // 10, float(u), float(v)) for i, (u, v) in enumerate(zip(a, b))], "mi int, x double, y double")
    real, old = cells(x, y), cells(sx, sy).filter("mi <> 7")
    fit = {r.mi: r for r in scurve.fit_asof(real, "x", "y", zoom=scurve.ZOOMS).collect()}
    want, _ = least_squares(x[:80], y[:80], (0.05, 0.2, 3, 0.4))
    assert min(fit) == 4 and (fit[8].k, fit[8].x0) == pytest.approx((want[2], want[3]), abs=1e-3) and fit[8].n == 80
    own = {r.mi: r for r in scurve.fit_asof(real, "x", "y", mode="seasoned-fit", seasoned=old, zoom=scurve.ZOOMS).collect()}
    want, _ = least_squares(sx[:70], sy[:70], (0.05, 0.2, 4.6, 0.1))
    assert own[7].n == own[8].n == 70 and (own[7].k, own[7].x0) == pytest.approx((want[2], want[3]), abs=1e-3)
    assert own[8].k == own[7].k and set(own) <= set(fit)
