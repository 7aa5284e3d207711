"""The safety screen of the mapping search against a scan of every map in numpy, and the least-weight sweep."""

import numpy as np
import pytest

from tideline.operators import scoring
from tideline.plans import mapping

SCHEMA = "coupon double, yyyymm int, mi int, forecast_cpr double, cpr_upb double, upb_atrisk double, inc double"
EDGES = [-99.0, -2.5, -1.5, -0.5, 0.5, 1.5, 99.0]


def panel(spark, slope, months=40, coupons=8, noise=0.02, seed=4):
    """Realized log speed with a slope on the model's that may depend on the incentive."""
    rng, rows = np.random.default_rng(seed), []
    for m in range(months):
        for c in range(coupons):
            inc = float(rng.uniform(-2, 1.5))
            f = float(np.exp(rng.uniform(-4, -1)))
            y = float(np.exp(-1.5 + 0.2 * inc + slope(inc) * (np.log(f) + 2.5) + noise * rng.normal()))
            rows.append((2.5 + 0.5 * c, 201000 + m, m, f, min(y, 0.95), float(rng.uniform(1, 9)), inc))
    return rows, mapping.cells(spark.createDataFrame(rows, SCHEMA))


def scan(rows, coefs):
    """Flags per specification by evaluating each map of each cutoff on each slice."""
    a = np.array(rows)
    inc, f = a[:, 6], a[:, 3]
    lo, hi = np.floor(inc.min() / 0.25) * 0.25, np.ceil(inc.max() / 0.25) * 0.25
    slices = []
    for left in np.arange(lo, hi, 0.25):
        mine = f[(inc >= left) & (inc < left + 0.25)]
        if len(mine) >= 3:
            slices.append((left + 0.125, np.exp(np.linspace(np.log(mine.min()) - 0.35, np.log(mine.max()) + 0.35, 40))))
    out = {}
    for r in coefs:
        for mid, speeds in slices:
            b = next(i for i in range(6) if EDGES[i] < mid <= EDGES[i + 1])
            if r.inc_bucket is not None and r.inc_bucket != ["<=-2.5", "-2.5..-1.5", "-1.5..-0.5", "-0.5..0.5", "0.5..1.5", ">1.5"][b]:
                continue
            c = np.clip(speeds, 1e-6, 1 - 1e-6)
            t = np.log(c) if r.family == "log" else np.log(c / (1 - c))
            v = r.b0 + r.b_t * t + r.b_inc * mid + r.b_inc2 * mid**2 + r.b_inc_t * mid * t
            v = speeds if r.family == "identity" else np.exp(v) if r.family == "log" else 1 / (1 + np.exp(-v))
            mono, inside, worst = out.get(r.spec, (True, True, (0.0, None)))
            if (v <= 0).any() or (v >= 1).any():
                worst = max(worst, (float(v.max()), mid), key=lambda w: w[0])
            out[r.spec] = (mono and bool((np.diff(v) > 0).all()), inside and bool(((v > 0) & (v < 1)).all()), worst)
    return out


@pytest.mark.parametrize("slope", [lambda inc: 0.5 + 0.45 * inc, lambda inc: 1.4])
def test_screen_equals_a_scan_of_every_map(spark, slope):
    rows, df = panel(spark, slope)
    coefs = mapping.coefficients(df, min_months=24).cache()
    want = scan(rows, coefs.collect())
    got = {r.spec: (r.monotone, r.in_range, r.worst_inc) for r in mapping.safety(df, coefs).collect()}
    assert set(got) == set(want) and len(got) == 11
    for spec, (mono, inside, worst) in want.items():
        assert got[spec] == (mono, inside, worst[1]), spec


def test_a_map_that_falls_somewhere_loses(spark):
    """The slope turns negative at deep discounts: the interaction fits best and is refused."""
    _, df = panel(spark, lambda inc: 0.5 + 0.45 * inc)
    coefs = mapping.coefficients(df, min_months=24).cache()
    scores = scoring.weighted_scores(mapping.search(df, coefs=coefs), "upb_atrisk", ["spec"]).cache()
    screen = mapping.safety(df, coefs).cache()
    flags = {r.spec: r for r in screen.collect()}
    unscreened = scores.filter("spec <> 'identity'").orderBy("log_rmse").first().spec
    assert unscreened in ("loglog_interact", "loglog_quad") and not flags[unscreened].monotone and flags[unscreened].n_unsafe > 0
    chosen = mapping.best_safe(scores, screen).first()
    assert flags[chosen.spec].monotone and flags[chosen.spec].in_range and chosen.spec != "identity"
    safe = [r for r in scores.collect() if flags[r.spec].monotone and flags[r.spec].in_range and r.spec != "identity"]
    assert chosen.log_rmse == min(r.log_rmse for r in safe)


def test_no_map_where_none_is_safe(spark):
    _, df = panel(spark, lambda inc: -0.6)
    coefs = mapping.coefficients(df, min_months=24).cache()
    scores = scoring.weighted_scores(mapping.search(df, coefs=coefs), "upb_atrisk", ["spec"])
    assert mapping.best_safe(scores, mapping.safety(df, coefs)).first().spec == "identity"


def test_sweep_equals_a_search_per_least_weight(spark):
    _, df = panel(spark, lambda inc: 0.7, noise=0.2)
    swept = {r.min_upb: r for r in mapping.weight_sweep(df, [0.0, 3.0, 5.0], min_months=20).collect()}
    assert set(swept) == {0.0, 3.0, 5.0}
    for least, r in swept.items():
        own = df.filter(f"upb_atrisk >= {least}")
        scores = {s.spec: s.log_rmse for s in scoring.weighted_scores(mapping.search(own, min_months=20), "upb_atrisk", ["spec"]).collect()}
        best = min(v for k, v in scores.items() if k != "identity")
        assert r.cells == own.count() and r.identity == pytest.approx(scores["identity"]) and r.best == pytest.approx(best)
        assert r.reduction_pct == pytest.approx(100 * (r.identity - r.best) / r.identity)
