"""What the pricing queries share is derived once, and the spread solver is exact enough to round."""

import math

import pytest

from tideline.catalog import memo, sequences
from tideline.catalog.survival import forecast_realized
from tideline.fixtures.views import CALENDAR, Fixtures
from tideline.plans import hazard, pricing


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_calendar_views_are_read_from_written_rows(spark, sf):
    fx = Fixtures(spark, sf)
    for name in CALENDAR:
        assert "lineitem" not in plan_of(fx.view(name)) and "orders" not in plan_of(fx.view(name)), name
        assert sorted(map(str, fx.view(name).collect())) == sorted(map(str, fx._sql(name, {}).collect())), name
    assert all(t not in plan_of(fx.forecast.join(fx.curve_daily, "mi")) for t in ("lineitem.parquet", "orders.parquet"))
    assert "orders" not in plan_of(forecast_realized(fx))
    assert plan_of(fx.loan).count("customer.parquet") == 1


def test_the_fit_derives_its_steps_once(spark, sf, monkeypatch):
    """Weights, fit and calibration read checkpointed steps, not the orders again."""
    seen = []

    def spy(steps, observed, names):
        seen.extend([plan_of(steps), plan_of(observed)])
        raise RuntimeError("seen")

    memo.forget()
    monkeypatch.setattr(hazard, "fit_index", spy)
    with pytest.raises(RuntimeError, match="seen"):
        sequences.fitted(Fixtures(spark, sf))
    assert len(seen) == 2 and not any("parquet" in p for p in seen)


def test_path_rows_are_dealt_over_the_cores(spark, sf):
    assert Fixtures(spark, sf).path.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_spread_solver_agrees_with_bisection(spark):
    """To 1e-8 bp: a coarser last bracket turns the second digit of some profiles."""
    coef = {"intercept": -5.0, "incentive": 0.4, "age": 0.02}
    paths = {p: [4.0 + ((p * 31 + t * 17) % 23) * 0.05 for t in range(1, 34)] for p in range(3)}

    def price(rate, active, spread):
        n, total = rate / 1200, 0.0
        pay = 100 * n / (1 - (1 + n) ** -360)
        for path in paths.values():
            bal, d = 100.0, 1.0
            for t, r in enumerate(path[:active], 1):
                hz = 1 / (1 + math.exp(-(coef["intercept"] + coef["incentive"] * (rate - r) + coef["age"] * t)))
                prin = min(pay - bal * n, bal)
                d *= 1 + ((r - 1.7) / 100 + spread / 10000) / 12
                total += (bal * n + prin + bal * hz) / d
                bal = max(bal - prin - bal * hz, 0)
        return total / len(paths)

    want, rows = {}, []
    for rate, active in ((3.0, 33), (4.25, 20), (6.5, 30)):
        market, lo, hi = price(rate, active, 41.37) * (1 + active / 5000), -500.0, 2000.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if price(rate, active, mid) > market else (lo, mid)
        want[rate] = lo
        rows.append((rate, active, market))
    chunks = pricing.packed_paths(spark.createDataFrame([(p, t, r) for p, v in paths.items() for t, r in enumerate(v, 1)], "path_id bigint, t bigint, rate double"), 1.7)
    out = pricing.oas_solve(spark.createDataFrame(rows, "note_rate double, n_active bigint, market double"), chunks, coef, "market")
    assert {r.note_rate: r.oas_bp for r in out.collect()} == pytest.approx(want, abs=1e-8)
