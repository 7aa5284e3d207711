"""Maps with a slope that is not positive are reported and applied; only the raising guard stops a job."""

import numpy as np
import pytest

from tideline.catalog import guards, pricing
from tideline.catalog.registry import QUERIES

SCHEMA = "coupon double, yyyymm bigint, mi bigint, forecast_cpr double, cpr_upb double, upb_atrisk double, inc double"


@pytest.fixture
def falling(spark, sf):
    """Cells of the table's own months whose realized speed falls in the forecast."""
    from tideline.fixtures.views import Fixtures

    rng = np.random.default_rng(3)
    months = sorted((r.yyyymm, r.mi) for r in Fixtures(spark, sf).market_rate.collect())
    rows = []
    for ym, mi in months:
        for c in range(4):
            f = float(rng.uniform(0.05, 0.4))
            rows.append((3.0 + c, ym, mi, f, 0.5 - f + float(rng.uniform(0, 0.05)), 1e6, 0.0))
    return spark.createDataFrame(rows, SCHEMA), len(months)


def test_refused_slopes_are_counted(spark, sf, monkeypatch, falling):
    df, months = falling
    monkeypatch.setattr(guards, "forecast_realized", lambda fx: df)
    r = QUERIES["N8_negative_slope_refused"](spark, sf).first()
    assert r.n_fits == r.n_refused == months - 25 and r.min_slope < 0


def test_a_falling_map_is_applied(spark, sf, monkeypatch, falling):
    df, months = falling
    monkeypatch.setattr(pricing, "forecast_realized", lambda fx: df)
    out = QUERIES["K5_apply_cpr_mapping"](spark, sf)
    got = {r.applied: r.n for r in out.groupBy("applied").count().withColumnRenamed("count", "n").collect()}
    assert got[True] > 0 and got[False] > 0
    assert out.filter("applied AND pointwise = off").isEmpty()
