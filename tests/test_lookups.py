"""Lookups over whole tables; unmatched keys on hand-made panels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare
from conftest import rows
from tideline.fixtures.views import Fixtures
from tideline.operators import joins


@pytest.mark.parametrize("name", ["D1_rate_lookup", "D2_hpi_double_lookup", "D6_nearest_month_lookup"])
def test_whole_lookup_equals_its_oracle(spark, con, sf, name):
    text, ok = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert ok, text


def test_no_month_region_or_match_is_left_out(spark, sf):
    q, fx = entry.queries(), Fixtures(spark, sf)
    rates = q["D1_rate_lookup"](spark, sf)
    assert rates.filter("mmyyyy % 2 = 1 AND rate_30yr IS NOT NULL").count() > 0
    known = fx.loan.join(fx.hpi.select("zip3", "yyyymm"), ["zip3", "yyyymm"], "left_semi").count()
    assert q["D2_hpi_double_lookup"](spark, sf).agg(F.count("hpi_now")).first()[0] == known
    absent = fx.price.select("yyyymm").distinct().join(fx.market_rate, "yyyymm", "left_anti").count()
    assert q["D6_nearest_month_lookup"](spark, sf).filter("m <> matched_m").count() == absent


def test_unmatched_keys_are_null(spark):
    panel = spark.createDataFrame([(1, 3, 200001, 200002), (2, 3, 200001, 200009), (3, 8, 200001, 200002), (4, None, 200001, None)], "loan_id int, zip3 int, orig_ym int, yyyymm int")
    market = spark.createDataFrame([(200002, 8.25)], "yyyymm int, rate_30yr double")
    hpi = spark.createDataFrame([(3, 200001, 100.0), (3, 200002, 110.0)], "zip3 int, yyyymm int, hpi double")
    assert rows(joins.rate_lookup(panel, market), "loan_id", "rate_30yr") == [(1, 8.25), (2, None), (3, 8.25), (4, None)]
    assert rows(joins.hpi_double_lookup(panel, hpi), "loan_id", "hpi_orig", "hpi_now") == [(1, 100.0, 110.0), (2, 100.0, None), (3, None, None), (4, None, None)]


def test_nearest_month_over_a_gap(spark):
    d = lambda y, m: dt.date(y, m, 1)
    left = spark.createDataFrame([(d(2000, 1),), (d(2000, 2),), (d(2000, 4),), (d(2000, 9),)], "m date")
    right = spark.createDataFrame([(d(2000, 2), 1.0), (d(2000, 5), 2.0)], "m date, v double")
    out = joins.nearest_month_lookup(left, right, "m", "v")
    assert rows(out, "m", "matched_m", "v") == [(d(2000, 1), d(2000, 2), 1.0), (d(2000, 2), d(2000, 2), 1.0), (d(2000, 4), d(2000, 5), 2.0), (d(2000, 9), d(2000, 5), 2.0)]
