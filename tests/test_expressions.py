import math

import pytest
from pyspark.sql import functions as F

from tideline.functions import bins, hashing, periods, rates


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_period_keys_do_not_sort_raw(spark):
    df = spark.createDataFrame([(122018,), (12019,), (22019,)], "p bigint")
    raw = [r.p for r in df.orderBy("p").collect()]
    by_time = [r.p for r in df.orderBy(periods.to_yyyymm("p")).collect()]
    assert raw == [12019, 22019, 122018]
    assert by_time == [122018, 12019, 22019]


@pytest.mark.parametrize("text,want", [("122018", 201812), ("12019", 201901), ("1201", None), ("x2018", None), ("132018", None), ("", None), (None, None)])
def test_period_text_is_lenient(spark, text, want):
    df = spark.createDataFrame([(text,)], "p string")
    assert df.select(periods.to_yyyymm_text("p").alias("v")).first().v == want


def test_period_round_trip_and_months(spark):
    r = one(spark, back=periods.to_mmyyyy(F.lit(201812)), gap=periods.months_between_ym(F.lit(201811), F.lit(202002)),
            d=periods.period_to_date(F.lit(12019)), bad=periods.period_to_date(F.lit(991)))
    assert r.back == 122018 and r.gap == 15 and str(r.d) == "2019-01-01" and r.bad is None


@pytest.mark.parametrize("rate,bucket", [(2.25, 2.0), (2.75, 3.0), (3.25, 3.0), (3.3, 3.5)])
def test_coupon_bucket_is_half_even(spark, rate, bucket):
    assert one(spark, b=rates.coupon_bucket(F.lit(rate))).b == bucket


def test_speed_conversions(spark):
    r = one(spark, smm=rates.cpr_to_smm(F.lit(0.08)), top=rates.cpr_to_smm(F.lit(1.5)), cpr=rates.smm_to_cpr(F.lit(0.01)))
    assert math.isclose(r.smm, 1 - 0.92 ** (1 / 12)) and math.isclose(r.top, 1 - 0.01 ** (1 / 12)) and math.isclose(r.cpr, 1 - 0.99 ** 12)


def test_sigmoid_is_clipped_and_logit_bounded(spark):
    r = one(spark, s=rates.sigmoid(F.lit(-1e9)), l0=rates.logit(F.lit(0.0)), l1=rates.logit(F.lit(1.0)))
    assert r.s == 1 / (1 + math.exp(50)) and math.isclose(r.l0, math.log(1e-6 / (1 - 1e-6))) and math.isclose(r.l1, -r.l0, rel_tol=1e-6)


def test_current_ltv_uses_original_balance_and_guards_zero(spark):
    r = one(spark, v=rates.current_ltv(F.lit(80.0), F.lit(80.0), F.lit(100.0), F.lit(200.0)),
            z=rates.current_ltv(F.lit(80.0), F.lit(0.0), F.lit(100.0), F.lit(200.0)),
            h=rates.current_ltv(F.lit(80.0), F.lit(80.0), F.lit(0.0), F.lit(200.0)))
    assert math.isclose(r.v, 40.0) and r.z is None and r.h is None


@pytest.mark.parametrize("x,right,left", [(-1.5, "<-1.5", "-1.5..-1"), (0.0, "-0.5..0", "0..0.5"), (2.0, "1.5..2", ">2"), (2.1, ">2", ">2"), (None, None, None)])
def test_bins_close_on_the_stated_side(spark, x, right, left):
    df = spark.createDataFrame([(x,)], "x double")
    r = df.select(bins.incentive_bin("x").alias("r"), bins.bin_label("x", bins.INCENTIVE_EDGES, bins.INCENTIVE_LABELS, "left").alias("l")).first()
    assert (r.r, r.l) == (right, left)


@pytest.mark.parametrize("age,want", [(None, -1), (-1, -1), (0, 0), (59, 0), (60, 60), (119, 60), (120, 120)])
def test_seasoning(spark, age, want):
    assert spark.createDataFrame([(age,)], "a int").select(bins.seasoning_group("a").alias("g")).first().g == want


def test_categories_default_to_zero(spark):
    df = spark.createDataFrame([("R",), ("C",), ("P",), ("U",), (None,)], "p string")
    assert [r.v for r in df.select(bins.encode_category("p", bins.PURPOSE_CODES).alias("v")).collect()] == [0.0, 1.0, 2.0, 0.0, 0.0]


def test_betas_degenerate_and_discount(spark):
    r = one(spark, x=rates.beta_level(F.lit(3.0), F.lit(0.1), F.lit(6.0)), y=rates.beta_slope(F.lit(3.0), F.lit(0.1), F.lit(6.0)),
            z=rates.beta_level(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    assert math.isclose(r.x, (0.06 - 0.03) / (0.16 * 0.13)) and r.y == 0.0 and r.z == 0.0


def test_analytic_betas_known_values(spark):
    # speeds and a 6.19 par rate with their published loadings to six digits
    r = one(spark, x=rates.beta_level(F.lit(2.5), F.lit(0.0074), F.lit(6.19)))
    assert math.isclose(r.x, (0.0619 - 0.025) / ((0.0619 + 0.0074) * (0.0074 + 0.025)), rel_tol=1e-12)


def test_safe_corr_handles_flat_sides(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.5, 5.0), (None, 1.0, 5.0)], "x double, y double, z double")
    r = df.agg(rates.safe_corr("x", "y").alias("a"), rates.safe_corr("x", "z").alias("b")).first()
    assert 0.99 < r.a < 1 and r.b is None


def test_unit_hash_is_uniform_and_stable(spark):
    df = spark.range(20000).select(hashing.unit_hash("id").alias("u"))
    r = df.agg(F.avg("u").alias("m"), F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert abs(r.m - 0.5) < 0.01 and r.lo >= 0 and r.hi < 1
    assert spark.range(5).select(hashing.unit_hash("id")).collect() == spark.range(5).select(hashing.unit_hash("id")).collect()


def test_poisson_weights_have_unit_mean_and_variance(spark):
    r = spark.range(20000).select(hashing.poisson_weight("id", F.lit(7)).alias("k")).agg(F.avg("k").alias("m"), F.var_samp("k").alias("v")).first()
    assert abs(r.m - 1) < 0.03 and abs(r.v - 1) < 0.05
