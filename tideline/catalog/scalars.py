"""2.B scalar expressions over the loan, price and curve views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import R, query, rnd
from tideline.functions import bins, curves, periods, rates

# fixed values: terminal speed curve used where no fit is supplied
TERMINAL = {"floor": 0.0459, "sat": 0.2204, "k": 3.0, "x0": 0.4}
# fixed values: score-to-probability map used where no fit is supplied
PLATT = {"a": 0.8, "b": -4.5}

PHI = "0.02 + 0.01*coupon"


def with_rate(fx, df):
    """Attach the month's market rate (one row per calendar month: bounded)."""
    return df.join(F.broadcast(fx.market_rate.select("yyyymm", "rate_30yr")), "yyyymm")


@query("B1_to_yyyymm", "f_loan", """
SELECT loan_id, mmyyyy, (mmyyyy % 10000)*100 + mmyyyy // 10000 AS yyyymm_num,
       CASE WHEN length(CAST(mmyyyy AS VARCHAR)) = 5
            THEN CAST(substr(CAST(mmyyyy AS VARCHAR), 2, 4) || '0' || substr(CAST(mmyyyy AS VARCHAR), 1, 1) AS BIGINT)
            WHEN length(CAST(mmyyyy AS VARCHAR)) = 6
            THEN CAST(substr(CAST(mmyyyy AS VARCHAR), 3, 4) || substr(CAST(mmyyyy AS VARCHAR), 1, 2) AS BIGINT) END AS yyyymm_text
FROM f_loan""")
def _(fx):
    return fx.loan.select(
        "loan_id", "mmyyyy",
        periods.to_yyyymm("mmyyyy").alias("yyyymm_num"),
        periods.to_yyyymm_text("mmyyyy").alias("yyyymm_text"),
    )


@query("B2_to_mmyyyy", "f_loan", """
SELECT loan_id, yyyymm, (yyyymm % 100)*10000 + yyyymm // 100 AS mmyyyy2 FROM f_loan""")
def _(fx):
    return fx.loan.select("loan_id", "yyyymm", periods.to_mmyyyy("yyyymm").alias("mmyyyy2"))


@query("B3_period_to_date", "f_loan", """
SELECT loan_id, mmyyyy, make_date(mmyyyy % 10000, mmyyyy // 10000, 1) AS month_start FROM f_loan""")
def _(fx):
    return fx.loan.select("loan_id", "mmyyyy", periods.period_to_date("mmyyyy").alias("month_start"))


@query("B4_month_floor", "f_curve_daily", """
SELECT d, CAST(date_trunc('month', d) AS DATE) AS month_start FROM f_curve_daily""")
def _(fx):
    return fx.curve_daily.select("d", periods.month_floor("d").alias("month_start"))


@query("B5_months_between_ym", "f_loan", """
SELECT loan_id, yyyymm, (yyyymm//100 - orig_ym//100)*12 + (yyyymm%100 - orig_ym%100) AS age FROM f_loan""")
def _(fx):
    return fx.loan.select("loan_id", "yyyymm", periods.months_between_ym("orig_ym", "yyyymm").alias("age"))


@query("B6_lenient_numeric", "", """
SELECT p_partkey, TRY_CAST(p_size AS DOUBLE) AS from_number, TRY_CAST(p_brand AS DOUBLE) AS from_text,
       TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS from_digits FROM part""")
def _(fx):
    p = fx.table("part")
    return p.select(
        "p_partkey",
        rates.lenient_numeric(F.col("p_size").cast("string")).alias("from_number"),
        rates.lenient_numeric("p_brand").alias("from_text"),
        rates.lenient_numeric(F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit(""))).alias("from_digits"),
    )


@query("B7_coupon_bucket", "f_loan", """
SELECT loan_id, yyyymm, round_even(note_rate*2, 0)/2 AS bucket, round(round_even(note_rate*2, 0)/2 - 0.5, 2) AS implied,
       round_even((note_rate-0.5)*2, 0)/2 AS bucket_net FROM f_loan""")
def _(fx):
    return fx.loan.select(
        "loan_id", "yyyymm",
        rates.coupon_bucket("note_rate").alias("bucket"),
        rates.implied_coupon(rates.coupon_bucket("note_rate")).alias("implied"),
        rates.coupon_bucket_net("note_rate").alias("bucket_net"),
    )


@query("B8_refi_incentive", "f_loan f_market_rate", """
SELECT l.loan_id, l.yyyymm, l.note_rate - m.rate_30yr AS incentive, greatest(0.0, l.note_rate - m.rate_30yr) AS relu_incentive,
       (round_even(note_rate*2, 0)/2 - 0.5 + 0.5) - m.rate_30yr AS moneyness
FROM f_loan l JOIN f_market_rate m ON l.yyyymm = m.yyyymm""")
def _(fx):
    inc = rates.incentive("note_rate", "rate_30yr")
    coupon = rates.implied_coupon(rates.coupon_bucket("note_rate"))
    return rnd(with_rate(fx, fx.loan).select(
        "loan_id", "yyyymm", inc.alias("incentive"), rates.relu(inc).alias("relu_incentive"),
        (coupon + rates.SERVICING_SPREAD - F.col("rate_30yr")).alias("moneyness"),
    ))


@query("B9_current_ltv", "f_loan f_hpi", f"""
SELECT l.loan_id, l.yyyymm,
  {R("l.orig_upb / nullif((l.orig_upb / nullif(l.ltv/100, 0)) * (n.hpi / nullif(o.hpi, 0)), 0) * 100")} AS current_ltv
FROM f_loan l LEFT JOIN f_hpi o ON l.zip3=o.zip3 AND l.orig_ym=o.yyyymm
LEFT JOIN f_hpi n ON l.zip3=n.zip3 AND l.yyyymm=n.yyyymm""")
def _(fx):
    from tideline.operators import joins

    df = joins.hpi_double_lookup(fx.loan, fx.hpi)
    return rnd(df.select(
        "loan_id", "yyyymm", rates.current_ltv("orig_upb", "ltv", "hpi_orig", "hpi_now").alias("current_ltv")
    ))


@query("B10_encode_category", "f_loan", """
SELECT loan_id, yyyymm, CASE purpose WHEN 'R' THEN 0.0 WHEN 'C' THEN 1.0 WHEN 'P' THEN 2.0 ELSE 0.0 END::DOUBLE AS purpose_enc,
 CASE property_type WHEN 'SF' THEN 0 WHEN 'PU' THEN 1 WHEN 'CO' THEN 2 WHEN 'MH' THEN 3 ELSE 0 END::DOUBLE AS property_enc FROM f_loan""")
def _(fx):
    return fx.loan.select(
        "loan_id", "yyyymm",
        bins.encode_category("purpose", bins.PURPOSE_CODES).alias("purpose_enc"),
        bins.encode_category("property_type", bins.PROPERTY_CODES).alias("property_enc"),
    )


@query("B11_smm_cpr", "f_forecast", f"""
SELECT coupon, yyyymm, {R("1-pow(1-least(greatest(forecast_cpr,0),0.99),1.0/12)", 9)} AS smm,
 {R("1-pow(1-(1-pow(1-least(greatest(forecast_cpr,0),0.99),1.0/12)),12)", 9)} AS cpr_back FROM f_forecast""")
def _(fx):
    smm = rates.cpr_to_smm("forecast_cpr")
    return rnd(fx.forecast.select("coupon", "yyyymm", smm.alias("smm"), rates.smm_to_cpr(smm).alias("cpr_back")), 9)


@query("B12_sigmoid_logit_platt", "f_forecast", f"""
SELECT coupon, yyyymm, {R("ln(forecast_cpr/(1-forecast_cpr))")} AS logit_cpr, {R("1/(1+exp(-(coupon-rate_30yr)))")} AS sig,
 {R(f"1/(1+exp(-({PLATT['a']}*(coupon-rate_30yr)+({PLATT['b']}))))", 9)} AS calibrated FROM f_forecast""")
def _(fx):
    x = F.col("coupon") - F.col("rate_30yr")
    return rnd(fx.forecast.select(
        "coupon", "yyyymm", rates.logit("forecast_cpr").alias("logit_cpr"), rates.sigmoid(x).alias("sig"),
        rates.platt(x, **PLATT).alias("calibrated"),
    ), calibrated=9)


@query("B13_bin_right_closed", "f_loan f_market_rate", """
SELECT l.loan_id, l.yyyymm, CASE WHEN i <= -1.5 THEN '<-1.5' WHEN i <= -1 THEN '-1.5..-1' WHEN i <= -0.5 THEN '-1..-0.5'
 WHEN i <= 0 THEN '-0.5..0' WHEN i <= 0.5 THEN '0..0.5' WHEN i <= 1 THEN '0.5..1' WHEN i <= 1.5 THEN '1..1.5'
 WHEN i <= 2 THEN '1.5..2' ELSE '>2' END AS refi_bin
FROM (SELECT f_loan.loan_id, f_loan.yyyymm, note_rate - rate_30yr AS i FROM f_loan JOIN f_market_rate m ON f_loan.yyyymm = m.yyyymm) l""")
def _(fx):
    df = with_rate(fx, fx.loan)
    return df.select("loan_id", "yyyymm", bins.incentive_bin(F.col("note_rate") - F.col("rate_30yr")).alias("refi_bin"))


@query("B14_bin_left_closed", "f_loan", """
SELECT loan_id, yyyymm,
 CASE WHEN fico IS NULL THEN NULL WHEN fico < 640 THEN '<640' WHEN fico < 680 THEN '640-680' WHEN fico < 720 THEN '680-720' WHEN fico < 760 THEN '720-760' ELSE '760+' END AS fico_bucket,
 CASE WHEN ltv < 60 THEN '<60' WHEN ltv < 70 THEN '60-70' WHEN ltv < 80 THEN '70-80' WHEN ltv < 90 THEN '80-90' ELSE '90+' END AS ltv_bucket,
 CASE WHEN age < 6 THEN '0-6m' WHEN age < 12 THEN '6-12m' WHEN age < 24 THEN '12-24m' WHEN age < 34 THEN '24-33m' END AS age_bucket
FROM (SELECT *, mi - ((orig_ym//100)*12 + orig_ym%100) AS age FROM f_loan)""")
def _(fx):
    from tideline.operators.scoring import SEGMENTS

    df = fx.loan.withColumn("age", periods.months_between_ym("orig_ym", "yyyymm"))
    pick = lambda col, seg: bins.bin_label(col, *SEGMENTS[seg], "left")
    return df.select(
        "loan_id", "yyyymm", pick("fico", "fico_bucket").alias("fico_bucket"),
        pick("ltv", "ltv_bucket").alias("ltv_bucket"), pick("age", "loan_age_bucket").alias("age_bucket"),
    )


@query("B15_seasoning_group", "f_loan", """
SELECT loan_id, yyyymm, CASE WHEN file_age IS NULL OR file_age < 0 THEN -1 WHEN file_age < 60 THEN 0 WHEN file_age < 120 THEN 60 ELSE 120 END AS age_group FROM f_loan""")
def _(fx):
    return rnd(fx.loan.select("loan_id", "yyyymm", bins.seasoning_group("file_age").alias("age_group")))


@query("B16_market_type", "f_forecast", """
SELECT coupon, yyyymm, CASE WHEN rate_30yr > 3.5 THEN 'DM' ELSE 'PM' END AS market_type,
 CASE WHEN coupon > rate_30yr THEN 'premium' ELSE 'discount' END AS security_type FROM f_forecast""")
def _(fx):
    return fx.forecast.select(
        "coupon", "yyyymm", rates.market_type("rate_30yr").alias("market_type"),
        rates.security_type("coupon", "rate_30yr").alias("security_type"),
    )


@query("B17_analytic_betas", "f_forecast", f"""
SELECT coupon, yyyymm, {R("(r-c)/((r+phi)*(phi+c))")} AS beta_x, {R("(r-c)/((r+phi)*(phi+c))*greatest(0, coupon+0.5-rate_30yr)/100")} AS beta_y
FROM (SELECT *, rate_30yr/100 AS r, coupon/100 AS c, forecast_cpr AS phi FROM f_forecast)""")
def _(fx):
    return rnd(fx.forecast.select(
        "coupon", "yyyymm", rates.beta_level("coupon", "forecast_cpr", "rate_30yr").alias("beta_x"),
        rates.beta_slope("coupon", "forecast_cpr", "rate_30yr").alias("beta_y"),
    ))


@query("B18_scurve", "f_forecast", f"""
SELECT coupon, yyyymm, {R("0.0459 + (0.2204-0.0459)/(1+exp(-3.0*((coupon+0.5-rate_30yr)-0.4)))")} AS terminal_cpr FROM f_forecast""")
def _(fx):
    x = F.col("coupon") + 0.5 - F.col("rate_30yr")
    return rnd(fx.forecast.select("coupon", "yyyymm", rates.scurve(x, **TERMINAL).alias("terminal_cpr")))


_NODE_SQL = "SELECT d, unnest([1.0/12,0.25,0.5,1,2,3,5,7,10,20,30]) AS t, unnest([m1,m3,m6,y1,y2,y3,y5,y7,y10,y20,y30]) AS y FROM f_curve_daily"


@query("B19_tent_weights", "f_curve_daily", f"""
WITH n AS ({_NODE_SQL}),
w AS (SELECT d, t, y,
  CASE WHEN t > 3 AND t <= 5 THEN (t-3)/2 WHEN t > 5 AND t < 7 THEN (7-t)/2 ELSE 0 END AS l5,
  CASE WHEN t > 7 AND t <= 10 THEN (t-7)/3 WHEN t > 10 AND t < 20 THEN (20-t)/10 ELSE 0 END AS l10,
  least(greatest((10-t)/5, 0), 1) AS s5,
  CASE WHEN t <= 2 THEN 1 WHEN t <= 5 THEN (5-t)/3 ELSE 0 END AS t2,
  CASE WHEN t <= 2 THEN 0 WHEN t <= 5 THEN (t-2)/3 WHEN t <= 10 THEN (10-t)/5 ELSE 0 END AS t5,
  CASE WHEN t <= 5 THEN 0 WHEN t <= 10 THEN (t-5)/5 ELSE 1 END AS t10 FROM n)
SELECT d, {R("sum(l5*y)")} AS local5, {R("sum(l10*y)")} AS local10, {R("sum(s5*y)")} AS span5, {R("sum((1-s5)*y)")} AS span10,
 {R("sum(t2*y)")} AS tent2, {R("sum(t5*y)")} AS tent5, {R("sum(t10*y)")} AS tent10, {R("sum(t2+t5+t10)")} AS unity FROM w GROUP BY d""")
def _(fx):
    """Each daily curve projected on the bump shapes; the tents sum to one."""
    def project(shape):
        w = curves.bump_weights(shape)
        total = F.lit(0.0)
        for name, weight in zip(curves.TENORS, w):
            total = total + F.lit(float(weight)) * F.col(name)
        return total

    shapes = {"local5": "local_5", "local10": "local_10", "span5": "span_5", "span10": "span_10",
              "tent2": "tent_2", "tent5": "tent_5", "tent10": "tent_10"}
    unity = sum(sum(curves.bump_weights(s)) for s in ("tent_2", "tent_5", "tent_10"))
    return rnd(fx.curve_daily.select(
        "d", *[project(s).alias(n) for n, s in shapes.items()], F.lit(float(unity)).alias("unity")
    ))


@query("B20_duration_transform", "f_curve_daily", f"""
SELECT d, {R("y2+y5+y10")} AS d_level3, {R("(y10-y2)/2")} AS d_slope3, {R("(2*y5-y2-y10)/6")} AS d_curve3,
 {R("y5+y10")} AS d_level2, {R("(y10-y5)/2")} AS d_slope2 FROM f_curve_daily""")
def _(fx):
    return rnd(fx.curve_daily.select(
        "d", rates.duration_level("y2", "y5", "y10").alias("d_level3"), rates.duration_slope("y2", "y10").alias("d_slope3"),
        rates.duration_curve("y2", "y5", "y10").alias("d_curve3"),
        rates.duration_level("y5", "y10").alias("d_level2"), rates.duration_slope("y5", "y10").alias("d_slope2"),
    ))


@query("B21_curve_basis", "f_curve_daily", f"""
WITH me AS (SELECT yyyymm, mi, arg_max(y2,d) y2, arg_max(y5,d) y5, arg_max(y10,d) y10 FROM f_curve_daily GROUP BY 1,2)
SELECT yyyymm, {R("((y5+y10)/2) - lag((y5+y10)/2) OVER w")} AS d_level, {R("(y10-y5) - lag(y10-y5) OVER w")} AS d_slope,
 {R("((y2+y5+y10)/3) - lag((y2+y5+y10)/3) OVER w")} AS d_level3, {R("(y10-y2) - lag(y10-y2) OVER w")} AS d_slope3,
 {R("(2*y5-y2-y10) - lag(2*y5-y2-y10) OVER w")} AS d_curve3 FROM me WINDOW w AS (ORDER BY mi)""")
def _(fx):
    from tideline.operators import series

    me = series.month_end(fx.curve_daily, ["y2", "y5", "y10"])
    return rnd(series.curve_basis(me).select("yyyymm", "d_level", "d_slope", "d_level3", "d_slope3", "d_curve3"))


@query("B22_balance_weights", "f_loan", f"""
SELECT loan_id, yyyymm, {R("upb / sum(upb) OVER (PARTITION BY yyyymm)", 9)} AS w FROM f_loan""")
def _(fx):
    from tideline.operators.series import share_of_total

    return rnd(share_of_total(fx.loan, "upb", ["yyyymm"], "w").select("loan_id", "yyyymm", "w"), 9)


@query("B23_perpetuity_duration", "f_forecast", f"""
SELECT coupon, yyyymm, {R("1/(rate_30yr/100+forecast_cpr)")} AS duration FROM f_forecast""")
def _(fx):
    return rnd(fx.forecast.select("coupon", "yyyymm", rates.perpetuity_duration("rate_30yr", "forecast_cpr").alias("duration")))
