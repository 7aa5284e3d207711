"""2.E aggregations: payoffs, prepayment speeds, profiles and shares."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tideline.catalog.memo import table
from tideline.catalog.registry import R, query, rnd
from tideline.functions import bins, periods, rates
from tideline.operators import joins, ordering, profiles, scoring, selection, series, survival

AGE = "mi - ((orig_ym//100)*12 + orig_ym%100)"

# per-loan state shared by the oracles below
STATE = """st AS (
  SELECT loan_id, last_ym, last_upb, last_rate, first_rate,
         CASE WHEN last_upb = 0 THEN last_ym END AS pm, CASE WHEN last_upb = 0 THEN prior_upb END AS pb
  FROM (SELECT loan_id, max(yyyymm) AS last_ym, max(CASE WHEN rd=1 THEN upb END) AS last_upb, max(CASE WHEN rd=2 THEN upb END) AS prior_upb,
               max(CASE WHEN rd=1 THEN note_rate END) AS last_rate, max(CASE WHEN ra=1 THEN note_rate END) AS first_rate
        FROM (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY yyyymm DESC) AS rd,
                        row_number() OVER (PARTITION BY loan_id ORDER BY yyyymm) AS ra FROM f_loan) GROUP BY loan_id))"""
WEIGHT = """w AS (SELECT l.*, st.pm, st.pb, round_even(st.first_rate*2, 0)/2 AS cb,
  (l.yyyymm = pm) IS TRUE AS is_pay, (pm IS NULL OR l.yyyymm < pm) AS is_act,
  CASE WHEN l.yyyymm = pm THEN pb ELSE upb END AS wt FROM f_loan l JOIN st USING (loan_id))"""


def speeds_sql(keys: str, extra: str = "", raw: bool = False) -> str:
    R = (lambda e, _=0: f"({e})") if raw else globals()["R"]
    return f"""SELECT cb AS coupon_bucket, round(cb-0.5, 2) AS implied_mbs_coupon, yyyymm, {keys}
 n_atrisk, n_prepay, {R("upb_atrisk", 2)} AS upb_atrisk, {R("upb_prepay", 2)} AS upb_prepay,
 {R("upb_prepay/upb_atrisk", 8)} AS smm_upb, {R("1-pow(1-upb_prepay/upb_atrisk,12)", 8)} AS cpr_upb,
 {R("n_prepay/n_atrisk", 8)} AS smm_count, {R("1-pow(1-n_prepay/n_atrisk,12)", 8)} AS cpr_count
FROM (SELECT cb, yyyymm, {keys} count(*) FILTER (is_act OR is_pay) AS n_atrisk, count(*) FILTER (is_pay) AS n_prepay,
  sum(wt) FILTER (is_act OR is_pay) AS upb_atrisk, coalesce(sum(wt) FILTER (is_pay), 0) AS upb_prepay
  FROM w WHERE wt IS NOT NULL AND wt >= 0 GROUP BY cb, yyyymm{(", " + keys.rstrip(" ,")) if keys else ""}) WHERE upb_atrisk > 0 {extra}"""


SPEED_COLS = ["coupon_bucket", "implied_mbs_coupon", "yyyymm", "n_atrisk", "n_prepay",
              "upb_atrisk", "upb_prepay", "smm_upb", "cpr_upb", "smm_count", "cpr_count"]


def tidy(df, *keys):
    return rnd(df.select(*SPEED_COLS, *keys), 8, upb_atrisk=2, upb_prepay=2)


@query("E1_last_appearance", "f_loan", f"""WITH {STATE} SELECT loan_id, last_ym, last_upb, last_rate, pm AS payoff_ym FROM st""")
def _(fx):
    return survival.last_appearance(fx.loan)


@query("E2_payoff_balance", "f_loan", f"""WITH {STATE} SELECT loan_id, pm AS payoff_ym, pb AS payoff_balance FROM st WHERE pm IS NOT NULL""")
def _(fx):
    return survival.payoff_balance(fx.loan)


@query("E3_realized_cpr_count", "f_loan", f"""WITH {STATE}
SELECT cb AS coupon_bucket, round(cb-0.5,2) AS implied_mbs_coupon, yyyymm, n_atrisk, n_prepay, {R("n_prepay/n_atrisk", 8)} AS smm, {R("1-pow(1-n_prepay/n_atrisk,12)", 8)} AS cpr
FROM (SELECT round_even(last_rate*2,0)/2 AS cb, yyyymm, count(*) FILTER (pm IS NULL OR yyyymm <= pm) AS n_atrisk, count(*) FILTER (yyyymm = pm) AS n_prepay
 FROM f_loan JOIN st USING (loan_id) GROUP BY 1, 2) WHERE n_atrisk > 0""")
def _(fx):
    out = survival.realized_cpr_count(fx.loan)
    return rnd(out.select("coupon_bucket", "implied_mbs_coupon", "yyyymm", "n_atrisk", "n_prepay", "smm", "cpr"), 8)


@query("E4_realized_cpr_upb", "f_loan", f"WITH {STATE}, {WEIGHT} " + speeds_sql(""))
def _(fx):
    return tidy(survival.realized_cpr_balance(fx.loan))


def aged(fx):
    return fx.loan.withColumn("age", periods.months_between_ym("orig_ym", "yyyymm")).withColumn(
        "age_group", bins.seasoning_group("age"))


def by_age(fx):
    return survival.realized_cpr_balance(aged(fx), keys=("age_group",))


AGE_KEY = WEIGHT.replace("SELECT l.*", f"SELECT l.*, CASE WHEN {AGE} < 0 THEN -1 WHEN {AGE} < 60 THEN 0 WHEN {AGE} < 120 THEN 60 ELSE 120 END AS age_group")


@query("E5_realized_cpr_byage", "f_loan", f"WITH {STATE}, {AGE_KEY} " + speeds_sql("age_group,"))
def _(fx):
    out = by_age(fx)
    return tidy(out.withColumn("age_group", F.col("age_group").cast("bigint")), "age_group")


COHORTS = {
    "early": [f"{y}Q{q}" for y in range(1995, 1998) for q in range(1, 5)],
    "late": [f"{y}Q{q}" for y in range(1996, 2002) for q in range(1, 5)],
}


@query("E6_realized_cpr_by_incentive", "f_loan f_market_rate", f"""
WITH tagged AS (SELECT l.*, {AGE} AS age, c.cohort FROM f_loan l JOIN (SELECT 'early' AS cohort, 1995 AS a, 1997 AS b UNION ALL SELECT 'late', 1996, 2001) c
   ON CAST(substr(l.vintage,1,4) AS INT) BETWEEN c.a AND c.b),
st AS (SELECT cohort, loan_id, max(yyyymm) AS last_ym, arg_max_null(upb, yyyymm) AS last_upb, arg_max_null(note_rate, yyyymm) AS rate FROM tagged GROUP BY 1, 2),
x AS (SELECT t.cohort, t.yyyymm, CASE WHEN last_upb = 0 THEN last_ym END AS pm, st.rate - m.rate_30yr AS inc
   FROM tagged t JOIN st USING (cohort, loan_id) JOIN f_market_rate m ON t.yyyymm = m.yyyymm WHERE t.age <= 33)
SELECT cohort, refi_bin, n_atrisk, n_prepay, {R("n_prepay/n_atrisk", 8)} AS smm, {R("1-pow(1-n_prepay/n_atrisk,12)", 6)} AS cpr FROM (
 SELECT cohort, CASE WHEN inc <= -1.5 THEN '<-1.5' WHEN inc <= -1 THEN '-1.5..-1' WHEN inc <= -0.5 THEN '-1..-0.5'
 WHEN inc <= 0 THEN '-0.5..0' WHEN inc <= 0.5 THEN '0..0.5' WHEN inc <= 1 THEN '0.5..1' WHEN inc <= 1.5 THEN '1..1.5' WHEN inc <= 2 THEN '1.5..2' ELSE '>2' END AS refi_bin,
 count(*) FILTER (pm IS NULL OR yyyymm <= pm) AS n_atrisk, count(*) FILTER (yyyymm = pm) AS n_prepay FROM x GROUP BY 1, 2) WHERE n_atrisk > 0""")
def _(fx):
    out = survival.realized_cpr_by_incentive(aged(fx), fx.market_rate, COHORTS, bins.incentive_bin)
    return rnd(out.select("cohort", "refi_bin", "n_atrisk", "n_prepay", "smm", "cpr"), 8, cpr=6)


@query("E7_realized_cpr_zbc", "f_loan", f"""
WITH c AS (SELECT round_even(note_rate*2,0)/2 AS cb, yyyymm, count(*) AS n, count(*) FILTER (zbc = 1) AS p FROM f_loan GROUP BY 1, 2)
SELECT cb AS coupon_bucket, CAST(sum(n) AS BIGINT) AS n_atrisk, CAST(sum(p) AS BIGINT) AS n_prepay, {R("sum((1-pow(1-p/n,12))*n)/sum(n)")} AS mean_cpr FROM c GROUP BY 1""")
def _(fx):
    cells = survival.realized_cpr_flagged(fx.loan, rates.coupon_bucket("note_rate"), F.col("zbc") == 1)
    out = cells.groupBy("coupon_bucket").agg(
        F.sum("n_atrisk").alias("n_atrisk"), F.sum("n_prepay").alias("n_prepay_"),
        F.try_divide(F.sum(F.col("cpr") * F.col("n_atrisk")), F.sum("n_atrisk")).alias("mean_cpr"),
    ).withColumnRenamed("n_prepay_", "n_prepay")
    return rnd(out)


@query("E8_rollup_age", "f_loan", f"WITH {STATE}, {AGE_KEY.replace('FROM f_loan l JOIN st', 'FROM f_loan l JOIN st')}, z AS (SELECT * FROM w WHERE age_group >= 0) "
       + speeds_sql("").replace("FROM w WHERE", "FROM z WHERE"))
def _(fx):
    """Seasoning levels of the age cube rolled back up: sums first, then speeds."""
    cells = by_age(fx).filter(F.col("age_group") >= 0)
    out = survival.rollup_speeds(cells, ["coupon_bucket", "yyyymm"])
    return tidy(out.withColumn("implied_mbs_coupon", rates.implied_coupon("coupon_bucket")))


@query("E9_ever_event_label", "f_loan", """
SELECT loan_id, yyyymm, CAST(max(CASE WHEN zbc = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY loan_id) AS BIGINT) AS prepaid FROM f_loan""")
def _(fx):
    return rnd(survival.with_ever_event(fx.loan, F.col("zbc") == 1).select("loan_id", "yyyymm", "prepaid"))


@query("E10_loan_dedupe_label", "f_loan", """
SELECT loan_id, CAST(max(CASE WHEN zbc = 1 THEN 1 ELSE 0 END) AS BIGINT) AS label FROM f_loan GROUP BY 1""")
def _(fx):
    """Per-vintage loan labels, unioned, then one row per loan with the largest."""
    per_vintage = fx.loan.groupBy("vintage", "loan_id").agg(F.max(F.when(F.col("zbc") == 1, 1).otherwise(0)).alias("label"))
    return rnd(per_vintage.groupBy("loan_id").agg(F.max("label").alias("label")))


@query("E11_last_obs_snapshot", "f_loan", """
SELECT loan_id, arg_max(upb, yyyymm) AS upb, arg_max(file_age, yyyymm) AS file_age, arg_max(fico, yyyymm) AS fico, arg_max(zbc, yyyymm) AS zbc,
 arg_max(zip3, yyyymm) AS zip3, arg_max(note_rate, yyyymm) AS note_rate FROM f_loan GROUP BY 1""")
def _(fx):
    return survival.last_known(fx.loan, ["upb", "file_age", "fico", "zbc", "zip3", "note_rate"])


@query("E12_label_rate", "f_loan", f"""
WITH l AS (SELECT vintage, loan_id, max(CASE WHEN zbc = 1 THEN 1.0 ELSE 0 END) AS y FROM f_loan GROUP BY 1, 2)
SELECT coalesce(vintage, 'all') AS vintage, count(*) AS n_loans, {R("avg(y)")} AS event_rate FROM l GROUP BY GROUPING SETS ((vintage), ())""")
def _(fx):
    labels = fx.loan.groupBy("vintage", "loan_id").agg(F.max(F.when(F.col("zbc") == 1, 1.0).otherwise(0.0)).alias("y"))
    out = labels.rollup("vintage").agg(F.count(F.lit(1)).alias("n_loans"), F.avg("y").alias("event_rate"))
    return rnd(out.withColumn("vintage", F.coalesce("vintage", F.lit("all"))))


CPR_CELLS = f"WITH {STATE}, {WEIGHT}, cell AS (" + speeds_sql("", raw=True) + ")"


@query("E13_coupon_summary", "f_loan", f"""{CPR_CELLS}
SELECT implied_mbs_coupon, count(DISTINCT yyyymm) AS n_months, {R("avg(cpr_upb)")} AS mean_cpr, {R("max(cpr_upb)")} AS max_cpr, {R("min(cpr_upb)")} AS min_cpr, {R("avg(n_atrisk)")} AS mean_atrisk FROM cell GROUP BY 1""")
def _(fx):
    cells = survival.realized_cpr_balance(fx.loan)
    return rnd(cells.groupBy("implied_mbs_coupon").agg(
        F.countDistinct("yyyymm").alias("n_months"), F.avg("cpr_upb").alias("mean_cpr"), F.max("cpr_upb").alias("max_cpr"),
        F.min("cpr_upb").alias("min_cpr"), F.avg("n_atrisk").alias("mean_atrisk")))


FVR = f"""{CPR_CELLS}, fr AS (SELECT f.coupon, f.yyyymm, f.mi, f.rate_30yr, f.forecast_cpr, c.cpr_upb, c.upb_atrisk, f.coupon + 0.5 - f.rate_30yr AS inc
  FROM f_forecast f JOIN cell c ON f.coupon = c.implied_mbs_coupon AND f.yyyymm = c.yyyymm)"""


def forecast_realized(fx):
    """Forecast and realized speed per (coupon, month), balance and incentive: cells of the calendar, written once to the
    shared folder of a session."""

    def make():
        cells = survival.realized_cpr_balance(fx.loan).select(
            F.col("implied_mbs_coupon").alias("coupon"), "yyyymm", "cpr_upb", "upb_atrisk")
        return fx.forecast.join(cells, ["coupon", "yyyymm"]).withColumn("inc", F.col("coupon") + 0.5 - F.col("rate_30yr"))

    return table(fx, "forecast-realized", make)


def scorr(x, y):
    """NULL instead of NaN when a side is flat, in both engines."""
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), rates.safe_corr(x, y))


SC = "CASE WHEN stddev_pop({0}) > 0 AND stddev_pop({1}) > 0 THEN corr({0}, {1}) END"


@query("E14_forecast_vs_realized_summary", "f_loan f_forecast", f"""{FVR}
SELECT coupon, count(*) AS n, {R("avg(forecast_cpr)")} AS mean_forecast, {R("avg(cpr_upb)")} AS mean_realized, {R("max(forecast_cpr)")} AS max_forecast,
 {R("max(cpr_upb)")} AS max_realized, {R("avg(cpr_upb)/avg(forecast_cpr)")} AS ratio, {R(SC.format("forecast_cpr", "cpr_upb"))} AS corr FROM fr GROUP BY coupon""")
def _(fx):
    return rnd(scoring.forecast_vs_realized(forecast_realized(fx), "forecast_cpr", "cpr_upb", ["coupon"]))


@query("E15_forecast_error", "f_loan f_forecast", f"""{FVR}
SELECT count(*) AS n, {R("avg(abs(forecast_cpr-cpr_upb))")} AS mae, {R("sqrt(avg(pow(forecast_cpr-cpr_upb,2)))")} AS rmse, {R("corr(forecast_cpr, cpr_upb)")} AS corr FROM fr""")
def _(fx):
    return rnd(scoring.forecast_error(forecast_realized(fx), "forecast_cpr", "cpr_upb"))


@query("E19_month_end_last", "f_curve_daily", """
SELECT yyyymm, mi, arg_max(y2, d) AS y2, arg_max(y5, d) AS y5, arg_max(y10, d) AS y10, max(d) AS month_end FROM f_curve_daily GROUP BY 1, 2""")
def _(fx):
    return series.month_end(fx.curve_daily, ["y2", "y5", "y10"])


def incentive_rows(fx):
    return joins.rate_lookup(fx.loan, fx.market_rate, how="inner").withColumn("inc", F.col("note_rate") - F.col("rate_30yr"))


INC = "WITH x AS (SELECT l.*, l.note_rate - m.rate_30yr AS inc FROM f_loan l JOIN f_market_rate m ON l.yyyymm = m.yyyymm)"


@query("E20_histogram_dist", "f_loan f_market_rate", f"""{INC},
s AS (SELECT avg(inc) AS mean, stddev_pop(inc) AS sd, quantile_cont(inc, 0.5) AS med, avg(CASE WHEN inc > 0 THEN 1.0 ELSE 0 END) AS pos, count(*) AS n FROM x),
b AS (SELECT CASE WHEN inc < -2 THEN 0 WHEN inc < -1.5 THEN 1 WHEN inc < -1 THEN 2 WHEN inc < -0.5 THEN 3 WHEN inc < 0 THEN 4 WHEN inc < 0.5 THEN 5
  WHEN inc < 1 THEN 6 WHEN inc < 1.5 THEN 7 WHEN inc < 2 THEN 8 ELSE 9 END AS bin, count(*) AS c FROM x GROUP BY 1)
SELECT CAST(bin AS BIGINT) AS bin, c AS n_bin, {R("c/n")} AS share, {R("mean")} AS mean, {R("sd")} AS std, {R("med")} AS median, {R("pos")} AS share_positive FROM b, s""")
def _(fx):
    edges = [float("-inf"), -2, -1.5, -1, -0.5, 0, 0.5, 1, 1.5, 2, float("inf")]
    return rnd(profiles.histogram(incentive_rows(fx), "inc", edges))


@query("E21_quantile_profile", "f_loan f_hpi", f"""
WITH x AS (SELECT l.loan_id, l.orig_upb / nullif((l.orig_upb / nullif(l.ltv/100, 0)) * (n.hpi / nullif(o.hpi, 0)), 0) * 100 AS v
 FROM f_loan l LEFT JOIN f_hpi o ON l.zip3=o.zip3 AND l.orig_ym=o.yyyymm LEFT JOIN f_hpi n ON l.zip3=n.zip3 AND l.yyyymm=n.yyyymm),
q AS (SELECT count(*) AS n, min(v) AS mn, quantile_cont(v,0.05) AS p5, quantile_cont(v,0.5) AS med, quantile_cont(v,0.95) AS p95, max(v) AS mx,
  avg(CASE WHEN v < 60 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN v >= 60 AND v < 80 THEN 1.0 ELSE 0 END) AS b, avg(CASE WHEN v >= 80 AND v < 100 THEN 1.0 ELSE 0 END) AS c, avg(CASE WHEN v >= 100 THEN 1.0 ELSE 0 END) AS d FROM x WHERE v IS NOT NULL),
p AS (SELECT loan_id, stddev_pop(v) AS sd FROM x WHERE v IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
r AS (SELECT quantile_cont(sd, 0.5) AS within_median, avg(CASE WHEN sd > 1 THEN 1.0 ELSE 0 END) AS within_over_1 FROM p)
SELECT n, {R("mn")} AS min, {R("p5")} AS p5, {R("med")} AS median, {R("p95")} AS p95, {R("mx")} AS max, {R("a")} AS share_lt60, {R("b")} AS share_60_80, {R("c")} AS share_80_100, {R("d")} AS share_ge100,
 {R("within_median")} AS within_median, {R("within_over_1")} AS within_over_1 FROM q, r""")
def _(fx):
    df = joins.hpi_double_lookup(fx.loan, fx.hpi).withColumn("v", rates.current_ltv("orig_upb", "ltv", "hpi_orig", "hpi_now"))
    return rnd(profiles.quantile_profile(df, "v", "loan_id"))


@query("E22_incentive_buckets", "f_loan f_forecast", f"""{FVR}
SELECT floor(inc/0.5)*0.5 AS inc_lo, count(*) AS n, {R("avg(inc)", 12)} AS mean_inc, {R("avg(cpr_upb)", 12)} AS mean_cpr, {R("avg(forecast_cpr)", 12)} AS mean_forecast FROM fr GROUP BY 1 HAVING count(*) >= 5""")
def _(fx):
    return rnd(profiles.bucket_means(forecast_realized(fx), "inc", 0.5, {"mean_inc": "inc", "mean_cpr": "cpr_upb", "mean_forecast": "forecast_cpr"}, 5), 12)


@query("E23_schema_profile", "f_loan", f"""
SELECT vintage, count(*) AS n_rows, {R("100*avg(CASE WHEN fico IS NULL THEN 1.0 ELSE 0 END)")} AS fico_null_pct, {R("100*avg(CASE WHEN file_age IS NULL THEN 1.0 ELSE 0 END)")} AS file_age_null_pct,
 {R("100*avg(CASE WHEN note_rate IS NULL THEN 1.0 ELSE 0 END)")} AS note_rate_null_pct, string_agg(DISTINCT purpose, ',' ORDER BY purpose) AS purpose_codes, string_agg(DISTINCT property_type, ',' ORDER BY property_type) AS property_type_codes
FROM f_loan GROUP BY 1""")
def _(fx):
    return rnd(profiles.schema_profile(fx.loan, "vintage", ["fico", "file_age", "note_rate"], ["purpose", "property_type"]))


@query("E24_find_code_column", "f_loan", """
WITH u AS (UNPIVOT (SELECT CAST(fico AS DOUBLE) AS fico, CAST(zbc AS DOUBLE) AS zbc, CAST(dti AS DOUBLE) AS dti, CAST(file_age AS DOUBLE) AS file_age, CAST(upb AS DOUBLE) AS upb,
 CAST(zip3 AS DOUBLE) AS zip3, TRY_CAST(purpose AS DOUBLE) AS purpose FROM f_loan) ON fico, zbc, dti, file_age, upb, zip3, purpose INTO NAME column_name VALUE v)
SELECT column_name, count(*) FILTER (v = 1) AS n_ones, string_agg(DISTINCT CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY CAST(CAST(v AS BIGINT) AS VARCHAR)) FILTER (v <> 0) AS codes
FROM u GROUP BY 1 HAVING bool_and(v IN (1,2,3,6,9,15,16)) FILTER (v <> 0) AND count(*) FILTER (v = 1) > 0""")
def _(fx):
    cols = ["fico", "zbc", "dti", "file_age", "upb", "zip3", "purpose"]
    return rnd(profiles.find_code_column(fx.loan, cols, profiles.ZERO_BALANCE_CODES))


@query("E25_stage_trace", "f_loan f_market_rate", """
WITH s AS (SELECT l.*, m.rate_30yr FROM f_loan l LEFT JOIN f_market_rate m USING (yyyymm)),
t AS (SELECT '1_read' AS stage, loan_id, zbc FROM s UNION ALL SELECT '2_cutoff', loan_id, zbc FROM s WHERE yyyymm <= 199912
 UNION ALL SELECT '3_rate', loan_id, zbc FROM s WHERE yyyymm <= 199912 AND rate_30yr IS NOT NULL
 UNION ALL SELECT '4_features', loan_id, zbc FROM s WHERE yyyymm <= 199912 AND rate_30yr IS NOT NULL AND fico IS NOT NULL)
SELECT stage, count(*) AS n_rows, count(*) FILTER (zbc = 1) AS event_rows, count(DISTINCT loan_id) FILTER (zbc = 1) AS event_loans FROM t GROUP BY 1""")
def _(fx):
    df = joins.rate_lookup(fx.loan, fx.market_rate)
    stages = {"1_read": F.lit(True), "2_cutoff": F.col("yyyymm") <= 199912, "3_rate": F.col("rate_30yr").isNotNull(), "4_features": F.col("fico").isNotNull()}
    return profiles.stage_trace(df, stages, F.col("zbc") == 1)


@query("E26_offset_distribution", "f_loan", f"""
WITH o AS (SELECT {AGE} - file_age AS offset_months FROM f_loan WHERE file_age IS NOT NULL)
SELECT offset_months, count(*) AS n, {R("count(*)/sum(count(*)) OVER ()")} AS share FROM o GROUP BY 1""")
def _(fx):
    off = periods.months_between_ym("orig_ym", "yyyymm") - F.col("file_age")
    return rnd(profiles.value_shares(fx.loan.withColumn("offset_months", off), "offset_months"))


@query("E27_seasoned_share", "f_loan", f"""WITH {STATE}, {AGE_KEY}, c AS ({speeds_sql("age_group,")})
SELECT CAST(age_group AS BIGINT) AS age_group, {R("sum(upb_atrisk)", 2)} AS upb_atrisk, {R("sum(upb_atrisk)/sum(sum(upb_atrisk)) OVER ()")} AS share, {R("sum(upb_prepay)", 2)} AS upb_prepay FROM c GROUP BY 1""")
def _(fx):
    cells = by_age(fx).groupBy("age_group").agg(F.sum("upb_atrisk").alias("upb_atrisk"), F.sum("upb_prepay").alias("upb_prepay"))
    out = cells.withColumn("share", F.col("upb_atrisk") / F.sum("upb_atrisk").over(W.partitionBy()))
    return rnd(out, upb_atrisk=2, upb_prepay=2)


@query("E29_discount_share", "f_price", f"""
SELECT coupon, yyyymm, {R("avg(CASE WHEN price < 97.75 THEN 1.0 ELSE 0 END) OVER (PARTITION BY yyyymm)")} AS discount_share FROM f_price""")
def _(fx):
    share = F.avg(F.when(F.col("price") < 97.75, 1.0).otherwise(0.0)).over(W.partitionBy("yyyymm"))
    return rnd(fx.price.select("coupon", "yyyymm", share.alias("discount_share")))


@query("E30_segment_metrics", "f_loan f_market_rate", f"""
WITH l AS (SELECT l.loan_id, arg_max(fico, l.yyyymm) AS fico, arg_max(ltv, l.yyyymm) AS ltv, arg_max(note_rate - rate_30yr, l.yyyymm) AS inc, arg_max({AGE.replace('mi -', 'l.mi -')}, l.yyyymm) AS age,
   arg_max(vintage, l.yyyymm) AS vintage, arg_max(note_rate, l.yyyymm) AS sa, arg_max(dti, l.yyyymm) AS sb, max(CASE WHEN zbc=1 THEN 1 ELSE 0 END) AS y FROM f_loan l LEFT JOIN f_market_rate m ON l.yyyymm = m.yyyymm GROUP BY 1),
s AS (SELECT 'fico_bucket' AS segment, CASE WHEN fico IS NULL THEN NULL WHEN fico < 640 THEN '<640' WHEN fico < 680 THEN '640-680' WHEN fico < 720 THEN '680-720' WHEN fico < 760 THEN '720-760' ELSE '760+' END AS value, sa, sb, y FROM l
 UNION ALL SELECT 'ltv_bucket', CASE WHEN ltv < 60 THEN '<60' WHEN ltv < 70 THEN '60-70' WHEN ltv < 80 THEN '70-80' WHEN ltv < 90 THEN '80-90' ELSE '90+' END, sa, sb, y FROM l
 UNION ALL SELECT 'refi_bucket', CASE WHEN inc < -1.5 THEN '<-150bps' WHEN inc < -0.5 THEN '-150to-50bps' WHEN inc < 0.5 THEN '-50to+50bps' WHEN inc < 1.5 THEN '+50to+150bps' WHEN inc < 99 THEN '>+150bps' END, sa, sb, y FROM l
 UNION ALL SELECT 'loan_age_bucket', CASE WHEN age < 6 THEN '0-6m' WHEN age < 12 THEN '6-12m' WHEN age < 24 THEN '12-24m' WHEN age < 34 THEN '24-33m' END, sa, sb, y FROM l
 UNION ALL SELECT 'vintage', vintage, sa, sb, y FROM l),
r AS (SELECT *, rank() OVER (PARTITION BY segment, value ORDER BY sa) + (count(*) OVER (PARTITION BY segment, value, sa) - 1)/2.0 AS ra,
  rank() OVER (PARTITION BY segment, value ORDER BY sb) + (count(*) OVER (PARTITION BY segment, value, sb) - 1)/2.0 AS rb FROM s WHERE value IS NOT NULL),
g AS (SELECT segment, value, count(*) AS n, sum(y) AS p, sum(ra*y) AS qa, sum(rb*y) AS qb FROM r GROUP BY 1, 2)
SELECT segment, value, n, {R("100*p/n")} AS event_pct, {R("(qa-p*(p+1)/2)/(p*(n-p))")} AS auc_a, {R("(qb-p*(p+1)/2)/(p*(n-p))")} AS auc_b, {R("(qa-qb)/(p*(n-p))")} AS delta FROM g WHERE n >= 50 AND p > 0 AND p < n""")
def _(fx):
    df = incentive_rows(fx).withColumn("age", periods.months_between_ym("orig_ym", "yyyymm"))
    snap = survival.last_known(df, ["fico", "ltv", "inc", "age", "vintage", "note_rate", "dti"]).join(
        survival.ever_event(fx.loan, F.col("zbc") == 1), "loan_id")
    src = {"fico_bucket": "fico", "ltv_bucket": "ltv", "refi_bucket": "inc", "loan_age_bucket": "age"}
    segs = {n: bins.bin_label(c, *scoring.SEGMENTS[n], "left") for n, c in src.items()} | {"vintage": F.col("vintage")}
    return rnd(scoring.segment_metrics(snap, segs, "note_rate", "dti", "prepaid"))


@query("E31_path_fan", "f_path", f"""
SELECT CAST(t AS BIGINT) AS t, count(*) AS n, {", ".join(f"{R(f'quantile_cont(rate, {q/100})')} AS p{q}" for q in (10, 25, 50, 75, 90))} FROM f_path GROUP BY 1""")
def _(fx):
    return rnd(ordering.exact_quantiles(fx.path, "rate", {f"p{q}": q / 100 for q in (10, 25, 50, 75, 90)}, ["t"]))


@query("E32_monotone_verdict", "f_loan f_forecast", f"""{FVR}, b AS (SELECT coupon, floor(inc/0.25)*0.25 AS g, avg(cpr_upb) AS v FROM fr GROUP BY 1, 2),
d AS (SELECT *, v - lag(v) OVER (PARTITION BY coupon ORDER BY g) AS step FROM b),
s AS (SELECT coupon, arg_max(v, g) - arg_min(v, g) AS net, avg(CASE WHEN step > 0 THEN 1.0 WHEN step IS NOT NULL THEN 0.0 END) AS up FROM d GROUP BY 1)
SELECT coupon, {R("net")} AS net_change, {R("up")} AS frac_up, CASE WHEN net > 0 AND up > 0.6 THEN 's-curve' WHEN net < 0 AND up < 0.4 THEN 'inverted' ELSE 'flat' END AS verdict FROM s""")
def _(fx):
    cells = forecast_realized(fx).groupBy("coupon", (F.floor(F.col("inc") / 0.25) * 0.25).alias("g")).agg(F.avg("cpr_upb").alias("v"))
    return rnd(profiles.monotone_verdict(cells, "g", "v", ["coupon"]))
