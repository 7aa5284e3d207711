"""2.C filters, 2.D joins, 2.H set operations, 2.I ordering."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from tideline.catalog.registry import R, query, rnd
from tideline.catalog.survival import CPR_CELLS, FVR, aged, forecast_realized
from tideline.functions import periods, rates
from tideline.operators import joins, selection, series, survival
from tideline.session import run_dir
from tideline.sources import vintages

CUTOFF = 199812

HASH = "(('0x' || substr(md5(CAST({0} AS VARCHAR) || '|42'), 1, 13))::BIGINT / 4503599627370496.0)"


@query("C1_cutoff_filter", "f_loan", f"SELECT loan_id, yyyymm, upb FROM f_loan WHERE yyyymm <= {CUTOFF}")
def _(fx):
    return selection.cutoff(fx.loan, CUTOFF).select("loan_id", "yyyymm", "upb")


@query("C2_keep_ids", "f_loan", "SELECT loan_id, yyyymm FROM f_loan WHERE loan_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(fx):
    ids = fx.table("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("loan_id"))
    return selection.keep_ids(fx.loan, ids).select("loan_id", "yyyymm")


@query("C3_vintage_prune", "f_loan", "SELECT loan_id, yyyymm, vintage FROM f_loan WHERE CAST(substr(vintage,1,4) AS INT) <= 1997")
def _(fx):
    return selection.vintage_prune(fx.loan, 1997).select("loan_id", "yyyymm", "vintage")


@query("C3b_dynamic_vintage_prune", "f_loan", "SELECT loan_id, yyyymm, vintage FROM f_loan WHERE CAST(substr(vintage,1,4) AS INT) <= 1997")
def _(fx):
    """The vintages that a small table names, from the partitioned panel table."""
    table = f"panel_{uuid.uuid4().hex[:12]}"
    vintages.to_panel_table(fx.loan.select("loan_id", "yyyymm", "vintage"), table, run_dir(fx.spark, "tables"))
    panel = fx.spark.table(table)
    listed = fx.loan.select("vintage").distinct().filter(F.substring("vintage", 1, 4).cast("int") <= 1997)
    return vintages.of_vintages(panel, listed).select("loan_id", "yyyymm", "vintage")


@query("C4_dropna_subset", "f_loan", "SELECT loan_id, yyyymm FROM f_loan WHERE fico IS NOT NULL AND file_age IS NOT NULL AND ltv IS NOT NULL")
def _(fx):
    return fx.loan.na.drop(subset=["fico", "file_age", "ltv"]).select("loan_id", "yyyymm")


@query("C5_age_cap", "f_loan", "SELECT loan_id, yyyymm, file_age FROM f_loan WHERE file_age <= 33")
def _(fx):
    return fx.loan.filter(F.col("file_age") <= 33).select("loan_id", "yyyymm", "file_age")


REGIMES = {"early": (199501, 199712), "late": (199701, 200112), "y1999": (199901, 199912)}


@query("C6_window_filter", "f_forecast", """
SELECT coupon, yyyymm, regime FROM f_forecast JOIN (VALUES ('early',199501,199712),('late',199701,200112),('y1999',199901,199912)) r(regime,a,b) ON yyyymm BETWEEN a AND b
WHERE yyyymm >= 199601 AND coupon IN (3.0, 3.5, 4.0)""")
def _(fx):
    f = fx.forecast.filter((F.col("yyyymm") >= 199601) & F.col("coupon").isin(3.0, 3.5, 4.0))
    return selection.regimes(f, REGIMES).select("coupon", "yyyymm", "regime")


VALIDITY = [("cutoff_1996", 1997), ("cutoff_1997", 1998), ("cutoff_1998", 1999), ("cutoff_1999", 2000)]


def validity(fx):
    """Model validity ranges in months: one year each, after its cutoff."""
    rows = [(m, y * 12 + 1, y * 12 + 12) for m, y in VALIDITY]
    return fx.spark.createDataFrame(rows, "model string, from_mi bigint, to_mi bigint")


def dispatched(fx):
    have = fx.spark.createDataFrame([(m,) for m, _ in VALIDITY if m != "cutoff_1998"], "model string")
    return joins.model_dispatch(fx.forecast, validity(fx), "mi", have, "production")


DISPATCH = """WITH md AS (SELECT f.*, CASE WHEN yyyymm BETWEEN 199701 AND 199712 THEN 'cutoff_1996' WHEN yyyymm BETWEEN 199801 AND 199812 THEN 'cutoff_1997'
 WHEN yyyymm BETWEEN 200001 AND 200012 THEN 'cutoff_1999' ELSE 'production' END AS model FROM f_forecast f)"""


@query("C7_oos_filter", "f_forecast", f"{DISPATCH} SELECT coupon, yyyymm, model FROM md WHERE model <> 'production' AND model NOT IN ('cutoff_1996')")
def _(fx):
    df = dispatched(fx).withColumn("is_oos", F.col("model") != "production")
    return df.filter(F.col("is_oos") & ~F.col("model").isin("cutoff_1996")).select("coupon", "yyyymm", "model")


@query("C8_min_weight_filter", "f_loan f_forecast", f"""{FVR}
SELECT coupon, yyyymm, {R("cpr_upb")} AS cpr_drop, {R("greatest(cpr_upb, 0.002)")} AS cpr_floor, cpr_upb > 0 AS kept FROM fr WHERE round(upb_atrisk,2) >= 2000000""")
def _(fx):
    df = forecast_realized(fx).filter(F.round("upb_atrisk", 2) >= 2000000)
    return rnd(df.select("coupon", "yyyymm", F.col("cpr_upb").alias("cpr_drop"),
                         F.greatest("cpr_upb", F.lit(0.002)).alias("cpr_floor"), (F.col("cpr_upb") > 0).alias("kept")))


@query("C9_loan_sample", "f_loan", f"SELECT loan_id, yyyymm FROM f_loan WHERE {HASH.format('loan_id')} < 0.2")
def _(fx):
    return selection.loan_sample(fx.loan, 0.2).select("loan_id", "yyyymm")


@query("C10_capped_sample_per_group", "f_loan", f"""
SELECT vintage, loan_id, yyyymm FROM (SELECT *, row_number() OVER (PARTITION BY vintage ORDER BY ('0x' || substr(md5(CAST(loan_id AS VARCHAR) || '-' || CAST(yyyymm AS VARCHAR) || '|42'), 1, 13))::BIGINT, loan_id, yyyymm) AS rn FROM f_loan) WHERE rn <= 100""")
def _(fx):
    df = fx.loan.withColumn("row_id", F.concat_ws("-", "loan_id", "yyyymm"))
    return selection.capped_sample(df, 100, ["vintage"], "row_id").select("vintage", "loan_id", "yyyymm")


LABELS = "lab AS (SELECT loan_id, CAST(max(CASE WHEN zbc=1 THEN 1 ELSE 0 END) AS BIGINT) AS prepaid FROM f_loan GROUP BY 1)"


def labels(fx):
    return rnd(survival.ever_event(fx.loan, F.col("zbc") == 1))


@query("C11_balanced_sample", "f_loan", f"""WITH {LABELS}
SELECT loan_id, prepaid FROM (SELECT *, row_number() OVER (PARTITION BY prepaid ORDER BY {HASH.format('loan_id')}, loan_id) AS rn FROM lab) WHERE rn <= 200""")
def _(fx):
    return selection.balanced_sample(labels(fx), "prepaid", 200, "loan_id")


@query("C12_oversample_5050", "f_loan", f"""
WITH s AS MATERIALIZED (SELECT loan_id, yyyymm, row_number() OVER (PARTITION BY loan_id ORDER BY yyyymm) AS r, CASE WHEN zbc = 1 THEN 1 ELSE 0 END AS e FROM f_loan),
k AS MATERIALIZED (SELECT *, r - 1 AS t FROM s WHERE r <= 33), l AS (SELECT loan_id, min(CASE WHEN e=1 THEN t END) AS et, max(t) AS lt FROM k GROUP BY 1),
n AS (SELECT count(*) AS n_all, count(et) AS n_event FROM l)
SELECT k.loan_id, k.t, CAST(k.t = coalesce(et, -1) AS BIGINT) AS y, {R("(CASE WHEN et IS NOT NULL THEN 0.5/n_event ELSE 0 END + 0.5/n_all)/(coalesce(et, lt)+1)", 12)} AS weight
FROM k JOIN l USING (loan_id), n WHERE k.t <= coalesce(et, lt)""")
def _(fx):
    """Class weights that equal the half-and-half batch in expectation."""
    from tideline.operators import sequences

    steps = sequences.person_period(sequences.timesteps(fx.loan, 33), F.col("zbc") == 1)
    return rnd(selection.person_period_weights(steps).select("loan_id", "t", "y", "weight"), 12)


@query("C13_top_n_per_group", "f_loan", """
SELECT loan_id, yyyymm, upb, rn FROM (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY yyyymm DESC) AS rn FROM f_loan) WHERE rn <= 2""")
def _(fx):
    return rnd(selection.latest_rows(fx.loan, 2, ["loan_id"], "yyyymm").select("loan_id", "yyyymm", "upb", "rn"))


@query("C14_head_min_group", "f_loan", """
SELECT loan_id, yyyymm FROM f_loan WHERE loan_id IN (SELECT loan_id FROM f_loan GROUP BY 1 HAVING count(*) >= 10)""")
def _(fx):
    return selection.groups_with_at_least(fx.loan, ["loan_id"], 10).select("loan_id", "yyyymm")


# ------------------------------------------------------------------ 2.D joins


@query("D1_rate_lookup", "f_loan f_market_rate", "SELECT loan_id, l.mmyyyy, m.rate_30yr FROM f_loan l LEFT JOIN f_market_rate m ON l.mmyyyy = m.mmyyyy")
def _(fx):
    """Every month of the market table."""
    return joins.rate_lookup(fx.loan, fx.market_rate, "mmyyyy").select("loan_id", "mmyyyy", "rate_30yr")


@query("D2_hpi_double_lookup", "f_loan f_hpi", """
SELECT l.loan_id, l.yyyymm, o.hpi AS hpi_orig, n.hpi AS hpi_now FROM f_loan l LEFT JOIN f_hpi o ON l.zip3=o.zip3 AND l.orig_ym=o.yyyymm LEFT JOIN f_hpi n ON l.zip3=n.zip3 AND l.yyyymm=n.yyyymm""")
def _(fx):
    """Every region of the home price table."""
    return joins.hpi_double_lookup(fx.loan, fx.hpi).select("loan_id", "yyyymm", "hpi_orig", "hpi_now")


@query("D3_loan_state_join", "f_loan", """
WITH st AS (SELECT loan_id, max(yyyymm) AS last_ym, arg_max_null(upb, yyyymm) AS last_upb, arg_max_null(note_rate, yyyymm) AS last_rate FROM f_loan GROUP BY 1)
SELECT l.loan_id, l.yyyymm, l.upb, last_rate, CASE WHEN last_upb = 0 THEN last_ym END AS payoff_ym FROM f_loan l JOIN st USING (loan_id)""")
def _(fx):
    state = survival.last_appearance(fx.loan).select("loan_id", "last_rate", "payoff_ym")
    return joins.loan_state_join(fx.loan.select("loan_id", "yyyymm", "upb"), state)


@query("D3b_bucketed_state_join", "f_loan", """
WITH mo AS (SELECT loan_id, yyyymm, count(*) AS n_rows, max(upb) FILTER (note_rate IS NOT NULL) AS month_upb, max(note_rate) AS month_rate FROM f_loan GROUP BY 1, 2),
st AS (SELECT loan_id, max(yyyymm) AS last_ym, arg_max(month_upb, yyyymm) AS last_upb, arg_max(month_rate, yyyymm) AS last_rate FROM mo WHERE month_rate IS NOT NULL GROUP BY 1)
SELECT mo.loan_id, mo.yyyymm, n_rows, month_upb, last_rate, CASE WHEN last_upb = 0 THEN last_ym END AS payoff_ym FROM mo JOIN st USING (loan_id)""")
def _(fx):
    """Loan state on (loan, month) rows that are laid out by loan once: neither the state nor the join moves them again."""
    months = vintages.to_month_table(survival.loan_months(fx.loan), f"loan_months_{uuid.uuid4().hex[:12]}", run_dir(fx.spark, "tables"), 32)
    state = survival.last_appearance(months, upb="month_upb", rate="month_rate").select("loan_id", "last_rate", "payoff_ym")
    return joins.loan_state_join(months.select("loan_id", "yyyymm", "n_rows", "month_upb"), state)


@query("D4_forecast_realized_join", "f_loan f_forecast", f"{FVR} SELECT coupon, yyyymm, {R('forecast_cpr')} AS forecast_cpr, {R('cpr_upb')} AS cpr_upb FROM fr")
def _(fx):
    return rnd(forecast_realized(fx).select("coupon", "yyyymm", "forecast_cpr", "cpr_upb"))


@query("D5_asof_month_end", "f_month f_curve_daily", """
SELECT last_day(make_date(m.yyyymm//100, m.yyyymm%100, 1)) AS month_end, c.d AS asof_d, c.y2, c.y10 FROM f_month m ASOF JOIN f_curve_daily c ON last_day(make_date(m.yyyymm//100, m.yyyymm%100, 1)) >= c.d""")
def _(fx):
    ends = fx.month.select(F.last_day(periods.yyyymm_to_date("yyyymm")).alias("month_end"))
    out = joins.asof_join(ends, fx.curve_daily, "month_end", "d", ["y2", "y10"])
    return out.filter(F.col("asof_d").isNotNull()).select("month_end", "asof_d", "y2", "y10")


@query("D6_nearest_month_lookup", "f_price f_market_rate", """
WITH k AS (SELECT DISTINCT make_date(yyyymm//100, yyyymm%100, 1) AS m FROM f_price), r AS (SELECT make_date(yyyymm//100, yyyymm%100, 1) AS rm, rate_30yr FROM f_market_rate),
c AS (SELECT m, rm, rate_30yr, row_number() OVER (PARTITION BY m ORDER BY abs(m - rm), rm) AS rn FROM k, r)
SELECT m, rm AS matched_m, rate_30yr FROM c WHERE rn = 1""")
def _(fx):
    """Every month of the market table."""
    keys = fx.price.select(periods.yyyymm_to_date("yyyymm").alias("m")).distinct()
    r = fx.market_rate.select(periods.yyyymm_to_date("yyyymm").alias("m"), "rate_30yr")
    return joins.nearest_month_lookup(keys, r, "m", "rate_30yr").select("m", "matched_m", "rate_30yr")


@query("D7_prior_row_join", "f_price f_curve_daily", """
WITH me AS (SELECT yyyymm, max(d) AS month_end, arg_max(y10, d) AS y10 FROM f_curve_daily GROUP BY 1),
p AS (SELECT coupon, yyyymm, price, lag(yyyymm) OVER (PARTITION BY coupon ORDER BY yyyymm) AS info_ym FROM f_price)
SELECT p.coupon, p.yyyymm AS ret_ym, info_ym, me.month_end AS info_date, me.y10 FROM p JOIN me ON me.yyyymm = p.info_ym""")
def _(fx):
    """Information date = previous price row; return month = current one."""
    p = joins.prior_row(fx.price, "yyyymm", {"info_ym": "yyyymm"}, ["coupon"]).filter(F.col("info_ym").isNotNull())
    me = series.month_end(fx.curve_daily, ["y10"]).select(F.col("yyyymm").alias("info_ym"), F.col("month_end").alias("info_date"), "y10")
    return p.join(F.broadcast(me), "info_ym").select("coupon", F.col("yyyymm").alias("ret_ym"), "info_ym", "info_date", "y10")


@query("D8_model_dispatch", "f_forecast", f"{DISPATCH} SELECT coupon, yyyymm, model FROM md")
def _(fx):
    return dispatched(fx).select("coupon", "yyyymm", "model")


@query("D9_grid_cross", "f_market_rate", f"""
SELECT yyyymm, coupon, ltv, {R("coupon + 0.5 - rate_30yr")} AS incentive FROM f_market_rate, (SELECT unnest([2.5,3.0,3.5,4.0,4.5,5.0,5.5,6.0,6.5])::DOUBLE AS coupon), (SELECT unnest([60,80,95])::DOUBLE AS ltv)""")
def _(fx):
    g = joins.grid(fx.market_rate, coupon=[2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5], ltv=[60, 80, 95])
    return rnd(g.select("yyyymm", "coupon", "ltv", (F.col("coupon") + 0.5 - F.col("rate_30yr")).alias("incentive")))


@query("D10_reconcile_outer", "f_loan", f"""
WITH a AS (SELECT loan_id, yyyymm, upb, ltv FROM f_loan WHERE yyyymm <= 200006), b AS (SELECT loan_id, yyyymm, upb*1.001 AS upb, ltv FROM f_loan WHERE yyyymm >= 199606),
m AS (SELECT a.loan_id AS la, b.loan_id AS lb, a.upb AS ua, b.upb AS ub, a.ltv AS va, b.ltv AS vb FROM a FULL JOIN b ON a.loan_id=b.loan_id AND a.yyyymm=b.yyyymm),
n AS (SELECT count(*) FILTER (la IS NOT NULL AND lb IS NOT NULL) AS n_both, count(*) FILTER (lb IS NULL) AS n_only_old, count(*) FILTER (la IS NULL) AS n_only_new FROM m)
SELECT 'upb' AS "column", n_both, n_only_old, n_only_new, {R("max(abs(ub-ua))")} AS max_abs_diff, {R("coalesce(max(abs(ub-ua)/nullif(abs(ua),0)),0)")} AS max_rel_diff FROM m, n GROUP BY ALL
UNION ALL SELECT 'ltv', n_both, n_only_old, n_only_new, {R("max(abs(vb-va))")}, {R("coalesce(max(abs(vb-va)/nullif(abs(va),0)),0)")} FROM m, n GROUP BY ALL""")
def _(fx):
    a = fx.loan.filter("yyyymm <= 200006")
    b = fx.loan.filter("yyyymm >= 199606").withColumn("upb", F.col("upb") * 1.001)
    return rnd(joins.reconcile(a, b, ["loan_id", "yyyymm"], ["upb", "ltv"]))


@query("D11_expanding_self_join", "f_loan f_forecast", f"""{FVR}, c AS (SELECT DISTINCT yyyymm AS cutoff, mi AS cmi FROM fr)
SELECT cutoff, count(*) AS n_train, count(DISTINCT yyyymm) AS n_months, {R("avg(forecast_cpr)", 12)} AS mean_forecast, {R("sum(upb_atrisk*cpr_upb)/sum(upb_atrisk)", 12)} AS weighted_cpr
FROM c JOIN fr ON fr.mi < c.cmi - 1 GROUP BY 1""")
def _(fx):
    """History strictly before each cutoff (one month lag) without pairing every
    cutoff with every row: month totals, then a running window."""
    from tideline.operators import regression

    return rnd(regression.expanding_history(
        forecast_realized(fx), "mi", lag_months=1,
        sums={"n_train": F.lit(1), "_f": F.col("forecast_cpr"), "_wy": F.col("upb_atrisk") * F.col("cpr_upb"), "_w": F.col("upb_atrisk")},
        carry={"cutoff": "yyyymm"},
    ).filter(F.col("n_train") > 0).select(
        "cutoff", "n_train", "n_months", (F.col("_f") / F.col("n_train")).alias("mean_forecast"), (F.col("_wy") / F.col("_w")).alias("weighted_cpr")), 12)


@query("D12_beta_join", "f_price f_forecast", f"""
WITH b AS (SELECT coupon, avg(forecast_cpr) AS beta FROM f_forecast GROUP BY 1) SELECT p.coupon, p.yyyymm, {R("beta", 12)} AS beta FROM f_price p JOIN b USING (coupon)""")
def _(fx):
    betas = fx.forecast.groupBy("coupon").agg(F.avg("forecast_cpr").alias("beta"))
    df = fx.price.join(F.broadcast(betas), "coupon")
    return rnd(df.select("coupon", "yyyymm", "beta"), 12)


@query("D13_align_metadata", "f_loan", f"""WITH {LABELS}
SELECT c.c_custkey AS loan_id, c.c_mktsegment AS segment, lab.prepaid FROM customer c LEFT JOIN lab ON lab.loan_id = c.c_custkey WHERE lab.loan_id IS NOT NULL""")
def _(fx):
    ids = fx.table("customer").select(F.col("c_custkey").alias("loan_id"), F.col("c_mktsegment").alias("segment"))
    return ids.join(labels(fx), "loan_id", "left").filter(F.col("prepaid").isNotNull())


RET = """me AS (SELECT yyyymm, mi, arg_max(y2, d) AS y2, arg_max(y5, d) AS y5, arg_max(y10, d) AS y10 FROM f_curve_daily GROUP BY 1, 2),
ts AS (SELECT yyyymm, mi, dy AS dy_avg, -6.5*dy/100 + y/1200 AS treasury_return FROM (SELECT yyyymm, mi, (y5+y10)/2 AS y, (y5+y10)/2 - lag((y5+y10)/2) OVER (ORDER BY mi) AS dy FROM me) WHERE dy IS NOT NULL),
tr AS (SELECT coupon, yyyymm, mi, price, (price + coupon/12 - pp)/pp AS total_return FROM (SELECT *, lag(price) OVER (PARTITION BY coupon ORDER BY mi) AS pp FROM f_price) WHERE pp IS NOT NULL),
ex AS (SELECT tr.coupon, tr.yyyymm, tr.mi, price, total_return, treasury_return, dy_avg, total_return - treasury_return AS excess_return, rate_30yr
  FROM tr JOIN ts ON tr.yyyymm = ts.yyyymm JOIN f_market_rate m ON m.yyyymm = tr.yyyymm)"""


def excess(fx):
    me = series.month_end(fx.curve_daily, ["y2", "y5", "y10"])
    return series.excess_returns(fx.price, me, fx.market_rate)


@query("D14_return_merge", "f_price f_curve_daily f_market_rate", f"WITH {RET} SELECT coupon, yyyymm, {R('total_return', 9)} AS total_return, {R('treasury_return', 9)} AS treasury_return, {R('excess_return', 9)} AS excess_return FROM ex")
def _(fx):
    return rnd(excess(fx).select("coupon", "yyyymm", "total_return", "treasury_return", "excess_return"), 9)


@query("D15_date_restricted_semi", "f_price f_curve_daily f_market_rate f_forecast", f"""WITH {RET}
SELECT coupon, yyyymm, {R('excess_return', 9)} AS excess_return FROM ex WHERE yyyymm IN (SELECT yyyymm FROM f_forecast WHERE yyyymm >= 199701)""")
def _(fx):
    months = fx.forecast.filter("yyyymm >= 199701").select("yyyymm").distinct()
    return rnd(excess(fx).join(months, "yyyymm", "left_semi").select("coupon", "yyyymm", "excess_return"), 9)


# ------------------------------------------------------- 2.H sets, 2.I ordering


@query("H1_union_all", "f_loan", "SELECT loan_id, yyyymm, 'a' AS part FROM f_loan WHERE yyyymm <= 199706 UNION ALL SELECT loan_id, yyyymm, 'b' FROM f_loan WHERE yyyymm >= 199701")
def _(fx):
    a = fx.loan.filter("yyyymm <= 199706").select("loan_id", "yyyymm", F.lit("a").alias("part"))
    b = fx.loan.filter("yyyymm >= 199701").select(F.lit("b").alias("part"), "yyyymm", "loan_id")
    return a.unionByName(b)


@query("H2_difference", "f_loan", "SELECT DISTINCT loan_id FROM f_loan WHERE loan_id NOT IN (SELECT loan_id FROM f_loan WHERE yyyymm >= 200101)")
def _(fx):
    held = fx.loan.filter("yyyymm >= 200101").select("loan_id").distinct()
    return selection.drop_ids(fx.loan.select("loan_id").distinct(), held)


@query("H3_key_union", "f_loan", """
SELECT coalesce(a.zip3, p.zip3) AS zip3, coalesce(a.yyyymm, p.yyyymm) AS yyyymm, coalesce(n_atrisk, 0) AS n_atrisk, coalesce(n_prepay, 0) AS n_prepay
FROM (SELECT zip3, yyyymm, count(*) AS n_atrisk FROM f_loan WHERE upb > 0 GROUP BY 1, 2) a FULL JOIN (SELECT zip3, yyyymm, count(*) AS n_prepay FROM f_loan WHERE upb = 0 GROUP BY 1, 2) p ON a.zip3=p.zip3 AND a.yyyymm=p.yyyymm""")
def _(fx):
    """At-risk and prepaid keys in one grouping: the union of keys for free."""
    return fx.loan.groupBy("zip3", "yyyymm").agg(F.count_if(F.col("upb") > 0).alias("n_atrisk"), F.count_if(F.col("upb") == 0).alias("n_prepay"))


@query("H4_distinct_ids", "f_loan", "SELECT DISTINCT loan_id FROM f_loan")
def _(fx):
    return fx.loan.select("loan_id").distinct()


@query("I1_sort_panel", "f_loan", "SELECT loan_id, yyyymm, upb FROM f_loan ORDER BY loan_id, yyyymm")
def _(fx):
    """Range-partitioned sort, so a hot loan is split over tasks by month."""
    return fx.loan.select("loan_id", "yyyymm", "upb").orderBy("loan_id", "yyyymm")


@query("I2_ordered_bins", "f_loan f_market_rate", """
SELECT bin, CAST(list_position(['<-1.5','-1.5..-1','-1..-0.5','-0.5..0','0..0.5','0.5..1','1..1.5','1.5..2','>2'], bin) - 1 AS BIGINT) AS bin_order, count(*) AS n FROM (
SELECT CASE WHEN i <= -1.5 THEN '<-1.5' WHEN i <= -1 THEN '-1.5..-1' WHEN i <= -0.5 THEN '-1..-0.5' WHEN i <= 0 THEN '-0.5..0' WHEN i <= 0.5 THEN '0..0.5' WHEN i <= 1 THEN '0.5..1'
 WHEN i <= 1.5 THEN '1..1.5' WHEN i <= 2 THEN '1.5..2' ELSE '>2' END AS bin FROM (SELECT note_rate - rate_30yr AS i FROM f_loan l JOIN f_market_rate m ON l.yyyymm = m.yyyymm)) GROUP BY 1, 2 ORDER BY 2""")
def _(fx):
    from tideline.functions import bins

    inc = F.col("note_rate") - F.col("rate_30yr")
    df = joins.rate_lookup(fx.loan, fx.market_rate, how="inner")
    out = df.groupBy(bins.bin_index(inc, bins.INCENTIVE_EDGES).alias("bin_order")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(s) for s in bins.INCENTIVE_LABELS])
    return rnd(out.withColumn("bin", F.get(names, F.col("bin_order"))).orderBy("bin_order"))


@query("I3_arg_extreme", "f_loan", f"""{CPR_CELLS}
SELECT implied_mbs_coupon, (array_agg(yyyymm ORDER BY round(cpr_upb,8) DESC, yyyymm))[1] AS peak_month, {R("max(cpr_upb)")} AS peak_cpr, (array_agg(yyyymm ORDER BY round(cpr_upb,8), yyyymm) FILTER (yyyymm >= 199801))[1] AS trough_month FROM cell GROUP BY 1""")
def _(fx):
    """Peak month per coupon and trough after a date; ties go to the earliest."""
    c = survival.realized_cpr_balance(fx.loan).withColumn("r", F.round("cpr_upb", 8))
    early = -F.col("yyyymm")
    after = F.col("yyyymm") >= 199801
    return rnd(c.groupBy("implied_mbs_coupon").agg(
        F.max_by("yyyymm", F.struct("r", early)).alias("peak_month"), F.max("cpr_upb").alias("peak_cpr"),
        F.min_by("yyyymm", F.when(after, F.struct("r", "yyyymm"))).alias("trough_month")))


@query("I5_head_sample", "f_loan", "SELECT loan_id, yyyymm, upb FROM f_loan ORDER BY loan_id, yyyymm LIMIT 100")
def _(fx):
    """First n rows in panel order (a top-n, not a full sort)."""
    return fx.loan.select("loan_id", "yyyymm", "upb").orderBy("loan_id", "yyyymm").limit(100)
