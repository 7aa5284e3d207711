"""2.N data-quality guards, reported as data (the raising form stops a job)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.olssql import ols_sql
from tideline.catalog.registry import R, query, rnd
from tideline.catalog.selection import LABELS, labels
from tideline.catalog.sequences import STEPS, event
from tideline.catalog.pricesql import V
from tideline.catalog.statistics import HPB, MAPCELL, asof_line, hedge_rows
from tideline.catalog.survival import AGE_KEY, STATE, WEIGHT, by_age, forecast_realized, speeds_sql
from tideline.functions import rates
from tideline.operators import joins, quality, regression, sequences, survival
from tideline.plans import mapping


@query("N1_spread_convention", "f_loan f_price", f"""WITH {STATE}, {WEIGHT}, c AS (SELECT DISTINCT cb AS note, round(cb - 0.5, 2) AS coupon FROM w WHERE cb IS NOT NULL), p AS (SELECT DISTINCT coupon FROM f_price),
j AS (SELECT note, p.coupon, round(note - p.coupon, 2) AS off FROM c JOIN p ON p.coupon = c.coupon)
SELECT min(off)::DOUBLE AS min_offset, max(off)::DOUBLE AS max_offset, count(*) > 0 AND min(off) = 0.5 AND max(off) = 0.5 AS ok FROM j""")
def _(fx):
    """Note-rate buckets of the loan panel against the coupons that are priced."""
    notes = survival.realized_cpr_balance(fx.loan).select(F.col("coupon_bucket").alias("note_rate")).distinct()
    df = notes.withColumn("coupon", rates.implied_coupon("note_rate")).join(F.broadcast(fx.price.select("coupon").distinct()), "coupon")
    return quality.require(quality.spread_convention(df), quality.spread_ok(0.5), "note rate minus coupon is not 0.50")


@query("N2_alignment_guard", V, f"""{HPB}, a AS (SELECT (dy2+dy5+dy10)/3 AS x, d_level AS y FROM hp) SELECT {R("corr(x, y)")} AS corr, {R("max(abs(x-y))")} AS max_err, {R("stddev_samp(y)")} AS sd, count(*) AS n, corr(x, y) >= 0.95 AND max(abs(x-y)) <= 0.5*stddev_samp(y) AS ok FROM a""")
def _(fx):
    df = hedge_rows(fx).withColumn("rebuilt", (F.col("dy2") + F.col("dy5") + F.col("dy10")) / 3)
    return rnd(quality.require(quality.alignment(df, "rebuilt", "d_level"), quality.alignment_ok(), "rate changes are misaligned with the panel"))


@query("N3_positive_control", V, f"""{HPB}, u AS (SELECT dy2, total_return - income AS unh FROM hp WHERE coupon = (SELECT min(coupon) FROM hp)) SELECT n, {R("t_dy2", 5)} AS t, abs(t_dy2) > 2 AS ok FROM {ols_sql("u", "unh", ["dy2"])}""")
def _(fx):
    """The unhedged return of the lowest coupon should load on rates."""
    df = hedge_rows(fx)
    low = df.withColumn("_m", df.agg(F.min("coupon")).scalar()).filter(F.col("coupon") == F.col("_m"))
    fit = regression.ols(low.withColumn("unh", F.col("total_return") - F.col("income")), "unh", ["dy2"])
    return rnd(quality.verdict(fit.select("n", F.col("t_dy2").alias("t")), F.abs("t") > 2), 5)


@query("N4_duplicate_key_guard", "f_price", "SELECT count(*) FILTER (c > 1) AS n_duplicated, count(*) AS n_keys, count(*) FILTER (c > 1) = 0 AS ok FROM (SELECT count(*) AS c FROM f_price GROUP BY coupon, yyyymm)")
def _(fx):
    return quality.require(quality.duplicate_keys(fx.price, ["coupon", "yyyymm"]), F.col("n_duplicated") == 0, "duplicate (coupon, month)")


@query("N5_positives_equal_events", "f_loan", f"WITH {STEPS}, {LABELS} SELECT (SELECT count(*) FROM k JOIN e USING (loan_id) WHERE t = event_step) AS n_positive, (SELECT CAST(sum(prepaid) AS BIGINT) FROM lab) AS n_labelled, (SELECT count(*) FROM k JOIN e USING (loan_id) WHERE t = event_step) = (SELECT sum(prepaid) FROM lab) AS ok")
def _(fx):
    steps = sequences.observed_steps(sequences.timesteps(fx.loan), event())
    row = quality.positives_equal_events(steps, labels(fx), "y", "prepaid")
    return quality.verdict(row, F.col("n_positive") == F.col("n_labelled"))


@query("N6_partition_reconcile", "f_loan", f"""WITH {STATE}, {AGE_KEY}, byage AS ({speeds_sql("age_group,", raw=True)}), tot AS ({speeds_sql("", raw=True)}),
m AS (SELECT t.upb_atrisk AS a, g.a AS b FROM tot t JOIN (SELECT coupon_bucket, yyyymm, sum(upb_atrisk) AS a FROM byage GROUP BY 1, 2) g USING (coupon_bucket, yyyymm)),
r AS (SELECT (SELECT count(*) FROM m) AS n_cells, (SELECT max(abs(a-b)) FROM m) AS gap, (SELECT sum(upb_prepay) FILTER (age_group >= 0)/sum(upb_prepay) FROM byage) AS mass)
SELECT n_cells, {R("gap", 3)} AS max_abs_diff, {R("mass")} AS mass_in_levels, gap < 1.0 AND mass > 0.99 AS ok FROM r""")
def _(fx):
    """Age levels must add up to the total, and the prepaid balance must sit in
    real levels (a sum test alone misses a broken association)."""
    ages = by_age(fx)
    total = survival.realized_cpr_balance(fx.loan).select("coupon_bucket", "yyyymm", "upb_atrisk")
    up = survival.rollup_speeds(ages, ["coupon_bucket", "yyyymm"]).select("coupon_bucket", "yyyymm", "upb_atrisk")
    rec = joins.reconcile(total, up, ["coupon_bucket", "yyyymm"], ["upb_atrisk"]).select(F.col("n_both").alias("n_cells"), "max_abs_diff")
    mass = quality.partition_mass(ages, "age_group", "upb_prepay").select(F.col("in_levels") / F.col("total"))
    row = rec.withColumn("mass_in_levels", mass.scalar())
    return rnd(quality.require(row, (F.col("max_abs_diff") < 1.0) & (F.col("mass_in_levels") > 0.99), "age levels do not reconcile"), 6, max_abs_diff=3)


LAST_FIT = f"{MAPCELL}, {asof_line('lx', 'ly', 'lf', 24)}, z AS (SELECT arg_max(a, mi) AS a, arg_max(b, mi) AS b FROM lf)"


@query("N7_monotone_in_range", "f_loan f_forecast", f"""{LAST_FIT}, s AS (SELECT DISTINCT floor(inc/0.25)*0.25 AS slice, lx FROM mc), v AS (SELECT slice, lx, 1/(1+exp(-(a+b*lx))) AS y FROM s, z), d AS (SELECT *, y - lag(y) OVER (PARTITION BY slice ORDER BY lx) AS st FROM v)
SELECT slice, coalesce(bool_and(st > 0), true) AS monotone, bool_and(y > 0 AND y < 1) AS in_range, {R("max(y)", 5)} AS max_value FROM d GROUP BY 1""")
def _(fx):
    """The latest map over the observed support of each incentive slice."""
    panel = mapping.cells(forecast_realized(fx))
    fit = mapping.fit_asof(panel, min_months=24).agg(F.max_by(F.struct("a", "b"), "mi").alias("f"))
    df = panel.select((F.floor(F.col("inc") / 0.25) * 0.25).alias("slice"), rates.logit("forecast_cpr").alias("x")).distinct().withColumn("f", fit.scalar())
    out = quality.monotone_in_range(df.withColumn("y", rates.sigmoid(F.col("f.a") + F.col("f.b") * F.col("x"))), "x", "y", ["slice"])
    return rnd(out, 5)


@query("N8_negative_slope_refused", "f_loan f_forecast", f"{MAPCELL}, {asof_line('lx', 'ly', 'lf', 24)} SELECT count(*) AS n_fits, {R('min(b)', 5)} AS min_slope, count(*) FILTER (b <= 0) AS n_refused FROM lf")
def _(fx):
    """Number of as-of fits, their least slope and how many the raising guard would refuse."""
    fit = mapping.fit_asof(forecast_realized(fx), min_months=24)
    return rnd(fit.agg(F.count(F.lit(1)).alias("n_fits"), F.min("b").alias("min_slope"), F.count_if(F.col("b") <= 0).alias("n_refused")), 5)


@query("N9_run_coverage", "f_forecast f_price", """WITH r AS (SELECT 'forecast' AS run, coupon, yyyymm FROM f_forecast UNION ALL SELECT 'price', coupon, yyyymm FROM f_price), k AS (SELECT coupon, yyyymm, count(DISTINCT run) AS c FROM r GROUP BY 1, 2)
SELECT count(*) AS n_cells, count(*) FILTER (c = 2) AS n_common, count(*) = count(*) FILTER (c = 2) AS ok FROM k""")
def _(fx):
    runs = fx.forecast.select(F.lit("forecast").alias("run"), "coupon", "yyyymm").unionByName(fx.price.select(F.lit("price").alias("run"), "coupon", "yyyymm"))
    return quality.verdict(quality.coverage(runs, "run", ["coupon", "yyyymm"]), F.col("n_cells") == F.col("n_common"))
