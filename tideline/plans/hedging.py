"""Hedged returns and their diagnostics on the (month, coupon) panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions import rates
from tideline.operators import regression


def hedged_returns(panel: DataFrame, curve_leg: bool = True) -> DataFrame:
    """hedged = total return - income + (sum of duration times shock)/100, from
    key-rate durations krd2/krd5/krd10 and shocks d_level, d_slope, d_curve."""
    out = panel.withColumns({
        "dur_level": rates.duration_level("krd2", "krd5", "krd10"),
        "dur_slope": rates.duration_slope("krd2", "krd10"),
        "dur_curve": rates.duration_curve("krd2", "krd5", "krd10"),
    })
    move = F.col("dur_level") * F.col("d_level") + F.col("dur_slope") * F.col("d_slope")
    if curve_leg:
        move = move + F.col("dur_curve") * F.col("d_curve")
    return out.withColumn("hedged", F.col("total_return") - F.col("income") + move / 100)


def verification(panel: DataFrame, shocks: list[str]) -> DataFrame:
    """Per coupon: hedged return on the shocks; every t should be near zero."""
    return regression.ols(panel, "hedged", shocks, ["coupon"])


def spread_control(panel: DataFrame, market: DataFrame, min_n: int = 10) -> DataFrame:
    """Hedged return on level and slope with and without the change of the
    mortgage spread, for both timings of the market rate: the panel's own (known
    at the information date) and the return month's."""
    own = market.select("yyyymm", F.col("rate_30yr").alias("pmms_ret"))
    df = panel.join(F.broadcast(own), "yyyymm", "left")
    w = W.partitionBy("coupon").orderBy("mi")
    d10 = F.col("d_level") + F.col("d_slope") / 2
    chg = lambda c: F.col(c) - F.lag(c).over(w) - d10
    tags = F.array(
        F.struct(F.lit("panel").alias("timing"), F.col("_a").alias("d_spread")),
        F.struct(F.lit("return_month").alias("timing"), F.col("_b").alias("d_spread")))
    long = df.withColumn("_a", chg("pmms")).withColumn("_b", chg("pmms_ret")).select(
        "coupon", "hedged", "d_level", "d_slope", F.explode(tags).alias("s")).select("*", "s.timing", "s.d_spread").filter(F.col("d_spread").isNotNull())
    keys = ["timing", "coupon"]
    without = regression.ols(long, "hedged", ["d_level", "d_slope"], keys).select(*keys, F.col("t_d_level").alias("t_level_no"))
    full = regression.ols(long, "hedged", ["d_level", "d_slope", "d_spread"], keys).select(
        *keys, "n", F.col("t_d_level").alias("t_level_yes"), F.col("t_d_slope").alias("t_slope_yes"), F.col("t_d_spread").alias("t_spread"))
    vif = regression.ols(long, "d_level", ["d_slope", "d_spread"], keys).select(*keys, (1 / F.greatest(1 - F.col("r2"), F.lit(1e-12))).alias("vif_level"))
    return full.join(without, keys).join(vif, keys).filter(F.col("n") >= min_n)


def hedge_exposure(df: DataFrame, duration: float = rates.MATCHED_DURATION, min_n: int = 8) -> DataFrame:
    """Residual rate exposure of the excess return and the duration it implies."""
    two = regression.ols(df, "excess_return", ["dy5", "dy10"], ["coupon"]).filter(F.col("n") >= min_n)
    one = regression.ols(df, "excess_return", ["dy_avg"], ["coupon"])
    return two.select("coupon", "n", "t_dy5", "t_dy10", "r2").join(
        one.select("coupon", (duration - 100 * F.col("b_dy_avg")).alias("implied_duration"), "t_dy_avg"), "coupon")


def control_t(df: DataFrame, y: str, control: str, with_n: bool = False, by: list[str] = ["coupon"]) -> DataFrame:
    fit = regression.ols(df, y, [control], by)
    return fit.select(*by, *(["n"] if with_n else []), f"t_{control}")


def empirical_hedge(panel: DataFrame, control: str = "dy2") -> DataFrame:
    """Fit the unhedged return on level and slope per coupon, remove the fitted
    rate part (the intercept stays), and test what is left on the control."""
    df = panel.withColumn("unh", F.col("total_return") - F.col("income"))
    xs = ["d_level", "d_slope"]
    fit = regression.ols(df, "unh", xs, ["coupon"])
    resid = regression.residuals(df, fit, "unh", xs, ["coupon"])
    kept = resid.join(fit.select("coupon", "b0"), "coupon").withColumn("excess", F.col("resid") + F.col("b0"))
    before = control_t(df, "unh", control, True).withColumnRenamed(f"t_{control}", "t_unhedged")
    after = control_t(kept, "excess", control).withColumnRenamed(f"t_{control}", "t_hedged")
    return fit.select("coupon", F.col("b_d_level").alias("b_level"), F.col("b_d_slope").alias("b_slope"), "r2").join(before, "coupon").join(after, "coupon")


def expanding_hedge(panel: DataFrame, shocks: list[str], min_months: int) -> DataFrame:
    """Durations refitted on strictly earlier months of the coupon; rows without
    ``min_months`` of history drop. Adds fit_<shock> (years) and hedged_fit."""
    df = panel.withColumn("unh", F.col("total_return") - F.col("income"))
    past = W.partitionBy("coupon").orderBy("mi").rowsBetween(W.unboundedPreceding, -1)
    keep = list(dict.fromkeys(["coupon", "yyyymm", "mi", "unh", *shocks, "dy1", "dy2", "dy30"]))
    fit = regression.ols_window(df.select(*keep), "unh", shocks, past, keep, min_months)
    hedged = F.col("unh")
    for s in shocks:
        hedged = hedged - F.col(f"b_{s}") * F.col(s)
    out = fit.filter(F.col("n") >= min_months).withColumn("hedged_fit", hedged)
    return out.withColumns({f"fit_{s}": -100 * F.col(f"b_{s}") for s in shocks})


def exposure_by_year(panel: DataFrame, control: str, min_months: int, min_n: int) -> DataFrame:
    """t of two- and three-factor expanding hedges on the control, by year."""
    def hedge(shocks, name):
        h = expanding_hedge(panel, shocks, min_months)
        return h.select("coupon", "yyyymm", control, F.col("hedged_fit").alias(name))

    two = hedge(["d_level", "d_slope"], "h2")
    three = hedge(["d_level", "d_slope", "d_curve"], "h3").drop(control)
    both = two.join(three, ["coupon", "yyyymm"]).withColumn("year", F.floor(F.col("yyyymm") / 100))
    keys = ["coupon", "year"]
    a = control_t(both, "h2", control, True, keys).withColumnRenamed(f"t_{control}", "t_two")
    b = control_t(both, "h3", control, False, keys).withColumnRenamed(f"t_{control}", "t_three")
    return a.join(b, keys).filter(F.col("n") >= min_n)


def pair_vol(panel: DataFrame, months: int = 12) -> DataFrame:
    """Annualised volatility of hedged spreads: each coupon against the next lower
    one that is present, and the widest pair. Partners come from the distinct
    coupons, so a missing coupon widens its neighbours' pair."""
    order = W.orderBy("coupon")
    known = panel.select("coupon").distinct().select("coupon", F.lag("coupon").over(order).alias("_below"), F.min("coupon").over(W.partitionBy(F.lit(0))).alias("_lo"), F.max("coupon").over(W.partitionBy(F.lit(0))).alias("_hi"))
    widest = F.when((F.col("coupon") == F.col("_hi")) & (F.col("_lo") < F.col("_hi")), F.col("_lo"))
    base = panel.select("yyyymm", "coupon", "hedged").join(F.broadcast(known), "coupon")
    partner = F.array("_below", widest)
    high = base.select("yyyymm", F.col("coupon").alias("hi"), F.col("hedged").alias("_h"), F.explode(F.array_compact(F.array_distinct(partner))).alias("lo"))
    low = panel.select("yyyymm", F.col("coupon").alias("lo"), F.col("hedged").alias("_l"))
    d = F.col("_h") - F.col("_l")
    return high.join(low, ["yyyymm", "lo"]).groupBy("hi", "lo").agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), (F.stddev_samp(d) * F.sqrt(F.lit(float(months)))).alias("ann_vol"),
        (F.avg(d) / F.nullif(F.stddev_samp(d), F.lit(0.0)) * F.sqrt(F.lit(float(months)))).alias("sharpe"))


def coupon_vol(panel: DataFrame, months: int = 12) -> DataFrame:
    """Annualised volatility of each coupon's own hedged return."""
    h = F.col("hedged")
    return panel.groupBy("coupon").agg(F.count(h).alias("n"), F.avg(h).alias("mean"), (F.stddev_samp(h) * F.sqrt(F.lit(float(months)))).alias("ann_vol"))


def duration_capture(panel: DataFrame) -> DataFrame:
    """Model against empirical duration spread, and the largest gap between the
    empirical duration and model plus residual duration."""
    df = panel.withColumn("unh", F.col("total_return") - F.col("income"))
    xs = ["d_level", "d_slope"]
    resid = regression.ols(df, "hedged", xs, ["coupon"]).select("coupon", (-100 * F.col("b_d_level")).alias("resid_d"))
    emp = regression.ols(df, "unh", xs, ["coupon"]).select("coupon", (-100 * F.col("b_d_level")).alias("emp_d"))
    mod = df.groupBy("coupon").agg(F.avg("dur_level").alias("mod_d"))
    j = resid.join(emp, "coupon").join(mod, "coupon").withColumn("gap", F.abs(F.col("emp_d") - F.col("resid_d") - F.col("mod_d")))
    ms, es = F.max("mod_d") - F.min("mod_d"), F.max("emp_d") - F.min("emp_d")
    return j.agg(ms.alias("model_spread"), es.alias("implied_spread"), (100 * ms / F.nullif(es, F.lit(0.0))).alias("capture_pct"),
                 F.max("gap").alias("worst_gap"), F.max_by("coupon", "gap").alias("worst_coupon"))


def duration_scale_sweep(panel: DataFrame, control: str, scales: list[float]) -> DataFrame:
    """Scale the model durations, sum the squared out-of-basis t over coupons, and
    find the scale with the smallest sum, also with each coupon left out."""
    from tideline.operators import joins

    g = joins.grid(panel, scale=scales)
    move = F.col("dur_level") * F.col("d_level") + F.col("dur_slope") * F.col("d_slope") + F.col("dur_curve") * F.col("d_curve")
    g = g.withColumn("h", F.col("total_return") - F.col("income") + F.col("scale") * move / 100)
    t = control_t(g, "h", control, False, ["scale", "coupon"]).withColumn("t2", F.pow(F.col(f"t_{control}"), F.lit(2.0)))
    total = F.sum("t2").over(W.partitionBy("scale"))
    loo = t.select(F.col("coupon").cast("string").alias("left_out"), "scale", (total - F.col("t2")).alias("s"))
    every = t.groupBy("scale").agg(F.sum("t2").alias("s")).select(F.lit("all").alias("left_out"), "scale", "s")
    best = F.min(F.struct(F.round("s", 9).alias("r"), "scale", "s"))
    return every.unionByName(loo).groupBy("left_out").agg(best.alias("m")).select("left_out", F.col("m.scale").alias("best_scale"), F.col("m.s").alias("sum_t2"))


def factor_tracking(panel: DataFrame) -> DataFrame:
    """Does the model's curvature duration, or the realized curvature, move with
    the 2-year; are curvature, level and slope separable; definition ratio."""
    from tideline.operators import ordering

    monthly = panel.select("yyyymm", "d_level", "d_slope", "d_curve", "dy2", "dy5", "dy10").distinct()
    alt = F.col("dy5") - (F.col("dy2") + F.col("dy10")) / 2
    ratio = monthly.filter(F.abs(alt) > 1e-12).withColumn("_r", F.col("d_curve") / alt)
    med = ordering.exact_quantiles(ratio, "_r", {"definition_ratio": 0.5}).select("definition_ratio")
    cc = monthly.agg(rates.safe_corr("d_curve", "d_level").alias("cl"), rates.safe_corr("d_curve", "d_slope").alias("cs")).select(F.struct("*"))
    return panel.groupBy("coupon").agg(
        rates.safe_corr("dur_curve", "dy2").alias("corr_model"), rates.safe_corr("d_curve", "dy2").alias("corr_realized")
    ).withColumn("_c", cc.scalar()).withColumn("definition_ratio", med.scalar()).select(
        "coupon", "corr_model", "corr_realized", F.col("_c.cl").alias("corr_curve_level"), F.col("_c.cs").alias("corr_curve_slope"), "definition_ratio")
