"""Prepayment-surprise factors, loadings and prices of risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions import rates, tdist
from tideline.operators import regression, series


def level_slope_factors(panel: DataFrame, min_n: int = 3, order: str = "mi") -> DataFrame:
    """Per month: line of forecast and realized speed on the truncated incentive;
    factors are realized minus forecast intercept (level) and slope.

    With no spread in the incentive the slope is 0 and the level is the mean.
    ``panel``: yyyymm, mi, forecast_cpr, realized_cpr, incentive (>= 0).
    """
    clean = panel.dropna(subset=["forecast_cpr", "realized_cpr", "incentive"])
    x = F.col("incentive")
    aggs = [F.count(F.lit(1)).alias("n"), (F.max(x) - F.min(x)).alias("_range")]
    for side in ("forecast", "realized"):
        y = F.col(f"{side}_cpr")
        aggs += [F.regr_slope(y, x).alias(f"_s_{side}"), F.regr_intercept(y, x).alias(f"_i_{side}"), F.avg(y).alias(f"_m_{side}")]
    g = clean.groupBy("yyyymm", order).agg(*aggs).filter(F.col("n") >= min_n)
    flat = F.col("_range") < 1e-12
    pick = lambda side: (
        F.when(flat, F.col(f"_m_{side}")).otherwise(F.col(f"_i_{side}")),
        F.when(flat, F.lit(0.0)).otherwise(F.col(f"_s_{side}")),
    )
    (xf, yf), (xr, yr) = pick("forecast"), pick("realized")
    return g.select(
        "yyyymm", order, (xr - xf).alias("f_level"), (yr - yf).alias("f_slope"),
        xf.alias("x_fcst"), xr.alias("x_real"), yf.alias("y_fcst"), yr.alias("y_real"))


def empirical_betas(returns: DataFrame, factors: DataFrame, min_n: int = 6, level="f_level", slope="f_slope") -> DataFrame:
    """Per coupon loadings of the excess return on both factors (with constant)."""
    merged = returns.join(
        F.broadcast(factors.select("yyyymm", F.col(level).alias("x"), F.col(slope).alias("y"))), "yyyymm")
    fit = regression.ols(merged, "excess_return", ["x", "y"], ["coupon"])
    return fit.filter(F.col("n") >= min_n).select(
        "coupon", F.col("b_x"), F.col("b_y"), F.col("n").alias("n_obs"), "r2")


def _no_intercept(returns: DataFrame, bx: Column, by: Column, y: str, keys: list[str], extra: list[Column]) -> DataFrame:
    yv = F.col(y)
    return returns.filter(bx.isNotNull() & by.isNotNull() & yv.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(bx * bx).alias("sxx"), F.sum(by * by).alias("syy"), F.sum(bx * by).alias("sxy"),
        F.sum(bx * yv).alias("sxr"), F.sum(by * yv).alias("syr"), F.sum(yv * yv).alias("srr"),
        (F.var_pop(yv) * F.count(yv)).alias("tss"), F.max(F.abs(by)).alias("max_by"), *extra)


def _lambdas(g: DataFrame, single: Column) -> DataFrame:
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    det = F.when(det > regression.PIVOT_TOL * F.col("sxx") * F.col("syy"), det)
    lx2 = (F.col("sxr") * F.col("syy") - F.col("syr") * F.col("sxy")) / det
    ly2 = (F.col("syr") * F.col("sxx") - F.col("sxr") * F.col("sxy")) / det
    lx = F.when(single, F.try_divide(F.col("sxr"), F.nullif("sxx", F.lit(0.0)))).otherwise(lx2)
    ly = F.when(~single, ly2)
    out = g.withColumn("lambda_x", lx).withColumn("lambda_y", ly)
    sse = F.col("srr") - F.col("lambda_x") * F.col("sxr") - F.coalesce(F.col("lambda_y") * F.col("syr"), F.lit(0.0))
    # centred R2 without an intercept: can be negative
    return out.withColumn("r2", F.when(F.col("tss") > 1e-12, 1 - sse / F.col("tss")))


def fama_macbeth_analytic(returns: DataFrame, beta_x: Column, beta_y: Column, min_n: int = 4) -> DataFrame:
    """Monthly cross-section without intercept on analytic loadings; one factor
    when every slope loading is zero. ``returns``: yyyymm, coupon, rate_30yr,
    excess_return."""
    g = _no_intercept(returns, beta_x, beta_y, "excess_return", ["yyyymm"], [
        F.max("rate_30yr").alias("rate_30yr"), F.count_if(F.col("coupon") > F.col("rate_30yr")).alias("n_premium")])
    out = _lambdas(g.filter(F.col("n") >= min_n), F.col("max_by") < 1e-10)
    return out.select(
        "yyyymm", rates.market_type("rate_30yr").alias("market_type"), "rate_30yr", "lambda_x", "lambda_y", "r2",
        F.col("n").alias("n_coupons"), "n_premium", (F.col("n") - F.col("n_premium")).alias("n_discount"))


def loading_correlation(betas: DataFrame) -> DataFrame:
    """One row: correlation of the two loadings across coupons, NULL when flat."""
    ok = (F.stddev_samp("b_x") > 1e-12) & (F.stddev_samp("b_y") > 1e-12)
    return betas.agg(F.when(ok, rates.safe_corr("b_x", "b_y")).alias("rho"))


def fama_macbeth_empirical(
    returns: DataFrame, betas: DataFrame, rho_max: float = 0.90, min_n: int = 4
) -> DataFrame:
    """Monthly cross-section on fixed loadings. Near-collinear loadings switch the
    whole run to one factor; otherwise single collinear months drop."""
    b = F.broadcast(betas.select("coupon", "b_x", "b_y"))
    merged = returns.join(b, "coupon")
    ok = (F.stddev_samp("b_x") > 1e-12) & (F.stddev_samp("b_y") > 1e-12)
    g = _no_intercept(merged, F.col("b_x"), F.col("b_y"), "excess_return", ["yyyymm"], [
        F.when(ok, rates.safe_corr("b_x", "b_y")).alias("rho_month")]).filter(F.col("n") >= min_n)
    g = g.withColumn("rho", loading_correlation(betas).scalar())
    single = F.coalesce(F.abs(F.col("rho")) > rho_max, F.lit(False))
    kept = g.filter(single | ~F.coalesce(F.abs(F.col("rho_month")) > rho_max, F.lit(False)))
    return _lambdas(kept, single).select(
        "yyyymm", "lambda_x", "lambda_y", "n", "r2", F.when(single, "single_factor").otherwise("two_factor").alias("mode"))


def orthogonalized_lambdas(returns: DataFrame, beta_x: Column, beta_y: Column, min_n: int = 4) -> DataFrame:
    """Baseline against slope loadings residualised on the level loadings within
    the month. Second step from first-step moments, no second pass."""
    df = returns.withColumn("_bx", beta_x).withColumn("_by", beta_y).dropna(subset=["_bx", "_by", "excess_return"])
    g = _no_intercept(df, F.col("_bx"), F.col("_by"), "excess_return", ["yyyymm"], [
        F.max("rate_30yr").alias("rate_30yr"), F.sum("_bx").alias("sx"), F.sum("_by").alias("sy"), F.sum("excess_return").alias("sr"),
        F.regr_slope("_by", "_bx").alias("c1"), F.regr_intercept("_by", "_bx").alias("c0"), F.stddev_pop("_bx").alias("sd_x"),
        (F.var_pop("_by") - F.try_divide(F.pow(F.covar_pop("_by", "_bx"), F.lit(2.0)), F.nullif(F.var_pop("_bx"), F.lit(0.0)))).alias("var_o")])
    base = _lambdas(g.filter(F.col("n") >= min_n), F.col("max_by") < 1e-12)
    c0, c1, n = F.col("c0"), F.col("c1"), F.col("n")
    oo = F.col("syy") - 2 * c0 * F.col("sy") - 2 * c1 * F.col("sxy") + c0 * c0 * n + 2 * c0 * c1 * F.col("sx") + c1 * c1 * F.col("sxx")
    xo = F.col("sxy") - c0 * F.col("sx") - c1 * F.col("sxx")
    orr = F.col("syr") - c0 * F.col("sr") - c1 * F.col("sxr")
    usable = (F.col("max_by") >= 1e-12) & (F.col("sd_x") > 1e-12) & (F.sqrt(F.greatest("var_o", F.lit(0.0))) > 1e-12)
    det = F.col("sxx") * oo - xo * xo
    det = F.when(usable & (det > 0), det)
    return base.select(
        "yyyymm", rates.market_type("rate_30yr").alias("market_type"),
        F.col("lambda_x").alias("lx_base"), F.col("lambda_y").alias("ly_base"),
        F.coalesce((F.col("sxr") * oo - orr * xo) / det, F.col("lambda_x")).alias("lx_orth"),
        ((orr * F.col("sxx") - F.col("sxr") * xo) / det).alias("ly_orth"))


def clustered_errors(df: DataFrame, y: str, xs: list[str], cluster: str) -> DataFrame:
    """Pooled least squares with HC0 and cluster-robust t ratios, one row per
    coefficient, and their two-sided p-values on n - k and clusters - 1 degrees.
    Scores are summed per cluster before the outer products."""
    names = ["one", *xs]
    rows = df.dropna(subset=[y, *xs]).withColumn("one", F.lit(1.0))
    solved = regression.solve(
        rows.agg(*regression.raw_moments(F.col(y), {n: F.col(n) for n in names}, F.lit(True))), names, len(names))
    packed = solved.select(F.struct("n", "tss", "sse", *[f"b_{n}" for n in names],
                                    *[f"v_{a}_{b}" for i, a in enumerate(names) for b in names[i:]]))
    e = F.col(y)
    tagged = rows.withColumn("_f", packed.scalar())
    for n in names:
        e = e - F.col(f"_f.b_{n}") * F.col(n)
    tagged = tagged.withColumn("_e", e)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    per = tagged.groupBy(cluster).agg(
        *[F.sum(F.col(n) * F.col("_e")).alias(f"s_{n}") for n in names],
        *[F.sum(F.col(a) * F.col(b) * F.col("_e") * F.col("_e")).alias(f"h_{a}_{b}") for a, b in pairs])
    meat = per.agg(
        F.count(F.lit(1)).alias("n_clusters"),
        *[F.sum(F.col(f"s_{a}") * F.col(f"s_{b}")).alias(f"c_{a}_{b}") for a, b in pairs],
        *[F.sum(f"h_{a}_{b}").alias(f"h_{a}_{b}") for a, b in pairs])
    out = meat.withColumn("_f", packed.scalar())
    key = lambda pre, a, b: f"{pre}_{a}_{b}" if names.index(a) <= names.index(b) else f"{pre}_{b}_{a}"

    def var(pre, n):
        total = F.lit(0.0)
        for a in names:
            for b in names:
                total = total + F.col("_f." + key("v", n, a)) * F.col(key(pre, a, b)) * F.col("_f." + key("v", b, n))
        return total

    table = [
        F.struct(F.lit(n).alias("term"), F.col(f"_f.b_{n}").alias("coef"),
                 (F.col(f"_f.b_{n}") / F.sqrt(var("h", n))).alias("t_plain"),
                 (F.col(f"_f.b_{n}") / F.sqrt(var("c", n))).alias("t_cluster"))
        for n in names
    ]
    r2 = 1 - F.col("_f.sse") / F.col("_f.tss")
    rows = out.select("n_clusters", F.col("_f.n").alias("n"), r2.alias("r2"), F.explode(F.array(*table)).alias("r")).select(
        "r.*", "n", "n_clusters", "r2")
    rows = tdist.with_p_value(rows, "t_plain", f"n - {len(names)}", "p_plain")
    return tdist.with_p_value(rows, "t_cluster", "n_clusters - 1", "p_cluster")


def innovations(factors: DataFrame, columns=("f_level", "f_slope")) -> DataFrame:
    """AR(1) residuals of the factors, z-scored within their own window."""
    out = factors
    for c in columns:
        out = series.ar1_residualize(out, c).withColumn(c, F.col("resid")).drop("rho", "alpha", "resid")
    out = out.dropna(subset=list(columns))
    return series.standardize(out, list(columns))


def beta_spread_sharpe(returns: DataFrame, betas: DataFrame, lambdas: DataFrame, months: int = 12) -> DataFrame:
    """Extreme-loading coupons, implied premium in bps a year and the annualised
    Sharpe ratio of long-high minus short-low. Duplicate (coupon, month) rows stop
    the job."""
    ends = betas.agg(
        F.max_by("coupon", "b_x").alias("hi"), F.max("b_x").alias("b_hi"),
        F.min_by("coupon", "b_x").alias("lo"), F.min("b_x").alias("b_lo"), F.count(F.lit(1)).alias("n_betas"))
    lam = lambdas.agg(F.avg("lambda_x").alias("lambda_x"))
    legs = returns.join(lambdas.select("yyyymm"), "yyyymm", "left_semi").withColumn("_e", ends.select(F.struct("*")).scalar())
    side = F.when(F.col("coupon") == F.col("_e.hi"), 1.0).when(F.col("coupon") == F.col("_e.lo"), -1.0)
    monthly = legs.withColumn("_w", side).filter(F.col("_w").isNotNull()).groupBy("yyyymm").agg(
        F.sum(F.col("_w") * F.col("excess_return")).alias("r"), F.count(F.lit(1)).alias("legs"),
        F.countDistinct("coupon").alias("sides"))
    checked = monthly.withColumn("r", F.when(F.col("legs") == F.col("sides"), F.col("r")).otherwise(
        F.raise_error(F.lit("duplicate (coupon, month) rows")).cast("double"))).filter(F.col("sides") == 2)
    port = checked.agg(F.count("r").alias("n_months"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"))
    out = port.withColumn("_e", ends.select(F.struct("*")).scalar()).withColumn("lambda_x", lam.scalar())
    spread = F.col("_e.b_hi") - F.col("_e.b_lo")
    ok = (F.col("n_months") >= 6) & (F.col("std") >= 1e-12)
    return out.select(
        F.col("_e.hi").alias("hi_coupon"), F.col("_e.lo").alias("lo_coupon"), spread.alias("b_x_spread"), "lambda_x",
        (F.col("lambda_x") * spread * months * 10000).alias("bps_per_year"), "n_months", "mean", "std",
        F.when(ok, F.col("mean") / F.col("std") * F.sqrt(F.lit(float(months)))).alias("sharpe"))


def beta_spread_without_each_month(returns: DataFrame, factors: DataFrame, min_n: int = 6, level="f_level", slope="f_slope") -> DataFrame:
    """Extreme level loadings and their spread with each factor month left out.

    Loadings move by leverage, so no fold is refitted; a coupon without a return
    in the month keeps its full-sample loading.
    """
    fac = factors.select("yyyymm", F.col(level).alias("x"), F.col(slope).alias("y"))
    merged = returns.join(F.broadcast(fac), "yyyymm")
    loo = regression.leave_one_out(merged, "excess_return", ["x", "y"], ["coupon", "yyyymm"], ["coupon"])
    full = empirical_betas(returns, factors, min_n, level, slope).agg(
        F.collect_list(F.struct("coupon", "b_x")).alias("all"))  # one entry per coupon
    folds = fac.select("yyyymm").withColumn("_a", full.scalar()).select("yyyymm", F.explode("_a").alias("c")).select("yyyymm", "c.coupon", F.col("c.b_x").alias("_full"))
    b = folds.join(loo.select("yyyymm", "coupon", "b_x"), ["yyyymm", "coupon"], "left").withColumn("b", F.coalesce("b_x", "_full"))
    return b.groupBy("yyyymm").agg(
        F.max_by("coupon", "b").alias("hi_coupon"), F.min_by("coupon", "b").alias("lo_coupon"),
        (F.max("b") - F.min("b")).alias("b_x_spread"), F.count(F.lit(1)).alias("n_coupons"))
