"""Calendar series: month ends, differences, returns, rolling pieces.

Windows without a partition key appear only over tables with at most one row
per calendar day (daily curves) or month, a few thousand rows per century.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions import rates


def month_end(daily: DataFrame, columns: list[str], day: str = "d", by=("yyyymm", "mi")) -> DataFrame:
    """Last non-null value per month for each column on its own."""
    return daily.groupBy(*by).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(day))).alias(c) for c in columns],
        F.max(day).alias("month_end"),
    )


def diff(c: Column | str, order: str = "mi", by: list[str] = []) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    w = W.partitionBy(*by).orderBy(order)
    return c - F.lag(c).over(w)


def curve_basis(monthly: DataFrame, order: str = "mi") -> DataFrame:
    """Changes of level, slope and curvature from month-end yields."""
    y2, y5, y10 = F.col("y2"), F.col("y5"), F.col("y10")
    d = lambda c: diff(c, order)
    return monthly.select(
        "*",
        d((y5 + y10) / 2).alias("d_level"), d(y10 - y5).alias("d_slope"),
        d((y2 + y5 + y10) / 3).alias("d_level3"), d(y10 - y2).alias("d_slope3"),
        d(2 * y5 - y2 - y10).alias("d_curve3"),
        d(y2).alias("dy2"), d(y5).alias("dy5"), d(y10).alias("dy10"),
        ((y5 + y10) / 2 / 12 / 100).alias("income"),
    )


def share_of_total(df: DataFrame, value: str, group: list[str], name: str) -> DataFrame:
    """x / sum(x) per group. The totals are aggregated first and joined back, so a
    hot group never has to sit in one window."""
    totals = df.groupBy(*group).agg(F.sum(value).alias("_total"))
    return df.join(totals, group).withColumn(name, F.try_divide(F.col(value), F.nullif("_total", F.lit(0.0)))).drop("_total")


def total_returns(prices: DataFrame, order: str = "mi") -> DataFrame:
    """(P + c/12 - P_prev) / P_prev per coupon over its priced months."""
    prev = F.lag("price").over(W.partitionBy("coupon").orderBy(order))
    out = prices.filter(F.col("price").isNotNull()).withColumn("price_prev", prev)
    ret = F.try_divide(F.col("price") + F.col("coupon") / 12 - F.col("price_prev"), F.col("price_prev"))
    return out.withColumn("total_return", ret).filter(F.col("total_return").isNotNull())


def treasury_returns(monthly: DataFrame, duration: float = rates.MATCHED_DURATION, order: str = "mi") -> DataFrame:
    """Duration-matched Treasury leg: -D*dy/100 + y/12/100 on the 5y/10y mean."""
    y = (F.col("y5") + F.col("y10")) / 2
    dy = diff(y, order)
    return (
        monthly.withColumn("dy_avg", dy)
        .withColumn("treasury_return", -F.lit(duration) * F.col("dy_avg") / 100 + y / 12 / 100)
        .filter(F.col("treasury_return").isNotNull())
    )


def excess_returns(prices: DataFrame, monthly: DataFrame, market: DataFrame) -> DataFrame:
    """Coupon total return minus the Treasury leg, with the month's market rate."""
    tsy = treasury_returns(monthly).select("yyyymm", "treasury_return", "dy_avg")
    out = total_returns(prices).join(F.broadcast(tsy), "yyyymm")
    return (
        out.withColumn("excess_return", F.col("total_return") - F.col("treasury_return"))
        .join(F.broadcast(market.select("yyyymm", "rate_30yr")), "yyyymm")
    )


def rolling_arrays(df: DataFrame, value: str, length: int, order: str = "mi", keep: list[str] = []) -> DataFrame:
    """Overlapping windows of ``length`` consecutive values, full windows only."""
    w = W.orderBy(order).rowsBetween(0, length - 1)
    packed = F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).over(w)
    out = df.withColumn("_w", F.array_sort(packed)).filter(F.size("_w") == length)
    return out.select(order, *keep, F.transform("_w", lambda e: e["v"]).alias("window"))


def gradient(x: str, y: str, order: str, by: list[str] = []) -> Column:
    """Second-order central difference on uneven spacing, one-sided at the ends."""
    w = W.partitionBy(*by).orderBy(order)
    x0, x1, x2 = F.lag(x).over(w), F.col(x), F.lead(x).over(w)
    y0, y1, y2 = F.lag(y).over(w), F.col(y), F.lead(y).over(w)
    hs, hd = x1 - x0, x2 - x1
    inner = (hs * hs * y2 + (hd * hd - hs * hs) * y1 - hd * hd * y0) / (hs * hd * (hd + hs))
    return F.when(x0.isNull(), (y2 - y1) / hd).when(x2.isNull(), (y1 - y0) / hs).otherwise(inner)


def discount_factor(rate: Column, order: str, by: list[str]) -> Column:
    """Running product of (1 + r/12) for r in percent, as exp of a running sum."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.exp(F.sum(F.log1p(rate / 100 / 12)).over(w))


def forward_rates(zeros: DataFrame, by: list[str] = []) -> DataFrame:
    """Monthly forwards from zeros (percent): (z_m m - z_{m-1} (m-1)) per month."""
    w = W.partitionBy(*by).orderBy("t")
    zm = F.col("zero") * F.col("t")
    prev = F.lag(zm).over(w)
    return zeros.withColumn("forward", F.when(prev.isNull(), F.col("zero")).otherwise(zm - prev))


def drift_correct(paths: DataFrame, forwards: DataFrame, floor: float = 0.01) -> DataFrame:
    """Shift each step's mean to its forward, then floor. Step means are one
    aggregate (33 rows), broadcast back."""
    means = paths.groupBy("t").agg(F.avg("rate").alias("mean_rate"))
    shift = means.join(forwards.select("t", "forward"), "t").select(
        "t", (F.col("forward") - F.col("mean_rate")).alias("shift")
    )
    return paths.join(F.broadcast(shift), "t").withColumn(
        "corrected", F.greatest(F.col("rate") + F.col("shift"), F.lit(floor))
    )


def zcb_reprice(paths: DataFrame, zeros: DataFrame, horizons: list[int], rate: str = "rate") -> DataFrame:
    """E[exp(-sum r/12)] against the curve's discount factor, error in bp.

    A path is at most the horizon long, so its running sum is a small window.
    """
    w = W.partitionBy("path_id").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = paths.withColumn("_s", F.sum(F.col(rate) / 100 / 12).over(w)).filter(F.col("t").isin(horizons))
    model = run.groupBy("t").agg(F.avg(F.exp(-F.col("_s"))).alias("model_df"))
    target = zeros.select("t", F.exp(-F.col("zero") / 100 * F.col("t") / 12).alias("target_df"))
    return model.join(F.broadcast(target), "t").withColumn(
        "error_bp", F.abs(F.col("model_df") - F.col("target_df")) * 10000
    )


def ar1_residualize(df: DataFrame, value: str, order: str = "mi", by: list[str] = []) -> DataFrame:
    """Fit x_t on x_{t-1} by OLS and keep the residual (NULL on the first row)."""
    w = W.partitionBy(*by).orderBy(order)
    lagged = df.withColumn("_lag", F.lag(value).over(w))
    part = W.partitionBy(*by)
    y, x = F.when(F.col("_lag").isNotNull(), F.col(value)), F.col("_lag")
    return (
        lagged.withColumn("rho", F.regr_slope(y, x).over(part))
        .withColumn("alpha", F.regr_intercept(y, x).over(part))
        .withColumn("resid", F.col(value) - (F.col("alpha") + F.col("rho") * F.col("_lag")))
        .drop("_lag")
    )


def lag1_autocorr(df: DataFrame, value: str, order: str = "mi", by: list[str] = [], tiny: float = 1e-12) -> DataFrame:
    """corr(x_t, x_{t-1}); NULL under 3 observations or when a side is flat."""
    w = W.partitionBy(*by).orderBy(order)
    clean = df.filter(F.col(value).isNotNull()).withColumn("_lag", F.lag(value).over(w))
    pair = F.col("_lag").isNotNull()
    a, b = F.when(pair, F.col(value)), F.col("_lag")
    out = clean.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), rates.safe_corr(a, b).alias("_c"),
        F.stddev_samp(a).alias("_sa"), F.stddev_samp(b).alias("_sb"),
    )
    ok = (F.col("n") >= 3) & (F.col("_sa") >= tiny) & (F.col("_sb") >= tiny)
    return out.select(*by, "n", F.when(ok, F.col("_c")).alias("autocorr"))


def standardize(df: DataFrame, columns: list[str], tiny: float = 1e-12) -> DataFrame:
    """z-scores with ddof 1 over the whole frame; a flat column raises at run time."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(f"_st_{c}") for c in columns])
    packed = stats.select(F.struct(*[f"_st_{c}" for c in columns]).alias("st"))
    out = df.withColumn("_st", packed.scalar())
    for c in columns:
        sd = F.col(f"_st._st_{c}.s")
        safe = F.when(sd >= tiny, sd).otherwise(F.raise_error(F.lit(f"{c} has no variance")).cast("double"))
        out = out.withColumn(f"{c}_z", (F.col(c) - F.col(f"_st._st_{c}.m")) / safe)
    return out.drop("_st")
