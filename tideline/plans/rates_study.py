"""Rate pass-through, stability and response-shape studies on month-level tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions.hashing import poisson_weight
from tideline.functions import rates
from tideline.operators import ordering, regression
from tideline.session import cut_lineage

LEGS = ["dy2", "dy5", "dy10"]


def condition_number(s: dict[tuple[str, str], str], xs: list[str]) -> Column:
    """sqrt(largest / smallest eigenvalue) of the symmetric cross-product matrix whose cells are the named columns."""
    m = len(xs)
    eigen = regression.jacobi(f"array({', '.join(f'CAST(`{s[a, b]}` AS DOUBLE)' for a in xs for b in xs)})", m)
    return F.expr(f"transform(array(transform(array({eigen}), e -> transform(sequence(0, {m - 1}), l -> get(e.a, l*{m + 1})))[0]), v -> sqrt(array_max(v)/IF(array_min(v) > 0, array_min(v), NULL)))[0]")


def rolling_pass_through(df: DataFrame, length: int, every: int, y: str = "dpmms", xs: list[str] = LEGS) -> DataFrame:
    """Rolling fit over the last ``length`` months at every ``every``-th end, with
    the condition number of the raw regressors."""
    order = W.orderBy("mi")
    frame = order.rowsBetween(-(length - 1), 0)
    rows = df.withColumn("rn", F.row_number().over(order))
    s = {}
    for i, a in enumerate(xs):
        for b in xs[i:]:
            rows = rows.withColumn(f"_x_{a}_{b}", F.sum(F.col(a) * F.col(b)).over(frame))
            s[a, b] = s[b, a] = f"_x_{a}_{b}"
    rows = rows.withColumn("cond", condition_number(s, xs))
    fit = regression.ols_window(rows, y, xs, frame, ["yyyymm", "mi", "rn", "cond"])
    return fit.filter((F.col("rn") >= length) & ((F.col("rn") - length) % every == 0))


def halves(df: DataFrame, order: str) -> DataFrame:
    """First floor(n/2) months against the rest."""
    rn = F.row_number().over(W.orderBy(order))
    n = F.count(F.lit(1)).over(W.partitionBy())
    return df.withColumn("half", F.when(rn <= F.floor(n / 2), "first").otherwise("second"))


def vif_and_corr(df: DataFrame, xs: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    out = df.agg(*[rates.safe_corr(a, b).alias(n) for n, (a, b) in pairs.items()])
    for x in xs:
        others = [z for z in xs if z != x]
        r2 = regression.ols(df, x, others).select("r2")
        out = out.withColumn(f"vif_{x}", 1 / F.greatest(1 - r2.scalar(), F.lit(1e-12)))
    return out


def local_linear_peak(df: DataFrame, x: str, y: str, lo: float, hi: float, step: float, half: float, min_n: int) -> DataFrame:
    """Steepest local line: each row is unfolded to the centres whose band holds
    it (a bounded number), then fitted per centre."""
    n_centres = round((hi - lo) / step)
    first = F.greatest(F.ceil((F.col(x) - half - lo) / step - 1e-9), F.lit(0))
    last = F.least(F.floor((F.col(x) + half - lo) / step + 1e-9), F.lit(n_centres))
    spread = df.withColumn("_i", F.explode(F.when(first <= last, F.sequence(first, last))))
    centre = F.round(F.lit(lo) + F.col("_i") * step, 2)
    fits = spread.withColumn("cx", centre).filter(
        (F.col(x) >= F.col("cx") - half) & (F.col(x) <= F.col("cx") + half)
    ).groupBy("cx").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope")).filter(F.col("n") >= min_n)
    best = fits.agg(F.max(F.struct(F.round("slope", 10).alias("r"), (-F.col("cx")).alias("neg"), "slope")).alias("m"))
    return best.select(F.col("m.slope").alias("best_slope"), (-F.col("m.neg")).alias("peak_at"))


def range_test(df: DataFrame, x: str, realized: str, model: str, half: float = 0.25) -> DataFrame:
    """Speeds in narrow bands around the 10th and 90th percentile of x, and the
    model's share of the realized range."""
    df = cut_lineage(df.select(x, realized, model))
    q = ordering.exact_quantiles(df, x, {"p10": 0.1, "p90": 0.9}).select(F.struct("p10", "p90"))
    tagged = df.withColumn("_q", q.scalar())
    band = lambda p, c: F.avg(F.when(F.col(x).between(F.col(f"_q.{p}") - half, F.col(f"_q.{p}") + half), F.col(c)))
    out = tagged.agg(
        F.max("_q.p10").alias("p10"), F.max("_q.p90").alias("p90"),
        band("p10", realized).alias("real_p10"), band("p90", realized).alias("real_p90"),
        band("p10", model).alias("_m10"), band("p90", model).alias("_m90"))
    real = F.col("real_p90") - F.col("real_p10")
    return out.withColumn("range_ratio", (F.col("_m90") - F.col("_m10")) / F.nullif(real, F.lit(0.0))).drop("_m10", "_m90")


def bootstrap_mean(df: DataFrame, value: str, weight: str, key: str, reps: int) -> DataFrame:
    """Plain and weighted mean with bootstrap standard errors (ddof 0).

    Every row draws a Poisson(1) count per replicate from a hash of its key, so
    replicates are one partial aggregate and the same on every retry.
    """
    v, w = F.col(value), F.col(weight)
    df = cut_lineage(df.select(key, value, weight))
    draws = df.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn(
        "_k", poisson_weight(key, F.col("_rep")))
    k = F.col("_k")
    per = draws.groupBy("_rep").agg(
        (F.sum(k * v) / F.nullif(F.sum(k), F.lit(0))).alias("m"), (F.sum(k * w * v) / F.nullif(F.sum(k * w), F.lit(0.0))).alias("mw"))
    spread = per.agg(F.stddev_pop("m").alias("se"), F.stddev_pop("mw").alias("weighted_se")).select(F.struct("*"))
    base = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.sum(w * v) / F.sum(w)).alias("weighted_mean"))
    return base.withColumn("_s", spread.scalar()).select("n", "mean", "_s.se", "weighted_mean", "_s.weighted_se")
