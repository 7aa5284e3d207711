"""Scores by segment, reliability tables and forecast-error summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions import bins
from tideline.functions import rates
from tideline.operators import ordering

# fixed values: segment edges (left-closed) and labels
SEGMENTS = {
    "fico_bucket": ([0, 640, 680, 720, 760, 9999], ["<640", "640-680", "680-720", "720-760", "760+"]),
    "ltv_bucket": ([0, 60, 70, 80, 90, 200], ["<60", "60-70", "70-80", "80-90", "90+"]),
    "refi_bucket": (
        [-99, -1.5, -0.5, 0.5, 1.5, 99],
        ["<-150bps", "-150to-50bps", "-50to+50bps", "+50to+150bps", ">+150bps"],
    ),
    "loan_age_bucket": ([0, 6, 12, 24, 34], ["0-6m", "6-12m", "12-24m", "24-33m"]),
}


def segment_metrics(
    df: DataFrame, segments: dict[str, Column], score_a: str, score_b: str, label: str, min_n: int = 50
) -> DataFrame:
    """Per segment value: rows, event share, AUC of two scores and their gap.

    Every row is unfolded once into its segment values and both scores, and one
    ranking per (segment, value, score) serves all; groups under ``min_n`` or with
    one class drop.
    """
    tags = F.array(*[F.struct(F.lit(n).alias("segment"), c.cast("string").alias("value")) for n, c in segments.items()])
    scores = F.array(*[F.struct(F.lit(w).alias("which"), F.col(c).cast("double").alias("score")) for w, c in (("a", score_a), ("b", score_b))])
    long = df.select(label, scores.alias("_p"), F.explode(tags).alias("_t")).filter(F.col("_t.value").isNotNull())
    long = long.select("_t.segment", "_t.value", label, F.explode("_p").alias("_s")).select("segment", "value", "_s.which", "_s.score", label)
    both = ordering.auc(long, "score", label, ["segment", "value", "which"])
    of = lambda which, c: F.max(F.when(F.col("which") == which, F.col(c)))
    wide = both.groupBy("segment", "value").agg(of("a", "n_pos").alias("n_pos"), of("a", "n_neg").alias("n_neg"), of("a", "auc").alias("auc_a"), of("b", "auc").alias("auc_b"))
    n = F.col("n_pos") + F.col("n_neg")
    return (
        wide.withColumn("n", n)
        .filter((F.col("n") >= min_n) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0))
        .select(
            "segment", "value", "n", (F.col("n_pos") / F.col("n") * 100).alias("event_pct"),
            "auc_a", "auc_b", (F.col("auc_a") - F.col("auc_b")).alias("delta"),
        )
    )


def reliability_table(df: DataFrame, p: str, y: str, bins_n: int = 10) -> DataFrame:
    """Mean prediction and outcome per quantile bin; edges are exact quantiles,
    bins left-closed with the last one closed on both sides. The rows are read
    once, into counts and events per distinct prediction."""
    counts = ordering.value_counts(df.filter(F.col(y).isNotNull()), p, events=F.sum(F.col(y).cast("double")))
    probs = {f"q{i}": i / bins_n for i in range(bins_n + 1)}
    edges = ordering.quantiles_of_counts(counts, p, probs).select(
        F.array(*[f"q{i}" for i in range(bins_n + 1)]).alias("edges")
    )
    tagged = counts.withColumn("_e", edges.scalar())
    passed = F.size(F.filter(F.slice("_e", 2, bins_n - 1), lambda e: e <= F.col(p)))
    n = F.col("n")
    return (
        tagged.withColumn("bin", passed)
        .groupBy("bin")
        .agg((F.sum(n * F.col(p)) / F.sum(n)).alias("mean_pred"), (F.sum("events") / F.sum(n)).alias("mean_actual"), F.sum(n).alias("n"))
    )


def forecast_error(df: DataFrame, forecast: str, actual: str, by: list[str] = []) -> DataFrame:
    e = F.col(forecast) - F.col(actual)
    return df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        rates.safe_corr(forecast, actual).alias("corr"), F.count(F.lit(1)).alias("n"),
    )


def forecast_vs_realized(df: DataFrame, forecast: str, actual: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(forecast).alias("mean_forecast"), F.avg(actual).alias("mean_realized"),
        F.max(forecast).alias("max_forecast"), F.max(actual).alias("max_realized"),
        F.try_divide(F.avg(actual), F.nullif(F.avg(forecast), F.lit(0.0))).alias("ratio"),
        rates.safe_corr(forecast, actual).alias("corr"), F.count(F.lit(1)).alias("n"),
    )


def weighted_scores(df: DataFrame, weight: str, by: list[str]) -> DataFrame:
    """Weighted log-RMSE, log-MAE, level-MAE and clamped share by group."""
    w = F.col(weight)
    mean = lambda c: F.sum(w * c) / F.nullif(F.sum(w), F.lit(0.0))
    e = F.col("log_err")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(mean(e * e)).alias("log_rmse"), mean(F.abs(e)).alias("log_mae"),
        mean(F.abs(F.col("mapped_cpr") - F.col("real_cpr"))).alias("level_mae"),
        (F.avg(F.col("clamped").cast("double")) * 100).alias("clamped_pct"),
    )


def variance_share(df: DataFrame, value: str, group: str, by: list[str], name: str, min_n: int = 10) -> DataFrame:
    """Share of variance between ``group`` means, less what pure noise would give."""
    per = df.groupBy(*by, group).agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_k"))
    between = per.groupBy(*by).agg(
        F.var_samp("_m").alias("_vm"), F.avg(1 / F.col("_k")).alias("_inv"), F.count(F.lit(1)).alias("_g")
    )
    total = df.groupBy(*by).agg(F.var_samp(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    if by:
        joined = between.join(total, by)
    else:
        joined = between.withColumn("_t", total.select(F.struct("*")).scalar()).select("*", "_t.*")
    share = F.greatest(
        F.col("_vm") / F.nullif("_v", F.lit(0.0)) - F.col("_inv") * (1 - 1 / F.col("_g")), F.lit(0.0)
    )
    return joined.select(*by, F.when((F.col("_v") > 0) & (F.col("_n") >= min_n), share).alias(name))
