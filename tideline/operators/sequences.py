"""Person-period rows and padded sequences of a loan's first months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

MAX_STEPS = 33  # fixed value: months kept per loan

# fixed values: feature order of one sequence step
FEATURES = [
    "refi_incentive", "fico", "original_ltv", "current_ltv", "original_upb",
    "loan_age", "dti", "purpose_enc", "property_enc",
]


def timesteps(df: DataFrame, max_steps: int = MAX_STEPS, loan="loan_id", order="yyyymm") -> DataFrame:
    """0-based step ``t`` within the loan, first ``max_steps`` rows only.

    The bound sits right on the ranking, so Spark trims each input partition to
    ``max_steps`` rows per loan before the shuffle.
    """
    rn = F.row_number().over(W.partitionBy(loan).orderBy(order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= max_steps).withColumn("t", F.col("_rn") - 1).drop("_rn")


def person_period(steps: DataFrame, event: Column, loan="loan_id") -> DataFrame:
    """(loan, t) rows up to and including the event step, ``y`` = 1 at it.

    At most MAX_STEPS rows per loan, so the per-loan window is bounded.
    """
    part = W.partitionBy(loan)
    hit = F.min(F.when(event, F.col("t"))).over(part)
    out = steps.withColumn("event_step", F.coalesce(hit, F.lit(-1)))
    last = F.max("t").over(part)
    out = out.withColumn("max_t", F.when(F.col("event_step") >= 0, F.col("event_step")).otherwise(last))
    return (
        out.filter(F.col("t") <= F.col("max_t"))
        .withColumn("y", F.when(F.col("t") == F.col("event_step"), 1).otherwise(0))
        .withColumn("event_loan", F.when(F.col("event_step") >= 0, 1).otherwise(0))
        .withColumn("n_steps", F.col("max_t") + 1)
        .drop("max_t")
    )


def observed_steps(steps: DataFrame, event: Column, loan="loan_id") -> DataFrame:
    """Every observed step with ``y`` = 1 at the event step (none dropped)."""
    hit = F.min(F.when(event, F.col("t"))).over(W.partitionBy(loan))
    return steps.withColumn("event_step", F.coalesce(hit, F.lit(-1))).withColumn(
        "y", F.when(F.col("t") == F.col("event_step"), 1).otherwise(0))


def event_step(steps: DataFrame, event: Column, by: list[str]) -> DataFrame:
    """Earliest event step per key, only where there is one."""
    return steps.filter(event).groupBy(*by).agg(F.min("t").alias("event_step"))


def scaler_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """One row of mean and population std per feature (flat features scale by 1)."""
    sd = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(F.lit(1.0))
    return df.agg(*[F.struct(F.avg(c).alias("mean"), sd(c).alias("scale")).alias(c) for c in features])


def scale(df: DataFrame, stats: DataFrame, features: list[str]) -> DataFrame:
    """(x - mean) / std with statistics of the training rows only."""
    out = df.withColumn("_st", stats.select(F.struct("*")).scalar())
    return out.withColumns({
        c: (F.col(c) - F.col(f"_st.{c}.mean")) / F.col(f"_st.{c}.scale") for c in features
    }).drop("_st")


def unscale(df: DataFrame, stats: DataFrame, features: list[str]) -> DataFrame:
    out = df.withColumn("_st", stats.select(F.struct("*")).scalar())
    return out.withColumns({
        c: F.col(c) * F.col(f"_st.{c}.scale") + F.col(f"_st.{c}.mean") for c in features
    }).drop("_st")


def build_sequences(
    df: DataFrame, features: list[str], event: Column, label: str = "prepaid", max_steps: int = MAX_STEPS, loan="loan_id",
    dtype: str = "float",
) -> DataFrame:
    """One row per loan: padded feature matrix, mask, label and event step.

    Rows with any missing feature drop before steps are numbered. The arrays
    exist only here, at the edge to a trainer; other jobs keep the long form.
    """
    steps = timesteps(df.na.drop(subset=features), max_steps, loan)
    cell = F.struct("t", F.array(*[F.col(c).cast(dtype) for c in features]).alias("x"))
    zero = F.array(*[F.lit(0.0).cast(dtype)] * len(features))
    out = steps.groupBy(loan).agg(
        F.array_sort(F.collect_list(cell)).alias("_c"),
        F.max(label).cast("double").alias("label"),
        F.coalesce(F.min(F.when(event, F.col("t"))), F.lit(-1)).alias("event_step"),
    )
    n = F.size("_c")
    return out.select(
        loan,
        F.concat(F.transform("_c", lambda e: e["x"]), F.array_repeat(zero, F.lit(max_steps) - n)).alias("seq"),
        F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), F.lit(max_steps) - n)).alias("mask"),
        "label", "event_step", n.alias("n_steps"),
    )


def survival_cdf(steps: DataFrame, hazard: str, loan="loan_id", by: list[str] = []) -> DataFrame:
    """1 - prod(1 - h) per loan as a sum of logs (combines map-side); a hazard of
    one or more ends survival exactly."""
    sure = F.bool_or(F.col(hazard) >= 1)
    log_s = F.sum(F.log1p(-F.when(F.col(hazard) < 1, F.col(hazard))))
    return steps.groupBy(*by, loan).agg(
        F.when(sure, F.lit(1.0)).otherwise(1 - F.exp(log_s)).alias("cdf"), F.count(F.lit(1)).alias("n_steps"))


def survival_curves(paths: DataFrame, prob: str, path="path_id") -> DataFrame:
    """Hazard, cumulative and survival arrays per path by one array fold:
    hazard_t = p_t * S_{t-1}, cdf accumulates, S = 1 - cdf; clipped to [0, 1]."""
    ordered = paths.groupBy(path).agg(F.array_sort(F.collect_list(F.struct("t", F.col(prob).alias("p")))).alias("_c"))
    empty = F.array().cast("array<double>")
    start = F.struct(F.lit(0.0).alias("cdf"), empty.alias("h"), empty.alias("c"))

    def step(acc, e):
        h = e["p"] * (1 - acc["cdf"])
        c = acc["cdf"] + h
        return F.struct(c.alias("cdf"), F.concat(acc["h"], F.array(h)).alias("h"), F.concat(acc["c"], F.array(c)).alias("c"))

    unit = lambda arr: F.transform(arr, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    folded = ordered.withColumn("_f", F.aggregate("_c", start, step))
    return folded.select(
        path, unit(F.col("_f.h")).alias("hazard"), unit(F.col("_f.c")).alias("cdf"),
        unit(F.transform("_f.c", lambda c: 1 - c)).alias("survival"))
