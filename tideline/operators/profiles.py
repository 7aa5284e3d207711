"""Distribution and data-quality profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions import bins
from tideline.operators import ordering

# fixed values: codes that close a loan
ZERO_BALANCE_CODES = [1, 2, 3, 6, 9, 15, 16]


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts and shares over left-closed bins (last one open-ended), repeated
    with mean, population std, exact median and the positive share.

    One pass over the rows: everything comes from the counts of distinct values.
    """
    counts = ordering.value_counts(df, value)
    v, n = F.col(value), F.col("n")
    per_bin = counts.groupBy(bins.bin_index(v, edges, "left").alias("bin")).agg(F.sum(n).alias("n_bin"))
    first = counts.agg(
        (F.sum(n * v) / F.sum(n)).alias("mean"), F.sum(n).alias("n"),
        (F.sum(F.when(v > 0, n).otherwise(F.lit(0))) / F.sum(n)).alias("share_positive"))
    dev = v - F.col("_f.mean")
    second = counts.withColumn("_f", first.select(F.struct("*")).scalar()).agg(
        F.max("_f").alias("_s"), F.sqrt(F.sum(n * dev * dev) / F.sum(n)).alias("std"))
    med = ordering.quantiles_of_counts(counts, value, {"median": 0.5}).select("median")
    out = per_bin.withColumn("_t", second.select(F.struct("*")).scalar()).withColumn("median", med.scalar())
    return out.select("bin", "n_bin", (F.col("n_bin") / F.col("_t._s.n")).alias("share"),
                      "_t._s.mean", "_t.std", "median", "_t._s.share_positive")


def quantile_profile(df: DataFrame, value: str, entity: str) -> DataFrame:
    """Min, p5, median, p95, max, bucket shares, and variation within entities.

    The rows are read once, into counts per (entity, value).
    """
    pairs = ordering.value_counts(df, value, [entity])
    v, n = F.col(value), F.col("n")
    counts = pairs.groupBy(value).agg(F.sum("n").alias("n"))
    share = lambda test: F.sum(F.when(test, n).otherwise(F.lit(0))) / F.sum(n)
    basic = counts.agg(
        F.min(v).alias("min"), F.max(v).alias("max"), share(v < 60).alias("share_lt60"),
        share((v >= 60) & (v < 80)).alias("share_60_80"), share((v >= 80) & (v < 100)).alias("share_80_100"),
        share(v >= 100).alias("share_ge100"))
    quant = ordering.quantiles_of_counts(counts, value, {"p5": 0.05, "median": 0.5, "p95": 0.95})
    means = pairs.groupBy(entity).agg(F.sum(n).alias("_k"), (F.sum(n * v) / F.sum(n)).alias("_m")).filter(F.col("_k") >= 2)
    dev = v - F.col("_m")
    within = pairs.join(means, entity).groupBy(entity).agg(F.sqrt(F.sum(n * dev * dev) / F.sum(n)).alias("sd"))
    sds = ordering.value_counts(within, "sd")
    spread = ordering.quantiles_of_counts(sds, "sd", {"within_median": 0.5}).select("within_median")
    over = sds.agg(F.sum(F.when(F.col("sd") > 1, n).otherwise(F.lit(0))) / F.sum(n))
    return (
        quant.withColumn("_b", basic.select(F.struct("*")).scalar())
        .withColumn("within_median", spread.scalar()).withColumn("within_over_1", over.scalar())
        .select("n", "p5", "median", "p95", "_b.*", "within_median", "within_over_1")
    )


def bucket_means(df: DataFrame, x: str, width: float, means: dict[str, str], min_n: int) -> DataFrame:
    """Means per equal-width bucket of x, buckets with fewer than ``min_n`` dropped."""
    return (
        df.groupBy((F.floor(F.col(x) / width) * width).alias(f"{x}_lo"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(n) for n, c in means.items()])
        .filter(F.col("n") >= min_n)
    )


def schema_profile(df: DataFrame, by: str, numeric: list[str], codes: list[str]) -> DataFrame:
    """Row count, null percentage per numeric column, sorted distinct codes per
    code column. Code sets are category columns: small by definition."""
    pct = lambda c: F.avg(F.when(F.col(c).isNull(), 100.0).otherwise(0.0))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[pct(c).alias(f"{c}_null_pct") for c in numeric],
        *[F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}_codes") for c in codes],
    )


def find_code_column(df: DataFrame, columns: list[str], codes: list[int]) -> DataFrame:
    """Columns whose non-zero numeric values all lie in ``codes`` and include 1.

    One aggregation pass over flags; the code list of a hit has at most
    ``len(codes)`` members.
    """
    num = lambda c: F.col(c).cast("string").try_cast("double")
    known = [float(c) for c in codes]
    row = df.agg(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.coalesce(F.bool_and(F.when(num(c) != 0, num(c).isin(known))), F.lit(False)).alias("all_known"),
            F.count_if(num(c) == 1).alias("n_ones"),
            F.collect_set(F.when(num(c).isin(known), num(c).cast("bigint").cast("string"))).alias("seen"),
        ).alias(f"_{i}")
        for i, c in enumerate(columns)
    ])
    cand = row.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(columns))])).alias("c"))
    return cand.filter(F.col("c.all_known") & (F.col("c.n_ones") > 0)).select(
        "c.column_name", "c.n_ones", F.array_join(F.array_sort("c.seen"), ",").alias("codes"))


def stage_trace(df: DataFrame, stages: dict[str, Column], event: Column, loan: str = "loan_id") -> DataFrame:
    """Rows, event rows and event loans left after each cumulative filter.

    One scan: each row is unfolded into the stages it survives.
    """
    alive, tags = F.lit(True), []
    for name, keep in stages.items():
        alive = alive & F.coalesce(keep, F.lit(False))
        tags.append(F.when(alive, F.lit(name)))
    hit = F.coalesce(event, F.lit(False))
    per_loan = (
        df.select(F.col(loan).alias("_loan"), hit.alias("_hit"), F.explode(F.array_compact(F.array(*tags))).alias("stage"))
        .groupBy("stage", "_loan")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("_hit").alias("e"))
    )
    return per_loan.groupBy("stage").agg(
        F.sum("n").alias("n_rows"), F.sum("e").alias("event_rows"), F.count_if(F.col("e") > 0).alias("event_loans"))


def value_shares(df: DataFrame, value: str) -> DataFrame:
    """Count and share per distinct value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n"))
    return counts.withColumn("_t", total.scalar()).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def monotone_verdict(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Net change and share of up-steps along x, and the shape they imply."""
    step = F.col(y) - F.lag(y).over(W.partitionBy(*by).orderBy(x))
    out = df.withColumn("_step", step).groupBy(*by).agg(
        (F.max_by(y, x) - F.min_by(y, x)).alias("net_change"),
        F.avg(F.when(F.col("_step") > 0, 1.0).when(F.col("_step").isNotNull(), 0.0)).alias("frac_up"))
    net, up = F.col("net_change"), F.col("frac_up")
    verdict = F.when((net > 0) & (up > 0.6), "s-curve").when((net < 0) & (up < 0.4), "inverted").otherwise("flat")
    return out.withColumn("verdict", verdict)
