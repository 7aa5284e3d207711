"""Guards. Each is one aggregate that raises inside the job when violated, so a
bad input stops the write instead of becoming a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions import rates


def require(row: DataFrame, ok: Column, message: str) -> DataFrame:
    """Pass a one-row check table through, raising ``message`` when not ok."""
    flag = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return row.withColumn("ok", flag)


def verdict(row: DataFrame, ok: Column) -> DataFrame:
    """Same table with the verdict as data, for reports."""
    return row.withColumn("ok", F.coalesce(ok, F.lit(False)))


def spread_convention(df: DataFrame, note="note_rate", coupon="coupon") -> DataFrame:
    """Distinct note-minus-coupon offsets; anything but the one spread is a mix."""
    off = F.round(F.col(note) - F.col(coupon), 2)
    return df.agg(F.min(off).alias("min_offset"), F.max(off).alias("max_offset"))


def spread_ok(spread: float) -> Column:
    return (F.col("min_offset") == spread) & (F.col("max_offset") == spread)


def alignment(df: DataFrame, rebuilt: str, reported: str) -> DataFrame:
    """Reconstructed series against the reported one."""
    both = df.filter(F.col(rebuilt).isNotNull() & F.col(reported).isNotNull())
    return both.agg(
        rates.safe_corr(rebuilt, reported).alias("corr"),
        F.max(F.abs(F.col(rebuilt) - F.col(reported))).alias("max_err"),
        F.stddev_samp(reported).alias("sd"),
        F.count(F.lit(1)).alias("n"),
    )


def alignment_ok(min_corr: float = 0.95, max_sd: float = 0.5) -> Column:
    return (F.col("n") > 0) & (F.col("corr") >= min_corr) & (F.col("max_err") <= max_sd * F.col("sd"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of keys held by more than one row."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.count_if(F.col("_n") > 1).alias("n_duplicated"), F.count(F.lit(1)).alias("n_keys"))


def positives_equal_events(steps: DataFrame, labels: DataFrame, y="y", label="label") -> DataFrame:
    """Positive (loan, step) rows against labelled loans."""
    loans = labels.agg(F.sum(label))
    return steps.agg(F.sum(y).alias("n_positive")).withColumn("n_labelled", loans.scalar())


def partition_mass(cells: DataFrame, level: str, value: str) -> DataFrame:
    """Total of a partitioned cube and the part that sits in real levels."""
    return cells.agg(
        F.sum(value).alias("total"), F.sum(F.when(F.col(level) >= 0, F.col(value)).otherwise(0)).alias("in_levels"))


def monotone_in_range(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Per slice: is y strictly rising in x, and inside (0, 1)?"""
    from pyspark.sql import Window as W

    step = F.col(y) - F.lag(y).over(W.partitionBy(*by).orderBy(x))
    return df.withColumn("_step", step).groupBy(*by).agg(
        F.coalesce(F.bool_and(F.col("_step") > 0), F.lit(True)).alias("monotone"),
        F.bool_and((F.col(y) > 0) & (F.col(y) < 1)).alias("in_range"),
        F.max(y).alias("max_value"),
    )


def coverage(runs: DataFrame, run: str, keys: list[str]) -> DataFrame:
    """Cells per run and cells common to all runs; equal when runs are comparable."""
    n_runs = runs.agg(F.countDistinct(run))
    per_key = runs.groupBy(*keys).agg(F.countDistinct(run).alias("_runs"))
    return per_key.withColumn("_n", n_runs.scalar()).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("_runs") == F.col("_n")).alias("n_common"))
