"""Row selection: cutoffs, id sets, hash samples, top-n per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions import periods
from tideline.functions.hashing import unit_hash
from tideline.operators import ordering


def cutoff(df: DataFrame, last_yyyymm: int, ym: str = "yyyymm") -> DataFrame:
    """No look-ahead: drop everything after the cutoff before labels are made."""
    return df.filter(F.col(ym) <= last_yyyymm)


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "loan_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str = "loan_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def vintage_prune(df: DataFrame, through_year: int, vintage: str = "vintage") -> DataFrame:
    """Vintages originated up to a year; a range on the partition column, so it
    prunes folders when the panel is partitioned by vintage."""
    return df.filter(F.col(vintage) <= f"{through_year}Q4")


def loan_sample(df: DataFrame, fraction: float, key: str = "loan_id", seed: int | str = 42) -> DataFrame:
    """Whole loans with probability ``fraction``: same loans on every run, no shuffle."""
    return df.filter(unit_hash(key, seed) < fraction)


def capped_sample(df: DataFrame, cap: int, by: list[str], key: str, seed: int | str = 42) -> DataFrame:
    """At most ``cap`` rows per group in hash order (a sampling operator).

    The hash cuts a group into leading buckets. Counts say in which bucket the cap
    is reached; rows behind it are dropped where they are read, and the ranking
    inside a bucket is bounded, so Spark trims it before the shuffle.
    """
    h = ordering.hash_buckets(df, key, seed)
    sizes = ordering.bucket_offsets(h, by).filter(F.col("_off") < cap).drop("_size")
    last = sizes.groupBy(*by).agg(F.max("_bk").alias("_last"))
    lead = _lookup(h, last, by).filter(F.col("_bk") <= F.col("_last")).drop("_last")
    order = W.partitionBy(*by, "_bk").orderBy("_h", key)
    first = lead.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= cap)
    ranked = _lookup(first, sizes, [*by, "_bk"])
    return ranked.filter(F.col("_off") + F.col("_rn") <= cap).drop("_h", "_bk", "_rn", "_off")


def _lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where NULL equals NULL."""
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(named, same).drop(*[f"_k_{k}" for k in keys])


def balanced_sample(df: DataFrame, label: str, n_per_class: int, key: str, seed: int | str = 42) -> DataFrame:
    """``n_per_class`` rows of each class in hash order (all, if there are fewer)."""
    return capped_sample(df, n_per_class, [label], key, seed)


def stratified_split(df: DataFrame, label: str, key: str, train: float = 0.8, seed: int | str = 42) -> DataFrame:
    """Adds ``split``: the first round(train * n) ids of each class in hash order
    are train. Class proportions are exact; ids are expected to be unique."""
    ranked = ordering.hash_rank(df, key, [label], seed)
    is_train = F.col("_rank") <= F.round(F.col("_size") * train, 0)
    return ranked.withColumn("split", F.when(is_train, "train").otherwise("test")).drop("_rank", "_size")


def person_period_weights(steps: DataFrame, y: str = "y", loan: str = "loan_id") -> DataFrame:
    """Weights that reproduce in expectation a half-and-half batch: half from
    event loans, half from all loans, then a uniform step of the loan.

    ``steps`` has one row per loan and allowed step (up to the event step), with
    ``event_loan`` 0/1 and ``n_steps``. No rows are copied.
    """
    loans = steps.select(loan, "event_loan").distinct().agg(
        F.count(F.lit(1)).alias("n_all"), F.sum("event_loan").alias("n_event"))
    out = steps.withColumn("_n", loans.select(F.struct("*")).scalar())
    from_event = F.when(F.col("event_loan") == 1, F.lit(0.5) / F.col("_n.n_event")).otherwise(F.lit(0.0))
    return out.withColumn("weight", (from_event + F.lit(0.5) / F.col("_n.n_all")) / F.col("n_steps")).drop("_n")


def oversample(df: DataFrame, event: Column, copies: int) -> DataFrame:
    """Replicate event rows ``copies`` times (adds ``copy`` 0-based)."""
    n = F.when(event, F.lit(copies)).otherwise(F.lit(1))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))


def latest_rows(df: DataFrame, n: int, by: list[str], order: str) -> DataFrame:
    """Latest n rows per group; Spark cuts each input partition to n per group
    before the shuffle, so a hot group never travels whole."""
    rn = F.row_number().over(W.partitionBy(*by).orderBy(F.col(order).desc()))
    return df.withColumn("rn", rn).filter(F.col("rn") <= n)


def groups_with_at_least(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """Rows of groups with at least n rows: counts are aggregated first and
    semi-joined, so no group is gathered."""
    big = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select(*by)
    return df.join(big, by, "left_semi")


def regimes(df: DataFrame, periods_by_name: dict[str, tuple[int, int]], ym: str = "yyyymm") -> DataFrame:
    """Tag rows with every named [from, to] period they fall in (may overlap)."""
    tags = [F.when(F.col(ym).between(a, b), F.lit(name)) for name, (a, b) in periods_by_name.items()]
    return df.withColumn("regime", F.explode(F.array_compact(F.array(*tags))))
