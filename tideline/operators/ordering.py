"""Global ranks, running totals and exact quantiles without a one-task window.

Values are first counted per distinct value (a heavy value becomes one row),
then cut into ordered buckets whose totals are small enough for a window; each
bucket finishes on its own task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions import rates
from tideline.functions.hashing import unit_hash
from tideline.session import cut_lineage


def _bucketed(counts: DataFrame, value: str, buckets: int) -> DataFrame:
    """Add ``_bk``: how many of the approximate quantiles lie below the value.

    The cut points are one bounded row; any cut points give the same final
    answer, they only balance the work.
    """
    probs = [i / buckets for i in range(1, buckets)]
    cuts = counts.agg(F.percentile_approx(value, probs, 10000).alias("cuts"))
    return (
        counts.withColumn("_cuts", cuts.scalar())
        # never NULL, so the later join adds no null test that would push this
        # expression down below the counting step
        .withColumn("_bk", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0)))
        .drop("_cuts")
    )


def running_totals(
    counts: DataFrame, value: str, sums: list[str], group: list[str] = [], buckets: int = 64
) -> DataFrame:
    """For rows unique in (group, value): for every column s in ``sums`` add
    ``s_before`` (total over smaller values) and ``s_total`` (group total).

    ``counts`` is read for the cut points, the bucket totals and the result; pass
    it through ``value_counts`` or ``cut_lineage`` so that what it came from
    (often the whole panel) is computed once.
    """
    cut = _bucketed(counts, value, buckets)
    per_bucket = cut.groupBy(*group, "_bk").agg(*[F.sum(s).alias(f"_{s}_bk") for s in sums])
    earlier = W.partitionBy(*group).orderBy("_bk").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    offsets = per_bucket.select(
        *group,
        "_bk",
        *[F.coalesce(F.sum(f"_{s}_bk").over(earlier), F.lit(0)).alias(f"_{s}_off") for s in sums],
        *[F.sum(f"_{s}_bk").over(whole).alias(f"{s}_total") for s in sums],
    )
    inside = W.partitionBy(*group, "_bk").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    joined = cut.join(offsets, [*group, "_bk"])
    return joined.select(
        *counts.columns,
        *[
            (F.col(f"_{s}_off") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"{s}_before")
            for s in sums
        ],
        *[f"{s}_total" for s in sums],
    )


def value_counts(df: DataFrame, value: str, group: list[str] = [], **extra: Column) -> DataFrame:
    """One row per distinct value (and group) with its count ``n`` and any extra
    aggregates, checkpointed: the one pass over the input."""
    aggs = [F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in extra.items()]]
    return cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(*aggs))


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], group: list[str] = [], buckets: int = 64
) -> DataFrame:
    """Linearly interpolated quantiles per group, named by the keys of ``probs``."""
    return quantiles_of_counts(value_counts(df, value, group), value, probs, group, buckets)


def quantiles_of_counts(
    counts: DataFrame, value: str, probs: dict[str, float], group: list[str] = [], buckets: int = 64
) -> DataFrame:
    """The same from a table of distinct values and their counts ``n``."""
    run = running_totals(counts, value, ["n"], group, buckets)
    last_pos = F.col("n_before") + F.col("n") - 1
    aggs = [F.max("n_total").alias("n")]
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("n_total") - 1)
        aggs.append(F.min(F.when(last_pos >= F.floor(pos), F.col(value))).alias(f"_{name}_lo"))
        aggs.append(F.min(F.when(last_pos >= F.ceil(pos), F.col(value))).alias(f"_{name}_hi"))
    out = run.groupBy(*group).agg(*aggs)
    picks = []
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        picks.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*group, "n", *picks)


def hash_buckets(df: DataFrame, id_col: str, seed: int | str = 42, buckets: int | None = None) -> DataFrame:
    """Adds the id's hash ``_h`` in [0, 1) and its leading bucket ``_bk``; there are
    four buckets to a shuffle partition, 256 at least."""
    many = buckets or max(256, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    h = df.withColumn("_h", unit_hash(id_col, seed))
    return h.withColumn("_bk", F.coalesce(F.floor(F.col("_h") * many).cast("int"), F.lit(0)))


def bucket_offsets(h: DataFrame, within: list[str]) -> DataFrame:
    """Rows before each bucket in its group (``_off``) and of the group (``_size``)."""
    sizes = h.groupBy(*within, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*within).orderBy("_bk").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(
        *within,
        "_bk",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
        F.sum("_n").over(W.partitionBy(*within)).alias("_size"),
    )


def hash_rank(
    df: DataFrame, id_col: str, within: list[str] = [], seed: int | str = 42, buckets: int | None = None
) -> DataFrame:
    """1-based rank of every row in a random but repeatable order inside each
    ``within`` group (``_rank``) and the group size (``_size``).

    The hash is uniform, so its leading part is a balanced bucket: a group that
    holds a third of all rows is still ranked by ``buckets`` tasks.
    """
    h = hash_buckets(df, id_col, seed, buckets)
    order = W.partitionBy(*within, "_bk").orderBy("_h", id_col)
    return (
        h.join(bucket_offsets(h, within), [*within, "_bk"])
        .withColumn("_rank", F.col("_off") + F.row_number().over(order))
        .drop("_h", "_bk", "_off")
    )


def auc(df: DataFrame, score: str, label: str, group: list[str] = [], buckets: int = 64) -> DataFrame:
    """Exact ROC AUC with ties at half, overall or per group; NULL with one class."""
    counts = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*group, score)
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
    )
    run = running_totals(cut_lineage(counts), score, ["neg"], group, buckets)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    out = run.groupBy(*group).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("_wins")
    )
    pairs = F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))
    return out.withColumn("auc", F.try_divide(F.col("_wins"), pairs)).drop("_wins")


def average_ranks(df: DataFrame, value: str, group: list[str], name: str) -> DataFrame:
    """Average rank with ties inside each group; groups are calendar-bounded
    series (coupons or months), not raw rows."""
    order = W.partitionBy(*group).orderBy(value)
    ties = W.partitionBy(*group, value)
    return df.withColumn(name, F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def spearman(df: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    ranked = average_ranks(average_ranks(df, x, group, "_rx"), y, group, "_ry")
    return ranked.groupBy(*group).agg(rates.safe_corr("_rx", "_ry").alias("spearman"), F.count(F.lit(1)).alias("n"))
