"""Lookups, as-of joins and reconciliations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# A dimension side is broadcast only when its key space is fixed (calendar
# months x regions x coupons); everything else is left to Spark's own size test.


def unique_side(side: DataFrame, keys: list[str]) -> DataFrame:
    """A lookup side that stops the job at a repeated key instead of multiplying
    the rows it is joined to."""
    values = [c for c in side.columns if c not in keys]
    once = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in values])
    guard = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"repeated lookup key {keys}")).cast("boolean"))
    return once.filter(guard).select(*side.columns)


def rate_lookup(panel: DataFrame, market: DataFrame, key: str = "yyyymm", how: str = "left") -> DataFrame:
    """Period -> market rate; one row per calendar month, so the side is bounded."""
    return panel.join(F.broadcast(unique_side(market.select(key, "rate_30yr"), [key])), key, how)


def hpi_double_lookup(
    panel: DataFrame, hpi: DataFrame, region="zip3", orig="orig_ym", now="yyyymm", period="yyyymm", value="hpi"
) -> DataFrame:
    """Home price at origination and now.

    The prices of a region become one map from period to value, so a row is looked
    up twice by one join on the region. The side has one row per region (three
    digits of a postal code, a thousand at most, times the calendar) and is
    broadcast; no panel row moves, however many share a region.
    """
    known = unique_side(hpi.select(region, period, value).filter(F.col(region).isNotNull() & F.col(period).isNotNull()), [region, period])
    maps = known.groupBy(region).agg(F.map_from_entries(F.collect_list(F.struct(period, value))).alias("_prices"))
    out = panel.join(F.broadcast(maps), region, "left")
    at = lambda c: F.when(F.col(c).isNotNull(), F.try_element_at("_prices", F.col(c)))
    return out.withColumn("hpi_orig", at(orig)).withColumn("hpi_now", at(now)).drop("_prices")


def loan_state_join(panel: DataFrame, state: DataFrame, loan: str = "loan_id") -> DataFrame:
    """Loan state onto its rows; rows of loans without a rate drop. Both sides are
    shuffled on the loan (or read co-located from buckets); AQE splits hot loans."""
    return panel.join(state.filter(F.col("last_rate").isNotNull()), loan)


def asof_join(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, values: list[str], by: list[str] = []
) -> DataFrame:
    """Last right row on or before each left row (inclusive), per ``by`` key.

    Union plus one ordered window instead of a range join: each side is read and
    moved once whatever the gaps. Without ``by`` both sides must be calendar
    series (one row per day at most), which is the only keyless use here.
    """
    lcols = left.columns
    probe = left.select(
        *lcols, F.col(left_on).alias("_t"), F.lit(1).alias("_probe"),
        *[F.lit(None).cast(right.schema[v].dataType).alias(f"_v_{v}") for v in values],
        F.lit(None).cast(right.schema[right_on].dataType).alias("_seen"),
    )
    build = right.select(
        *[F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in lcols],
        F.col(right_on).alias("_t"), F.lit(0).alias("_probe"),
        *[F.col(v).alias(f"_v_{v}") for v in values],
        F.col(right_on).alias("_seen"),
    )
    order = W.partitionBy(*by).orderBy("_t", "_probe").rowsBetween(W.unboundedPreceding, W.currentRow)
    packed = F.when(F.col("_probe") == 0, F.struct(*[f"_v_{v}" for v in values], "_seen"))
    out = probe.unionByName(build).withColumn("_last", F.last(packed, ignorenulls=True).over(order))
    return out.filter(F.col("_probe") == 1).select(
        *lcols,
        *[F.col(f"_last._v_{v}").alias(v) for v in values],
        F.col("_last._seen").alias("asof_" + right_on),
    )


def nearest_month_lookup(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Exact month, else the month with the smallest day distance; ties go to the
    earlier one. ``key`` is a date column on both sides, ``right`` one row per month."""
    before = asof_join(left.select(key).distinct(), right, key, key, [value])
    flip = lambda df: df.withColumn("_neg", -F.datediff(F.col(key), F.lit("1970-01-01").cast("date")))
    later = asof_join(
        flip(left.select(key).distinct()),
        flip(right).select("_neg", F.col(value).alias("_later"), F.col(key).alias("_later_key")),
        "_neg", "_neg", ["_later", "_later_key"],
    ).select(key, "_later", "_later_key")
    both = before.join(later, key)
    back = F.datediff(F.col(key), F.col("asof_" + key))
    ahead = F.datediff(F.col("_later_key"), F.col(key))
    use_later = F.col("asof_" + key).isNull() | (F.col("_later_key").isNotNull() & (ahead < back))
    picked = both.select(
        key,
        F.when(use_later, F.col("_later")).otherwise(F.col(value)).alias(value),
        F.when(use_later, F.col("_later_key")).otherwise(F.col("asof_" + key)).alias("matched_" + key),
    )
    return left.join(picked, key)


def prior_row(df: DataFrame, order: str, columns: dict[str, str], by: list[str] = []) -> DataFrame:
    """Previous row's values under new names (information date = previous row)."""
    w = W.partitionBy(*by).orderBy(order)
    return df.select("*", *[F.lag(src).over(w).alias(dst) for dst, src in columns.items()])


def model_dispatch(
    df: DataFrame, validity: DataFrame, key: str = "mi", available: DataFrame | None = None, default: str = "default"
) -> DataFrame:
    """Attach the model valid in each month. ``validity`` is (model, from_mi,
    to_mi); its ranges unfold to months so the lookup is an equi-join. A model
    missing from ``available`` falls back to the default."""
    months = validity.select("model", F.explode(F.sequence("from_mi", "to_mi")).alias(key))
    if available is not None:
        months = months.join(F.broadcast(available.select("model")), "model", "left_semi")
    return df.join(months, key, "left").withColumn("model", F.coalesce("model", F.lit(default)))


def grid(df: DataFrame, **axes: list[float]) -> DataFrame:
    """Every row with every combination of the given axes, by unfolding literal
    arrays (a parameter grid; no join)."""
    out = df
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return out


def reconcile(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full outer match on keys: cell coverage and the largest absolute and
    relative difference per column, as one row per column."""
    a = old.select(*keys, *[F.col(c).cast("double").alias(f"{c}_old") for c in columns], F.lit(1).alias("_old"))
    b = new.select(*keys, *[F.col(c).cast("double").alias(f"{c}_new") for c in columns], F.lit(1).alias("_new"))
    m = a.join(b, keys, "full_outer")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    parts = []
    for c in columns:
        diff = F.abs(F.col(f"{c}_new") - F.col(f"{c}_old"))
        rel = F.try_divide(diff, F.nullif(F.abs(F.col(f"{c}_old")), F.lit(0.0)))
        parts.append(F.struct(
            F.lit(c).alias("column"),
            F.max(F.when(both, diff)).alias("max_abs_diff"),
            F.coalesce(F.max(F.when(both, rel)), F.lit(0.0)).alias("max_rel_diff"),
        ))
    row = m.agg(
        F.count_if(both).alias("n_both"),
        F.count_if(F.col("_new").isNull()).alias("n_only_old"),
        F.count_if(F.col("_old").isNull()).alias("n_only_new"),
        F.array(*parts).alias("parts"),
    )
    return row.select("n_both", "n_only_old", "n_only_new", F.explode("parts").alias("p")).select(
        "p.column", "n_both", "n_only_old", "n_only_new", "p.max_abs_diff", "p.max_rel_diff"
    )


def full_outer_sides(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Side indicator per key: both, left_only or right_only."""
    a = old.select(*keys, F.lit(True).alias("_l"))
    b = new.select(*keys, F.lit(True).alias("_r"))
    side = (
        F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    )
    return a.join(b, keys, "full_outer").select(*keys, side.alias("side"))
