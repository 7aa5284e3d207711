"""Forecast jobs on loans and on (month, coupon) cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.functions import rates
from tideline.operators import selection


def rolling_forecast(scored: DataFrame, cutoff_year: int) -> DataFrame:
    """By coupon: mean annualised hazard at the cutoff against the share of loans
    that prepaid in the following year.

    ``scored`` has loan_id, yyyymm, note_rate, zbc, vintage and the monthly hazard
    ``h``. The hazard is the one at each loan's last month up to the cutoff.
    """
    pool = selection.vintage_prune(scored, cutoff_year)
    at_cutoff = (
        selection.cutoff(pool, cutoff_year * 100 + 12).groupBy("loan_id").agg(F.max_by("h", "yyyymm").alias("h"))
    )
    year = (cutoff_year + 1) * 100
    active = pool.filter(F.col("yyyymm").between(year + 1, year + 12)).groupBy("loan_id").agg(
        F.min_by("note_rate", "yyyymm").alias("note_rate"),
        F.max(F.when(F.col("zbc") == 1, 1).otherwise(0)).alias("realized"),
    )
    annual = rates.smm_to_cpr(rates.clip("h", 0.0, 1 - 1e-7))
    return (
        at_cutoff.join(active.filter(F.col("note_rate").isNotNull()), "loan_id")
        .groupBy(rates.coupon_bucket_net("note_rate").alias("coupon"))
        .agg(
            F.count(F.lit(1)).alias("n_loans"), F.sum("realized").alias("n_prepaid"),
            (F.avg(annual) * 100).alias("forecast_cpr"), (F.avg("realized") * 100).alias("realized_cpr"),
        )
    )
