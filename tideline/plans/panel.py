"""Raw loan months -> typed feature panel without look-ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.functions import bins, periods, rates
from tideline.operators import joins, selection, survival


def feature_panel(
    loans: DataFrame, market: DataFrame, hpi: DataFrame, cutoff: int | None = None, label_event=None
) -> DataFrame:
    """Typed loan-month rows with the nine model features and the loan label.

    The cutoff comes first, so neither features nor labels see later months. The
    age is derived from the origination month because the file's own age is blank
    on payoff rows.
    """
    event = F.col("zbc") == 1 if label_event is None else label_event
    df = selection.cutoff(loans, cutoff) if cutoff else loans
    df = joins.rate_lookup(df, market)
    df = joins.hpi_double_lookup(df, hpi)
    df = df.select(
        "loan_id", "yyyymm", "vintage", "zbc", "upb", "note_rate",
        rates.incentive("note_rate", "rate_30yr").alias("refi_incentive"),
        F.col("fico").cast("double").alias("fico"),
        F.col("ltv").alias("original_ltv"),
        rates.current_ltv("orig_upb", "ltv", "hpi_orig", "hpi_now").alias("current_ltv"),
        F.col("orig_upb").alias("original_upb"),
        periods.months_between_ym("orig_ym", "yyyymm").cast("double").alias("loan_age"),
        F.col("dti").cast("double").alias("dti"),
        bins.encode_category("purpose", bins.PURPOSE_CODES).alias("purpose_enc"),
        bins.encode_category("property_type", bins.PROPERTY_CODES).alias("property_enc"),
    )
    return survival.with_ever_event(df, event)
