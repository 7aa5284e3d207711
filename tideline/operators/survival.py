"""Payoff detection and prepayment speeds over a loan-month panel.

Layout: raw rows are combined to one row per (loan, month[, keys]) before they
move, so a loan that owns a large share of the rows arrives as at most one row
per calendar month and key. Only then does a per-loan window find the last two
observed months; cells are summed with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions import rates


def loan_months(
    panel: DataFrame,
    loan: str = "loan_id",
    ym: str = "yyyymm",
    upb: str = "upb",
    rate: str = "note_rate",
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """One row per (loan, month, *keys) with counts and balances of its rows.

    Several rows of one month keep their count (``n_rows``) and the sum over
    rows with a usable balance; the month's own balance is the largest one.
    """
    usable = F.col(upb) >= 0
    has_rate = F.col(rate).isNotNull()
    return (
        panel.filter(F.col(loan).isNotNull() & F.col(ym).isNotNull())
        .groupBy(F.col(loan).alias("loan_id"), F.col(ym).alias("yyyymm"), *keys)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(usable).alias("n_valid"),
            F.sum(F.when(usable, F.col(upb))).alias("w_valid"),
            F.max(F.when(has_rate, F.col(upb))).alias("month_upb"),
            F.max(F.col(rate)).alias("month_rate"),
        )
    )


def last_appearance(
    panel: DataFrame, loan="loan_id", ym="yyyymm", upb="upb", rate="note_rate", keys: tuple[str, ...] = ()
) -> DataFrame:
    """Per loan over *all* files: last month, balance and rate there, payoff month.

    A loan is prepaid when the balance on its last row is zero; a NULL balance is
    censored. Rows of one month tie-break on the larger balance.
    """
    usable = F.col(loan).isNotNull() & F.col(ym).isNotNull() & F.col(rate).isNotNull()
    last = F.max(F.struct(F.col(ym).alias("yyyymm"), F.col(upb).alias("upb"), F.col(rate).alias("rate")))
    return (
        panel.filter(usable)
        .groupBy(*keys, F.col(loan).alias("loan_id"))
        .agg(last.alias("last"))
        .select(
            *keys,
            "loan_id",
            F.col("last.yyyymm").alias("last_ym"),
            F.col("last.upb").alias("last_upb"),
            F.col("last.rate").alias("last_rate"),
            F.when(F.col("last.upb") == 0, F.col("last.yyyymm")).alias("payoff_ym"),
        )
    )


def with_loan_state(months: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Attach each loan's last month, payoff month, balance before payoff, and
    first and last rate to its (loan, month) rows. One shuffle, on the loan."""
    part = W.partitionBy(*keys, "loan_id")
    has_rate = F.col("month_rate").isNotNull()
    newest = part.orderBy(has_rate.desc(), F.col("yyyymm").desc())
    ranked = months.withColumn("_rd", F.dense_rank().over(newest))
    last, prior = has_rate & (F.col("_rd") == 1), has_rate & (F.col("_rd") == 2)
    seen = F.when(has_rate, F.col("yyyymm"))
    state = ranked.select(
        *ranked.columns,
        F.max(F.when(last, F.col("yyyymm"))).over(part).alias("last_ym"),
        F.max(F.when(last, F.col("month_upb"))).over(part).alias("last_upb"),
        F.max(F.when(prior, F.col("month_upb"))).over(part).alias("prior_upb"),
        F.max(F.when(last, F.col("month_rate"))).over(part).alias("last_rate"),
        F.min(F.struct(seen.isNull(), seen, F.col("month_rate"))).over(part)["month_rate"].alias("first_rate"),
    )
    paid = F.col("last_upb") == 0
    return state.select(
        "*",
        F.when(paid, F.col("last_ym")).alias("payoff_ym"),
        F.when(paid, F.col("prior_upb")).alias("payoff_balance"),
    ).drop("_rd")


def payoff_balance(panel: DataFrame, **cols) -> DataFrame:
    """Prepaid loans with the balance of their second latest distinct month."""
    state = with_loan_state(loan_months(panel, **cols))
    return state.filter(F.col("yyyymm") == F.col("payoff_ym")).select(
        "loan_id", "payoff_ym", "payoff_balance"
    ).distinct()


def at_risk_count(state: DataFrame) -> tuple[Column, Column]:
    """Row counts at risk (payoff month included) and newly prepaid."""
    pm, ym, n = F.col("payoff_ym"), F.col("yyyymm"), F.col("n_rows")
    return (
        F.when(pm.isNull() | (ym <= pm), n).otherwise(F.lit(0)),
        F.when(ym == pm, n).otherwise(F.lit(0)),
    )


def at_risk_balance() -> dict[str, Column]:
    """Balance-weighted at-risk and prepaid contributions of one (loan, month).

    The payoff month weighs the *previous* month's balance, since its own is 0;
    rows without a usable weight drop out of numerator and denominator alike.
    """
    pm, ym, pb, n = F.col("payoff_ym"), F.col("yyyymm"), F.col("payoff_balance"), F.col("n_rows")
    active = pm.isNull() | (ym < pm)
    payoff = (ym == pm) & pb.isNotNull() & (pb >= 0)
    zero, none = F.lit(0.0), F.lit(0)
    return {
        "n_atrisk": F.when(active, F.col("n_valid")).when(payoff, n).otherwise(none),
        "n_prepay": F.when(payoff, n).otherwise(none),
        "upb_atrisk": F.when(active, F.coalesce("w_valid", zero)).when(payoff, pb * n).otherwise(zero),
        "upb_prepay": F.when(payoff, pb * n).otherwise(zero),
    }


def count_speeds(cells: DataFrame) -> DataFrame:
    smm = F.try_divide(F.col("n_prepay"), F.nullif(F.col("n_atrisk"), F.lit(0)))
    return cells.withColumn("smm", smm).withColumn("cpr", rates.smm_to_cpr("smm"))


def balance_speeds(cells: DataFrame) -> DataFrame:
    """SMM and CPR by balance and by count; cells without balance are dropped."""
    return (
        cells.filter(F.col("upb_atrisk") > 0)
        .withColumn("smm_upb", F.col("upb_prepay") / F.col("upb_atrisk"))
        .withColumn("cpr_upb", rates.smm_to_cpr("smm_upb"))
        .withColumn("smm_count", F.try_divide(F.col("n_prepay"), F.nullif(F.col("n_atrisk"), F.lit(0))))
        .withColumn("cpr_count", rates.smm_to_cpr("smm_count"))
    )


def realized_cpr_count(panel: DataFrame, spread: float = rates.SERVICING_SPREAD, **cols) -> DataFrame:
    """Count-based speed by (coupon bucket, month); bucket from the last rate."""
    state = with_loan_state(loan_months(panel, **cols)).filter(F.col("last_rate").isNotNull())
    at_risk, prepaid = at_risk_count(state)
    cells = (
        state.groupBy(rates.coupon_bucket("last_rate").alias("coupon_bucket"), "yyyymm")
        .agg(F.sum(at_risk).alias("n_atrisk"), F.sum(prepaid).alias("n_prepay"))
        .filter(F.col("n_atrisk") > 0)
    )
    return count_speeds(cells).withColumn(
        "implied_mbs_coupon", rates.implied_coupon("coupon_bucket", spread)
    )


def realized_cpr_balance(
    panel: DataFrame, spread: float = rates.SERVICING_SPREAD, keys: tuple[str, ...] = (), **cols
) -> DataFrame:
    """Balance-weighted speed by (coupon bucket, month[, keys]); bucket from the
    first-seen rate. ``keys`` are panel columns such as the seasoning group."""
    state = with_loan_state(loan_months(panel, keys=keys, **cols)).filter(F.col("first_rate").isNotNull())
    cells = state.groupBy(rates.coupon_bucket("first_rate").alias("coupon_bucket"), "yyyymm", *keys).agg(
        *[F.sum(c).alias(name) for name, c in at_risk_balance().items()]
    )
    return balance_speeds(cells).withColumn(
        "implied_mbs_coupon", rates.implied_coupon("coupon_bucket", spread)
    )


def cohort_members(panel: DataFrame, cohorts: dict[str, list[str]], vintage: str = "vintage") -> DataFrame:
    """Tag rows with every cohort their vintage belongs to (a vintage may be in
    several); rows of no cohort drop before any shuffle."""
    tags: dict[str, list[str]] = {}
    for name, vintages in cohorts.items():
        for v in vintages:
            tags.setdefault(v, []).append(name)
    out = F.array().cast("array<string>")
    for v, names in tags.items():
        out = F.when(F.col(vintage) == v, F.array(*[F.lit(n) for n in names])).otherwise(out)
    return panel.filter(F.col(vintage).isin(list(tags))).withColumn("cohort", F.explode(out))


def realized_cpr_by_incentive(
    panel: DataFrame,
    market: DataFrame,
    cohorts: dict[str, list[str]],
    bin_of,
    max_age: int = 33,
    age: str = "age",
) -> DataFrame:
    """Count-based speed by cohort and incentive bin, with the cohort's own last
    appearance. ``market`` is (yyyymm, rate_30yr), one row per calendar month."""
    tagged = cohort_members(panel, cohorts)
    keep = F.col(age).isNotNull() & (F.col(age) <= max_age)
    tagged = tagged.withColumn("_in", F.when(keep, 1).otherwise(0))
    months = (
        tagged.filter(F.col("loan_id").isNotNull() & F.col("yyyymm").isNotNull())
        .groupBy("cohort", "loan_id", "yyyymm")
        .agg(
            F.sum("_in").alias("n_rows"),
            F.max(F.when(F.col("note_rate").isNotNull(), F.col("upb"))).alias("month_upb"),
            F.max("note_rate").alias("month_rate"),
        )
    )
    state = with_loan_state(months, keys=("cohort",)).filter(
        (F.col("n_rows") > 0) & F.col("last_rate").isNotNull()
    )
    priced = state.join(F.broadcast(market.select("yyyymm", "rate_30yr")), "yyyymm")
    at_risk, prepaid = at_risk_count(priced)
    label = bin_of(F.col("last_rate") - F.col("rate_30yr"))
    cells = (
        priced.withColumn("refi_bin", label)
        .filter(F.col("refi_bin").isNotNull())
        .groupBy("cohort", "refi_bin")
        .agg(F.sum(at_risk).alias("n_atrisk"), F.sum(prepaid).alias("n_prepay"))
        .filter(F.col("n_atrisk") > 0)
    )
    return count_speeds(cells)


def realized_cpr_flagged(panel: DataFrame, bucket: Column, event: Column) -> DataFrame:
    """Simple speed from an event flag: rows and events by (bucket, month)."""
    cells = panel.groupBy(bucket.alias("coupon_bucket"), "yyyymm").agg(
        F.count(F.lit(1)).alias("n_atrisk"), F.count_if(event).alias("n_prepay")
    )
    return count_speeds(cells)


def rollup_speeds(cells: DataFrame, by: list[str]) -> DataFrame:
    """Coarser cells: sum balances, then recompute speeds (never average a CPR)."""
    return balance_speeds(
        cells.groupBy(*by).agg(
            *[F.sum(c).alias(c) for c in ("n_atrisk", "n_prepay", "upb_atrisk", "upb_prepay")]
        )
    )


def last_known(panel: DataFrame, columns: list[str], loan="loan_id", order="yyyymm") -> DataFrame:
    """Per loan the last non-null value of each column on its own."""
    return panel.groupBy(loan).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    )


def ever_event(panel: DataFrame, event: Column, loan="loan_id", name="prepaid") -> DataFrame:
    """Loan-level flag: 1 when any of its rows satisfies ``event``."""
    return panel.groupBy(loan).agg(
        F.max(F.when(event, F.lit(1)).otherwise(F.lit(0))).alias(name)
    )


def with_ever_event(panel: DataFrame, event: Column, loan="loan_id", name="prepaid") -> DataFrame:
    """The flag on every row. Only loans with an event travel to the join."""
    hits = panel.filter(event).select(loan).distinct().withColumn("_hit", F.lit(1))
    return panel.join(hits, loan, "left").withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_hit")
