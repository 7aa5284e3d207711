"""Rates, speeds and closed-form sensitivities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values
SERVICING_SPREAD = 0.50          # realized and factor work
SERVICING_SPREAD_FORECAST = 0.75  # older forecast runs
MATCHED_DURATION = 6.5           # constant duration of the Treasury leg
DISCOUNT_MARKET_RATE = 3.5       # market rate above this is a discount market


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_numeric(c, dtype: str = "double") -> Column:
    """Text to number, NULL when it does not parse (ANSI-safe)."""
    return F.trim(_col(c)).try_cast(dtype)


def coupon_bucket(note_rate) -> Column:
    """Nearest half point, ties to even."""
    return F.rint(_col(note_rate) * 2) / 2


def coupon_bucket_net(note_rate, spread: float = SERVICING_SPREAD) -> Column:
    """Rolling-forecast variant: remove the spread first, then bucket."""
    return F.rint((_col(note_rate) - spread) * 2) / 2


def implied_coupon(bucket, spread: float = SERVICING_SPREAD) -> Column:
    return F.round(_col(bucket) - spread, 2)


def incentive(note_rate, market_rate) -> Column:
    return _col(note_rate) - _col(market_rate)


def relu(c) -> Column:
    return F.greatest(F.lit(0.0), _col(c))


def nonzero(c) -> Column:
    return F.nullif(_col(c).cast("double"), F.lit(0.0))


def current_ltv(original_upb, original_ltv, hpi_orig, hpi_now) -> Column:
    """Loan-to-value today from the *original* balance and the home-price ratio.

    The current balance is zero on a payoff row and would leak the outcome.
    """
    upb = _col(original_upb).cast("double")
    home_value = F.try_divide(upb, nonzero(_col(original_ltv) / 100))
    growth = F.try_divide(_col(hpi_now).cast("double"), nonzero(hpi_orig))
    return F.try_divide(upb, nonzero(home_value * growth)) * 100


def smm_to_cpr(smm) -> Column:
    return 1 - F.pow(1 - _col(smm), F.lit(12.0))


def cpr_to_smm(cpr) -> Column:
    clipped = F.least(F.greatest(_col(cpr), F.lit(0.0)), F.lit(0.99))
    return 1 - F.pow(1 - clipped, F.lit(1.0 / 12.0))


def clip(c, low: float, high: float) -> Column:
    return F.least(F.greatest(_col(c), F.lit(float(low))), F.lit(float(high)))


# fixed values: open interval used before taking a logit
CPR_LO, CPR_HI = 1e-6, 1.0 - 1e-6


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-clip(x, -50.0, 50.0)))


def logit(p) -> Column:
    q = clip(p, CPR_LO, CPR_HI)
    return F.log(q / (1 - q))


def platt(score, a, b) -> Column:
    """Calibrated probability sigmoid(a*score + b)."""
    a = F.lit(float(a)) if isinstance(a, (int, float)) else _col(a)
    b = F.lit(float(b)) if isinstance(b, (int, float)) else _col(b)
    return sigmoid(a * _col(score) + b)


def scurve(x, floor, sat, k, x0) -> Column:
    to = lambda v: F.lit(float(v)) if isinstance(v, (int, float)) else _col(v)
    floor, sat, k, x0 = map(to, (floor, sat, k, x0))
    return floor + (sat - floor) / (1 + F.exp(-k * (_col(x) - x0)))


def beta_level(coupon, phi, par_rate, tiny: float = 1e-12) -> Column:
    """(r - c) / ((r + phi)(phi + c)) with rates in percent; 0 when degenerate."""
    r, c, p = _col(par_rate) / 100, _col(coupon) / 100, _col(phi)
    den = (r + p) * (p + c)
    return F.when(F.abs(den) < tiny, F.lit(0.0)).otherwise((r - c) / F.nullif(den, F.lit(0.0)))


def beta_slope(coupon, phi, par_rate, spread: float = SERVICING_SPREAD) -> Column:
    """Level beta times the borrower's moneyness max(0, note - r), as a fraction."""
    money = relu(_col(coupon) + spread - _col(par_rate)) / 100
    return beta_level(coupon, phi, par_rate) * money


def perpetuity_duration(par_rate, phi) -> Column:
    return F.try_divide(F.lit(1.0), _col(par_rate) / 100 + _col(phi))


def market_type(market_rate, threshold: float = DISCOUNT_MARKET_RATE) -> Column:
    return F.when(_col(market_rate) > threshold, F.lit("DM")).otherwise(F.lit("PM"))


def security_type(coupon, par_rate) -> Column:
    return F.when(_col(coupon) > _col(par_rate), F.lit("premium")).otherwise(F.lit("discount"))


def duration_level(*krds) -> Column:
    cols = [_col(k) for k in krds]
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total


def duration_slope(short, long) -> Column:
    return (_col(long) - _col(short)) / 2


def duration_curve(k2, k5, k10) -> Column:
    return (2 * _col(k5) - _col(k2) - _col(k10)) / 6


def hazard_index(incentive_col, age_col, coef: dict[str, float]) -> Column:
    """Linear hazard index: intercept + incentive and age terms."""
    return (
        F.lit(float(coef["intercept"]))
        + F.lit(float(coef["incentive"])) * _col(incentive_col)
        + F.lit(float(coef["age"])) * _col(age_col)
    )


def safe_corr(x, y) -> Column:
    """Correlation aggregate over rows where both are present; NULL (not an error)
    when a side is flat."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    scale = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.try_divide(F.covar_pop(x, y), F.nullif(scale, F.lit(0.0)))
