"""Pass-through cash flows as one array fold per row: no exploded months, no UDF.

Array lambdas are interpreted per element, so anything constant over the months
is bound once with ``let`` and the fold itself is kept to a few operations.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tideline.functions import rates


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it as often as needed in ``body``."""
    return F.transform(F.array(value), body)[0]


def discounts(zeros: Column) -> Column:
    """Monthly discount factors from monthly zeros (percent, continuous)."""
    return F.transform(zeros, lambda z, i: F.exp(z * (i + 1) / F.lit(-1200.0)))


def _months(coupon: Column, cpr: Column, disc: Column, spread: float) -> Column:
    """Per month: share kept after prepayment, the same times monthly growth at
    the note rate, discount factor, and discounted balance plus coupon."""
    growth, income = 1 + (coupon + spread) / 1200, 1 + coupon / 1200

    def pair(g_i, c, d):
        kept = F.pow(1 - rates.clip(c, 0.0, 0.99), F.lit(1.0 / 12.0))
        return let(kept, lambda k: F.struct(k.alias("k"), (k * g_i["g"]).alias("kg"), d.alias("d"), (d * g_i["i"]).alias("di")))

    return let(F.struct(growth.alias("g"), income.alias("i")), lambda gi: F.zip_with(cpr, disc, lambda c, d: pair(gi, c, d)))


def _payment(coupon: Column, spread: float, n: int) -> Column:
    note = (coupon + spread) / 1200
    return note / (1 - F.pow(1 + note, F.lit(float(-n))))


def price(coupon: Column, cpr: Column, disc: Column, spread: float = rates.SERVICING_SPREAD, n: int = 360) -> Column:
    """Price per 100 of a level-pay pass-through from monthly speeds (annual
    decimals) and monthly discount factors, both as arrays.

    The balance is carried in units of the level payment: it grows by the note
    rate, loses one payment (never below zero) and keeps the unprepaid share; the
    cash of the month is the balance plus coupon less the new balance.
    """
    pay = _payment(coupon, spread, n)
    start = F.struct((1 / pay).alias("u"), F.lit(0.0).alias("pv"))

    def step(acc, m):
        left = F.greatest(acc["u"] * m["kg"] - m["k"], F.lit(0.0))
        return F.struct(left.alias("u"), (acc["pv"] + acc["u"] * m["di"] - left * m["d"]).alias("pv"))

    return F.aggregate(_months(coupon, cpr, disc, spread), start, step, lambda a: a["pv"]) * pay * 100


def price_and_duration(coupon: Column, cpr: Column, disc: Column, spread: float = rates.SERVICING_SPREAD, n: int = 360) -> Column:
    """struct(pv, tpv): price and time-weighted value; tpv/pv is the closed-form
    duration to a parallel shift of the zeros."""
    pay = _payment(coupon, spread, n)
    months = F.transform(_months(coupon, cpr, disc, spread), lambda m, i: F.struct(m["k"], m["kg"], m["d"], m["di"], ((i + 1) / F.lit(12.0)).alias("t")))
    start = F.struct((1 / pay).alias("u"), F.lit(0.0).alias("pv"), F.lit(0.0).alias("tpv"))

    def step(acc, m):
        left = F.greatest(acc["u"] * m["kg"] - m["k"], F.lit(0.0))
        value = acc["u"] * m["di"] - left * m["d"]
        return F.struct(left.alias("u"), (acc["pv"] + value).alias("pv"), (acc["tpv"] + m["t"] * value).alias("tpv"))

    scale = pay * 100
    return F.aggregate(months, start, step, lambda a: F.struct((a["pv"] * scale).alias("pv"), (a["tpv"] * scale).alias("tpv")))


def extend(path: Column, terminal: Column, n: int = 360) -> Column:
    """Model months followed by a flat terminal speed."""
    return let(path, lambda p: F.concat(p, F.array_repeat(terminal, F.lit(n) - F.size(p))))


def flat(cpr: Column, n: int = 360) -> Column:
    return F.array_repeat(cpr, n)


def mean(c: Column) -> Column:
    return let(c, lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def map_path(path: Column, a: Column, b: Column, mode: str, base_path: Column | None = None) -> Column:
    """Apply a logit map (a + b * logit) to a model path.

    off: unchanged. scalar: rescale by mapped/model at the path mean. pointwise:
    map each month. frozen: the scalar factor of ``base_path`` (the unbumped
    path), so a bump moves the path but not the correction. A missing map leaves
    the path as it is.
    """
    if mode == "off":
        return path
    lo, hi = rates.CPR_LO, rates.CPR_HI
    through = lambda p: rates.sigmoid(a + b * rates.logit(p))
    if mode == "pointwise":
        out = F.transform(path, lambda p: rates.clip(through(p), lo, hi))
    elif mode in ("scalar", "frozen"):
        source = base_path if mode == "frozen" else path
        factor = let(rates.clip(mean(source), lo, hi), lambda m: through(m) / m)
        out = let(factor, lambda f: F.transform(path, lambda p: rates.clip(p * f, lo, hi)))
    else:
        raise ValueError(mode)
    return F.when(a.isNull() | b.isNull(), path).otherwise(out)


# ------------------------------------------------------------------ loan paths


def path_cashflows(note: Column, hazard: Column) -> Column:
    """Cash flows per 100 of balance along one path of monthly hazards: struct of
    the flows and the balance left at the end (level pay over 360 months)."""
    start = F.struct(F.lit(100.0).alias("bal"), F.array().cast("array<double>").alias("cf"))

    def run(c):
        def step(acc, h):
            bal = acc["bal"]
            interest = bal * c["n"]
            principal = F.least(c["pmt"] - interest, bal)
            prepay = bal * h
            return F.struct(
                F.greatest(bal - principal - prepay, F.lit(0.0)).alias("bal"),
                F.concat(acc["cf"], F.array(interest + principal + prepay)).alias("cf"))

        return F.aggregate(hazard, start, step)

    n = note / 1200
    return let(F.struct(n.alias("n"), (_payment(note, 0.0, 360) * 100).alias("pmt")), run)


def discounted(flows: Column, short_rates: Column, spread_bp: Column, active: Column, terminal: Column | None = None) -> Column:
    """Present value of monthly flows along one path of short rates (percent) plus
    a spread (basis points); only the first ``active`` flows count, the terminal
    balance, if given, is discounted from the last month."""
    pairs = F.zip_with(flows, short_rates, lambda c, r: F.struct(c.alias("c"), r.alias("r")))
    start = F.struct(F.lit(1.0).alias("d"), F.lit(0.0).alias("pv"), F.lit(0).alias("i"))

    def step(acc, p):
        growth = 1 + (p["r"] / 100 + spread_bp / 10000) / 12
        return let(acc["d"] * growth, lambda d: F.struct(
            d.alias("d"), (acc["pv"] + F.when(acc["i"] < active, p["c"] / d).otherwise(F.lit(0.0))).alias("pv"), (acc["i"] + 1).alias("i")))

    done = lambda a: a["pv"] + (terminal / a["d"] if terminal is not None else F.lit(0.0))
    return F.aggregate(pairs, start, step, done)
