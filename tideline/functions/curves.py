"""Yield-curve expressions: bump shapes, zero bootstraps and monthly grids.

The tenor grid is fixed, so which nodes bracket a coupon date is known when the
plan is built. Each solved node becomes one generated column; no loop runs per
row outside generated code except the final 360-month array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: par-curve columns and their maturities in years
TENORS = ["m1", "m3", "m6", "y1", "y2", "y3", "y5", "y7", "y10", "y20", "y30"]
YEARS = [1 / 12, 3 / 12, 6 / 12, 1, 2, 3, 5, 7, 10, 20, 30]

N_MONTHS = 360
BUMP_PP = 0.25  # fixed value: 25 basis points

_TRIANGLES = {"local_5": (3.0, 5.0, 7.0), "local_10": (7.0, 10.0, 20.0)}
_KNOTS = {  # piecewise-linear shapes as (year, weight) knots, flat outside
    "span_5": [(5.0, 1.0), (10.0, 0.0)],
    "span_10": [(5.0, 0.0), (10.0, 1.0)],
    "tent_2": [(2.0, 1.0), (5.0, 0.0)],
    "tent_5": [(2.0, 0.0), (5.0, 1.0), (10.0, 0.0)],
    "tent_10": [(5.0, 0.0), (10.0, 1.0)],
    "parallel": [(0.0, 1.0)],
    "none": [(0.0, 0.0)],
}
for _name, (_lo, _mid, _hi) in _TRIANGLES.items():
    _KNOTS[_name] = [(_lo, 0.0), (_mid, 1.0), (_hi, 0.0)]


def _interp(x: float, knots: list[tuple[float, float]]) -> float:
    if x <= knots[0][0]:
        return knots[0][1]
    for (x0, w0), (x1, w1) in zip(knots, knots[1:]):
        if x <= x1:
            return w0 + (w1 - w0) * (x - x0) / (x1 - x0)
    return knots[-1][1]


def bump_weights(shape: str) -> list[float]:
    """Weight of a bump shape on each par node."""
    return [_interp(t, _KNOTS[shape]) for t in YEARS]


def _lit(x: float) -> str:
    return f"{float(x)!r}D"


def bumped(df: DataFrame, shape: str | None = None, size: float | None = None) -> DataFrame:
    """Par columns moved by ``size`` (percentage points) times the bump shape.

    Without arguments both come from the columns ``shape`` and ``size``, so that
    scenarios are rows.
    """
    amount = "size" if size is None else _lit(size)
    out = {}
    for i, tenor in enumerate(TENORS):
        if shape is not None:
            w = _lit(bump_weights(shape)[i])
        else:
            cases = " ".join(f"WHEN '{n}' THEN {_lit(bump_weights(n)[i])}" for n in _KNOTS if bump_weights(n)[i])
            w = f"CASE shape {cases} ELSE 0.0D END"
        out[tenor] = F.expr(f"{tenor} + {amount} * {w}")
    return df.withColumns(out)


def _mix(t: float, nodes: list[tuple[float, str]]) -> str:
    """Linear interpolation over nodes known at plan time, flat beyond them."""
    if t <= nodes[0][0] + 1e-12:
        return nodes[0][1]
    for (t0, z0), (t1, z1) in zip(nodes, nodes[1:]):
        if t <= t1 + 1e-12:
            w = (t - t0) / (t1 - t0)
            return z1 if w > 1 - 1e-12 else f"({z0} * {_lit(1 - w)} + {z1} * {_lit(w)})"
    return nodes[-1][1]


def _sum(terms: list[str]) -> str:
    return " + ".join(terms) if terms else "0.0D"


def bootstrap_zeros(df: DataFrame, prefix: str = "z_") -> DataFrame:
    """Zero rates (percent) per par node as columns ``z_m1 .. z_y30``.

    Up to one year the par yield is the zero. Beyond, semi-annual coupons before
    the last known node use interpolated zeros, later ones its flat extension.
    """
    out = df.withColumns({f"{prefix}{n}": F.col(n) for n, t in zip(TENORS, YEARS) if t <= 1.0})
    for i, (name, maturity) in enumerate(zip(TENORS, YEARS)):
        if maturity <= 1.0:
            continue
        known = [(YEARS[j], f"{prefix}{TENORS[j]}") for j in range(i)]
        pv = _sum([f"exp({_mix(s / 2, known)} * {_lit(-s / 200)})" for s in range(1, round(maturity * 2))])
        factor = f"((1.0D - {name} / 200.0D * ({pv})) / (1.0D + {name} / 200.0D))"
        out = out.withColumn(f"{prefix}{name}", F.expr(f"CASE WHEN {factor} > 0 THEN -ln({factor}) * {_lit(100 / maturity)} END"))
    return out


def _segments(nodes: list[tuple[int, Column]], months: int) -> Column:
    """Array of (m0, m1, v0, v1) pieces; node values are evaluated once here, not
    once per month inside the lambda that reads them."""
    parts = []
    for (m0, v0), (m1, v1) in zip(nodes, nodes[1:]):
        if m0 < months:
            parts.append(F.struct(F.lit(m0).alias("m0"), F.lit(min(m1, months)).alias("top"), F.lit(float(m1 - m0)).alias("w"), v0.alias("v0"), v1.alias("v1")))
    return F.array(*parts)


def monthly_zeros(prefix: str = "z_", months: int = N_MONTHS) -> Column:
    """Array of monthly zero rates by linear interpolation between the nodes."""
    nodes = [(round(t * 12), F.col(f"{prefix}{n}")) for n, t in zip(TENORS, YEARS)]
    nodes = [(0, nodes[0][1]), *nodes]
    piece = lambda s: F.transform(
        F.sequence(s["m0"] + 1, s["top"]), lambda m: s["v0"] + (s["v1"] - s["v0"]) * (m - s["m0"]) / s["w"])
    return F.flatten(F.transform(_segments(nodes, months), piece))


# --- self-consistent bootstrap on integrated zeros (minus log discount) -------

# integrated zero of a bill quote r (decimal) at time t
BILL_CONVENTIONS = {
    "simple": "ln(1.0D + {r} * {t})",
    "discount": "-ln(1.0D - {r} * {t} * 360.0D / 365.0D)",
    "bond_equivalent": "2.0D * ln(1.0D + {r} / 2.0D) * {t}",
    "continuous": "{r} * {t}",
}


def bootstrap_exact(df: DataFrame, convention: str = "simple", prefix: str = "x_", rounds: int = 60) -> DataFrame:
    """Integrated zeros ``x = -ln DF`` per node so that every par bond prices at
    par on the piecewise-linear curve of x, including coupons inside the gap
    being solved.

    The par condition falls in x, so each node is a bisection with a fixed number
    of rounds inside one array fold.
    """
    bill = BILL_CONVENTIONS[convention]
    out = df.withColumns({
        f"{prefix}{n}": F.expr(bill.format(r=f"({n} / 100.0D)", t=_lit(t))) for n, t in zip(TENORS, YEARS) if t <= 0.5})
    for i, (name, maturity) in enumerate(zip(TENORS, YEARS)):
        if maturity <= 0.5:
            continue
        t0 = YEARS[i - 1]
        known = [(0.0, "0.0D")] + [(YEARS[j], f"{prefix}{TENORS[j]}") for j in range(i)]
        steps = [s / 2 for s in range(1, round(maturity * 2) + 1)]
        inside = ", ".join(_lit((t - t0) / (maturity - t0)) for t in steps if t > t0 + 1e-12)
        staged = out.withColumns({
            "_pv": F.expr(_sum([f"exp(-{_mix(t, known)})" for t in steps if t <= t0 + 1e-12])),
            "_half": F.expr(f"{name} / 200.0D"), "_x0": F.col(f"{prefix}{TENORS[i - 1]}")})
        span = max(maturity, 1.0)
        mid = "((b.lo + b.hi) / 2.0D)"
        gap = f"aggregate(array({inside}), 0.0D, (s, w) -> s + exp(-(_x0 * (1.0D - w) + {mid} * w)))"
        dear = f"_half * (_pv + {gap}) + exp(-{mid}) - 1.0D > 0"  # still above par: x must grow
        solved = (
            f"aggregate(sequence(1, {rounds}), named_struct('lo', {_lit(-2 * span)}, 'hi', {_lit(5 * span)}), "
            f"(b, r) -> IF({dear}, named_struct('lo', {mid}, 'hi', b.hi), named_struct('lo', b.lo, 'hi', {mid})), b -> (b.lo + b.hi) / 2.0D)")
        out = staged.withColumn(f"{prefix}{name}", F.expr(solved)).drop("_pv", "_half", "_x0")
    return out


def bootstrap_logdf(df: DataFrame, convert: bool = True, prefix: str = "x_") -> DataFrame:
    """One-pass variant on integrated zeros: bills to one year are converted, then
    coupons beyond the last node extend its last forward flat."""
    short = "ln(1.0D + {n} / 100.0D)" if convert else "{n} / 100.0D"
    out = df.withColumns({
        f"{prefix}{n}": F.expr(f"{short.format(n=n)} * {_lit(t)}") for n, t in zip(TENORS, YEARS) if t <= 1.0})
    for i, (name, maturity) in enumerate(zip(TENORS, YEARS)):
        if maturity <= 1.0:
            continue
        known = [(0.0, "0.0D")] + [(YEARS[j], f"{prefix}{TENORS[j]}") for j in range(i)]
        (ta, xa), (tb, xb) = known[-2], known[-1]
        at = lambda t: _mix(t, known) if t <= tb else f"({xb} + ({xb} - {xa}) * {_lit((t - tb) / (tb - ta))})"
        pv = _sum([f"exp(-{at(s / 2)})" for s in range(1, round(maturity * 2))])
        factor = f"((1.0D - {name} / 200.0D * ({pv})) / (1.0D + {name} / 200.0D))"
        out = out.withColumn(f"{prefix}{name}", F.expr(f"CASE WHEN {factor} > 0 THEN -ln({factor}) END"))
    return out


def monthly_zeros_from_logdf(prefix: str = "x_", months: int = N_MONTHS) -> Column:
    """Monthly zero rates (percent) from integrated zeros, linear in x."""
    nodes = [(0, F.lit(0.0))] + [(round(t * 12), F.col(f"{prefix}{n}")) for n, t in zip(TENORS, YEARS)]
    piece = lambda s: F.transform(
        F.sequence(s["m0"] + 1, s["top"]), lambda m: (s["v0"] + (s["v1"] - s["v0"]) * (m - s["m0"]) / s["w"]) / m * 1200.0)
    return F.flatten(F.transform(_segments(nodes, months), piece))


def par_bond_price(zeros: str, maturity: float, coupon: str) -> Column:
    """Semi-annual bond (face 100, coupon column in percent) off a monthly zero
    array column."""
    last = round(maturity * 2)
    pv = f"aggregate(sequence(1, {last}), 0.0D, (s, h) -> s + exp(element_at({zeros}, h * 6) * h / -200.0D))"
    return F.expr(f"{coupon} / 2.0D * {pv} + 100.0D * exp(element_at({zeros}, {last * 6}) * {_lit(-maturity / 100)})")
