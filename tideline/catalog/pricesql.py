"""Scenario prices and durations with their SQL, for the pricing queries and the hedge panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.memo import written
from tideline.catalog.registry import rnd
from tideline.catalog.scurvesql import BAND, descent_sql, in_band
from tideline.catalog.sequences import FIT, FITV, cell_path_sql, fitted
from tideline.catalog.survival import FVR, forecast_realized
from tideline.functions import curves
from tideline.operators import series
from tideline.plans import pricing, scurve

TEN = curves.TENORS
YRS = ["1.0/12", "0.25", "0.5", "1", "2", "3", "5", "7", "10", "20", "30"]
MON = [round(y * 12) for y in curves.YEARS]


def month_curves(fx):
    """Last curve of each month, all tenors."""
    return series.month_end(fx.curve_daily, TEN).select("yyyymm", "mi", *TEN)


def terminal_params(fx):
    """Terminal curve of each month, fitted on months strictly before it (to four
    digits), off the grid, written once to the shared folder of a session."""
    fit = lambda: scurve.fit_asof(in_band(forecast_realized(fx)), "inc", "cpr_upb", steps=scurve.STEPS)
    path = written(fx, "terminal-curve", lambda to: rnd(fit().select("mi", "floor", "sat", "k", "x0"), 4).write.parquet(to))
    return fx.spark.read.parquet(path)


#: Columns of the terminal curve that a position carries.
CURVE = {"floor": "tf", "sat": "ts", "k": "tk", "x0": "tx"}


def positions(fx):
    """(month, coupon) with a price, a market rate and the terminal curve that was
    known then; months without enough history take the fixed curve."""
    month = fx.market_rate.select("yyyymm", "mi", F.col("rate_30yr").alias("pmms")).join(F.broadcast(terminal_params(fx)), "mi", "left")
    known = [F.coalesce(F.col(n), F.lit(pricing.TERMINAL[n])).alias(c) for n, c in CURVE.items()]
    return fx.price.select("yyyymm", "coupon", "price").join(F.broadcast(month.select("yyyymm", "pmms", *known)), "yyyymm")


# ----------------------------------------------------------------- oracle pieces

ME = "mz AS MATERIALIZED (SELECT yyyymm, mi, " + ", ".join(f"arg_max({t}, d) AS {t}" for t in TEN) + " FROM f_curve_daily GROUP BY 1, 2)"


def interp_sql(t: float, known: list[int]) -> str:
    """Zero at year t on solved nodes, flat beyond the ends."""
    ys = [curves.YEARS[i] for i in known]
    if t >= ys[-1]:
        return f"z_{TEN[known[-1]]}"
    for a, b in zip(known, known[1:]):
        if t <= curves.YEARS[b]:
            w = (t - curves.YEARS[a]) / (curves.YEARS[b] - curves.YEARS[a])
            return f"(z_{TEN[a]} + (z_{TEN[b]} - z_{TEN[a]})*{w!r})"
    raise AssertionError


def zeros_sql(rel: str, keys: str) -> str:
    """Nested SELECTs that add z_<tenor> and the 360-month list ``zs``."""
    q = f"SELECT {keys}, {', '.join(TEN)}, " + ", ".join(f"{t} AS z_{t}" for t in TEN[:4]) + f" FROM {rel}"
    for i in range(4, len(TEN)):
        known = list(range(i))
        mat = curves.YEARS[i]
        pv = " + ".join(f"exp(-{interp_sql(s / 2, known)}/100*{s / 2})" for s in range(1, mat * 2))
        q = f"SELECT *, -ln((1 - {TEN[i]}/200*({pv}))/(1 + {TEN[i]}/200))/{mat}*100 AS z_{TEN[i]} FROM ({q})"
    case = "CASE WHEN m <= 1 THEN z_m1 " + " ".join(
        f"WHEN m <= {MON[i + 1]} THEN z_{TEN[i]} + (z_{TEN[i + 1]} - z_{TEN[i]})*(m - {MON[i]})/{MON[i + 1] - MON[i]}.0" for i in range(10)) + " END"
    return f"SELECT *, list_transform(range(1, 361), lambda m: {case}) AS zs FROM ({q})"


def price_sql(coupon: str, cpr: str, zs: str, timed: bool = False) -> str:
    """List fold over 360 months; ``cpr`` and ``zs`` are lists."""
    note, inv = f"(({coupon}+0.5)/1200)", f"({coupon}/1200)"
    pmt = f"(100*{note}/(1-pow(1+{note}, -360)))"
    sp = f"greatest(least({pmt} - acc.bal*{note}, acc.bal), 0)"
    smm = f"(1-pow(1-least(greatest({cpr}[m], 0), 0.99), 1.0/12))"
    cf = f"(acc.bal*{inv} + {sp} + (acc.bal-{sp})*{smm})*exp(-{zs}[m]/100*m/12)"
    extra, init = (f", tpv := acc.tpv + m/12.0*{cf}", ", tpv := 0.0::DOUBLE") if timed else ("", "")
    fold = f"list_reduce(range(1, 361), lambda acc, m: struct_pack(bal := (acc.bal-{sp})*(1-{smm}), pv := acc.pv + {cf}{extra}), struct_pack(bal := 100.0::DOUBLE, pv := 0.0::DOUBLE{init}))"
    return fold if timed else f"({fold}).pv"


def haz_sql(inc: str) -> str:
    """Model speeds of 33 months; h0..h2 of the fitted index must be in scope."""
    return cell_path_sql(inc)


def term_sql(inc: str) -> str:
    return f"(tf + (ts-tf)/(1+exp(-tk*(({inc})-tx))))"


def cpr360_sql(path: str, term: str) -> str:
    return f"list_concat({path}, list_transform(range(1, 328), lambda q: {term}))"


POS0 = "ps AS MATERIALIZED (SELECT p.yyyymm, p.mi, p.coupon, p.price, m.rate_30yr AS pmms FROM f_price p JOIN f_market_rate m ON p.yyyymm = m.yyyymm)"
POS = f"""{FIT}, zt AS MATERIALIZED (SELECT * FROM ({FVR}, {BAND}, bh AS (SELECT a.mi, b.cx, b.cy FROM (SELECT DISTINCT mi FROM bd) a JOIN bd b ON b.mi < a.mi), {descent_sql("bh", "mi")})),
ps AS MATERIALIZED (SELECT p.yyyymm, p.mi, p.coupon, p.price, m.rate_30yr AS pmms, h0, h1, h2, coalesce(zt.floor, 0.0459) AS tf, coalesce(zt.sat, 0.2204) AS ts, coalesce(zt.k, 3.0) AS tk, coalesce(zt.x0, 0.4) AS tx
 FROM hx, f_price p JOIN f_market_rate m ON p.yyyymm = m.yyyymm LEFT JOIN zt ON zt.mi = m.mi)"""
V = "f_curve_daily f_price f_market_rate f_forecast " + FITV


def weights_sql(shape: str) -> list[float]:
    return curves.bump_weights(shape)


def scen_sql(scens: list[dict]) -> str:
    """Scenario rows as a VALUES table with per-tenor moves."""
    rows = []
    for s in scens:
        moves = ", ".join(repr(w * s["size"]) for w in weights_sql(s["shape"]))
        rows.append(f"('{s['scenario']}', {s['rate_move']!r}, {str(s['model']).lower()}, {str(s['terminal']).lower()}, '{s['form']}', {s['scale']!r}, {moves})")
    return f"sv(scenario, dp, rm, rt, form, sc, {', '.join('b_' + t for t in TEN)}) AS (VALUES {', '.join(rows)})"


def priced_sql(scens: list[dict]) -> str:
    bump = ", ".join(f"mz.{t} + sv.b_{t} AS {t}" for t in TEN)
    i1 = "(coupon+0.5-pmms-dp)"
    i0 = "(coupon+0.5-pmms)"
    own = haz_sql(f"CASE WHEN rm THEN {i1} ELSE {i0} END")
    cap = lambda e: f"list_transform({haz_sql(i0)}, lambda p: least(greatest({e}, 0), 0.99))"
    path = f"CASE form WHEN 'add' THEN {cap(f'p + {term_sql(i1)} - {term_sql(i0)}')} WHEN 'mult' THEN {cap(f'p * {term_sql(i1)}/{term_sql(i0)}')} ELSE {own} END"
    term = f"sc*{term_sql(f'CASE WHEN rt THEN {i1} ELSE {i0} END')}"
    return f"""{scen_sql(scens)}, cv AS MATERIALIZED (SELECT mz.yyyymm, sv.scenario, sv.dp, sv.rm, sv.rt, sv.form, sv.sc, {bump} FROM mz, sv),
zc AS MATERIALIZED ({zeros_sql("cv", "yyyymm, scenario, dp, rm, rt, form, sc")}),
pp AS MATERIALIZED (SELECT ps.yyyymm, ps.coupon, scenario, {path} AS path, {term} AS term, zs FROM zc JOIN ps USING (yyyymm)),
px AS MATERIALIZED (SELECT yyyymm, coupon, scenario, {price_sql("coupon", "cp", "zs")} AS p FROM (SELECT *, {cpr360_sql("path", "term")} AS cp FROM pp))"""


def dur_sql(names: list[str], base: str = "base") -> str:
    at = lambda s: f"max(p) FILTER (scenario = '{s}')"
    cols = ", ".join(f"({at(n + '-')} - {at(n + '+')})/(2*{at(base)}*0.0025) AS {n}" for n in names)
    return f"SELECT yyyymm, coupon, {at(base)} AS price, {cols} FROM px GROUP BY 1, 2"


def sc_prices(fx, scens, **kw):
    return pricing.scenario_prices(month_curves(fx), positions(fx), scens, fitted(fx).cell(), params=CURVE, **kw)


KRD = ["krd2", "krd5", "krd10"]
TENT = pricing.tent_scenarios()


def key_rate_durations(fx):
    """Priced key-rate durations of every (month, coupon), written once to the
    shared folder for all queries of a session that read them."""
    return fx.spark.read.parquet(written(fx, "key-rate-durations", lambda to: pricing.durations(sc_prices(fx, TENT), KRD).write.parquet(to)))
