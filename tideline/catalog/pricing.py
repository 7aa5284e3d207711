"""2.K scenario pricing over month-end curves and coupons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.memo import table
from tideline.catalog.olssql import ols_sql
from tideline.catalog.registry import R, query, rnd
from tideline.catalog.selection import RET
from tideline.catalog.pricesql import (
    CURVE, KRD, ME, MON, POS, POS0, TEN, TENT, V, cpr360_sql, dur_sql, haz_sql, key_rate_durations, month_curves, positions, price_sql,
    priced_sql, sc_prices, scen_sql, term_sql, zeros_sql,
)
from tideline.catalog.sequences import FIT, FITV, cell_path_sql, fitted
from tideline.catalog.statistics import BASIS, basis
from tideline.catalog.survival import FVR, forecast_realized
from tideline.functions import cashflow, curves, rates
from tideline.operators import regression, series
from tideline.plans import hedging, mapping, pricing
from tideline.plans.hazard import array_mean, hazard_cpr_path

# ------------------------------------------------------------------------ queries


@query("K1_bootstrap_zeros", "f_curve_daily", f"""SELECT d, {", ".join(f"{R(f'z_{t}', 8)} AS z_{t}" for t in TEN[4:])}, {R("zs[18]", 8)} AS m18, {R("zs[100]", 8)} AS m100, {R("zs[360]", 8)} AS m360 FROM ({zeros_sql("f_curve_daily", "d")})""")
def _(fx):
    """Every daily curve: solved nodes and three months of the grid (K1b has all)."""
    z = curves.bootstrap_zeros(fx.curve_daily).withColumn("zs", curves.monthly_zeros())
    at = lambda m: F.element_at("zs", m).alias(f"m{m}")
    return rnd(z.select("d", *[f"z_{t}" for t in TEN[4:]], at(18), at(100), at(360)), 8)


@query("K1b_monthly_grid", "f_curve_daily", f"""WITH {ME}, g AS ({zeros_sql("mz", "yyyymm")}) SELECT yyyymm, CAST(unnest(range(1, 361)) AS BIGINT) AS month, {R("unnest(zs)", 8)} AS zero FROM g""")
def _(fx):
    """The whole 360-month grid of every month-end curve."""
    z = curves.bootstrap_zeros(month_curves(fx)).select("yyyymm", F.posexplode(curves.monthly_zeros()).alias("i", "zero"))
    return rnd(z.select("yyyymm", (F.col("i") + 1).cast("bigint").alias("month"), "zero"), 8)


@query("K1c_daily_grid", "f_curve_daily", f"""WITH g AS ({zeros_sql("f_curve_daily", "d")}) SELECT d, CAST(unnest(range(1, 361)) AS BIGINT) AS month, {R("unnest(zs)", 8)} AS zero FROM g""")
def _(fx):
    """The whole 360-month grid of every daily curve."""
    z = curves.bootstrap_zeros(fx.curve_daily).select("d", F.posexplode(curves.monthly_zeros()).alias("i", "zero"))
    return rnd(z.select("d", (F.col("i") + 1).cast("bigint").alias("month"), "zero"), 8)


def exact_sql(rel: str, keys: str, bill: str = "ln(1 + {r}*{t})") -> str:
    q = f"SELECT {keys}, {', '.join(TEN)}, " + ", ".join(f"{bill.format(r=f'({t}/100)', t=repr(float(y)))} AS x_{t}" for t, y in zip(TEN[:3], curves.YEARS)) + f" FROM {rel}"
    for i in range(3, len(TEN)):
        mat, t0, x0 = curves.YEARS[i], curves.YEARS[i - 1], f"x_{TEN[i - 1]}"
        steps = [s / 2 for s in range(1, mat * 2 + 1)]
        nodes = [(0.0, "0.0")] + [(curves.YEARS[j], f"x_{TEN[j]}") for j in range(i)]

        def at(t):
            for (ta, xa), (tb, xb) in zip(nodes, nodes[1:]):
                if t <= tb:
                    return f"({xa} + ({xb}-{xa})*{(t - ta) / (tb - ta)!r})"

        fixed = " + ".join(f"exp(-{at(t)})" for t in steps if t <= t0) or "0.0"
        ws = [(t - t0) / (mat - t0) for t in steps if t > t0]
        ex = f"(hf*(fx + list_sum(list_transform({ws}, lambda w: exp(-(x0*(1-w)+((acc.lo+acc.hi)/2)*w))))) + exp(-(acc.lo+acc.hi)/2) - 1)"
        span = max(mat, 1.0)
        fold = f"list_reduce(range(1, 61), lambda acc, i: CASE WHEN {ex} > 0 THEN struct_pack(lo := (acc.lo+acc.hi)/2, hi := acc.hi) ELSE struct_pack(lo := acc.lo, hi := (acc.lo+acc.hi)/2) END, struct_pack(lo := {-2.0 * span!r}::DOUBLE, hi := {5.0 * span!r}::DOUBLE))"
        q = f"SELECT * EXCLUDE (hf, fx, x0, fo), (fo.lo+fo.hi)/2 AS x_{TEN[i]} FROM (SELECT *, {fold} AS fo FROM (SELECT *, {TEN[i]}/200 AS hf, {fixed} AS fx, {x0} AS x0 FROM ({q})))"
    return q


@query("K2_bootstrap_zeros_exact", "f_curve_daily", f"WITH {ME} SELECT yyyymm, {', '.join(f'{R(f'x_{t}', 8)} AS x_{t}' for t in TEN)} FROM ({exact_sql('mz', 'yyyymm')})")
def _(fx):
    z = curves.bootstrap_exact(month_curves(fx))
    return rnd(z.select("yyyymm", *[f"x_{t}" for t in TEN]), 8)


@query("K3_price_passthrough", V + " f_forecast", f"""WITH {ME}, zc AS MATERIALIZED ({zeros_sql("mz", "yyyymm")}), j AS (SELECT f.yyyymm, f.coupon, list_transform(range(1, 361), lambda q: f.forecast_cpr) AS cp, zs FROM zc JOIN f_forecast f USING (yyyymm))
SELECT yyyymm, coupon, {R(price_sql("coupon", "cp", "zs"))} AS model_price FROM j""")
def _(fx):
    """Price at the month's forecast speed held flat for life."""
    z = curves.bootstrap_zeros(month_curves(fx)).select("yyyymm", cashflow.discounts(curves.monthly_zeros()).alias("disc"))
    df = pricing.spread(fx.forecast.join(z, "yyyymm"), "yyyymm", "coupon")
    return rnd(df.select("yyyymm", "coupon", cashflow.price(F.col("coupon"), cashflow.flat(F.col("forecast_cpr")), F.col("disc")).alias("model_price")))


@query("K4_extend_cpr", V, f"""WITH {POS}, e AS (SELECT yyyymm, coupon, {cpr360_sql(haz_sql("coupon+0.5-pmms"), term_sql("coupon+0.5-pmms"))} AS cp FROM ps)
SELECT yyyymm, coupon, len(cp) AS n, {R("cp[1]")} AS m1, {R("cp[33]")} AS m33, {R("cp[34]")} AS m34, {R("cp[360]")} AS m360, {R("list_sum(cp)", 5)} AS total FROM e""")
def _(fx):
    inc = F.col("coupon") + 0.5 - F.col("pmms")
    cp = cashflow.extend(hazard_cpr_path(inc, fitted(fx).cell()), pricing.terminal_speed(inc, CURVE))
    df = positions(fx).withColumn("cp", cp)
    at = lambda m: F.element_at("cp", m).alias(f"m{m}")
    return rnd(df.select("yyyymm", "coupon", F.size("cp").alias("n"), at(1), at(33), at(34), at(360), F.aggregate("cp", F.lit(0.0), lambda a, x: a + x).alias("total")), 6, total=5)


MAPFIT = f"""{FVR}, mc AS MATERIALIZED (SELECT *, ln(forecast_cpr/(1-forecast_cpr)) AS lx, ln(least(cpr_upb, 1-1e-6)/(1-least(cpr_upb, 1-1e-6))) AS ly, upb_atrisk/1e6 AS w FROM fr WHERE cpr_upb > 0 AND forecast_cpr > 0),
lf AS MATERIALIZED (SELECT mi, (sw*sxy-sx*sy)/(sw*sxx-sx*sx) AS b, (sy-(sw*sxy-sx*sy)/(sw*sxx-sx*sx)*sx)/sw AS a FROM (SELECT c.mi, sum(m.w) AS sw, sum(m.w*m.lx) AS sx, sum(m.w*m.ly) AS sy, sum(m.w*m.lx*m.lx) AS sxx, sum(m.w*m.lx*m.ly) AS sxy, count(DISTINCT m.mi) AS nm
  FROM (SELECT DISTINCT mi FROM mc) c JOIN mc m ON m.mi < c.mi - 1 GROUP BY 1) WHERE nm >= 24)"""


@query("K5_apply_cpr_mapping", V + " f_loan f_forecast", f"""{MAPFIT}, {POS}, e AS (SELECT ps.*, lf.a, lf.b, {haz_sql("coupon+0.5-pmms+0.25")} AS up, {haz_sql("coupon+0.5-pmms")} AS base FROM ps LEFT JOIN lf ON lf.mi = ps.mi),
k AS (SELECT *, list_avg(up) AS mu, list_avg(base) AS mb FROM e), g AS (SELECT *, 1/(1+exp(-(a+b*ln(mu/(1-mu)))))/mu AS fu, 1/(1+exp(-(a+b*ln(mb/(1-mb)))))/mb AS fb FROM k)
SELECT yyyymm, coupon, {R("list_avg(up)", 5)} AS off, {R("CASE WHEN a IS NULL THEN list_avg(up) ELSE list_avg(list_transform(up, lambda p: least(greatest(p*fu, 1e-6), 1-1e-6))) END", 5)} AS scalar,
 {R("CASE WHEN a IS NULL THEN list_avg(up) ELSE list_avg(list_transform(up, lambda p: 1/(1+exp(-(a+b*ln(p/(1-p))))))) END", 5)} AS pointwise,
 {R("CASE WHEN a IS NULL THEN list_avg(up) ELSE list_avg(list_transform(up, lambda p: least(greatest(p*fb, 1e-6), 1-1e-6))) END", 5)} AS frozen, a IS NOT NULL AS applied FROM g""")
def _(fx):
    """All four modes on the path bumped by -25bp of market rate. Every map is applied as fitted, whatever its slope; N8
    counts those that the raising guard would refuse."""
    fit = mapping.fit_asof(forecast_realized(fx), min_months=24)
    pos = positions(fx).join(F.broadcast(fx.market_rate.select("yyyymm", "mi")), "yyyymm").join(F.broadcast(fit.select("mi", "a", "b")), "mi", "left")
    inc = F.col("coupon") + 0.5 - F.col("pmms")
    coef = fitted(fx).cell()
    df = pos.withColumn("up", hazard_cpr_path(inc + 0.25, coef)).withColumn("base", hazard_cpr_path(inc, coef))
    mode = lambda m: array_mean(cashflow.map_path(F.col("up"), F.col("a"), F.col("b"), m, F.col("base"))).alias(m)
    return rnd(df.select("yyyymm", "coupon", *[mode(m) for m in ("off", "scalar", "pointwise", "frozen")], F.col("a").isNotNull().alias("applied")), 5)


@query("K6_key_rate_durations", V, f"WITH {ME}, {POS}, {priced_sql(TENT)} SELECT yyyymm, coupon, {R('price', 5)} AS price, {', '.join(f'{R(k, 4)} AS {k}' for k in KRD)} FROM ({dur_sql(KRD)})")
def _(fx):
    return rnd(key_rate_durations(fx), 4, price=5)


@query("K6b_localized_durations", V, f"WITH {ME}, {POS}, {priced_sql(pricing.local_scenarios())} SELECT yyyymm, coupon, {R('price', 5)} AS price, {R('krd5', 4)} AS krd5, {R('krd10', 4)} AS krd10 FROM ({dur_sql(['krd5', 'krd10'])})")
def _(fx):
    return rnd(pricing.durations(sc_prices(fx, pricing.local_scenarios()), ["krd5", "krd10"]), 4, price=5)


def panel(fx):
    krds = key_rate_durations(fx)
    b = basis(fx).select("yyyymm", "income", F.col("d_level3").alias("d_level"), F.col("d_slope3").alias("d_slope"), F.col("d_curve3").alias("d_curve"))
    return pricing.hedge_panel(fx.price, krds, b)


HP7 = f"""WITH {RET}, {BASIS}, {ME}, {POS}, {priced_sql(TENT)}, kr AS MATERIALIZED ({dur_sql(KRD)}),
h7 AS MATERIALIZED (SELECT t.coupon, t.yyyymm, t.mi, t.info_ym, t.total_return, cb.income, cb.d_level3 AS d_level, cb.d_slope3 AS d_slope, cb.d_curve3 AS d_curve, krd2+krd5+krd10 AS dl, (krd10-krd2)/2 AS ds, (2*krd5-krd2-krd10)/6 AS dc,
  t.total_return - cb.income + ((krd2+krd5+krd10)*cb.d_level3 + (krd10-krd2)/2*cb.d_slope3 + (2*krd5-krd2-krd10)/6*cb.d_curve3)/100 AS hedged
 FROM (SELECT coupon, yyyymm, mi, info_ym, (price + coupon/12 - pp)/pp AS total_return FROM (SELECT *, lag(price) OVER (PARTITION BY coupon ORDER BY mi) AS pp, lag(yyyymm) OVER (PARTITION BY coupon ORDER BY mi) AS info_ym FROM f_price) WHERE pp IS NOT NULL) t
 JOIN kr ON kr.coupon = t.coupon AND kr.yyyymm = t.info_ym JOIN cb ON cb.yyyymm = t.yyyymm WHERE cb.d_level3 IS NOT NULL)"""


@query("K7_hedged_return_panel", V, f"{HP7} SELECT coupon, yyyymm AS ret_ym, info_ym, {R('total_return', 8)} AS total_return, {R('dl', 4)} AS dur_level, {R('ds', 4)} AS dur_slope, {R('dc', 4)} AS dur_curve, {R('hedged')} AS hedged FROM h7")
def _(fx):
    p = panel(fx)
    return rnd(p.select("coupon", F.col("yyyymm").alias("ret_ym"), "info_ym", "total_return", "dur_level", "dur_slope", "dur_curve", "hedged"), 4, total_return=8, hedged=6)


SHOCKS = ["d_level", "d_slope", "d_curve"]


@query("K8_hedge_verification", V, f"{HP7} SELECT coupon, n, {', '.join(f'{R(f't_{x}', 3)} AS t_{x}' for x in SHOCKS)}, {R('r2', 5)} AS r2 FROM {ols_sql('h7', 'hedged', SHOCKS, 'coupon')}")
def _(fx):
    f = hedging.verification(panel(fx), SHOCKS)
    return rnd(f.select("coupon", "n", *[f"t_{x}" for x in SHOCKS], "r2"), 3, r2=5)


SCALES = [1.0, 0.75, 0.5, 0.35, 0.25, 0.15]


def scaled_scenarios():
    out = []
    for k in SCALES:
        for s in pricing.local_scenarios(spanning=True):
            out.append({**s, "scenario": f"{k}|{s['scenario']}", "scale": k})
    return out


K9NAMES = [f"{k}|{n}" for k in SCALES for n in ("krd5", "krd10")]
K9P = f"""{HP7.split(", mz AS")[0]}, {ME}, {POS}, {{px}}, pq AS (SELECT yyyymm, coupon, split_part(scenario, '|', 1)::DOUBLE AS scale, split_part(scenario, '|', 2) AS sn, p FROM px),
k9 AS MATERIALIZED (SELECT scale, yyyymm, coupon, (max(p) FILTER (sn = 'krd5-') - max(p) FILTER (sn = 'krd5+'))/(2*max(p) FILTER (sn = 'base')*0.0025) AS krd5, (max(p) FILTER (sn = 'krd10-') - max(p) FILTER (sn = 'krd10+'))/(2*max(p) FILTER (sn = 'base')*0.0025) AS krd10 FROM pq GROUP BY 1, 2, 3),
r9 AS (SELECT coupon, yyyymm, mi, info_ym, (price + coupon/12 - pp)/pp AS total_return FROM (SELECT *, lag(price) OVER (PARTITION BY coupon ORDER BY mi) AS pp, lag(yyyymm) OVER (PARTITION BY coupon ORDER BY mi) AS info_ym FROM f_price) WHERE pp IS NOT NULL),
h9 AS MATERIALIZED (SELECT k9.scale, r9.coupon, krd5 + krd10 AS dl, cb.d_level, cb.d_slope, total_return - income + ((krd5+krd10)*cb.d_level + (krd10-krd5)/2*cb.d_slope)/100 AS hedged FROM r9 JOIN k9 ON k9.coupon = r9.coupon AND k9.yyyymm = r9.info_ym JOIN cb ON cb.yyyymm = r9.yyyymm WHERE cb.d_level IS NOT NULL)
SELECT f.scale, f.coupon, n, {R("t_d_level", 3)} AS t_d_level, {R("t_d_slope", 3)} AS t_d_slope, {R("m.dl", 3)} AS dur_level FROM {ols_sql("h9", "hedged", ["d_level", "d_slope"], "scale, coupon")} f JOIN (SELECT scale, coupon, avg(dl) AS dl FROM h9 GROUP BY 1, 2) m ON m.scale = f.scale AND m.coupon = f.coupon"""


@query("K9_terminal_scale_sweep", V, K9P.replace("{px}", priced_sql(scaled_scenarios())))
def _(fx):
    """Terminal speed scaled by six factors; durations and hedge verification."""
    px = sc_prices(fx, scaled_scenarios())
    parts = F.split("scenario", "\\|")
    px = px.withColumn("scale", parts[0].cast("double")).withColumn("scenario", parts[1])
    d = pricing.durations(px, ["krd5", "krd10"], ["scale", "yyyymm", "coupon"])
    b = basis(fx).select("yyyymm", "income", "d_level", "d_slope")
    from tideline.operators import joins

    ret = series.total_returns(fx.price).join(
        joins.prior_row(fx.price, "mi", {"info_ym": "yyyymm"}, ["coupon"]).select("coupon", "yyyymm", "info_ym"), ["coupon", "yyyymm"])
    df = ret.join(d.withColumnRenamed("yyyymm", "info_ym").drop("price"), ["coupon", "info_ym"]).join(F.broadcast(b), "yyyymm").dropna(subset=["d_level"])
    h = F.col("total_return") - F.col("income") + ((F.col("krd5") + F.col("krd10")) * F.col("d_level") + (F.col("krd10") - F.col("krd5")) / 2 * F.col("d_slope")) / 100
    df = df.withColumn("hedged", h)
    means = df.groupBy("scale", "coupon").agg(F.avg(F.col("krd5") + F.col("krd10")).alias("dur_level"))
    fit = regression.ols(df, "hedged", ["d_level", "d_slope"], ["scale", "coupon"]).select("scale", "coupon", "n", "t_d_level", "t_d_slope")
    return rnd(means.join(fit, ["scale", "coupon"]), 3)


CASES = {"r_none": (False, False), "r_model": (True, False), "r_term": (False, True), "r_both": (True, True)}
DECOMP = [pricing.scenario("base")] + [s for n, (m, t) in CASES.items() for s in pricing.two_sided(n, "parallel", 1.0, model=m, terminal=t)]


@query("K10_response_decomposition", V, f"""WITH {ME}, {POS}, {priced_sql(DECOMP)}, d AS ({dur_sql(list(CASES))})
SELECT coupon, {", ".join(f"{R(f'avg({n})', 4)} AS d{n}" for n in CASES)}, {R("avg(r_both) - avg(r_model) - avg(r_term) + avg(r_none)", 4)} AS interaction FROM d GROUP BY 1""")
def _(fx):
    d = pricing.durations(sc_prices(fx, DECOMP), list(CASES)).groupBy("coupon").agg(*[F.avg(n).alias(f"d{n}") for n in CASES])
    inter = F.col("dr_both") - F.col("dr_model") - F.col("dr_term") + F.col("dr_none")
    return rnd(d.withColumn("interaction", inter), 4)


FORMS = ["base", "add", "mult"]
GRAFT = [pricing.scenario("base")] + [s for f in FORMS for s in (
    pricing.two_sided(f"{f}_par", "parallel", 1.0, form=f) + pricing.two_sided(f"{f}_k5", "tent_5", 0.0, form=f) + pricing.two_sided(f"{f}_k10", "tent_10", 1.0, form=f))]
GN = [f"{f}_{c}" for f in FORMS for c in ("par", "k5", "k10")]


@query("K11_graft_variants", V, f"""WITH {ME}, {POS}, {priced_sql(GRAFT)}, d AS ({dur_sql(GN)})
SELECT coupon, {", ".join(f"{R(f'avg({f}_par)', 4)} AS {f}_parallel, {R(f'avg({f}_k5+{f}_k10)', 4)} AS {f}_tents" for f in FORMS)} FROM d GROUP BY 1""")
def _(fx):
    d = pricing.durations(sc_prices(fx, GRAFT), GN)
    cols = []
    for f in FORMS:
        cols += [F.avg(f"{f}_par").alias(f"{f}_parallel"), F.avg(F.col(f"{f}_k5") + F.col(f"{f}_k10")).alias(f"{f}_tents")]
    return rnd(d.groupBy("coupon").agg(*cols), 4)


CHECK = pricing.tent_scenarios() + pricing.two_sided("par", "parallel")


@query("K12_bump_checks", "f_curve_daily f_price", f"""WITH {ME}, cp AS (SELECT DISTINCT p.yyyymm, coupon FROM f_price p JOIN mz ON mz.yyyymm = p.yyyymm), {scen_sql(CHECK)}, cv AS MATERIALIZED (SELECT mz.yyyymm, sv.scenario, {", ".join(f"mz.{t} + sv.b_{t} AS {t}" for t in TEN)} FROM mz, sv), zc AS MATERIALIZED ({zeros_sql("cv", "yyyymm, scenario")}),
f AS MATERIALIZED (SELECT yyyymm, coupon, scenario, {price_sql("coupon", "cl", "zs", True)} AS r FROM (SELECT *, list_transform(range(1, 361), lambda q: 0.12) AS cl FROM zc JOIN cp USING (yyyymm))), px AS (SELECT yyyymm, coupon, scenario, r.pv AS p, r.tpv/r.pv AS dc FROM f),
d AS ({dur_sql(["krd2", "krd5", "krd10", "par"])}), c AS (SELECT yyyymm, coupon, dc FROM px WHERE scenario = 'base')
SELECT coupon, {R("avg(par)", 4)} AS d_parallel, {R("avg(dc)", 4)} AS d_closed, {R("max(abs((krd2+krd5+krd10)/par - 1))", 6)} AS worst_tent_gap FROM d JOIN c USING (yyyymm, coupon) GROUP BY 1""")
def _(fx):
    """Speed frozen at 12 percent: parallel bump against the closed form, and the
    sum of the tents against the parallel bump."""
    sc = pricing.scenario_curves(month_curves(fx), CHECK).join(fx.price.select("yyyymm", "coupon").distinct(), "yyyymm")
    sc = pricing.spread(sc, "yyyymm", "coupon", "s.scenario")
    out = sc.withColumn("r", cashflow.price_and_duration(F.col("coupon"), cashflow.flat(F.lit(0.12)), F.col("disc")))
    px = out.select("yyyymm", "coupon", F.col("s.scenario").alias("scenario"), F.col("r.pv").alias("price"), (F.col("r.tpv") / F.col("r.pv")).alias("dc"))
    d = pricing.durations(px, [*KRD, "par"])
    closed = px.filter("scenario = 'base'").select("yyyymm", "coupon", "dc")
    gap = F.abs((F.col("krd2") + F.col("krd5") + F.col("krd10")) / F.col("par") - 1)
    return rnd(d.join(closed, ["yyyymm", "coupon"]).groupBy("coupon").agg(
        F.avg("par").alias("d_parallel"), F.avg("dc").alias("d_closed"), F.max(gap).alias("worst_tent_gap")), 4, worst_tent_gap=6)


GAP = 1.7  # fixed value: mortgage rate minus short rate on a path


def profiles(fx):
    """Loan profile: note rate and active months (months seen, at most 33). There are as many as note rates times 33; they are
    written once to the shared folder of a session."""

    def make():
        loans = fx.loan.groupBy("loan_id").agg(
            F.max("note_rate").alias("note_rate"), F.least(F.count(F.lit(1)), F.lit(33)).alias("n_active"), F.max("orig_upb").alias("upb"))
        return pricing.loan_profiles(loans)

    return table(fx, "loan-profiles", make)


def path_chunks(fx):
    """Distinct rate paths in chunks, written once to the shared folder of a session."""
    return table(fx, "path-chunks", lambda: pricing.packed_paths(fx.path, GAP))


PATHS = FIT + """, pf AS MATERIALIZED (SELECT note_rate, n_active, count(*) AS n_loans, sum(upb) AS upb FROM (SELECT loan_id, max(note_rate) AS note_rate, least(count(*), 33) AS n_active, max(orig_upb) AS upb FROM f_loan GROUP BY 1) GROUP BY 1, 2),
pa AS MATERIALIZED (SELECT m, count(*) AS n FROM (SELECT path_id, list(rate ORDER BY t) AS m FROM f_path GROUP BY 1) GROUP BY 1)"""
PNOTE = "(note_rate/1200)"
PPMT = f"(100*{PNOTE}/(1-pow(1+{PNOTE}, -360)))"
HZ = "(1/(1+exp(-(h0 + h1*(note_rate - m[t]) + h2*t))))"
PRIN = f"least({PPMT} - acc.bal*{PNOTE}, acc.bal)"


def path_pv_sql(spread: str, terminal: bool) -> str:
    d = f"(acc.d*(1 + ((m[t]-1.7)/100 + ({spread})/10000)/12))"
    cf = f"(acc.bal*{PNOTE} + {PRIN} + acc.bal*{HZ})"
    fold = f"list_reduce(range(1, 34), lambda acc, t: struct_pack(bal := greatest(acc.bal - {PRIN} - acc.bal*{HZ}, 0), d := {d}, pv := acc.pv + CASE WHEN t <= n_active THEN {cf}/{d} ELSE 0 END), struct_pack(bal := 100.0::DOUBLE, d := 1.0::DOUBLE, pv := 0.0::DOUBLE))"
    return f"(SELECT x.pv + x.bal/x.d FROM (SELECT {fold} AS x))" if terminal else f"({fold}).pv"


@query("K13_mc_loan_price", FITV + " f_path", f"""WITH {PATHS}, v AS (SELECT note_rate, n_active, n_loans, n, r.pv + r.bal/r.d AS p FROM (SELECT pf.*, pa.n, {path_pv_sql("0.0", False)[1:-4]} AS r FROM pf, pa, hx))
SELECT note_rate, n_active, any_value(n_loans) AS n_loans, {R("sum(n*p)/sum(n)")} AS model_price, {R("sqrt(sum(n*pow(p-100,2))/sum(n) - pow(sum(n*(p-100))/sum(n),2))", 5)} AS price_std FROM v GROUP BY 1, 2""")
def _(fx):
    out = pricing.mc_loan_price(profiles(fx), path_chunks(fx), fitted(fx).cell())
    return rnd(out.select("note_rate", "n_active", "n_loans", "model_price", "price_std"), 6, price_std=5)


def mean_price_sql(note: str, active: str, spread: str) -> str:
    """Mean over the listed paths ``ps`` (with counts) of the flows' value."""
    n = f"({note}/1200)"
    pmt = f"(100*{n}/(1-pow(1+{n}, -360)))"
    hz = f"(1/(1+exp(-(h0 + h1*({note} - p.m[t]) + h2*t))))"
    pr = f"least({pmt} - a.bal*{n}, a.bal)"
    d = f"(a.d*(1 + ((p.m[t]-1.7)/100 + ({spread})/10000)/12))"
    fold = f"list_reduce(range(1, 34), lambda a, t: struct_pack(bal := greatest(a.bal - {pr} - a.bal*{hz}, 0), d := {d}, pv := a.pv + CASE WHEN t <= {active} THEN (a.bal*{n} + {pr} + a.bal*{hz})/{d} ELSE 0 END), struct_pack(bal := 100.0::DOUBLE, d := 1.0::DOUBLE, pv := 0.0::DOUBLE))"
    return f"(list_sum(list_transform(ps, lambda p: p.n*({fold}).pv))/tot)"


ALLP = f"{PATHS}, al AS MATERIALIZED (SELECT list(struct_pack(m := m, n := n)) AS ps, sum(n) AS tot FROM pa)"


def solve_sql(price: str, market: str) -> str:
    """50 bisections of a price that falls in the spread; ``price`` uses MID."""
    mid = "((b.lo+b.hi)/2)"
    return f"list_reduce(range(1, 51), lambda b, i: CASE WHEN {price.replace('MID', mid)} > {market} THEN struct_pack(lo := {mid}, hi := b.hi) ELSE struct_pack(lo := b.lo, hi := {mid}) END, struct_pack(lo := -500.0::DOUBLE, hi := 2000.0::DOUBLE)).lo"


OAS_P = lambda s: mean_price_sql("note_rate", "n_active", s)


@query("K14_oas_solve", FITV + " f_path", f"""WITH {ALLP}, q AS MATERIALIZED (SELECT pf.*, 0.99*n_active*(100*(note_rate/1200)/(1-pow(1+note_rate/1200, -360)) + 100/(1+exp(-(note_rate*0.9-9.0)))) AS market, ps, tot, h0, h1, h2 FROM pf, al, hx), e AS MATERIALIZED (SELECT *, {OAS_P("-500.0")} AS p0, {OAS_P("2000.0")} AS p1 FROM q)
SELECT note_rate, n_active, n_loans, {R(f"CASE WHEN market > p0 THEN -500 WHEN market < p1 THEN 2000 ELSE {solve_sql(OAS_P('MID'), 'market')} END", 2)} AS oas_bp, market <= p0 AND market >= p1 AS converged FROM e""")
def _(fx):
    """Spread of every profile at 99 percent of a simple sum of its flows."""
    n = F.col("note_rate") / 1200
    month = 100 * n / (1 - F.pow(1 + n, F.lit(-360.0))) + 100 * rates.sigmoid(F.col("note_rate") * 0.9 - 9.0)
    pr = profiles(fx).withColumn("market", 0.99 * F.col("n_active") * month)
    out = pricing.oas_solve(pr, path_chunks(fx), fitted(fx).cell(), "market")
    return rnd(out.select("note_rate", "n_active", "n_loans", "oas_bp", "converged"), 2)


POOL_P = f"(list_sum(list_transform(fs, lambda f: f.u*{mean_price_sql('f.r', 'f.k', 'MID')}))/ut)"


@query("K14b_pool_oas", FITV + " f_path", f"""WITH {ALLP}, q AS MATERIALIZED (SELECT list(struct_pack(r := note_rate, k := n_active, u := upb)) AS fs, sum(upb) AS ut, any_value(ps) AS ps, any_value(tot) AS tot, any_value(h0) AS h0, any_value(h1) AS h1, any_value(h2) AS h2 FROM pf, al, hx) SELECT {R(solve_sql(POOL_P, "15.0"), 2)} AS pool_oas_bp, {POOL_P.replace('MID', '-500.0')} >= 15.0 AND {POOL_P.replace('MID', '2000.0')} <= 15.0 AS converged FROM q""")
def _(fx):
    return rnd(pricing.pool_oas(profiles(fx), path_chunks(fx), fitted(fx).cell(), 15.0), 2)


def flat_price_sql(cpr: str, zs: str) -> str:
    return price_sql("coupon", "FLAT", zs).replace("FLAT[m]", cpr).replace("acc", "g")


PMID = "((b.lo+b.hi)/2)"
K15D = f"(({flat_price_sql(PMID, 'zd')} - {flat_price_sql(PMID, 'zu')})/(2*{flat_price_sql(PMID, 'z0')}*0.0025))"


@query("K15_long_run_cpr_needed", V, f"""WITH {ME}, {POS0}, {scen_sql([pricing.scenario("base"), *pricing.two_sided("par", "parallel")])}, cv AS MATERIALIZED (SELECT mz.yyyymm, sv.scenario, {", ".join(f"mz.{t} + sv.b_{t} AS {t}" for t in TEN)} FROM mz, sv), zc AS MATERIALIZED ({zeros_sql("cv", "yyyymm, scenario")}),
j AS MATERIALIZED (SELECT ps.yyyymm, ps.coupon, 7.0 - ps.coupon/2 AS target, a.zs AS z0, u.zs AS zu, d.zs AS zd FROM ps JOIN zc a ON a.yyyymm = ps.yyyymm AND a.scenario = 'base' JOIN zc u ON u.yyyymm = ps.yyyymm AND u.scenario = 'par+' JOIN zc d ON d.yyyymm = ps.yyyymm AND d.scenario = 'par-')
SELECT yyyymm, coupon, target, {R("(s.lo+s.hi)/2", 5)} AS flat_cpr FROM (SELECT *, list_reduce(range(1, 21), lambda b, i: CASE WHEN {K15D} > target THEN struct_pack(lo := {PMID}, hi := b.hi) ELSE struct_pack(lo := b.lo, hi := {PMID}) END, struct_pack(lo := 0.001::DOUBLE, hi := 0.60::DOUBLE)) AS s FROM j)""")
def _(fx):
    """Flat speed that reproduces a duration falling with the coupon."""
    targets = positions(fx).select("yyyymm", "coupon", (F.lit(7.0) - F.col("coupon") / 2).alias("target"))
    return rnd(pricing.long_run_speed(month_curves(fx), targets, rounds=20), 5)


def repricing(df, zeros, name):
    err = [F.abs(curves.par_bond_price(zeros, t, n) - 100) for n, t in zip(TEN, curves.YEARS) if t >= 1]
    return F.greatest(*err).alias(name)


BILLS = {"simple": "ln(1 + {r}*{t})", "discount": "-ln(1 - {r}*{t}*360.0/365.0)", "bond_equivalent": "2*ln(1 + {r}/2)*{t}", "continuous": "{r}*{t}"}


def xs_to_zs(q: str) -> str:
    """Add the 360-month list of zeros from integrated zeros x_<tenor>."""
    case = f"CASE WHEN m <= 1 THEN x_m1*m " + " ".join(f"WHEN m <= {MON[i + 1]} THEN x_{TEN[i]} + (x_{TEN[i + 1]} - x_{TEN[i]})*(m - {MON[i]})/{MON[i + 1] - MON[i]}.0" for i in range(10)) + " END"
    return f"SELECT *, list_transform(range(1, 361), lambda m: ({case})/m*1200) AS zs FROM ({q})"


def logdf_sql(rel: str, keys: str) -> str:
    q = f"SELECT {keys}, {', '.join(TEN)}, " + ", ".join(f"ln(1 + {t}/100)*{y!r} AS x_{t}" for t, y in zip(TEN[:4], curves.YEARS)) + f" FROM {rel}"
    for i in range(4, len(TEN)):
        nodes = [(0.0, "0.0")] + [(curves.YEARS[j], f"x_{TEN[j]}") for j in range(i)]

        def at(t):
            for (ta, xa), (tb, xb) in zip(nodes, nodes[1:]):
                if t <= tb:
                    return f"({xa} + ({xb}-{xa})*{(t - ta) / (tb - ta)!r})"
            (ta, xa), (tb, xb) = nodes[-2:]
            return f"({xb} + ({xb}-{xa})*{(t - tb) / (tb - ta)!r})"

        pv = " + ".join(f"exp(-{at(s / 2)})" for s in range(1, curves.YEARS[i] * 2))
        q = f"SELECT *, -ln((1 - {TEN[i]}/200*({pv}))/(1 + {TEN[i]}/200)) AS x_{TEN[i]} FROM ({q})"
    return q


def reprice_sql() -> str:
    errs = []
    for t, y in zip(TEN, curves.YEARS):
        if y >= 1:
            pv = f"list_sum(list_transform(range(1, {y * 2 + 1}), lambda h: exp(-zs[h*6]/100*h/2)))"
            errs.append(f"abs({t}/2*{pv} + 100*exp(-zs[{y * 12}]/100*{y}) - 100)")
    return f"greatest({', '.join(errs)})"


KINK = "abs(((zs[8]*8 - zs[7]*7) - (zs[6]*6 - zs[5]*5))/1200*120000)"
K16 = [f"a AS (SELECT yyyymm, {reprice_sql()} AS err_standard FROM ({zeros_sql('mz', 'yyyymm')}))", f"b AS (SELECT yyyymm, {reprice_sql()} AS err_logdf FROM ({xs_to_zs(logdf_sql('mz', 'yyyymm'))}))"]
K16 += [f"c{i} AS (SELECT yyyymm, {KINK} AS kink_{n}{', ' + reprice_sql() + ' AS err_exact' if n == 'simple' else ''} FROM ({xs_to_zs(exact_sql('mz', 'yyyymm', b))}))" for i, (n, b) in enumerate(BILLS.items())]


@query("K16_curve_checks", "f_curve_daily", f"""WITH {ME}, {", ".join(K16)} SELECT yyyymm, {R("err_standard")} AS err_standard, {R("err_logdf")} AS err_logdf, {R("err_exact")} AS err_exact, {", ".join(f"{R('kink_' + n, 4)} AS kink_{n}" for n in BILLS)}
FROM a JOIN b USING (yyyymm) {" ".join(f"JOIN c{i} USING (yyyymm)" for i in range(4))}""")
def _(fx):
    """Par repricing error of three bootstraps and the forward kink at the bill
    and bond boundary under four bill conventions, per month-end curve."""
    c = month_curves(fx)
    std = curves.bootstrap_zeros(c).withColumn("zs", curves.monthly_zeros()).select("yyyymm", repricing(None, "zs", "err_standard"))
    log = curves.bootstrap_logdf(c).withColumn("zs", curves.monthly_zeros_from_logdf()).select("yyyymm", repricing(None, "zs", "err_logdf"))
    out = std.join(log, "yyyymm")
    for conv in curves.BILL_CONVENTIONS:
        z = curves.bootstrap_exact(c, conv).withColumn("zs", curves.monthly_zeros_from_logdf())
        x = lambda m: F.element_at("zs", m) * m / 1200
        fwd = lambda m: (x(m + 1) - x(m)) * 12 * 10000
        cols = [F.abs(fwd(7) - fwd(5)).alias(f"kink_{conv}")]
        if conv == "simple":
            cols.append(repricing(None, "zs", "err_exact"))
        out = out.join(z.select("yyyymm", *cols), "yyyymm")
    return rnd(out, 6, **{f"kink_{n}": 4 for n in BILLS})


PAR = [pricing.scenario("base"), *pricing.two_sided("par", "parallel")]


K17 = f"""WITH {ME}, {POS0}, {scen_sql(PAR)}, cv AS MATERIALIZED (SELECT mz.yyyymm, sv.scenario, {", ".join(f"mz.{t} + sv.b_{t} AS {t}" for t in TEN)} FROM mz, sv),
zz AS MATERIALIZED (SELECT 'a' AS m_, yyyymm, scenario, zs FROM ({zeros_sql("cv", "yyyymm, scenario")}) UNION ALL SELECT 'b', yyyymm, scenario, zs FROM ({xs_to_zs(exact_sql("cv", "yyyymm, scenario"))})),
fl AS MATERIALIZED (SELECT m_, zz.yyyymm, scenario, coupon, list_transform(range(1, 361), lambda q: 0.12) AS cl, zs FROM zz JOIN ps USING (yyyymm)), px AS (SELECT m_, yyyymm, coupon, scenario, {price_sql("coupon", "cl", "zs")} AS p FROM fl),
d AS (SELECT m_, yyyymm, coupon, (max(p) FILTER (scenario = 'par-') - max(p) FILTER (scenario = 'par+'))/(2*max(p) FILTER (scenario = 'base')*0.0025) AS du FROM px GROUP BY 1, 2, 3), r AS (SELECT a.coupon, b.du/a.du AS q FROM d a JOIN d b ON a.yyyymm = b.yyyymm AND a.coupon = b.coupon WHERE a.m_ = 'a' AND b.m_ = 'b')
SELECT coupon, {R("avg(q)")} AS mean_ratio, {R("min(q)")} AS min_ratio, {R("max(q)")} AS max_ratio, count(*) AS n FROM r GROUP BY 1"""


@query("K17_curve_method_impact", V, K17)
def _(fx):
    """Duration ratio of two bootstraps at a frozen speed, by coupon."""
    d = lambda m: pricing.durations(sc_prices(fx, PAR, method=m, frozen_cpr=0.12), ["par"])
    a = d("standard").select("yyyymm", "coupon", F.col("par").alias("a"))
    b = d("exact").select("yyyymm", "coupon", F.col("par").alias("b"))
    r = F.col("b") / F.col("a")
    return rnd(a.join(b, ["yyyymm", "coupon"]).groupBy("coupon").agg(
        F.avg(r).alias("mean_ratio"), F.min(r).alias("min_ratio"), F.max(r).alias("max_ratio"), F.count(F.lit(1)).alias("n")))


@query("K18_clip_and_move", V, f"""WITH {POS}, e AS (SELECT coupon, coupon+0.5-pmms AS i0, h0, h1, h2, tf, ts, tk, tx FROM ps), k AS (SELECT coupon, {haz_sql("i0")} AS base, list_avg({haz_sql("i0+0.25")}) - list_avg({haz_sql("i0")}) AS mv, {term_sql("i0+0.25")} - {term_sql("i0")} AS up, {term_sql("i0-0.25")} - {term_sql("i0")} AS dn FROM e),
c AS (SELECT *, len(list_filter(base, lambda p: p+up < 0 OR p+up > 0.99)) + len(list_filter(base, lambda p: p+dn < 0 OR p+dn > 0.99)) AS nc FROM k)
SELECT coupon, {R("sum(nc)/(count(*)*66.0)")} AS clip_share, {R("avg(mv)")} AS model_move, {R("avg(up)")} AS scurve_move, {R("avg(up)/avg(mv)", 5)} AS ratio FROM c GROUP BY 1""")
def _(fx):
    """Share of grafted path points that would clip, and the speed response to
    25bp lower rates of the model and of the terminal curve."""
    i0 = F.col("coupon") + 0.5 - F.col("pmms")
    coef = fitted(fx).cell()
    df = positions(fx).withColumn("base", hazard_cpr_path(i0, coef)).withColumn("up", pricing.terminal_speed(i0 + 0.25, CURVE) - pricing.terminal_speed(i0, CURVE)).withColumn(
        "dn", pricing.terminal_speed(i0 - 0.25, CURVE) - pricing.terminal_speed(i0, CURVE))
    out_of = lambda d: F.size(F.filter("base", lambda p: (p + F.col(d) < 0) | (p + F.col(d) > 0.99)))
    move = array_mean(hazard_cpr_path(i0 + 0.25, coef)) - array_mean(F.col("base"))
    g = df.withColumn("nc", out_of("up") + out_of("dn")).withColumn("mv", move).groupBy("coupon")
    return rnd(g.agg((F.sum("nc") / (F.count(F.lit(1)) * 66.0)).alias("clip_share"), F.avg("mv").alias("model_move"), F.avg("up").alias("scurve_move"),
                     (F.avg("up") / F.avg("mv")).alias("ratio")), 6, ratio=5)


@query("K19_age_extrapolation", V, f"""WITH {POS}, e AS (SELECT coupon, age, list_avg({cell_path_sql("coupon+0.5-pmms", "age")}) AS c FROM ps, (SELECT unnest([0, 33, 60, 120, 240]) AS age))
SELECT coupon, CAST(age AS BIGINT) AS start_age, age > 33 AS extrapolated, {R("avg(c)")} AS mean_cpr, {R("max(c)")} AS max_cpr FROM e GROUP BY 1, 2, 3""")
def _(fx):
    """Speed at start ages beyond the 33 training months."""
    df = positions(fx).withColumn("start_age", F.explode(F.array(*[F.lit(a) for a in (0, 33, 60, 120, 240)])))
    c = array_mean(hazard_cpr_path(F.col("coupon") + 0.5 - F.col("pmms"), fitted(fx).cell(), F.col("start_age")))
    return rnd(df.withColumn("c", c).groupBy("coupon", "start_age").agg(F.avg("c").alias("mean_cpr"), F.max("c").alias("max_cpr")).withColumn(
        "extrapolated", F.col("start_age") > 33))


# ------------------------------------------------------- forwards on bootstrapped zeros


ZERO = f"""zr AS MATERIALIZED ({zeros_sql("(SELECT * FROM f_curve_daily WHERE d = (SELECT max(d) FROM f_curve_daily))", "d")}),
z AS (SELECT CAST(unnest(range(1, 34)) AS BIGINT) AS t, unnest(zs[1:33]) AS zero FROM zr),
fw AS (SELECT t, zero, coalesce(zero*t - lag(zero*t) OVER (ORDER BY t), zero) AS forward FROM z)"""


def zeros33(fx):
    """Bootstrapped zeros of the latest curve day on months 1..33."""
    last = fx.curve_daily.agg(F.max("d"))
    day = fx.curve_daily.withColumn("_last", last.scalar()).filter(F.col("d") == F.col("_last")).select("d", *TEN)
    grid = F.slice(curves.monthly_zeros(), 1, 33)
    return curves.bootstrap_zeros(day).select(F.posexplode(grid).alias("i", "zero")).select((F.col("i") + 1).cast("bigint").alias("t"), "zero")


@query("F25_forward_rates", "f_curve_daily", f"WITH {ZERO} SELECT t, {R('zero', 8)} AS zero, {R('forward', 8)} AS forward FROM fw")
def _(fx):
    return rnd(series.forward_rates(zeros33(fx)), 8)


DRIFT = f"""{ZERO}, mn AS (SELECT t, avg(rate) AS m FROM f_path GROUP BY 1), dc AS (SELECT p.path_id, CAST(p.t AS BIGINT) AS t, greatest(p.rate + fw.forward - mn.m, 0.01) AS corrected FROM f_path p JOIN mn ON p.t=mn.t JOIN fw ON p.t=fw.t)"""


@query("F26_drift_correct", "f_curve_daily f_path", f"WITH {DRIFT} SELECT path_id, t, {R('corrected')} AS corrected FROM dc")
def _(fx):
    return rnd(series.drift_correct(fx.path, series.forward_rates(zeros33(fx))).select("path_id", "t", "corrected"))


HORIZONS = [1, 3, 6, 12, 24, 33]


@query("F27_zcb_reprice", "f_curve_daily f_path", f"""WITH {DRIFT}, c AS (SELECT path_id, t, sum(corrected/1200) OVER (PARTITION BY path_id ORDER BY t) AS s FROM dc)
SELECT c.t, {R("avg(exp(-s))", 9)} AS model_df, {R("any_value(exp(-zero*z.t/1200))", 9)} AS target_df, {R("abs(avg(exp(-s)) - any_value(exp(-zero*z.t/1200)))*10000")} AS error_bp FROM c JOIN z ON z.t = c.t WHERE c.t IN (1,3,6,12,24,33) GROUP BY 1""")
def _(fx):
    z = zeros33(fx)
    paths = series.drift_correct(fx.path, series.forward_rates(z))
    return rnd(series.zcb_reprice(paths, z, HORIZONS, "corrected"), 9, error_bp=6)
