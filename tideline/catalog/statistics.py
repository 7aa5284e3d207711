"""2.G grouped regression and statistics, with the mapping scores E16-E18."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tideline.catalog.olssql import ols_sql
from tideline.catalog.pricesql import KRD, ME, POS, TENT, V, dur_sql, key_rate_durations, priced_sql
from tideline.catalog.registry import R, query, rnd
from tideline.catalog.scurvesql import BAND, descent_sql, in_band, scurve_sql, zoom_sql
from tideline.catalog.selection import RET, excess
from tideline.catalog.survival import AGE, FVR, STATE, AGE_KEY, by_age, forecast_realized, speeds_sql
from tideline.functions import rates
from tideline.operators import joins, ordering, regression, scoring, selection, series, survival
from tideline.plans import factors, mapping, scurve
from tideline.session import cut_lineage

PRICE_VIEWS = "f_price f_curve_daily f_market_rate"

# ---------------------------------------------------------------- shared panels

BASIS = """cm AS (SELECT yyyymm, mi, arg_max(y1, d) AS y1, arg_max(y2, d) AS y2, arg_max(y5, d) AS y5, arg_max(y10, d) AS y10, arg_max(y30, d) AS y30 FROM f_curve_daily GROUP BY 1, 2),
cb AS (SELECT yyyymm, mi, (y5+y10)/2 - lag((y5+y10)/2) OVER w AS d_level, (y10-y5) - lag(y10-y5) OVER w AS d_slope, (y2+y5+y10)/3 - lag((y2+y5+y10)/3) OVER w AS d_level3,
  (y10-y2) - lag(y10-y2) OVER w AS d_slope3, (2*y5-y2-y10) - lag(2*y5-y2-y10) OVER w AS d_curve3, y1 - lag(y1) OVER w AS dy1, y2 - lag(y2) OVER w AS dy2, y5 - lag(y5) OVER w AS dy5,
  y10 - lag(y10) OVER w AS dy10, y30 - lag(y30) OVER w AS dy30, (y5+y10)/2/12/100 AS income FROM cm WINDOW w AS (ORDER BY mi))"""


def basis(fx):
    me = series.month_end(fx.curve_daily, ["y1", "y2", "y5", "y10", "y30"])
    b = series.curve_basis(me)
    return b.withColumn("dy1", series.diff("y1")).withColumn("dy30", series.diff("y30"))


EXB = f"WITH {RET}, {BASIS}, xb AS (SELECT ex.*, d_level, d_slope, d_level3, d_slope3, d_curve3, dy1, dy2, dy5, dy10, dy30, income FROM ex JOIN cb ON ex.yyyymm = cb.yyyymm)"


def excess_basis(fx):
    b = basis(fx).drop("mi", "y1", "y2", "y5", "y10", "y30", "month_end")
    return excess(fx).join(F.broadcast(b), "yyyymm")


DPM = f"""WITH {BASIS}, pm AS (SELECT m.yyyymm, m.mi, rate_30yr, rate_30yr - lag(rate_30yr) OVER (ORDER BY m.mi) AS dpmms, d_level, dy2, dy5, dy10 FROM f_market_rate m JOIN cb ON m.yyyymm = cb.yyyymm),
dm AS (SELECT * FROM pm WHERE dpmms IS NOT NULL AND dy2 IS NOT NULL)"""


def rate_changes(fx):
    """Monthly change of the market rate beside the Treasury changes."""
    m = fx.market_rate.join(F.broadcast(basis(fx).drop("mi")), "yyyymm")
    return m.withColumn("dpmms", series.diff("rate_30yr")).dropna(subset=["dpmms", "dy2"])


HPB = f"""WITH {RET}, {BASIS}, {ME}, {POS}, {priced_sql(TENT)}, kr AS MATERIALIZED ({dur_sql(KRD)}), km AS (SELECT kr.*, f.mi FROM kr JOIN f_price f ON f.yyyymm = kr.yyyymm AND f.coupon = kr.coupon),
 hp AS MATERIALIZED (SELECT tr.coupon, tr.yyyymm, tr.mi, tr.total_return, cb.income, cb.d_level3 AS d_level, cb.d_slope3 AS d_slope, cb.d_curve3 AS d_curve, cb.dy1, cb.dy2, cb.dy5, cb.dy10, cb.dy30,
   pm.rate_30yr AS pmms, k.krd2, k.krd5, k.krd10, k.krd2+k.krd5+k.krd10 AS dur_level, (k.krd10-k.krd2)/2 AS dur_slope, (2*k.krd5-k.krd2-k.krd10)/6 AS dur_curve,
   tr.total_return - cb.income + ((k.krd2+k.krd5+k.krd10)*cb.d_level3 + (k.krd10-k.krd2)/2*cb.d_slope3 + (2*k.krd5-k.krd2-k.krd10)/6*cb.d_curve3)/100 AS hedged
 FROM tr JOIN cb ON tr.yyyymm = cb.yyyymm JOIN f_market_rate pm ON pm.mi = tr.mi - 1 JOIN km k ON k.coupon = tr.coupon AND k.mi = tr.mi - 1 WHERE cb.d_level3 IS NOT NULL)"""


def hedge_rows(fx):
    """Hedge panel in canonical columns, with the key-rate durations priced from
    the information month's curve and the fitted model."""
    b = basis(fx)
    pm = fx.market_rate.select((F.col("mi") + 1).alias("mi"), F.col("rate_30yr").alias("pmms"))
    now = b.select("mi", "income", F.col("d_level3").alias("d_level"), F.col("d_slope3").alias("d_slope"), F.col("d_curve3").alias("d_curve"), "dy1", "dy2", "dy5", "dy10", "dy30")
    info = key_rate_durations(fx).join(fx.price.select("yyyymm", "coupon", "mi"), ["yyyymm", "coupon"]).select("coupon", (F.col("mi") + 1).alias("mi"), *KRD)
    df = series.total_returns(fx.price).join(F.broadcast(now), "mi").join(F.broadcast(pm), "mi").join(info, ["coupon", "mi"])
    from tideline.plans.hedging import hedged_returns

    return hedged_returns(df.filter(F.col("d_level").isNotNull()))


FACT = f"""{FVR}, fi AS (SELECT *, greatest(inc, 0) AS rl FROM fr), fg AS (SELECT yyyymm, mi, max(rate_30yr) AS rate_30yr, count(*) AS n, max(rl)-min(rl) AS rg, regr_slope(forecast_cpr, rl) AS sf, regr_intercept(forecast_cpr, rl) AS if_, avg(forecast_cpr) AS mf,
  regr_slope(cpr_upb, rl) AS sr, regr_intercept(cpr_upb, rl) AS ir, avg(cpr_upb) AS mr FROM fi GROUP BY 1, 2 HAVING count(*) >= 3),
fa AS (SELECT yyyymm, mi, CASE WHEN rg < 1e-12 THEN mr - mf ELSE ir - if_ END AS f_level, CASE WHEN rg < 1e-12 THEN 0 ELSE sr - sf END AS f_slope FROM fg)"""


def factor_panel(fx):
    """Factors are read by several steps: built from the loan panel once."""
    df = forecast_realized(fx).withColumn("incentive", rates.relu("inc")).withColumn("realized_cpr", F.col("cpr_upb"))
    return cut_lineage(factors.level_slope_factors(df))


ALLV = "f_loan f_forecast f_curve_daily"
FEX = FACT + f", {RET}"

def t_sql(t: str, dof: str) -> str:
    """Two-sided p-value by the finite sums in the angle, for whole degrees of freedom."""
    fold = lambda up, low: f"list_reduce(range(1, z.h + 1), lambda a, j: struct_pack(c := a.c*z.q*(2*j - {up})/(2*j + {low}), s := a.s + a.c*z.q*(2*j - {up})/(2*j + {low})), struct_pack(c := 1.0::DOUBLE, s := 1.0::DOUBLE)).s"
    value = f"CASE WHEN z.n = 1 THEN 1 - 2*z.th/pi() WHEN z.n % 2 = 1 THEN 1 - 2/pi()*(z.th + z.sn*sqrt(z.q)*{fold(0, 1)}) ELSE 1 - z.sn*{fold(1, 0)} END"
    parts = f"struct_pack(n := ({dof})::BIGINT, q := ({dof})/(({dof}) + pow({t}, 2)), sn := abs({t})/sqrt(({dof}) + pow({t}, 2)), th := atan(abs({t})/sqrt({dof})), h := CASE WHEN ({dof}) % 2 = 1 THEN (({dof}) - 3)//2 ELSE (({dof}) - 2)//2 END)"
    return f"CASE WHEN ({dof}) >= 1 THEN list_transform([{parts}], lambda z: {value})[1] END"


# -------------------------------------------------------------------- G queries


@query("G1_ols_grouped", PRICE_VIEWS, f"""{EXB} SELECT coupon, n, {R("b_d_level", 8)} AS b_level, {R("b_d_slope", 8)} AS b_slope, {R("t_d_level", 5)} AS t_level, {R("t_d_slope", 5)} AS t_slope, {R("b0", 8)} AS b0, {R("t0", 5)} AS t0, {R("r2")} AS r2 FROM {ols_sql("xb", "excess_return", ["d_level", "d_slope"], "coupon")}""")
def _(fx):
    f = regression.ols(excess_basis(fx), "excess_return", ["d_level", "d_slope"], ["coupon"])
    return rnd(f.select("coupon", "n", F.col("b_d_level").alias("b_level"), F.col("b_d_slope").alias("b_slope"), F.col("t_d_level").alias("t_level"),
                        F.col("t_d_slope").alias("t_slope"), "b0", "t0", "r2"), 8, t_level=5, t_slope=5, t0=5, r2=6)


@query("G2_level_slope_factors", "f_loan f_forecast", f"{FACT} SELECT yyyymm, {R('f_level', 8)} AS f_level, {R('f_slope', 8)} AS f_slope FROM fa")
def _(fx):
    return rnd(factor_panel(fx).select("yyyymm", "f_level", "f_slope"), 8)


EB = ols_sql("(SELECT ex.coupon, ex.excess_return, fa.f_level AS x, fa.f_slope AS y FROM ex JOIN fa ON ex.yyyymm = fa.yyyymm)", "excess_return", ["x", "y"], "coupon")


def betas(fx):
    return factors.empirical_betas(excess(fx), factor_panel(fx))


@query("G3_empirical_betas", ALLV, f"{FEX} SELECT coupon, n AS n_obs, {R('b_x')} AS b_x, {R('b_y')} AS b_y, {R('r2')} AS r2 FROM {EB} WHERE n >= 6")
def _(fx):
    return rnd(betas(fx))


FM = f"""{FEX}, ab AS (SELECT ex.coupon, ex.yyyymm, ex.excess_return, ex.rate_30yr, ((r-c)/((r+phi)*(phi+c))) AS bx, ((r-c)/((r+phi)*(phi+c)))*greatest(0, ex.coupon+0.5-ex.rate_30yr)/100 AS by_
   FROM ex, LATERAL (SELECT ex.rate_30yr/100 AS r, ex.coupon/100 AS c, 0.02 + 0.01*ex.coupon AS phi)),
ag AS (SELECT yyyymm, max(rate_30yr) AS rate_30yr, count(*) AS n, count(*) FILTER (coupon > rate_30yr) AS np, sum(bx*bx) AS xx, sum(by_*by_) AS yy, sum(bx*by_) AS xy, sum(bx*excess_return) AS xr, sum(by_*excess_return) AS yr, sum(excess_return*excess_return) AS rr,
   var_pop(excess_return)*count(*) AS tss, max(abs(by_)) AS mb FROM ab GROUP BY 1 HAVING count(*) >= 4),
fm AS (SELECT *, CASE WHEN mb < 1e-10 THEN xr/xx ELSE (xr*yy-yr*xy)/(xx*yy-xy*xy) END AS lx, CASE WHEN mb >= 1e-10 THEN (yr*xx-xr*xy)/(xx*yy-xy*xy) END AS ly FROM (SELECT *, CASE WHEN rate_30yr > 3.5 THEN 'DM' ELSE 'PM' END AS mt FROM ag) )"""


def phi():
    return 0.02 + 0.01 * F.col("coupon")


def analytic(fx):
    ex = excess(fx)
    return factors.fama_macbeth_analytic(ex, rates.beta_level("coupon", phi(), "rate_30yr"), rates.beta_slope("coupon", phi(), "rate_30yr"))


@query("G4_fama_macbeth_analytic", ALLV, f"""{FM} SELECT yyyymm, mt AS market_type, rate_30yr, {R("lx", 8)} AS lambda_x, {R("ly")} AS lambda_y, {R("CASE WHEN tss > 1e-12 THEN 1 - (rr - lx*xr - coalesce(ly*yr, 0))/tss END")} AS r2, n AS n_coupons, np AS n_premium, n - np AS n_discount FROM fm""")
def _(fx):
    return rnd(analytic(fx), 6, lambda_x=8)


FME = f"""{FEX}, be AS (SELECT coupon, b_x, b_y FROM {EB} WHERE n >= 6), rh AS (SELECT corr(b_x, b_y) AS rho FROM be),
eg AS (SELECT ex.yyyymm, count(*) AS n, corr(b_x, b_y) AS rm, sum(b_x*b_x) AS xx, sum(b_y*b_y) AS yy, sum(b_x*b_y) AS xy, sum(b_x*excess_return) AS xr, sum(b_y*excess_return) AS yr, sum(excess_return*excess_return) AS rr, var_pop(excess_return)*count(*) AS tss
   FROM ex JOIN be USING (coupon) WHERE ex.yyyymm IN (SELECT yyyymm FROM fa) GROUP BY 1 HAVING count(*) >= 4),
em AS (SELECT eg.*, abs(rho) > 0.9 AS single FROM eg, rh),
el AS (SELECT yyyymm, n, single, CASE WHEN single THEN xr/xx ELSE (xr*yy-yr*xy)/(xx*yy-xy*xy) END AS lx, CASE WHEN NOT single THEN (yr*xx-xr*xy)/(xx*yy-xy*xy) END AS ly, xr, yr, rr, tss FROM em WHERE single OR abs(rm) <= 0.9)"""


def empirical(fx):
    fac = factor_panel(fx)
    ret = excess(fx).join(fac.select("yyyymm"), "yyyymm", "left_semi")
    return factors.fama_macbeth_empirical(ret, factors.empirical_betas(excess(fx), fac))


@query("G5_fama_macbeth_empirical", ALLV, f"""{FME} SELECT yyyymm, n, {R("lx", 8)} AS lambda_x, {R("ly", 8)} AS lambda_y, {R("CASE WHEN tss > 1e-12 THEN 1 - (rr - lx*xr - coalesce(ly*yr, 0))/tss END")} AS r2, CASE WHEN single THEN 'single_factor' ELSE 'two_factor' END AS mode FROM el""")
def _(fx):
    return rnd(empirical(fx), 8, r2=6)


@query("G6_ttest_1samp", ALLV, f"""{FM} SELECT mt AS market_type, count(lx) AS n, {R("avg(lx)", 8)} AS mean, {R("stddev_samp(lx)", 8)} AS std, {R("avg(lx)/(stddev_samp(lx)/sqrt(count(lx)))", 5)} AS t, {R(t_sql("avg(lx)/(stddev_samp(lx)/sqrt(count(lx)))", "count(lx) - 1"), 8)} AS p FROM fm GROUP BY 1""")
def _(fx):
    return rnd(regression.one_sample_t(analytic(fx), "lambda_x", ["market_type"]), 8, t=5)


def _sums_sql(name: str, rel: str, value: str) -> str:
    t = f"avg({value})/nullif(stddev_samp({value})/sqrt(count({value})), 0)"
    return f"""SELECT '{name}' AS test, count({value}) AS n, {R(f"avg({value})", 8)} AS mean, {R(f"stddev_samp({value})", 8)} AS std, {R(t, 5)} AS t, {R(t_sql(t, f"count({value}) - 1"), 8)} AS p FROM {rel}"""


@query("G6b_ttest_summaries", ALLV, f"""{FM}, {FME.replace(FEX + ", ", "")} {_sums_sql("analytic level", "fm", "lx")} UNION ALL {_sums_sql("analytic slope", "fm", "ly")}
UNION ALL {_sums_sql("empirical level", "el", "lx")} UNION ALL {_sums_sql("empirical slope", "el", "ly")}""")
def _(fx):
    """Premia of G4 and G5 against zero, with p-values."""
    long = lambda df, kind: df.select(F.explode(F.array(*[F.struct(F.lit(f"{kind} {n}").alias("test"), F.col(c).alias("v")) for n, c in (("level", "lambda_x"), ("slope", "lambda_y"))])).alias("r")).select("r.*")
    return rnd(regression.one_sample_t(long(analytic(fx), "analytic").unionByName(long(empirical(fx), "empirical")), "v", ["test"]), 8, t=5)


@query("G7_orthogonalize", ALLV, f"""{FM}, c AS (SELECT ab.yyyymm, regr_slope(by_, bx) AS c1, regr_intercept(by_, bx) AS c0 FROM ab GROUP BY 1),
o AS (SELECT ab.yyyymm, sum(bx*bx) AS xx, sum(pow(by_-c0-c1*bx, 2)) AS oo, sum(bx*(by_-c0-c1*bx)) AS xo, sum(bx*excess_return) AS xr, sum((by_-c0-c1*bx)*excess_return) AS orr, stddev_pop(by_-c0-c1*bx) AS so FROM ab JOIN c USING (yyyymm) GROUP BY 1)
SELECT fm.yyyymm, mt AS market_type, {R("lx")} AS lx_base, {R("ly", 5)} AS ly_base, {R("CASE WHEN mb >= 1e-12 AND so > 1e-12 THEN (o.xr*oo - orr*xo)/(o.xx*oo-xo*xo) ELSE lx END")} AS lx_orth, {R("CASE WHEN mb >= 1e-12 AND so > 1e-12 THEN (orr*o.xx - o.xr*xo)/(o.xx*oo-xo*xo) END", 5)} AS ly_orth FROM fm JOIN o USING (yyyymm)""")
def _(fx):
    out = factors.orthogonalized_lambdas(excess(fx), rates.beta_level("coupon", phi(), "rate_30yr"), rates.beta_slope("coupon", phi(), "rate_30yr"))
    return rnd(out, 6, ly_base=5, ly_orth=5)


@query("G8_clustered_se", ALLV, f"""{FEX}, sh AS (SELECT yyyymm, avg(CASE WHEN price < 97.75 THEN 1.0 ELSE 0 END) AS s FROM ex GROUP BY 1), d AS (SELECT ex.yyyymm, excess_return AS y, rate_30yr - coupon AS rel, (rate_30yr - coupon)*(s - 0.5) AS inter FROM ex JOIN sh USING (yyyymm)),
f AS (SELECT * FROM {ols_sql("d", "y", ["rel", "inter"])}), e AS (SELECT d.*, y - b0 - b_rel*rel - b_inter*inter AS u FROM d, f),
x AS (SELECT count(*) AS s00, sum(rel) AS s01, sum(inter) AS s02, sum(rel*rel) AS s11, sum(rel*inter) AS s12, sum(inter*inter) AS s22 FROM d),
iv AS (SELECT (s11*s22-s12*s12)/dt AS a00, (s02*s12-s01*s22)/dt AS a01, (s01*s12-s02*s11)/dt AS a02, (s00*s22-s02*s02)/dt AS a11, (s01*s02-s00*s12)/dt AS a12, (s00*s11-s01*s01)/dt AS a22
   FROM (SELECT *, s00*(s11*s22-s12*s12) - s01*(s01*s22-s12*s02) + s02*(s01*s12-s11*s02) AS dt FROM x)),
wz AS (SELECT 'one' AS term, yyyymm, u*(a00 + a01*rel + a02*inter) AS z FROM e, iv UNION ALL SELECT 'rel', yyyymm, u*(a01 + a11*rel + a12*inter) FROM e, iv UNION ALL SELECT 'inter', yyyymm, u*(a02 + a12*rel + a22*inter) FROM e, iv),
p AS (SELECT term, sqrt(sum(z*z)) AS se FROM wz GROUP BY 1), q AS (SELECT term, sqrt(sum(g*g)) AS se, count(*) AS n_clusters FROM (SELECT term, yyyymm, sum(z) AS g FROM wz GROUP BY 1, 2) GROUP BY 1)
SELECT term, {R("CASE term WHEN 'one' THEN b0 WHEN 'rel' THEN b_rel ELSE b_inter END", 8)} AS coef, {R("CASE term WHEN 'one' THEN b0 WHEN 'rel' THEN b_rel ELSE b_inter END/p.se", 5)} AS t_plain, {R("CASE term WHEN 'one' THEN b0 WHEN 'rel' THEN b_rel ELSE b_inter END/q.se", 5)} AS t_cluster, {R(t_sql("CASE term WHEN 'one' THEN b0 WHEN 'rel' THEN b_rel ELSE b_inter END/p.se", "f.n - 3"), 8)} AS p_plain, {R(t_sql("CASE term WHEN 'one' THEN b0 WHEN 'rel' THEN b_rel ELSE b_inter END/q.se", "n_clusters - 1"), 8)} AS p_cluster, f.n, n_clusters, {R("r2")} AS r2 FROM p JOIN q USING (term), f""")
def _(fx):
    share = F.avg(F.when(F.col("price") < 97.75, 1.0).otherwise(0.0)).over(W.partitionBy("yyyymm"))
    rel = F.col("rate_30yr") - F.col("coupon")
    df = excess(fx).withColumn("rel", rel).withColumn("inter", rel * (share - 0.5))
    return rnd(factors.clustered_errors(df, "excess_return", ["rel", "inter"], "yyyymm"), 8, t_plain=5, t_cluster=5, r2=6)


MAPCELL = f"""{FVR}, mc AS MATERIALIZED (SELECT *, ln(least(greatest(forecast_cpr,1e-6),1-1e-6)/(1-least(greatest(forecast_cpr,1e-6),1-1e-6))) AS lx, ln(least(greatest(cpr_upb,1e-6),1-1e-6)/(1-least(greatest(cpr_upb,1e-6),1-1e-6))) AS ly,
  ln(least(greatest(forecast_cpr,1e-6),1-1e-6)) AS gx, ln(least(greatest(cpr_upb,1e-6),1-1e-6)) AS gy, upb_atrisk/1e6 AS w FROM fr WHERE cpr_upb > 0 AND forecast_cpr > 0)"""


def asof_line(x: str, y: str, name: str, months: int) -> str:
    return f"""{name} AS MATERIALIZED (SELECT mi, (sw*sxy - sx*sy)/nullif(sw*sxx - sx*sx, 0) AS b, (sy - (sw*sxy - sx*sy)/nullif(sw*sxx - sx*sx, 0)*sx)/sw AS a, nm, nt FROM (
 SELECT c.mi, sum(m.w) AS sw, sum(m.w*m.{x}) AS sx, sum(m.w*m.{y}) AS sy, sum(m.w*m.{x}*m.{x}) AS sxx, sum(m.w*m.{x}*m.{y}) AS sxy, count(DISTINCT m.mi) AS nm, count(*) AS nt FROM (SELECT DISTINCT mi FROM mc) c JOIN mc m ON m.mi < c.mi - 1 GROUP BY 1) WHERE nm >= {months})"""


@query("G9_wls_logit_asof", "f_loan f_forecast", f"{MAPCELL}, {asof_line('lx', 'ly', 'lf', 24)} SELECT mi, {R('a', 5)} AS a, {R('b', 5)} AS b, nm AS n_months, nt AS n_train FROM lf")
def _(fx):
    return rnd(mapping.fit_asof(forecast_realized(fx), min_months=24), 5)


def mapping_cells(fx):
    return mapping.cells(forecast_realized(fx))


def wls_asof_sql(name: str, y: str, xs: dict[str, str], bucket: str = "", rel: str = "mc", by: str = "") -> str:
    """Weighted fit on months before each month less one, by cofactors of the
    centred cross-products; ``bucket`` and ``by`` add keys."""
    from tideline.catalog.olssql import det, inverse

    ns = list(xs)
    key = (f", {by}" if by else "") + (f", {bucket}" if bucket else "")
    raw = ["sum(w) AS sw", "count(*) AS cells", f"sum(w*({y})) AS sy"] + [f"sum(w*({e})) AS s_{n}" for n, e in xs.items()] + [f"sum(w*({e})*({y})) AS p_{n}" for n, e in xs.items()]
    raw += [f"sum(w*({xs[a]})*({xs[b]})) AS p_{a}_{b}" for i, a in enumerate(ns) for b in ns[i:]]
    src = f"(SELECT {rel}.*, h.tm FROM (SELECT DISTINCT {by + ', ' if by else ''}mi AS tm FROM {rel}) h JOIN {rel} ON {rel}.mi < h.tm - 1{f' AND {rel}.{by} = h.{by}' if by else ''})"
    mat = [[f"(p_{ns[min(i, j)]}_{ns[max(i, j)]} - s_{ns[i]}*s_{ns[j]}/sw)" for j in range(len(ns))] for i in range(len(ns))]
    inv = inverse(mat)
    bs = ", ".join("(" + " + ".join(f"{inv[i][j]}*(p_{n2} - s_{n2}*sy/sw)" for j, n2 in enumerate(ns)) + f") AS b_{n}" for i, n in enumerate(ns))
    b0 = "(sy - (" + " + ".join(f"b_{n}*s_{n}" for n in ns) + "))/sw AS b0"
    return f"{name} AS MATERIALIZED (SELECT tm AS mi, cells, b0, {', '.join('b_' + n for n in ns)}{key} FROM (SELECT *, {b0} FROM (SELECT *, {bs} FROM (SELECT *, {det(mat)} AS dt FROM (SELECT tm{key}, {', '.join(raw)} FROM {src} GROUP BY tm{key})))))"


XS = lambda t: {"t": t, "inc": "inc", "inc2": "inc*inc", "inc_t": f"inc*{t}"}
G10T = {"log": ("gx", "gy", "exp({0})"), "logit": ("lx", "ly", "1/(1+exp(-({0})))")}


def maps_sql(rel: str, by: str = "", at: str | None = None) -> tuple[list[str], list[str]]:
    """Fits of every specification on ``rel``, and its value on the rows of ``at`` (``rel`` itself by default, matched by month)."""
    on, rows = f"{by + ', ' if by else ''}mi", at or rel
    meet = lambda f: f"JOIN {f} USING ({on})" if at is None else f"CROSS JOIN {f}"
    shown = "mc.*" if at is None else "p.mi, mc.*"
    first = f"SELECT 'identity' AS spec, mc.*, forecast_cpr AS raw FROM {rows} mc" if at is None else f"SELECT 'identity' AS spec, p.mi, mc.*, forecast_cpr AS raw FROM {rows} mc CROSS JOIN f_loglog p"
    fits, values = [], [first]
    for spec, (family, names) in mapping.SMOOTH.items():
        x, y, back = G10T[family]
        fits.append(wls_asof_sql("f_" + spec, y, {k: v for k, v in XS(x).items() if k in names}, "", rel, by))
        total = " + ".join(["p.b0"] + [f"p.b_{k}*({XS('mc.' + x)[k].replace('inc', 'mc.inc')})" for k in names])
        values.append(f"SELECT '{spec}', {shown}, {back.format(total)} FROM {rows} mc {meet('f_' + spec + ' p')}")
    for spec, family in mapping.BUCKETED.items():
        x, y, back = G10T[family]
        fits.append(wls_asof_sql("o_" + spec, y, {"t": x}, "bk", rel, by))
        value = back.format(f"CASE WHEN o.cells >= 20 AND o.b_t IS NOT NULL THEN o.b0 + o.b_t*mc.{x} ELSE p.b0 + p.b_t*mc.{x} END")
        same = f" AND o.{by} = mc.{by}" if by else ""
        values.append(f"SELECT '{spec}', {shown}, {value} FROM {rows} mc {meet('f_' + ('loglog' if family == 'log' else 'logit') + ' p')} LEFT JOIN o_{spec} o ON o.mi = {'mc' if at is None else 'p'}.mi AND o.bk = mc.bk{same}")
    return fits, values


BK = "CASE WHEN inc <= -2.5 THEN 0 WHEN inc <= -1.5 THEN 1 WHEN inc <= -0.5 THEN 2 WHEN inc <= 0.5 THEN 3 WHEN inc <= 1.5 THEN 4 ELSE 5 END AS bk"
G10F, G10R = maps_sql("mc")
MCB = MAPCELL.replace("upb_atrisk/1e6 AS w FROM fr", f"upb_atrisk/1e6 AS w, {BK} FROM fr")


ELEVEN = ["identity", *mapping.SMOOTH, *mapping.BUCKETED]
#: Every specification out of sample on every scored month.
SPECS = f"""{MCB}, {", ".join(G10F)}, sm AS (SELECT h.tm AS mi FROM (SELECT DISTINCT mi AS tm FROM mc) h JOIN mc ON mc.mi < h.tm - 1 GROUP BY 1 HAVING count(DISTINCT mc.mi) >= 24),
al AS MATERIALIZED ({" UNION ALL ".join(G10R)}),
oo AS MATERIALIZED (SELECT *, cpr_upb AS real_cpr, least(greatest(raw, 1e-6), 1-1e-6) AS mapped, ln(cpr_upb) - ln(least(greatest(raw, 1e-6), 1-1e-6)) AS le FROM al WHERE mi IN (SELECT mi FROM sm))"""


@query("E16_weighted_log_score", "f_loan f_forecast", f"""{SPECS} SELECT spec, count(*) AS n, {R("sqrt(sum(upb_atrisk*le*le)/sum(upb_atrisk))", 5)} AS log_rmse, {R("sum(upb_atrisk*abs(le))/sum(upb_atrisk)", 5)} AS log_mae,
 {R("sum(upb_atrisk*abs(mapped-real_cpr))/sum(upb_atrisk)", 5)} AS level_mae, {R("100*avg(CASE WHEN raw >= 1 OR raw <= 0 THEN 1.0 ELSE 0 END)", 5)} AS clamped_pct FROM oo GROUP BY 1""")
def _(fx):
    oos = mapping.search(mapping_cells(fx), min_months=24)
    return rnd(scoring.weighted_scores(oos, "upb_atrisk", ["spec"]), 5)


@query("E17_score_by_bucket_year", "f_loan f_forecast", f"""{SPECS}, lb AS (SELECT *, CASE WHEN inc <= -2.5 THEN '<=-2.5' WHEN inc <= -1.5 THEN '-2.5..-1.5' WHEN inc <= -0.5 THEN '-1.5..-0.5' WHEN inc <= 0.5 THEN '-0.5..0.5' WHEN inc <= 1.5 THEN '0.5..1.5' ELSE '>1.5' END AS inc_bucket FROM oo)
SELECT 'bucket' AS kind, inc_bucket AS slice, {", ".join(f"{R(f'''avg(le) FILTER (spec = '{s}')''', 5)} AS {s}" for s in ELEVEN)} FROM lb GROUP BY 2 UNION ALL SELECT 'year', CAST(yyyymm//100 AS VARCHAR), {", ".join(f"{R(f'''sqrt(avg(le*le) FILTER (spec = '{s}'))''', 5)} AS {s}" for s in ELEVEN)} FROM lb GROUP BY 2""")
def _(fx):
    oos = cut_lineage(mapping.search(mapping_cells(fx), min_months=24))
    by_bucket = oos.groupBy(F.lit("bucket").alias("kind"), F.col("inc_bucket").alias("slice")).pivot("spec", ELEVEN).agg(F.avg("log_err"))
    e2 = F.col("log_err") * F.col("log_err")
    year = F.floor(F.col("yyyymm") / 100).cast("string")
    by_year = oos.groupBy(F.lit("year").alias("kind"), year.alias("slice")).pivot("spec", ELEVEN).agg(F.sqrt(F.avg(e2)))
    return rnd(by_bucket.unionByName(by_year), 5)


@query("E18_variance_shares", "f_loan f_forecast", f"""{SPECS}, v AS (SELECT spec, var_samp(le) AS v, count(*) AS n FROM oo GROUP BY 1),
d AS (SELECT spec, var_samp(m) AS vm, avg(1.0/k) AS ik, count(*) AS g FROM (SELECT spec, yyyymm, avg(le) AS m, count(*) AS k FROM oo GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT spec, var_samp(m) AS vm, avg(1.0/k) AS ik, count(*) AS g FROM (SELECT spec, coupon, avg(le) AS m, count(*) AS k FROM oo GROUP BY 1, 2) GROUP BY 1)
SELECT spec, {R("greatest(d.vm/v.v - d.ik*(1-1.0/d.g), 0)", 5)} AS time_share, {R("greatest(c.vm/v.v - c.ik*(1-1.0/c.g), 0)", 5)} AS coupon_share FROM v JOIN d USING (spec) JOIN c USING (spec)""")
def _(fx):
    oos = cut_lineage(mapping.search(mapping_cells(fx), min_months=24))
    t = scoring.variance_share(oos, "log_err", "yyyymm", ["spec"], "time_share")
    c = scoring.variance_share(oos, "log_err", "coupon", ["spec"], "coupon_share")
    return rnd(t.join(c, "spec"), 5)


#: The safety screen point by point: speeds of every slice of incentive under every specification and cutoff.
SCREEN = f"""sl AS (SELECT floor(inc/0.25) AS s, ln(min(forecast_cpr)) AS lo, ln(max(forecast_cpr)) AS hi FROM mc GROUP BY 1 HAVING count(*) >= 3 AND floor(inc/0.25) < (SELECT ceil(max(inc)/0.25) FROM mc)),
pt AS MATERIALIZED (SELECT *, {BK}, ln(least(greatest(forecast_cpr,1e-6),1-1e-6)) AS gx, ln(least(greatest(forecast_cpr,1e-6),1-1e-6)/(1-least(greatest(forecast_cpr,1e-6),1-1e-6))) AS lx FROM (SELECT s, i, (s+0.5)*0.25 AS inc, exp(lo-0.35+(hi-lo+0.7)*i/39) AS forecast_cpr FROM sl, (SELECT unnest(range(40)) AS i))),
sv AS (SELECT *, lag(raw) OVER (PARTITION BY spec, mi, s ORDER BY i) AS before FROM ({" UNION ALL ".join(maps_sql("mc", at="pt")[1])}) WHERE mi IN (SELECT mi FROM sm)),
sc AS (SELECT spec, mi, bool_and(coalesce(raw > before, true)) AS up, bool_and(raw > 0 AND raw < 1) AS inside, arg_max(inc, CASE WHEN raw <= 0 OR raw >= 1 THEN raw END) AS winc, max(CASE WHEN raw <= 0 OR raw >= 1 THEN raw END) AS wraw FROM sv GROUP BY 1, 2),
sf AS (SELECT spec, bool_and(up) AS monotone, bool_and(inside) AS in_range, count(*) FILTER (NOT up OR NOT inside) AS n_unsafe, arg_max(winc, wraw) AS worst_inc FROM sc GROUP BY 1)"""


def mapping_search(fx):
    """Out-of-sample rows and the safety screen, from one set of coefficients."""
    cells = cut_lineage(mapping_cells(fx))
    coefs = cut_lineage(mapping.coefficients(cells, min_months=24))
    return mapping.search(cells, coefs=coefs), mapping.safety(cells, coefs)


@query("G10_mapping_spec_search", "f_loan f_forecast", f"""{SPECS}, {SCREEN}, sx AS (
SELECT spec, count(*) AS n, {R("sqrt(sum(w*pow(ln(cpr_upb)-ln(mapped),2))/sum(w))", 5)} AS log_rmse, {R("sum(w*abs(ln(cpr_upb)-ln(mapped)))/sum(w)", 5)} AS log_mae, {R("sum(w*abs(mapped-cpr_upb))/sum(w)", 5)} AS level_mae, {R("100*avg(CASE WHEN raw >= 1 OR raw <= 0 THEN 1.0 ELSE 0 END)", 5)} AS clamped_pct FROM oo GROUP BY 1)
SELECT sx.*, monotone, in_range, n_unsafe, worst_inc FROM sx LEFT JOIN sf USING (spec)""")
def _(fx):
    """All eleven specifications out of sample, ranked by weighted log error, with the safety screen at every cutoff."""
    oos, screen = mapping_search(fx)
    scores = scoring.weighted_scores(oos, "upb_atrisk", ["spec"])
    return rnd(scores.join(F.broadcast(screen), "spec", "left").orderBy("log_rmse"), 5)


@query("I4_best_spec", "f_loan f_forecast", f"""{SPECS}, {SCREEN}, sx AS (SELECT spec, {R("sqrt(sum(w*le*le)/sum(w))", 5)} AS log_rmse FROM oo GROUP BY 1)
SELECT spec, log_rmse FROM sx JOIN sf USING (spec) WHERE spec = 'identity' OR (monotone AND in_range) ORDER BY spec = 'identity', log_rmse, spec LIMIT 1""")
def _(fx):
    """The safe specification with the smallest weighted log error out of sample."""
    oos, screen = mapping_search(fx)
    scores = rnd(scoring.weighted_scores(oos, "upb_atrisk", ["spec"]).select("spec", "log_rmse"), 5)
    return mapping.best_safe(scores, screen)


#: Least balances of a cell; fixed values, in the scale of the panel's cells.
LEAST_UPB = [0.0, 1e6, 2.5e6, 5e6]
G10WF, G10WR = maps_sql("mw", "min_upb")


@query("G10b_min_weight_sweep", "f_loan f_forecast", f"""{MCB}, mw AS MATERIALIZED (SELECT min_upb, mc.* FROM mc, (SELECT unnest({LEAST_UPB})::DOUBLE AS min_upb) WHERE upb_atrisk >= min_upb), {", ".join(G10WF)},
sm AS (SELECT h.min_upb, h.tm AS mi FROM (SELECT DISTINCT min_upb, mi AS tm FROM mw) h JOIN mw ON mw.min_upb = h.min_upb AND mw.mi < h.tm - 1 GROUP BY 1, 2 HAVING count(DISTINCT mw.mi) >= 24),
sc AS (SELECT min_upb, spec, sqrt(sum(w*pow(ln(cpr_upb)-ln(least(greatest(raw, 1e-6), 1-1e-6)), 2))/sum(w)) AS e FROM ({" UNION ALL ".join(G10WR)}) JOIN sm USING (min_upb, mi) GROUP BY 1, 2),
b AS (SELECT min_upb, max(e) FILTER (spec = 'identity') AS identity, (array_agg(e ORDER BY round(e, 9), spec) FILTER (spec <> 'identity'))[1] AS best, (array_agg(spec ORDER BY round(e, 9), spec) FILTER (spec <> 'identity'))[1] AS best_spec FROM sc GROUP BY 1)
SELECT min_upb, cells, {R("identity", 5)} AS identity, {R("best", 5)} AS best, best_spec, {R("100*(identity-best)/identity", 3)} AS reduction_pct FROM b JOIN (SELECT min_upb, count(*) AS cells FROM mw GROUP BY 1) USING (min_upb)""")
def _(fx):
    """How far the choice depends on cells of small balance."""
    return rnd(mapping.weight_sweep(mapping_cells(fx), LEAST_UPB, min_months=24), 5, reduction_pct=3)


# rolling fit oracle: direct self-join per window
ROLL = ols_sql("(SELECT a.yyyymm AS win_end, b.dpmms, b.dy2, b.dy5, b.dy10 FROM dn a JOIN dn b ON b.rn BETWEEN a.rn-23 AND a.rn WHERE a.rn >= 24 AND (a.rn - 24) % 3 = 0)", "dpmms", ["dy2", "dy5", "dy10"], "win_end")


@query("G11_rolling_regression", "f_curve_daily f_market_rate", f"{DPM}, dn AS (SELECT *, row_number() OVER (ORDER BY mi) AS rn FROM dm) SELECT win_end, {', '.join(f"{R('b_' + x)} AS b_{x}, {R('t_' + x, 5)} AS t_{x}" for x in ('dy2', 'dy5', 'dy10'))} FROM {ROLL}")
def _(fx):
    """24-month rolling fit at every third month; the condition number of the raw
    regressors rides along in ``plans.rates_study``."""
    from tideline.plans.rates_study import rolling_pass_through

    out = rolling_pass_through(rate_changes(fx), 24, 3)
    names = ("dy2", "dy5", "dy10")
    return rnd(out.select(F.col("yyyymm").alias("win_end"), *[c for x in names for c in (f"b_{x}", f"t_{x}")]), 6, **{f"t_{x}": 5 for x in names})


EIG = """WITH_, s AS (SELECT a.yyyymm, a.rn, sum(b.dy2*b.dy2) AS s11, sum(b.dy5*b.dy5) AS s22, sum(b.dy10*b.dy10) AS s33, sum(b.dy2*b.dy5) AS s12, sum(b.dy2*b.dy10) AS s13, sum(b.dy5*b.dy10) AS s23 FROM dn a JOIN dn b ON b.rn BETWEEN a.rn-23 AND a.rn WHERE a.rn >= 24 AND (a.rn-24) % 3 = 0 GROUP BY 1, 2),
c AS (SELECT *, s11+s22+s33 AS tr, s11*s22+s11*s33+s22*s33-s12*s12-s13*s13-s23*s23 AS m2, s11*(s22*s33-s23*s23)-s12*(s12*s33-s23*s13)+s13*(s12*s23-s22*s13) AS dt FROM s),
nt AS (SELECT *, list_reduce(range(1, 61), lambda x, i: x - (x*x*x - tr*x*x + m2*x - dt)/(3*x*x - 2*tr*x + m2), tr::DOUBLE) AS hi, list_reduce(range(1, 61), lambda x, i: x - (x*x*x - tr*x*x + m2*x - dt)/(3*x*x - 2*tr*x + m2), 0.0::DOUBLE) AS lo FROM c)"""


@query("G11b_condition_number", "f_curve_daily f_market_rate", f"{DPM}, dn AS (SELECT *, row_number() OVER (ORDER BY mi) AS rn FROM dm){EIG.replace('WITH_', '')} SELECT yyyymm, {R('sqrt(hi/lo)', 5)} AS cond FROM nt")
def _(fx):
    from tideline.plans.rates_study import rolling_pass_through

    return rnd(rolling_pass_through(rate_changes(fx), 24, 3).select("yyyymm", "cond"), 5)


X3 = ["dy2", "dy5", "dy10"]


@query("G12_split_sample", "f_curve_daily f_market_rate", f"""{DPM}, dh AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY mi) <= count(*) OVER () // 2 THEN 'first' ELSE 'second' END AS half FROM dm)
SELECT half, n, {", ".join(f"{R(f'b_{x}')} AS b_{x}, {R(f't_{x}', 5)} AS t_{x}" for x in X3)} FROM {ols_sql("dh", "dpmms", X3, "half")}""")
def _(fx):
    from tideline.plans.rates_study import halves

    f = regression.ols(halves(rate_changes(fx), "mi"), "dpmms", X3, ["half"])
    return rnd(f.select("half", "n", *[c for x in X3 for c in (f"b_{x}", f"t_{x}")]), 6, **{f"t_{x}": 5 for x in X3})


LOO = ols_sql("(SELECT a.yyyymm AS dropped, b.dpmms, b.dy2, b.dy5, b.dy10 FROM dm a JOIN dm b ON a.mi <> b.mi)", "dpmms", X3, "dropped")


@query("G13_leave_one_out", "f_curve_daily f_market_rate", f"{DPM} SELECT dropped, {', '.join(f'{R(f_)} AS {f_}' for f_ in ('b_dy2', 'b_dy5', 'b_dy10'))} FROM {LOO}")
def _(fx):
    """Coefficient without each month, by leverage; the summary is G13b."""
    out = regression.leave_one_out(rate_changes(fx), "dpmms", X3, ["yyyymm"])
    return rnd(out.select(F.col("yyyymm").alias("dropped"), "b_dy2", "b_dy5", "b_dy10"))


@query("G13b_leave_one_out_summary", "f_curve_daily f_market_rate", f"""{DPM}, l AS (SELECT dropped, b_dy2 FROM {LOO}), f AS (SELECT b_dy2 AS fb FROM {ols_sql("dm", "dpmms", X3)})
SELECT {R("min(b_dy2)")} AS b_min, {R("max(b_dy2)")} AS b_max, {R("avg(b_dy2)")} AS b_mean, {R("stddev_pop(b_dy2)")} AS b_std, arg_max(dropped, abs(b_dy2 - fb)) AS most_influential, count(*) FILTER (sign(b_dy2) <> sign(fb)) AS sign_flips FROM l, f""")
def _(fx):
    loo = regression.leave_one_out(rate_changes(fx), "dpmms", X3, ["yyyymm"])
    return rnd(loo.agg(
        F.min("b_dy2").alias("b_min"), F.max("b_dy2").alias("b_max"), F.avg("b_dy2").alias("b_mean"), F.stddev_pop("b_dy2").alias("b_std"),
        F.max_by("yyyymm", F.abs(F.col("b_dy2") - F.col("full_dy2"))).alias("most_influential"),
        F.count_if(F.signum("b_dy2") != F.signum("full_dy2")).alias("sign_flips")))


LOOB = ols_sql("(SELECT d.yyyymm AS dropped, ex.coupon, ex.excess_return, fa.f_level AS x, fa.f_slope AS y FROM fa d JOIN fa ON fa.yyyymm <> d.yyyymm JOIN ex ON ex.yyyymm = fa.yyyymm)", "excess_return", ["x", "y"], "dropped, coupon")


@query("G13c_beta_spread_leave_one_out", ALLV, f"""{FEX}, l AS (SELECT dropped, coupon, b_x FROM {LOOB})
SELECT dropped AS yyyymm, arg_max(coupon, b_x) AS hi_coupon, arg_min(coupon, b_x) AS lo_coupon, {R("max(b_x) - min(b_x)")} AS b_x_spread, count(*) AS n_coupons FROM l GROUP BY 1""")
def _(fx):
    return rnd(factors.beta_spread_without_each_month(excess(fx), factor_panel(fx)))


@query("G14_lead_lag_compare", "f_curve_daily f_market_rate", f"""{DPM}, dl AS (SELECT *, lag(dy2) OVER (ORDER BY mi) AS dy2_lag1 FROM dm), dk AS (SELECT * FROM dl WHERE dy2_lag1 IS NOT NULL)
SELECT 'lag0' AS spec, n, {R("b_dy2")} AS b, {R("t_dy2", 5)} AS t FROM {ols_sql("dk", "dpmms", ["dy2"])} UNION ALL SELECT 'lag1', n, {R("b_dy2_lag1")}, {R("t_dy2_lag1", 5)} FROM {ols_sql("dk", "dpmms", ["dy2_lag1"])}""")
def _(fx):
    df = rate_changes(fx).withColumn("dy2_lag1", F.lag("dy2").over(W.orderBy("mi"))).dropna(subset=["dy2_lag1"])
    fit = lambda x, name: regression.ols(df, "dpmms", [x]).select(F.lit(name).alias("spec"), "n", F.col(f"b_{x}").alias("b"), F.col(f"t_{x}").alias("t"))
    return rnd(fit("dy2", "lag0").unionByName(fit("dy2_lag1", "lag1")), 6, t=5)


@query("G15_pass_through", "f_curve_daily f_market_rate", f"""{DPM} SELECT 'joint' AS spec, n, {R("b_dy2")} AS b_dy2, {R("b_dy5")} AS b_dy5, {R("b_dy10")} AS b_dy10, {R("r2")} AS r2 FROM {ols_sql("dm", "dpmms", X3)}
UNION ALL SELECT 'dy2', n, {R("b_dy2")}, NULL, NULL, {R("r2")} FROM {ols_sql("dm", "dpmms", ["dy2"])} UNION ALL SELECT 'dy5', n, NULL, {R("b_dy5")}, NULL, {R("r2")} FROM {ols_sql("dm", "dpmms", ["dy5"])}
UNION ALL SELECT 'dy10', n, NULL, NULL, {R("b_dy10")}, {R("r2")} FROM {ols_sql("dm", "dpmms", ["dy10"])}""")
def _(fx):
    df = rate_changes(fx)
    out = regression.ols(df, "dpmms", X3).select(F.lit("joint").alias("spec"), "n", "b_dy2", "b_dy5", "b_dy10", "r2")
    for x in X3:
        one = regression.ols(df, "dpmms", [x])
        out = out.unionByName(one.select(F.lit(x).alias("spec"), "n", F.col(f"b_{x}"), "r2"), allowMissingColumns=True)
    return rnd(out)


@query("G16_vif_corr", "f_curve_daily f_market_rate", f"""{DPM}, c AS (SELECT {R("corr(dy2,dy5)")} AS c25, {R("corr(dy2,dy10)")} AS c210, {R("corr(dy5,dy10)")} AS c510 FROM dm)
SELECT {R("1/(1-v2.r2)")} AS vif_dy2, {R("1/(1-v5.r2)")} AS vif_dy5, {R("1/(1-v10.r2)")} AS vif_dy10, c.* FROM {ols_sql("dm", "dy2", ["dy5", "dy10"])} v2, {ols_sql("dm", "dy5", ["dy2", "dy10"])} v5, {ols_sql("dm", "dy10", ["dy2", "dy5"])} v10, c""")
def _(fx):
    from tideline.plans.rates_study import vif_and_corr

    return rnd(vif_and_corr(rate_changes(fx), X3, {"c25": ("dy2", "dy5"), "c210": ("dy2", "dy10"), "c510": ("dy5", "dy10")}))


SPREAD = f"""{HPB}, sp AS (SELECT hp.*, m.rate_30yr AS pmms_ret FROM hp LEFT JOIN f_market_rate m ON m.yyyymm = hp.yyyymm),
sd AS (SELECT *, pmms - lag(pmms) OVER w - (d_level + d_slope/2) AS spread_a, pmms_ret - lag(pmms_ret) OVER w - (d_level + d_slope/2) AS spread_b FROM sp WINDOW w AS (PARTITION BY coupon ORDER BY mi)),
sl AS (SELECT coupon, yyyymm, hedged, d_level, d_slope, 'panel' AS timing, spread_a AS d_spread FROM sd WHERE spread_a IS NOT NULL UNION ALL SELECT coupon, yyyymm, hedged, d_level, d_slope, 'return_month', spread_b FROM sd WHERE spread_b IS NOT NULL)"""


@query("G17_spread_control", V, f"""{SPREAD}, a AS (SELECT timing, coupon, t_d_level AS t0 FROM {ols_sql("sl", "hedged", ["d_level", "d_slope"], "timing, coupon")}), b AS (SELECT timing, coupon, n, t_d_level, t_d_slope, t_d_spread FROM {ols_sql("sl", "hedged", ["d_level", "d_slope", "d_spread"], "timing, coupon")}),
v AS (SELECT timing, coupon, r2 FROM {ols_sql("sl", "d_level", ["d_slope", "d_spread"], "timing, coupon")})
SELECT timing, coupon, n, {R("t0", 5)} AS t_level_no, {R("t_d_level", 5)} AS t_level_yes, {R("t_d_slope", 5)} AS t_slope_yes, {R("t_d_spread", 5)} AS t_spread, {R("1/(1-r2)", 4)} AS vif_level FROM a JOIN b USING (timing, coupon) JOIN v USING (timing, coupon) WHERE n >= 10""")
def _(fx):
    from tideline.plans.hedging import spread_control

    return rnd(spread_control(hedge_rows(fx), fx.market_rate), 5, vif_level=4)


@query("G18_hedge_exposure", PRICE_VIEWS, f"""{EXB}, a AS (SELECT coupon, n, t_dy5, t_dy10, r2 FROM {ols_sql("xb", "excess_return", ["dy5", "dy10"], "coupon")}), b AS (SELECT coupon, b_dy_avg, t_dy_avg FROM {ols_sql("xb", "excess_return", ["dy_avg"], "coupon")})
SELECT coupon, n, {R("t_dy5", 5)} AS t_dy5, {R("t_dy10", 5)} AS t_dy10, {R("r2")} AS r2, {R("6.5 - 100*b_dy_avg")} AS implied_duration, {R("t_dy_avg", 5)} AS t_dy_avg FROM a JOIN b USING (coupon) WHERE n >= 8""")
def _(fx):
    from tideline.plans.hedging import hedge_exposure

    return rnd(hedge_exposure(excess_basis(fx)), 6, t_dy5=5, t_dy10=5, t_dy_avg=5)


@query("G19_spearman", PRICE_VIEWS, f"""{"WITH " + RET}, rk AS (SELECT yyyymm, rank() OVER (PARTITION BY yyyymm ORDER BY coupon) + (count(*) OVER (PARTITION BY yyyymm, coupon)-1)/2.0 AS rx, rank() OVER (PARTITION BY yyyymm ORDER BY excess_return) + (count(*) OVER (PARTITION BY yyyymm, excess_return)-1)/2.0 AS ry FROM ex)
SELECT yyyymm, count(*) AS n, {R("corr(rx, ry)")} AS spearman FROM rk GROUP BY 1 HAVING count(*) > 2""")
def _(fx):
    return rnd(ordering.spearman(excess(fx), "coupon", "excess_return", ["yyyymm"]).filter("n > 2"))


@query("G20_empirical_hedge", V, f"""{HPB}, u AS (SELECT *, total_return - income AS unh FROM hp), f AS (SELECT coupon, b0, b_d_level, b_d_slope, r2 FROM {ols_sql("u", "unh", ["d_level", "d_slope"], "coupon")}),
g AS (SELECT u.coupon, u.yyyymm, u.unh, u.dy2, unh - b_d_level*d_level - b_d_slope*d_slope AS ea FROM u JOIN f USING (coupon)),
t0 AS (SELECT coupon, n, t_dy2 AS tn FROM {ols_sql("g", "unh", ["dy2"], "coupon")}), t1 AS (SELECT coupon, t_dy2 AS ta FROM {ols_sql("g", "ea", ["dy2"], "coupon")})
SELECT coupon, n, {R("b_d_level", 8)} AS b_level, {R("b_d_slope", 8)} AS b_slope, {R("r2")} AS r2, {R("tn", 5)} AS t_unhedged, {R("ta", 5)} AS t_hedged FROM f JOIN t0 USING (coupon) JOIN t1 USING (coupon)""")
def _(fx):
    from tideline.plans.hedging import empirical_hedge

    return rnd(empirical_hedge(hedge_rows(fx)), 8, r2=6, t_unhedged=5, t_hedged=5)


EXPD = ols_sql("(SELECT a.coupon, a.yyyymm AS at_, b.total_return - b.income AS unh, b.d_level, b.d_slope FROM hp a JOIN hp b ON a.coupon = b.coupon AND b.mi < a.mi)", "unh", ["d_level", "d_slope"], "coupon, at_")


@query("G21_expanding_durations", V, f"""{HPB}, f AS (SELECT * FROM {EXPD} WHERE n >= 36), h AS (SELECT hp.coupon, hp.yyyymm, dy1, dy2, dy30, -100*b_d_level AS dl, total_return - income - b_d_level*d_level - b_d_slope*d_slope AS hew FROM hp JOIN f ON f.coupon = hp.coupon AND f.at_ = hp.yyyymm),
t1 AS (SELECT coupon, t_dy1 FROM {ols_sql("h", "hew", ["dy1"], "coupon")}), t2 AS (SELECT coupon, n, t_dy2 FROM {ols_sql("h", "hew", ["dy2"], "coupon")}), t3 AS (SELECT coupon, t_dy30 FROM {ols_sql("h", "hew", ["dy30"], "coupon")}), m AS (SELECT coupon, avg(dl) AS dl FROM h GROUP BY 1)
SELECT coupon, n, {R("dl", 4)} AS d_fit, {R("t_dy1", 4)} AS t_dy1, {R("t_dy2", 4)} AS t_dy2, {R("t_dy30", 4)} AS t_dy30 FROM m JOIN t1 USING (coupon) JOIN t2 USING (coupon) JOIN t3 USING (coupon)""")
def _(fx):
    from tideline.plans.hedging import expanding_hedge, control_t

    h = expanding_hedge(hedge_rows(fx), ["d_level", "d_slope"], 36)
    out = h.groupBy("coupon").agg(F.avg("fit_d_level").alias("d_fit"))
    for c in ("dy1", "dy2", "dy30"):
        out = out.join(control_t(h, "hedged_fit", c, with_n=(c == "dy2")), "coupon")
    return rnd(out, 4)


@query("G22_beta_spread_sharpe", ALLV, f"""{FEX}, al AS (SELECT *, lag(f_level) OVER (ORDER BY mi) AS ll, lag(f_slope) OVER (ORDER BY mi) AS ls FROM fa), ar AS (SELECT regr_slope(f_level, ll) AS rl, regr_intercept(f_level, ll) AS al_, regr_slope(f_slope, ls) AS rs, regr_intercept(f_slope, ls) AS as_ FROM al),
re AS (SELECT yyyymm, f_level - (al_ + rl*ll) AS a, f_slope - (as_ + rs*ls) AS b FROM al, ar WHERE ll IS NOT NULL), z AS (SELECT yyyymm, (a - avg(a) OVER ())/stddev_samp(a) OVER () AS x, (b - avg(b) OVER ())/stddev_samp(b) OVER () AS y FROM re),
be AS (SELECT coupon, b_x, b_y FROM {ols_sql("(SELECT ex.coupon, excess_return, z.x, z.y FROM ex JOIN z USING (yyyymm))", "excess_return", ["x", "y"], "coupon")} WHERE n >= 6), rh AS (SELECT abs(corr(b_x, b_y)) > 0.9 AS single FROM be),
eg AS (SELECT ex.yyyymm, corr(b_x, b_y) AS rm, sum(b_x*b_x) AS xx, sum(b_y*b_y) AS yy, sum(b_x*b_y) AS xy, sum(b_x*excess_return) AS xr, sum(b_y*excess_return) AS yr FROM ex JOIN be USING (coupon) WHERE ex.yyyymm IN (SELECT yyyymm FROM z) GROUP BY 1 HAVING count(*) >= 4),
el AS (SELECT yyyymm, CASE WHEN single THEN xr/xx ELSE (xr*yy-yr*xy)/(xx*yy-xy*xy) END AS lx FROM eg, rh WHERE single OR abs(rm) <= 0.9),
en AS (SELECT arg_max(coupon, b_x) AS hi, max(b_x) AS bh, arg_min(coupon, b_x) AS lo, min(b_x) AS bl FROM be), pt AS (SELECT h.yyyymm, h.excess_return - l.excess_return AS r FROM ex h JOIN ex l ON h.yyyymm = l.yyyymm, en WHERE h.coupon = hi AND l.coupon = lo AND h.yyyymm IN (SELECT yyyymm FROM el)),
lm AS (SELECT avg(lx) AS lx FROM el), pp AS (SELECT count(*) AS n, avg(r) AS m, stddev_samp(r) AS s FROM pt)
SELECT hi AS hi_coupon, lo AS lo_coupon, {R("bh-bl")} AS b_x_spread, {R("lx")} AS lambda_x, {R("lx*(bh-bl)*12*10000", 3)} AS bps_per_year, n AS n_months, {R("m")} AS mean, {R("s")} AS std, {R("m/s*sqrt(12)")} AS sharpe FROM en, lm, pp""")
def _(fx):
    fac = factors.innovations(factor_panel(fx))
    ex = excess(fx)
    b = factors.empirical_betas(ex, fac, level="f_level_z", slope="f_slope_z")
    ret = ex.join(fac.select("yyyymm"), "yyyymm", "left_semi")
    lam = factors.fama_macbeth_empirical(ret, b)
    return rnd(factors.beta_spread_sharpe(ex, b, lam), 6, bps_per_year=3)


@query("G23_pair_vol", V, f"""{HPB}, cs AS (SELECT coupon, lag(coupon) OVER (ORDER BY coupon) AS below, min(coupon) OVER () AS lowest, max(coupon) OVER () AS highest FROM (SELECT DISTINCT coupon FROM hp)),
pq AS (SELECT coupon AS hi, below AS lo FROM cs WHERE below IS NOT NULL UNION SELECT coupon, lowest FROM cs WHERE coupon = highest AND lowest < highest),
p AS (SELECT pq.hi, pq.lo, a.hedged - b.hedged AS d FROM pq JOIN hp a ON a.coupon = pq.hi JOIN hp b ON b.coupon = pq.lo AND b.yyyymm = a.yyyymm)
SELECT hi, lo, count(*) AS n, {R("avg(d)", 8)} AS mean, {R("stddev_samp(d)*sqrt(12)")} AS ann_vol, {R("avg(d)/stddev_samp(d)*sqrt(12)")} AS sharpe FROM p GROUP BY 1, 2""")
def _(fx):
    from tideline.plans.hedging import pair_vol

    return rnd(pair_vol(hedge_rows(fx)), 6, mean=8)


@query("G23b_coupon_vol", V, f"""{HPB} SELECT coupon, count(hedged) AS n, {R("avg(hedged)", 8)} AS mean, {R("stddev_samp(hedged)*sqrt(12)")} AS ann_vol FROM hp GROUP BY 1""")
def _(fx):
    from tideline.plans.hedging import coupon_vol

    return rnd(coupon_vol(hedge_rows(fx)), 6, mean=8)


@query("G24_duration_capture", V, f"""{HPB}, u AS (SELECT *, total_return - income AS unh FROM hp), r AS (SELECT coupon, -100*b_d_level AS resid_d FROM {ols_sql("u", "hedged", ["d_level", "d_slope"], "coupon")}), e AS (SELECT coupon, -100*b_d_level AS emp_d FROM {ols_sql("u", "unh", ["d_level", "d_slope"], "coupon")}),
m AS (SELECT coupon, avg(dur_level) AS mod_d FROM hp GROUP BY 1), j AS (SELECT *, emp_d - (resid_d + mod_d) AS gap FROM r JOIN e USING (coupon) JOIN m USING (coupon))
SELECT {R("max(mod_d)-min(mod_d)")} AS model_spread, {R("max(emp_d)-min(emp_d)", 4)} AS implied_spread, {R("100*(max(mod_d)-min(mod_d))/(max(emp_d)-min(emp_d))", 4)} AS capture_pct, {R("max(abs(gap))", 4)} AS worst_gap, arg_max(coupon, abs(gap)) AS worst_coupon FROM j""")
def _(fx):
    from tideline.plans.hedging import duration_capture

    return rnd(duration_capture(hedge_rows(fx)), 4, model_spread=6)


@query("G25_local_linear_peak", "f_loan f_forecast", f"""{FVR}, g AS (SELECT unnest(range(0, 105)) AS i), c AS (SELECT round(-3.6 + i*0.05, 2) AS cx FROM g), s AS (SELECT cx, count(*) AS n, regr_slope(cpr_upb, inc) AS slope FROM c JOIN fr ON inc >= cx - 0.4 AND inc <= cx + 0.4 GROUP BY 1 HAVING count(*) >= 25)
SELECT {R("max(slope)")} AS best_slope, ((array_agg(cx ORDER BY round(slope, 10) DESC, cx))[1])::DOUBLE AS peak_at FROM s""")
def _(fx):
    from tideline.plans.rates_study import local_linear_peak

    return rnd(local_linear_peak(forecast_realized(fx), "inc", "cpr_upb", -3.6, 1.6, 0.05, 0.4, 25))


@query("G26_range_test", "f_loan f_forecast", f"""{FVR}, q AS (SELECT quantile_cont(inc, 0.1) AS p10, quantile_cont(inc, 0.9) AS p90 FROM fr)
SELECT {R("any_value(p10)")} AS p10, {R("any_value(p90)")} AS p90, {R("avg(cpr_upb) FILTER (inc BETWEEN p10-0.25 AND p10+0.25)")} AS real_p10, {R("avg(cpr_upb) FILTER (inc BETWEEN p90-0.25 AND p90+0.25)")} AS real_p90,
 {R("(avg(forecast_cpr) FILTER (inc BETWEEN p90-0.25 AND p90+0.25) - avg(forecast_cpr) FILTER (inc BETWEEN p10-0.25 AND p10+0.25))/(avg(cpr_upb) FILTER (inc BETWEEN p90-0.25 AND p90+0.25) - avg(cpr_upb) FILTER (inc BETWEEN p10-0.25 AND p10+0.25))", 5)} AS range_ratio FROM fr, q""")
def _(fx):
    from tideline.plans.rates_study import range_test

    return rnd(range_test(forecast_realized(fx), "inc", "cpr_upb", "forecast_cpr"), 6, range_ratio=5)


def pois_sql(u: str) -> str:
    """Poisson(1) count of a uniform by inverse CDF, as CASE."""
    import math

    out, total, p = [], 0.0, math.exp(-1.0)
    for k in range(12):
        total += p
        out.append(f"WHEN {u} < {total!r} THEN {k}")
        p /= k + 1
    return "CASE " + " ".join(out) + " ELSE 12 END"


BOOT_U = "('0x' || substr(md5(CAST(coupon AS VARCHAR) || '-' || CAST(yyyymm AS VARCHAR) || '|' || CAST(rep AS VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0"


@query("G27_bootstrap_mean", "f_loan f_forecast", f"""{FVR}, b AS (SELECT fr.*, rep, {BOOT_U} AS u FROM fr, (SELECT unnest(range(1, 201)) AS rep) WHERE inc <= -1.0), k AS (SELECT *, {pois_sql("u")} AS w FROM b),
r AS (SELECT rep, sum(w*cpr_upb)/sum(w) AS m, sum(w*upb_atrisk*cpr_upb)/sum(w*upb_atrisk) AS mw FROM k GROUP BY 1), o AS (SELECT count(*) AS n, avg(cpr_upb) AS m, sum(upb_atrisk*cpr_upb)/sum(upb_atrisk) AS mw FROM fr WHERE inc <= -1.0)
SELECT any_value(o.n) AS n, {R("any_value(o.m)")} AS mean, {R("stddev_pop(r.m)")} AS se, {R("any_value(o.mw)")} AS weighted_mean, {R("stddev_pop(r.mw)")} AS weighted_se FROM r, o""")
def _(fx):
    from tideline.plans.rates_study import bootstrap_mean

    df = forecast_realized(fx).filter("inc <= -1.0").withColumn("cell", F.concat_ws("-", F.col("coupon").cast("string"), "yyyymm"))
    return rnd(bootstrap_mean(df, "cpr_upb", "upb_atrisk", "cell", 200))


@query("G28_scurve_fit", "f_loan f_forecast", f"""{FVR}, {BAND}, bh AS (SELECT a.mi, b.cx, b.cy FROM (SELECT DISTINCT mi FROM bd) a JOIN bd b ON b.mi < a.mi), {scurve_sql("bh", "mi")}""")
def _(fx):
    out = scurve.fit_asof(in_band(forecast_realized(fx)), "inc", "cpr_upb")
    return rnd(out, 4)


@query("G28b_scurve_pinned_fixed", "f_loan f_forecast", f"""{FVR}, {BAND}, bh AS (SELECT a.mi, b.cx, b.cy FROM (SELECT DISTINCT mi FROM bd) a JOIN bd b ON b.mi < a.mi), {scurve_sql("bh", "mi", "0.0459")}""")
def _(fx):
    return rnd(scurve.fit_asof(in_band(forecast_realized(fx)), "inc", "cpr_upb", mode="pinned-fixed"), 4)


def seasoned_cells(fx):
    """Speeds of loans seasoned 60 months or more, sums first, with incentives."""
    cells = by_age(fx).filter(F.col("age_group") >= 60)
    up = survival.rollup_speeds(cells, ["coupon_bucket", "yyyymm"]).withColumn("coupon", rates.implied_coupon("coupon_bucket"))
    m = fx.market_rate
    up = up.filter(F.col("coupon").between(2.5, 6.5))
    return up.join(F.broadcast(m.select("yyyymm", "mi", "rate_30yr")), "yyyymm").withColumn("inc", F.col("coupon") + 0.5 - F.col("rate_30yr"))


SEAS = f"""sw AS (SELECT cb, yyyymm, sum(CASE WHEN is_pay THEN wt ELSE 0 END)/sum(wt) AS smm FROM (SELECT *, CASE WHEN ({AGE}) < 0 THEN -1 WHEN ({AGE}) < 60 THEN 0 WHEN ({AGE}) < 120 THEN 60 ELSE 120 END AS ag FROM w) WHERE ag >= 60 AND (is_act OR is_pay) AND wt IS NOT NULL AND wt >= 0 GROUP BY 1, 2 HAVING sum(wt) > 0),
sd AS (SELECT m.mi, 1-pow(1-smm, 12) AS c FROM sw JOIN f_market_rate m USING (yyyymm) WHERE round(cb-0.5, 2) BETWEEN 2.5 AND 6.5 AND round(cb-0.5, 2)+0.5-m.rate_30yr <= -0.5),
fp AS (SELECT a.mi, avg(sd.c) AS fl, count(*) AS n_deep FROM (SELECT DISTINCT mi FROM bd) a JOIN sd ON sd.mi < a.mi GROUP BY 1 HAVING count(*) >= 3),
bh AS (SELECT a.mi, a.fl, a.n_deep, b.cx, b.cy FROM fp a JOIN bd b ON b.mi < a.mi)"""


@query("G28c_scurve_pinned_seasoned", "f_loan f_forecast f_market_rate", f"""{FVR}, {BAND}, {SEAS}, {scurve_sql("bh", "mi, fl, n_deep", "fl").replace("SELECT mi, fl, n_deep, n, k", "SELECT mi, n_deep, n, k")}""")
def _(fx):
    """Floor pinned at the seasoned speed in deep discounts before each month."""
    out = scurve.fit_asof(in_band(forecast_realized(fx)), "inc", "cpr_upb", mode="pinned-seasoned", seasoned=seasoned_cells(fx), deep=-0.5, min_deep=3)
    return rnd(out, 4)


@query("G29_scope_compare", "f_loan f_forecast", f"""{FVR}, {BAND}, ss AS (SELECT 'all' AS scope, cx, cy FROM bd UNION ALL SELECT 'coupon_le_4' , cx, cy FROM bd WHERE coupon <= 4 UNION ALL SELECT 'from_1998', cx, cy FROM bd WHERE mi >= 1998*12+1), {scurve_sql("ss", "scope")}""")
def _(fx):
    df = in_band(forecast_realized(fx))
    tests = {"all": F.lit(True), "coupon_le_4": F.col("coupon") <= 4, "from_1998": F.col("mi") >= 1998 * 12 + 1}
    tag = F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])))
    return rnd(scurve.fit_by_scope(df.withColumn("scope", tag), "inc", "cpr_upb", ["scope"]), 4)


PAST = "bh AS MATERIALIZED (SELECT a.mi, b.cx, b.cy FROM (SELECT DISTINCT mi FROM bd) a JOIN bd b ON b.mi < a.mi)"


@query("G28d_scurve_refined", "f_loan f_forecast", f"{FVR}, {BAND}, {PAST}, {zoom_sql('bh', 'mi')}")
def _(fx):
    """As G28, refined until the step is below 1e-3."""
    return rnd(scurve.fit_asof(in_band(forecast_realized(fx)), "inc", "cpr_upb", zoom=scurve.ZOOMS), 4)


@query("G28e_scurve_pinned_fixed_refined", "f_loan f_forecast", f"{FVR}, {BAND}, {PAST}, {zoom_sql('bh', 'mi', '0.0459')}")
def _(fx):
    return rnd(scurve.fit_asof(in_band(forecast_realized(fx)), "inc", "cpr_upb", mode="pinned-fixed", zoom=scurve.ZOOMS), 4)


@query("G28f_scurve_pinned_seasoned_refined", "f_loan f_forecast f_market_rate", f"{FVR}, {BAND}, {SEAS}, {zoom_sql('bh', 'mi, fl, n_deep', 'fl', 'mi, n_deep')}")
def _(fx):
    out = scurve.fit_asof(
        in_band(forecast_realized(fx)), "inc", "cpr_upb", mode="pinned-seasoned", seasoned=seasoned_cells(fx), deep=-0.5, min_deep=3, zoom=scurve.ZOOMS)
    return rnd(out, 4)


SEASONED_FIT = f"""sw AS (SELECT cb, yyyymm, sum(CASE WHEN is_pay THEN wt ELSE 0 END)/sum(wt) AS smm FROM (SELECT *, CASE WHEN ({AGE}) < 0 THEN -1 WHEN ({AGE}) < 60 THEN 0 WHEN ({AGE}) < 120 THEN 60 ELSE 120 END AS ag FROM w) WHERE ag >= 60 AND (is_act OR is_pay) AND wt IS NOT NULL AND wt >= 0 GROUP BY 1, 2 HAVING sum(wt) > 0),
sd AS (SELECT m.mi, round(cb-0.5, 2)+0.5-m.rate_30yr AS cx, 1-pow(1-smm, 12) AS cy FROM sw JOIN f_market_rate m USING (yyyymm) WHERE round(cb-0.5, 2) BETWEEN 2.5 AND 6.5 AND round(cb-0.5, 2)+0.5-m.rate_30yr BETWEEN -4.0 AND 2.0),
am AS (SELECT a.mi FROM (SELECT DISTINCT mi FROM bd) a JOIN bd b ON b.mi < a.mi GROUP BY 1 HAVING count(*) >= 40),
bh AS MATERIALIZED (SELECT am.mi, sd.cx, sd.cy FROM am JOIN sd ON sd.mi < am.mi)"""


@query("G28g_scurve_seasoned_fit", "f_loan f_forecast f_market_rate", f"{FVR}, {BAND}, {SEASONED_FIT}, {zoom_sql('bh', 'mi')}")
def _(fx):
    """All four parameters on seasoned speeds before each month."""
    out = scurve.fit_asof(
        in_band(forecast_realized(fx)), "inc", "cpr_upb", mode="seasoned-fit", seasoned=in_band(seasoned_cells(fx)), zoom=scurve.ZOOMS)
    return rnd(out, 4)


@query("G29b_scope_compare_refined", "f_loan f_forecast", f"""{FVR}, {BAND}, ss AS (SELECT 'all' AS scope, cx, cy FROM bd UNION ALL SELECT 'coupon_le_4' , cx, cy FROM bd WHERE coupon <= 4 UNION ALL SELECT 'from_1998', cx, cy FROM bd WHERE mi >= 1998*12+1), {zoom_sql("ss", "scope")}""")
def _(fx):
    df = in_band(forecast_realized(fx))
    tests = {"all": F.lit(True), "coupon_le_4": F.col("coupon") <= 4, "from_1998": F.col("mi") >= 1998 * 12 + 1}
    tag = F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])))
    return rnd(scurve.fit_by_scope(df.withColumn("scope", tag), "inc", "cpr_upb", ["scope"], zoom=scurve.ZOOMS), 4)


@query("G28h_scurve_descent", "f_loan f_forecast", f"{FVR}, {BAND}, {PAST}, {descent_sql('bh', 'mi')}")
def _(fx):
    """As G28, by Gauss-Newton from the grid's best point; no cutoff meets its past rows. The terminal curve of the prices."""
    return rnd(scurve.fit_asof(in_band(forecast_realized(fx)), "inc", "cpr_upb", steps=scurve.STEPS), 4)


@query("G28i_scurve_pinned_fixed_descent", "f_loan f_forecast", f"{FVR}, {BAND}, {PAST}, {descent_sql('bh', 'mi', '0.0459')}")
def _(fx):
    return rnd(scurve.fit_asof(in_band(forecast_realized(fx)), "inc", "cpr_upb", mode="pinned-fixed", steps=scurve.STEPS), 4)


@query("G28j_scurve_pinned_seasoned_descent", "f_loan f_forecast f_market_rate", f"{FVR}, {BAND}, {SEAS}, {descent_sql('bh', 'mi, fl, n_deep', 'fl', 'mi, n_deep')}")
def _(fx):
    out = scurve.fit_asof(
        in_band(forecast_realized(fx)), "inc", "cpr_upb", mode="pinned-seasoned", seasoned=seasoned_cells(fx), deep=-0.5, min_deep=3, steps=scurve.STEPS)
    return rnd(out, 4)


@query("G28k_scurve_seasoned_fit_descent", "f_loan f_forecast f_market_rate", f"{FVR}, {BAND}, {SEASONED_FIT}, {descent_sql('bh', 'mi')}")
def _(fx):
    out = scurve.fit_asof(
        in_band(forecast_realized(fx)), "inc", "cpr_upb", mode="seasoned-fit", seasoned=in_band(seasoned_cells(fx)), steps=scurve.STEPS)
    return rnd(out, 4)


PL_A, PL_B = [0.2, 0.6, 1.0, 1.4], [-6.0, -5.0, -4.0, -3.0, -2.0]
PZ = "list_transform(range(1, 34), lambda t: 0.9*inc + 0.02*t)"


def platt_sql() -> str:
    err = "pow(1-pow(1-list_avg(list_transform(pz, lambda z: 1/(1+exp(-(a*z+b))))),12) - cpr_upb, 2)"
    return f"""tc AS MATERIALIZED (SELECT cpr_upb, {PZ} AS pz FROM fr WHERE yyyymm BETWEEN 199801 AND 199912),
g0 AS (SELECT a, b, sum({err}) AS sse, count(*) AS nc FROM tc, (SELECT unnest({PL_A})::DOUBLE AS a), (SELECT unnest({PL_B})::DOUBLE AS b) GROUP BY 1, 2), m0 AS (SELECT a AS a0, b AS b0 FROM g0 ORDER BY round(sse, 12), a, b LIMIT 1),
g1 AS (SELECT a0 + 0.4*d/5 AS a, b0 + 1.0*e/5 AS b FROM m0, (SELECT unnest(range(-5, 6)) AS d), (SELECT unnest(range(-5, 6)) AS e)), s1 AS (SELECT a, b, sum({err}) AS sse, count(*) AS nc FROM tc, g1 GROUP BY 1, 2)
SELECT {R("a", 4)} AS a, {R("b", 4)} AS b, {R("sse", 6)} AS sse, nc AS n_cells FROM s1 ORDER BY round(s1.sse, 12), s1.a, s1.b LIMIT 1"""


@query("G30_platt_recalibrate", "f_loan f_forecast", f"{FVR}, {platt_sql()}")
def _(fx):
    """Recalibration on the trough window by two grid passes."""
    z = F.transform(F.sequence(F.lit(1), F.lit(33)), lambda t: 0.9 * F.col("inc") + 0.02 * t)
    cells = forecast_realized(fx).filter("yyyymm BETWEEN 199801 AND 199912").withColumn("z", z)
    return rnd(scurve.platt_recalibrate(cells, "z", "cpr_upb", PL_A, PL_B), 4, sse=6)


def platt_descent_sql(passes: int = 30) -> str:
    """(a, b) of the trough cells by Gauss-Newton with halved steps, pass by pass; CTE ``pf``."""
    p = "(1/(1+exp(-(a*z+b))))"
    mean = lambda e: f"list_avg(list_transform(pz, lambda z: {e}))"
    ctes = [f"tc AS MATERIALIZED (SELECT cpr_upb, {PZ} AS pz FROM fr WHERE yyyymm BETWEEN 199801 AND 199912)", "pn0 AS (SELECT 1.0::DOUBLE AS a, -3.0::DOUBLE AS b, NULL::DOUBLE AS ca, NULL::DOUBLE AS cb, NULL::DOUBLE AS e)"]
    for i in range(1, passes + 1):
        ctes.append(f"""pm{i} AS (SELECT a, b, ca, cb, e, cpr_upb, {mean(p)} AS m, {mean(f'{p}*(1-{p})*z')} AS u, {mean(f'{p}*(1-{p})')} AS v FROM tc, pn{i - 1}),
pk{i} AS (SELECT *, 1-pow(1-m,12)-cpr_upb AS r, 12*pow(1-m,11)*u AS fa, 12*pow(1-m,11)*v AS fb FROM pm{i}),
ps{i} AS (SELECT a, b, ca, cb, e, count(*) AS n, sum(r*r) AS sse, sum(fa*fa) AS aa, sum(fa*fb) AS ab, sum(fb*fb) AS bb, sum(fa*r) AS ae, sum(fb*r) AS be FROM pk{i} GROUP BY ALL),
pn{i} AS MATERIALIZED (SELECT CASE WHEN ok THEN a + (ab*be-bb*ae)/(aa*bb-ab*ab) ELSE (ca+a)/2 END AS a, CASE WHEN ok THEN b + (ab*ae-aa*be)/(aa*bb-ab*ab) ELSE (cb+b)/2 END AS b, CASE WHEN ok THEN a ELSE ca END AS ca, CASE WHEN ok THEN b ELSE cb END AS cb, CASE WHEN ok THEN sse ELSE e END AS e, n FROM (SELECT *, e IS NULL OR sse < e AS ok FROM ps{i}))""")
    return ", ".join(ctes) + f", pf AS (SELECT ca AS a, cb AS b, e, n FROM pn{passes})"


def platt_cells(fx):
    z = F.transform(F.sequence(F.lit(1), F.lit(33)), lambda t: 0.9 * F.col("inc") + 0.02 * t)
    return forecast_realized(fx).withColumn("z", z)


@query("G30b_platt_descent", "f_loan f_forecast", f"{FVR}, {platt_descent_sql()} SELECT {R('a', 4)} AS a, {R('b', 4)} AS b, {R('e', 6)} AS sse, n AS n_cells FROM pf")
def _(fx):
    """Recalibration on the trough window to the optimum."""
    a, b, sse, n = scurve.platt_descent(platt_cells(fx).filter("yyyymm BETWEEN 199801 AND 199912"), "z", "cpr_upb")
    return rnd(fx.spark.createDataFrame([(a, b, sse, n)], "a double, b double, sse double, n_cells long"), 4, sse=6)


@query("G30c_platt_validation", "f_loan f_forecast", f"""{FVR}, {platt_descent_sql()}, pv AS (SELECT CASE WHEN yyyymm BETWEEN 199801 AND 199912 THEN 'trough' ELSE 'boom' END AS span, coupon, cpr_upb, 1-pow(1-list_avg(list_transform({PZ}, lambda z: 1/(1+exp(-(a*z+b))))), 12) AS f FROM fr, pf WHERE yyyymm BETWEEN 199801 AND 200112)
SELECT span, coupon, count(*) AS n, {R('avg(f)', 4)} AS forecast, {R('avg(cpr_upb)', 4)} AS realized, {R('avg(f)/nullif(avg(cpr_upb), 0)', 4)} AS ratio FROM pv GROUP BY 1, 2""")
def _(fx):
    """The trough fit held against its own window and against the boom that it has not seen, by coupon."""
    span = F.when(F.col("yyyymm").between(199801, 199912), "trough").otherwise("boom")
    cells = cut_lineage(platt_cells(fx).filter("yyyymm BETWEEN 199801 AND 200112").withColumn("span", span).select("span", "coupon", "z", "cpr_upb"))
    a, b, _, _ = scurve.platt_descent(cells.filter("span = 'trough'"), "z", "cpr_upb")
    return rnd(scurve.platt_report(cells, "z", "cpr_upb", a, b, ["span", "coupon"]), 4)


LIQ = "coupon IN (3.0, 3.5, 4.0, 4.5, 5.0)"


@query("G31_liquid_robustness", ALLV, f"""{FME.replace("FROM ex JOIN fa ON ex.yyyymm = fa.yyyymm)", f"FROM ex JOIN fa ON ex.yyyymm = fa.yyyymm WHERE ex.{LIQ})")} SELECT count(lx) AS n, {R("avg(lx)")} AS mean, {R("stddev_samp(lx)")} AS std, {R("avg(lx)/(stddev_samp(lx)/sqrt(count(lx)))", 5)} AS t, {R(t_sql("avg(lx)/(stddev_samp(lx)/sqrt(count(lx)))", "count(lx) - 1"), 6)} AS p FROM el""")
def _(fx):
    fac = factor_panel(fx)
    ex = excess(fx).filter(LIQ)
    lam = factors.fama_macbeth_empirical(ex.join(fac.select("yyyymm"), "yyyymm", "left_semi"), factors.empirical_betas(ex, fac))
    return rnd(regression.one_sample_t(lam, "lambda_x"), 6, t=5)


@query("G32_collinearity_by_month", ALLV, f"""{FM}, c AS (SELECT yyyymm, max(rate_30yr) AS r, CASE WHEN stddev_samp(bx) > 1e-12 AND stddev_samp(by_) > 1e-12 THEN corr(bx, by_) END AS rho, count(*) AS n FROM ab GROUP BY 1 HAVING count(*) >= 4)
SELECT CASE WHEN r > 3.5 THEN 'DM' ELSE 'PM' END AS market_type, count(*) AS n_months, {R("avg(rho)")} AS mean_rho, {R("max(rho)")} AS max_rho, {R("avg(CASE WHEN abs(rho) > 0.9 THEN 1.0 WHEN rho IS NOT NULL THEN 0.0 END)")} AS share_above FROM c GROUP BY 1""")
def _(fx):
    bx, by = rates.beta_level("coupon", phi(), "rate_30yr"), rates.beta_slope("coupon", phi(), "rate_30yr")
    df = excess(fx).withColumn("bx", bx).withColumn("by", by)
    ok = (F.stddev_samp("bx") > 1e-12) & (F.stddev_samp("by") > 1e-12)
    m = df.groupBy("yyyymm").agg(F.max("rate_30yr").alias("r"), F.when(ok, rates.safe_corr("bx", "by")).alias("rho"), F.count(F.lit(1)).alias("n")).filter("n >= 4")
    rho = F.col("rho")
    return rnd(m.groupBy(rates.market_type("r").alias("market_type")).agg(
        F.count(F.lit(1)).alias("n_months"), F.avg(rho).alias("mean_rho"), F.max(rho).alias("max_rho"),
        F.avg(F.when(F.abs(rho) > 0.9, 1.0).when(rho.isNotNull(), 0.0)).alias("share_above")))


@query("G33_return_scale", PRICE_VIEWS, f"WITH {RET} SELECT coupon, count(*) AS n, {R('avg(excess_return)*10000', 4)} AS mean_bp, {R('stddev_samp(excess_return)*10000', 4)} AS std_bp, {R('min(excess_return)*10000', 4)} AS min_bp, {R('max(excess_return)*10000', 4)} AS max_bp FROM ex GROUP BY 1")
def _(fx):
    bp = F.col("excess_return") * 10000
    return rnd(excess(fx).groupBy("coupon").agg(
        F.count(F.lit(1)).alias("n"), F.avg(bp).alias("mean_bp"), F.stddev_samp(bp).alias("std_bp"), F.min(bp).alias("min_bp"), F.max(bp).alias("max_bp")), 4)


SWEEP = """{0}, hs AS (SELECT scale, coupon, dy2, total_return - income + scale*(dur_level*d_level + dur_slope*d_slope + dur_curve*d_curve)/100 AS h FROM hp, (SELECT unnest([0.8, 1.0, 1.2, 1.4, 1.6])::DOUBLE AS scale))"""


@query("G34_duration_scale_sweep", V, f"""{SWEEP.format(HPB)}, t AS (SELECT scale, coupon, t_dy2 AS t FROM {ols_sql("hs", "h", ["dy2"], "scale, coupon")}),
a AS (SELECT 'all' AS left_out, scale, sum(t*t) AS s FROM t GROUP BY 2 UNION ALL SELECT CAST(o.coupon AS VARCHAR), t.scale, sum(t.t*t.t) FROM t JOIN (SELECT DISTINCT coupon FROM t) o ON o.coupon <> t.coupon GROUP BY 1, 2)
SELECT left_out, (array_agg(scale ORDER BY round(s, 9), scale))[1] AS best_scale, {R("min(s)", 4)} AS sum_t2 FROM a GROUP BY 1""")
def _(fx):
    from tideline.plans.hedging import duration_scale_sweep

    return rnd(duration_scale_sweep(hedge_rows(fx), "dy2", [0.8, 1.0, 1.2, 1.4, 1.6]), 4)


def exp_h(xs, name):
    pairs = ", ".join(f"b.{x}" for x in xs)
    fit = ols_sql(f"(SELECT a.coupon, a.yyyymm AS at_, b.total_return - b.income AS unh, {pairs} FROM hp a JOIN hp b ON a.coupon = b.coupon AND b.mi < a.mi)", "unh", xs, "coupon, at_")
    hat = " + ".join(f"b_{x}*{x}" for x in xs)
    return f"{name} AS (SELECT hp.coupon, hp.yyyymm, total_return - income - ({hat}) AS h, dy2 FROM hp JOIN (SELECT * FROM {fit} WHERE n >= 36) f ON f.coupon = hp.coupon AND f.at_ = hp.yyyymm)"


@query("G35_exposure_by_year", V, f"""{HPB}, {exp_h(["d_level", "d_slope"], "h2")}, {exp_h(["d_level", "d_slope", "d_curve"], "h3")}, j AS (SELECT h2.coupon, h2.yyyymm//100 AS year, h2.h AS a, h3.h AS b, h2.dy2 FROM h2 JOIN h3 USING (coupon, yyyymm)),
ta AS (SELECT coupon, year, n, t_dy2 AS t2 FROM {ols_sql("j", "a", ["dy2"], "coupon, year")}), tb AS (SELECT coupon, year, t_dy2 AS t3 FROM {ols_sql("j", "b", ["dy2"], "coupon, year")})
SELECT coupon, year, n, {R("t2", 3)} AS t_two, {R("t3", 3)} AS t_three FROM ta JOIN tb USING (coupon, year) WHERE n >= 6""")
def _(fx):
    from tideline.plans.hedging import exposure_by_year

    return rnd(exposure_by_year(hedge_rows(fx), "dy2", 36, 6), 3)


@query("G36_factor_tracking", V, f"""{HPB}, m AS (SELECT DISTINCT yyyymm, d_level, d_slope, d_curve, dy2, dy5, dy10 FROM hp), q AS (SELECT quantile_cont(d_curve/(dy5-(dy2+dy10)/2), 0.5) AS r FROM m WHERE abs(dy5-(dy2+dy10)/2) > 1e-12)
SELECT coupon, {R("corr(dur_curve, dy2)")} AS corr_model, {R("corr(d_curve, dy2)")} AS corr_realized, {R("any_value(cl)")} AS corr_curve_level, {R("any_value(cs)")} AS corr_curve_slope, {R("any_value(r)")} AS definition_ratio
FROM hp, (SELECT corr(d_curve, d_level) AS cl, corr(d_curve, d_slope) AS cs FROM m), q GROUP BY 1""")
def _(fx):
    from tideline.plans.hedging import factor_tracking

    return rnd(factor_tracking(hedge_rows(fx)))


@query("G37_duration_share", V, f"""{HPB} SELECT coupon, {R("avg(krd2)")} AS krd2, {R("avg(krd5)")} AS krd5, {R("avg(krd10)")} AS krd10, {R("100*avg(krd2)/(avg(krd2)+avg(krd5)+avg(krd10))")} AS krd2_pct, {R("stddev_samp(krd2)/abs(avg(krd2))")} AS krd2_cv FROM hp GROUP BY 1""")
def _(fx):
    k = lambda c: F.avg(c)
    return rnd(hedge_rows(fx).groupBy("coupon").agg(
        k("krd2").alias("krd2"), k("krd5").alias("krd5"), k("krd10").alias("krd10"),
        (100 * k("krd2") / (k("krd2") + k("krd5") + k("krd10"))).alias("krd2_pct"), (F.stddev_samp("krd2") / F.abs(k("krd2"))).alias("krd2_cv")))
