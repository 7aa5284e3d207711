"""SQL of the S-curve grid fit, and the cells it is fitted on."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import R
from tideline.plans import scurve

SC_GRID = f"(SELECT unnest({scurve.K_GRID})::DOUBLE AS k), (SELECT unnest({scurve.X0_GRID})::DOUBLE AS x0)"


def scurve_sql(rel: str, by: str, floor: str | None = None) -> str:
    """Same grid and box in SQL: sums per grid point, then candidates unrolled."""
    key = f"{by}, " if by else ""
    f = lambda v: f"least(greatest({v}, 0.005), 0.15)"
    s = lambda v: f"least(greatest({v}, 0.05), 0.60)"
    sse = "yy + f*f*aa + s*s*gg + 2*f*s*ag - 2*f*ay - 2*s*gy"
    if floor:
        cand = f"SELECT *, {floor} AS f, {s(f'(gy - {floor}*ag)/gg')} AS s FROM sg"
    else:
        cand = f"""SELECT * FROM (SELECT *, (ay*gg-gy*ag)/dt AS f, (gy*aa-ay*ag)/dt AS s FROM (SELECT *, CASE WHEN aa*gg-ag*ag > 1e-12*aa*gg THEN aa*gg-ag*ag END AS dt FROM sg)) WHERE f BETWEEN 0.005 AND 0.15 AND s BETWEEN 0.05 AND 0.60
 UNION ALL SELECT *, NULL, 0.005, {s('(gy-0.005*ag)/gg')} FROM sg UNION ALL SELECT *, NULL, 0.15, {s('(gy-0.15*ag)/gg')} FROM sg
 UNION ALL SELECT *, NULL, {f('(ay-0.05*ag)/aa')}, 0.05 FROM sg UNION ALL SELECT *, NULL, {f('(ay-0.60*ag)/aa')}, 0.60 FROM sg"""
    return f"""gx AS (SELECT {key}k, x0, cy, 1/(1+exp(-k*(cx-x0))) AS g FROM {rel}, {SC_GRID}),
sg AS (SELECT {key}k, x0, count(*) AS n, sum((1-g)*(1-g)) AS aa, sum(g*g) AS gg, sum((1-g)*g) AS ag, sum((1-g)*cy) AS ay, sum(g*cy) AS gy, sum(cy*cy) AS yy, sum(cy) AS sy FROM gx GROUP BY {key}k, x0 HAVING count(*) >= 40),
cd AS ({cand}), rk AS (SELECT {key}k, x0, f, s, n, {sse} AS sse, yy - sy*sy/n AS tss, row_number() OVER ({f'PARTITION BY {by}' if by else ''} ORDER BY round({sse}, 12), k, x0) AS rn FROM cd)
SELECT {key}n, k, x0, {R("f", 4)} AS floor, {R("s", 4)} AS sat, {R("CASE WHEN tss > 1e-12 THEN 1 - sse/tss END", 4)} AS r2 FROM rk WHERE rn = 1"""


#: Written out, so that a wrong grid, box or step of the module shows.
ZK = [0.2, 0.6, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 8.0, 10.0]
ZX = [-2.0, -1.5, -1.0, -0.75, -0.5, -0.25, 0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0]


def zoom_sql(rel: str, by: str, floor: str | None = None, shown: str | None = None) -> str:
    """The fit with seven finer grids around each key's best point."""
    f = lambda v: f"least(greatest({v}, 0.005), 0.15)"
    s = lambda v: f"least(greatest({v}, 0.05), 0.60)"
    ctes, k_step, x_step = [], 2 / 3, 0.5 / 3
    for i in range(8):
        if i == 0:
            grid = f"SELECT DISTINCT {by}, k, x0 FROM {rel}, (SELECT unnest({ZK})::DOUBLE AS k), (SELECT unnest({ZX})::DOUBLE AS x0)"
        else:
            ks, xs = [k_step * d for d in range(-5, 6)], [x_step * d for d in range(-5, 6)]
            grid = f"SELECT DISTINCT {by}, least(greatest(k + dk, 0.2), 10.0) AS k, least(greatest(x0 + dx, -2.0), 3.0) AS x0 FROM zr{i - 1}, (SELECT unnest({ks})::DOUBLE AS dk), (SELECT unnest({xs})::DOUBLE AS dx)"
            k_step, x_step = k_step / 3, x_step / 3
        if floor:
            cand = f"SELECT *, {floor} AS f, {s(f'(gy - {floor}*ag)/gg')} AS s FROM zs{i}"
        else:
            cand = f"""SELECT * EXCLUDE (dt) FROM (SELECT *, (ay*gg-gy*ag)/dt AS f, (gy*aa-ay*ag)/dt AS s FROM (SELECT *, CASE WHEN aa*gg-ag*ag > 1e-12*aa*gg THEN aa*gg-ag*ag END AS dt FROM zs{i})) WHERE f BETWEEN 0.005 AND 0.15 AND s BETWEEN 0.05 AND 0.60
 UNION ALL SELECT *, 0.005, {s('(gy-0.005*ag)/gg')} FROM zs{i} UNION ALL SELECT *, 0.15, {s('(gy-0.15*ag)/gg')} FROM zs{i}
 UNION ALL SELECT *, {f('(ay-0.05*ag)/aa')}, 0.05 FROM zs{i} UNION ALL SELECT *, {f('(ay-0.60*ag)/aa')}, 0.60 FROM zs{i}"""
        ctes.append(f"""zg{i} AS MATERIALIZED ({grid}), zx{i} AS (SELECT {by}, k, x0, cy, 1/(1+exp(-k*(cx-x0))) AS g FROM {rel} JOIN zg{i} USING ({by})),
zs{i} AS MATERIALIZED (SELECT {by}, k, x0, count(*) AS n, sum((1-g)*(1-g)) AS aa, sum(g*g) AS gg, sum((1-g)*g) AS ag, sum((1-g)*cy) AS ay, sum(g*cy) AS gy, sum(cy*cy) AS yy, sum(cy) AS sy FROM zx{i} GROUP BY {by}, k, x0 HAVING count(*) >= 40),
zc{i} AS (SELECT *, yy + f*f*aa + s*s*gg + 2*f*s*ag - 2*f*ay - 2*s*gy AS sse, yy - sy*sy/n AS tss FROM ({cand})),
zr{i} AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(sse, 12), k, x0) AS rn FROM zc{i}) WHERE rn = 1)""")
    return ", ".join(ctes) + f""" SELECT {shown or by}, n, {R("k", 4)} AS k, {R("x0", 4)} AS x0, {R("f", 4)} AS floor, {R("s", 4)} AS sat, {R("CASE WHEN tss > 1e-12 THEN 1 - sse/tss END", 4)} AS r2 FROM zr7"""


def descent_sql(rel: str, by: str, floor: str | None = None, shown: str | None = None, start: str = "", steps: int = 12) -> str:
    """Gauss-Newton from the grid's best point of each key, on a lattice of 1/65536; every key sums its own rows anew.
    ``start`` names CTEs so that two descents can stand in one statement."""
    f = lambda v: f"least(greatest({v}, 0.005), 0.15)"
    s = lambda v: f"least(greatest({v}, 0.05), 0.60)"
    snap = lambda v, lo, hi: f"least(greatest(round(({v})*65536)/65536, {lo}), {hi})"
    cand = lambda src: f"SELECT *, {floor} AS f, {s(f'(gy - {floor}*ag)/gg')} AS s FROM {src}" if floor else f"""SELECT * EXCLUDE (dt) FROM (SELECT *, (ay*gg-gy*ag)/dt AS f, (gy*aa-ay*ag)/dt AS s FROM (SELECT *, CASE WHEN aa*gg-ag*ag > 1e-12*aa*gg THEN aa*gg-ag*ag END AS dt FROM {src})) WHERE f BETWEEN 0.005 AND 0.15 AND s BETWEEN 0.05 AND 0.60
 UNION ALL SELECT *, 0.005, {s('(gy-0.005*ag)/gg')} FROM {src} UNION ALL SELECT *, 0.15, {s('(gy-0.15*ag)/gg')} FROM {src}
 UNION ALL SELECT *, {f('(ay-0.05*ag)/aa')}, 0.05 FROM {src} UNION ALL SELECT *, {f('(ay-0.60*ag)/aa')}, 0.60 FROM {src}"""
    sums = "count(*) AS n, sum((1-g)*(1-g)) AS aa, sum(g*g) AS gg, sum((1-g)*g) AS ag, sum((1-g)*cy) AS ay, sum(g*cy) AS gy, sum(cy*cy) AS yy, sum(cy) AS sy"
    more = "sum((1-g)*u) AS au, sum(g*u) AS gu, sum((1-g)*v) AS av, sum(g*v) AS gv, sum(u*u) AS uu, sum(u*v) AS uv, sum(v*v) AS vv, sum(u*cy) AS uy, sum(v*cy) AS vy"
    sse = "yy + f*f*aa + s*s*gg + 2*f*s*ag - 2*f*ay - 2*s*gy"
    t = start
    ctes = [f"""{t}g0 AS (SELECT {by}, k, x0, cy, 1/(1+exp(-k*(cx-x0))) AS g FROM {rel}, (SELECT unnest({ZK})::DOUBLE AS k), (SELECT unnest({ZX})::DOUBLE AS x0)),
{t}s0 AS MATERIALIZED (SELECT {by}, k, x0, {sums} FROM {t}g0 GROUP BY {by}, k, x0 HAVING count(*) >= 40),
{t}n0 AS MATERIALIZED (SELECT {by}, {snap('k', 0.2, 10.0)} AS tk, {snap('x0', -2.0, 3.0)} AS tx, NULL::DOUBLE AS ck, NULL::DOUBLE AS cx0, NULL::DOUBLE AS e, NULL::DOUBLE AS cf, NULL::DOUBLE AS cs, NULL::DOUBLE AS r2, NULL::BIGINT AS nn FROM (
 SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round({sse}, 12), k, x0) AS rn FROM ({cand(t + 's0')})) WHERE rn = 1)"""]
    drop = lambda p, q: (f"d*d*({p}{q} - CASE WHEN ff AND fs THEN (a{p}*(gg*a{q}-ag*g{q}) + g{p}*(aa*g{q}-ag*a{q}))/(aa*gg-ag*ag) WHEN ff THEN a{p}*a{q}/aa WHEN fs THEN g{p}*g{q}/gg ELSE 0 END)")
    free = "false" if floor else "f > 0.005+1e-9 AND f < 0.15-1e-9"
    for i in range(1, steps + 1):
        ctes.append(f"""{t}x{i} AS (SELECT {by}, tk, tx, ck, cx0, e, cf, cs, r2, nn, cy, 1/(1+exp(-tk*(cx-tx))) AS g, cx - tx AS z FROM {rel} JOIN {t}n{i - 1} USING ({by})),
{t}s{i} AS MATERIALIZED (SELECT {by}, tk, tx, ck, cx0, e, cf, cs, r2, nn, {sums}, {more} FROM (SELECT *, z*g*(1-g) AS u, -tk*g*(1-g) AS v FROM {t}x{i}) GROUP BY ALL),
{t}b{i} AS (SELECT *, s - f AS d, {free} AS ff, s > 0.05+1e-9 AND s < 0.60-1e-9 AS fs, sse < e*(1-1e-9) OR e IS NULL AS ok FROM (SELECT *, {sse} AS sse, row_number() OVER (PARTITION BY {by} ORDER BY {sse}, f, s) AS rn FROM ({cand(f'{t}s{i}')})) WHERE rn = 1),
{t}m{i} AS (SELECT *, {drop('u', 'u')} AS muu, {drop('u', 'v')} AS muv, {drop('v', 'v')} AS mvv, d*(uy - f*au - s*gu) AS ru, d*(vy - f*av - s*gv) AS rv FROM {t}b{i}),
{t}d{i} AS (SELECT *, CASE WHEN muu*mvv-muv*muv > 1e-6*muu*mvv THEN (mvv*ru-muv*rv)/(muu*mvv-muv*muv) ELSE 0 END AS dk, CASE WHEN muu*mvv-muv*muv > 1e-6*muu*mvv THEN (muu*rv-muv*ru)/(muu*mvv-muv*muv) WHEN mvv > 0 THEN rv/mvv ELSE 0 END AS dx FROM {t}m{i}),
{t}h{i} AS (SELECT *, (tk <= 0.2 AND dk < 0) OR (tk >= 10.0 AND dk > 0) AS hk, (tx <= -2.0 AND dx < 0) OR (tx >= 3.0 AND dx > 0) AS hx FROM {t}d{i}),
{t}e{i} AS (SELECT *, least(greatest(CASE WHEN hk THEN 0 WHEN hx THEN CASE WHEN muu > 0 THEN ru/muu ELSE 0 END ELSE dk END, -1), 1) AS sk, least(greatest(CASE WHEN hx THEN 0 WHEN hk THEN CASE WHEN mvv > 0 THEN rv/mvv ELSE 0 END ELSE dx END, -0.5), 0.5) AS sx FROM {t}h{i}),
{t}n{i} AS MATERIALIZED (SELECT {by}, CASE WHEN ok THEN {snap('tk + sk', 0.2, 10.0)} ELSE ck + trunc((tk-ck)*65536/2)/65536 END AS tk, CASE WHEN ok THEN {snap('tx + sx', -2.0, 3.0)} ELSE cx0 + trunc((tx-cx0)*65536/2)/65536 END AS tx,
 CASE WHEN ok THEN tk ELSE ck END AS ck, CASE WHEN ok THEN tx ELSE cx0 END AS cx0, CASE WHEN ok THEN sse ELSE e END AS e, CASE WHEN ok THEN f ELSE cf END AS cf, CASE WHEN ok THEN s ELSE cs END AS cs, CASE WHEN ok THEN CASE WHEN yy - sy*sy/n > 1e-12 THEN 1 - sse/(yy - sy*sy/n) END ELSE r2 END AS r2, CASE WHEN ok THEN n ELSE nn END AS nn FROM {t}e{i})""")
    return ", ".join(ctes) + f""" SELECT {shown or by}, nn AS n, {R("ck", 4)} AS k, {R("cx0", 4)} AS x0, {R("cf", 4)} AS floor, {R("cs", 4)} AS sat, {R("r2", 4)} AS r2 FROM {t}n{steps}"""


def in_band(df):
    """Incentive -4..2 and coupons 2.5..6.5."""
    return df.filter(F.col("inc").between(-4.0, 2.0) & F.col("coupon").between(2.5, 6.5))


BAND = "bd AS (SELECT mi, coupon, inc AS cx, cpr_upb AS cy FROM fr WHERE inc BETWEEN -4.0 AND 2.0 AND coupon BETWEEN 2.5 AND 6.5)"
