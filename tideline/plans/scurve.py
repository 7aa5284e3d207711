"""Parameter fits re-aimed as grid jobs: grid points are rows, residual sums are
aggregates, the linear part is solved in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions import rates
from tideline.operators import joins
from tideline.session import cut_lineage

# fixed values: box of the four-parameter curve
FLOOR_BOX, SAT_BOX = (0.005, 0.15), (0.05, 0.60)
K_GRID = [0.2, 0.6, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 8.0, 10.0]
X0_GRID = [-2.0, -1.5, -1.0, -0.75, -0.5, -0.25, 0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0]
FIXED_FLOOR = 0.0459
# fixed values: box of k and x0; first steps of a zoom and its passes, each with steps of a third (the last below 1e-3)
K_BOX, X0_BOX = (0.2, 10.0), (-2.0, 3.0)
ZOOM_STEPS, ZOOMS = (2 / 3, 0.5 / 3), 7
# fixed values of the descent: points of its lattice per unit, longest step in k and x0, least relative gain, least
# relative determinant of a two-way step, passes at most
LATTICE, LONGEST, GAIN, SINGULAR, STEPS = 65536, (1.0, 0.5), 1e-9, 1e-6, 12


def _on_grid(df: DataFrame, x: str, ks: list[float], x0s: list[float]) -> DataFrame:
    g = joins.grid(df, k=ks, x0=x0s)
    return g.withColumn("_g", 1 / (1 + F.exp(-F.col("k") * (F.col(x) - F.col("x0")))))


def _sums(y: str) -> dict[str, Column]:
    g, v = F.col("_g"), F.col(y)
    a = 1 - g  # weight of the floor; g is the weight of the saturation level
    return {"n": F.lit(1), "aa": a * a, "gg": g * g, "ag": a * g, "ay": a * v, "gy": g * v, "yy": v * v, "sy": v}


def _sse(f: Column, s: Column) -> Column:
    return (
        F.col("yy") + f * f * F.col("aa") + s * s * F.col("gg") + 2 * f * s * F.col("ag")
        - 2 * f * F.col("ay") - 2 * s * F.col("gy"))


def _box_solve(sums: DataFrame, floor: Column | None = None) -> DataFrame:
    """Best (floor, sat) in the box for each grid row: the interior solution when
    feasible, else the best of the four edges (the objective is convex)."""
    cl = lambda c, box: rates.clip(c, *box)
    sat_given = lambda f: cl((F.col("gy") - f * F.col("ag")) / F.col("gg"), SAT_BOX)
    floor_given = lambda s: cl((F.col("ay") - s * F.col("ag")) / F.col("aa"), FLOOR_BOX)
    if floor is not None:
        cands = [(floor, sat_given(floor))]
    else:
        det = F.col("aa") * F.col("gg") - F.col("ag") * F.col("ag")
        det = F.when(det > 1e-12 * F.col("aa") * F.col("gg"), det)
        f0 = (F.col("ay") * F.col("gg") - F.col("gy") * F.col("ag")) / det
        s0 = (F.col("gy") * F.col("aa") - F.col("ay") * F.col("ag")) / det
        inside = f0.between(*FLOOR_BOX) & s0.between(*SAT_BOX)
        cands = [(F.when(inside, f0), F.when(inside, s0))]
        cands += [(F.lit(b), sat_given(F.lit(b))) for b in FLOOR_BOX]
        cands += [(floor_given(F.lit(b)), F.lit(b)) for b in SAT_BOX]
    out = sums
    packs = []
    for i, (f, s) in enumerate(cands):
        out = out.withColumn(f"_f{i}", f).withColumn(f"_s{i}", s)
        packs.append(F.struct(_sse(F.col(f"_f{i}"), F.col(f"_s{i}")).alias("sse"), F.col(f"_f{i}").alias("floor"), F.col(f"_s{i}").alias("sat")))
    best = F.array_min(F.filter(F.array(*packs), lambda p: p["sse"].isNotNull()))
    return out.withColumn("_b", best)


def _pick(solved: DataFrame, by: list[str], extra: list[str] = []) -> DataFrame:
    tss = F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")
    row = F.struct(F.round("_b.sse", 12).alias("r"), "k", "x0", "_b.sse", "_b.floor", "_b.sat", "n", tss.alias("tss"), *extra)
    out = solved.filter(F.col("_b").isNotNull()).groupBy(*by).agg(F.min(row).alias("b")) if by else solved.agg(F.min(row).alias("b"))
    return out.select(
        *by, "b.floor", "b.sat", "b.k", "b.x0", "b.n", *[f"b.{e}" for e in extra],
        F.when(F.col("b.tss") > 1e-12, 1 - F.col("b.sse") / F.col("b.tss")).alias("r2"))


def _zoom(rows: DataFrame, x: str, y: str, by: list[str], best: DataFrame, zoom: int, pinned: bool, extra: list[str] = []) -> DataFrame:
    """``zoom`` finer grids around the best point of each key, a third of the step
    each time. A window is wider than the step before it, so a point can move on
    along a valley; it stays in the box and never gets worse. ``pinned`` keeps the
    floor of the first fit."""
    rows, best = cut_lineage(rows), cut_lineage(best)
    sk, sx = ZOOM_STEPS
    pin = [F.col("floor").alias("_pin")] if pinned else []
    keys = [*by, *extra, *["_pin"] * pinned]
    around = lambda c, s, box: F.explode(F.array_distinct(F.array(*[rates.clip(F.col(c) + F.lit(s * d), *box) for d in range(-5, 6)])))
    for _ in range(zoom):
        near = best.select(*by, *extra, *pin, around("k", sk, K_BOX).alias("k"), "x0").select(*keys, "k", around("x0", sx, X0_BOX).alias("x0"))
        g = rows.join(near, by).withColumn("_g", 1 / (1 + F.exp(-F.col("k") * (F.col(x) - F.col("x0")))))
        sums = g.groupBy(*keys, "k", "x0").agg(*[F.sum(c).alias(n) for n, c in _sums(y).items()])
        best = cut_lineage(_pick(_box_solve(sums, F.col("_pin") if pinned else None), by, extra))
        sk, sx = sk / 3, sx / 3
    return best


def _clip(c: str, box: tuple[float, float]) -> str:
    return f"greatest({box[0]!r}D, least({c}, {box[1]!r}D))"


def _descent_layers(pinned: bool) -> list[dict[str, str]]:
    """One pass of the descent as layers of SQL columns over the sums of a trial point (k, x0) and the state of its cutoff:
    floor and saturation in the box, acceptance, and the Gauss-Newton step in (k, x0) with floor and saturation eliminated
    where they are free. A direction that leaves the box is held; a nearly singular pair of directions moves x0 alone."""
    sse = lambda f, s: f"yy + {f}*{f}*aa + {s}*{s}*gg + 2*{f}*{s}*ag - 2*{f}*ay - 2*{s}*gy"
    sat_at = lambda f: _clip(f"(gy - {f}*ag)/gg", SAT_BOX)
    floor_at = lambda s: _clip(f"(ay - {s}*ag)/aa", FLOOR_BOX)
    if pinned:
        ends = [("floor", sat_at("floor"))]
    else:
        inside = f"det > 1e-12*aa*gg AND f0 BETWEEN {FLOOR_BOX[0]}D AND {FLOOR_BOX[1]}D AND s0 BETWEEN {SAT_BOX[0]}D AND {SAT_BOX[1]}D"
        ends = [(f"IF({inside}, f0, NULL)", f"IF({inside}, s0, NULL)")]
        ends += [(f"{v!r}D", sat_at(f"{v!r}D")) for v in FLOOR_BOX] + [(floor_at(f"{v!r}D"), f"{v!r}D") for v in SAT_BOX]
    pairs = ", ".join(f"struct({f} AS f, {s} AS s)" for f, s in ends)
    both = lambda p, q: f"(a{p}*(gg*a{q} - ag*g{q}) + g{p}*(aa*g{q} - ag*a{q}))/det"
    left = lambda p, q: f"d*d*({p}{q} - CASE WHEN free_f AND free_s THEN {both(p, q)} WHEN free_f THEN a{p}*a{q}/aa WHEN free_s THEN g{p}*g{q}/gg ELSE 0D END)"
    free = lambda c, box: f"{c} > {box[0]!r}D + 1e-9D AND {c} < {box[1]!r}D - 1e-9D"
    out = lambda c, step, box: f"({c} <= {box[0]!r}D AND {step} < 0) OR ({c} >= {box[1]!r}D AND {step} > 0)"
    limit = lambda c, most: f"greatest(-{most!r}D, least({c}, {most!r}D))"
    snap = lambda c, box: _clip(f"round(({c})*{LATTICE})/{LATTICE}", box)
    half = lambda t, c: f"{c} + CAST(({t} - {c})*{LATTICE}/2 AS BIGINT)/{LATTICE}"
    new = lambda a, b: f"IF(ok, {a}, {b})"
    return [
        {"det": "aa*gg - ag*ag"},
        {"f0": "(ay*gg - gy*ag)/nullif(det, 0D)", "s0": "(gy*aa - ay*ag)/nullif(det, 0D)"},
        {"ends": f"filter(array({pairs}), e -> e.f IS NOT NULL AND e.s IS NOT NULL)"},
        {"best": f"array_min(transform(ends, e -> struct({sse('e.f', 'e.s')} AS sse, e.f AS f, e.s AS s)))"},
        {"f": "best.f", "s": "best.s", "d": "best.s - best.f", "ok": f"coalesce(sse IS NULL OR best.sse < sse*(1 - {GAIN!r}D), false)",
         "free_f": "false" if pinned else free("best.f", FLOOR_BOX), "free_s": free("best.s", SAT_BOX)},
        {"ru": "d*(uy - f*au - s*gu)", "rv": "d*(vy - f*av - s*gv)", "muu": left("u", "u"), "muv": left("u", "v"), "mvv": left("v", "v")},
        {"dd": "muu*mvv - muv*muv", "only_k": "IF(muu > 0, ru/muu, 0D)", "only_x": "IF(mvv > 0, rv/mvv, 0D)"},
        {"sound": f"dd > {SINGULAR!r}D*muu*mvv"},
        {"dk": "IF(sound, (mvv*ru - muv*rv)/dd, 0D)", "dx": "IF(sound, (muu*rv - muv*ru)/dd, only_x)"},
        {"hold_k": out("k", "dk", K_BOX), "hold_x": out("x0", "dx", X0_BOX)},
        {"sk": limit("CASE WHEN hold_k THEN 0D WHEN hold_x THEN only_k ELSE dk END", LONGEST[0]), "sx": limit("CASE WHEN hold_x THEN 0D WHEN hold_k THEN only_x ELSE dx END", LONGEST[1])},
        {"tk": new(snap("k + sk", K_BOX), half("tk", "ck")), "tx": new(snap("x0 + sx", X0_BOX), half("tx", "cx")), "ck": new("k", "ck"), "cx": new("x0", "cx"),
         "sse": new("best.sse", "sse"), "cf": new("f", "cf"), "cs": new("s", "cs"),
         "r2": new("IF(yy - sy*sy/m > 1e-12D, 1 - best.sse/(yy - sy*sy/m), NULL)", "r2"), "n": new("CAST(m AS BIGINT)", "n")},
    ]


def _descend(rows: DataFrame, x: str, y: str, order: str, best: DataFrame, steps: int, pinned: bool, extra: list[str]) -> DataFrame:
    """Gauss-Newton from the best grid point of each cutoff, all cutoffs in one pass per step.

    Trial points lie on a lattice that all cutoffs share, so a pass evaluates the distinct points once per row, sums them by
    month and lets a running window give every cutoff its own history: no cutoff meets its past rows. A trial that does not
    lower the residual sum is halved towards the point it left; a point that is its own trial has converged. The box holds.
    One exchange by point serves the month sums and the window.
    """
    rows = cut_lineage(rows.select(F.col(order).alias("_at"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")))
    keep = [*extra, *(["floor"] if pinned else [])]
    snap = lambda c, box: _clip(f"round({c}*{LATTICE})/{LATTICE}", box)
    state = best.selectExpr(
        f"`{order}` AS _at", *keep, f"{snap('k', K_BOX)} AS tk", f"{snap('x0', X0_BOX)} AS tx",
        *[f"CAST(NULL AS DOUBLE) AS {c}" for c in ("ck", "cx", "sse", "cf", "cs", "r2")], "CAST(NULL AS BIGINT) AS n")
    parts = {"a": "(1 - g)", "g": "g", "u": "u", "v": "v", "y": "_y"}
    products = {p + q: f"sum({parts[p]}*{parts[q]})" for p, q in map(tuple, ("aa", "gg", "ag", "ay", "gy", "yy", "au", "gu", "av", "gv", "uu", "uv", "vv", "uy", "vy"))}
    sums = {"m": "CAST(count(_y) AS DOUBLE)", "sy": "sum(_y)", **products}
    layers = _descent_layers(pinned)
    for _ in range(steps):
        state = cut_lineage(state.coalesce(1))  # one row per cutoff: a calendar table
        if state.filter("ck IS NULL OR tk <> ck OR tx <> cx").isEmpty():
            break
        points = state.selectExpr("collect_set(struct(tk AS k, tx AS x0)) AS p")
        tried = rows.withColumn("_p", F.explode(points.scalar())).selectExpr("_at", "_x", "_y", "_p.k", "_p.x0")
        asked = state.selectExpr("_at", "CAST(NULL AS DOUBLE) AS _x", "CAST(NULL AS DOUBLE) AS _y", "tk AS k", "tx AS x0")  # so that a cutoff has a row
        here = tried.unionByName(asked).repartition("k", "x0").selectExpr("*", "1/(1 + exp(-k*(_x - x0))) AS g")
        here = here.selectExpr("*", "(_x - x0)*g*(1 - g) AS u", "-k*g*(1 - g) AS v")
        months = here.groupBy("k", "x0", "_at").agg(*[F.expr(e).alias(n) for n, e in sums.items()])
        past = "OVER (PARTITION BY k, x0 ORDER BY _at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        hist = months.selectExpr("k", "x0", "_at", *[f"sum({n}) {past} AS {n}" for n in sums])
        step = hist.join(F.broadcast(state.selectExpr("*", "tk AS k", "tx AS x0")), ["k", "x0", "_at"])
        for layer in layers[:-1]:
            step = step.selectExpr("*", *[f"{e} AS {c}" for c, e in layer.items()])
        state = step.selectExpr("_at", *keep, *[f"{e} AS {c}" for c, e in layers[-1].items()])
    return state.selectExpr(f"_at AS `{order}`", "cf AS floor", "cs AS sat", "ck AS k", "cx AS x0", "n", *extra, "r2")


def fit_by_scope(df: DataFrame, x: str, y: str, by: list[str], floor: float | None = None,
                 ks: list[float] = K_GRID, x0s: list[float] = X0_GRID, min_n: int = 40, zoom: int = 0) -> DataFrame:
    """One fit per scope key over the grid, refined by ``zoom`` passes (``ZOOMS``
    for a step below 1e-3)."""
    clean = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = _on_grid(clean, x, ks, x0s)
    sums = g.groupBy(*by, "k", "x0").agg(*[F.sum(c).alias(n) for n, c in _sums(y).items()]).filter(F.col("n") >= min_n)
    best = _pick(_box_solve(sums, None if floor is None else F.lit(floor)), by)
    return _zoom(clean.select(*by, x, y), x, y, by, best, zoom, floor is not None) if zoom else best


def fit_asof(df: DataFrame, x: str, y: str, order: str = "mi", mode: str = "fitted",
             seasoned: DataFrame | None = None, deep: float = -2.5, min_n: int = 40, min_deep: int = 10,
             ks: list[float] = K_GRID, x0s: list[float] = X0_GRID, zoom: int = 0, steps: int = 0) -> DataFrame:
    """Fit on rows strictly before each month. Month totals per grid point feed a
    running window, so the work is rows x grid, not rows x grid x cutoffs.

    mode: fitted | pinned-fixed | pinned-seasoned (floor = mean seasoned speed at
    deep discounts before the month, from ``seasoned``: order, x, y) | seasoned-fit
    (all four on the rows of ``seasoned``, for months with enough rows of both).

    ``zoom`` passes refine the grid of each month (``ZOOMS`` for a step below 1e-3).
    Months have grids of their own there, so rows meet every later month; they must
    be cells of the calendar, not loans. ``steps`` (``STEPS``) descends from the
    grid's best point instead, to a lattice of 1/65536, and pairs no cutoff with rows.
    """
    if mode not in ("fitted", "pinned-fixed", "pinned-seasoned", "seasoned-fit"):
        raise ValueError(mode)
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    clean = df.filter(known)
    rows = seasoned.filter(known) if mode == "seasoned-fit" else clean
    g = _on_grid(rows, x, ks, x0s)
    names = _sums(y)
    monthly = g.groupBy("k", "x0", order).agg(*[F.sum(c).alias(n) for n, c in names.items()])
    before = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    if mode == "seasoned-fit":
        cutoffs = clean.groupBy(order).agg(F.count(F.lit(1)).alias("_n")).select(order, F.sum("_n").over(before).alias("_n")).filter(F.col("_n") >= min_n)
        empty = joins.grid(cutoffs.select(order), k=ks, x0=x0s).select("k", "x0", order, *[F.lit(0).alias(n) for n in names])
        monthly = monthly.unionByName(empty).groupBy("k", "x0", order).agg(*[F.sum(n).alias(n) for n in names])
    past = W.partitionBy("k", "x0").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    hist = monthly.select("k", "x0", order, *[F.sum(n).over(past).alias(n) for n in names]).filter(F.col("n") >= min_n)
    floor, extra = None, []
    if mode == "seasoned-fit":
        hist = hist.join(F.broadcast(cutoffs.select(order)), order, "left_semi")
    elif mode == "pinned-fixed":
        floor = F.lit(FIXED_FLOOR)
    elif mode == "pinned-seasoned":
        deep_rows = seasoned.filter(F.col(x) <= deep).groupBy(order).agg(F.sum(y).alias("_s"), F.count(F.lit(1)).alias("_n"))
        months = clean.select(order).distinct().join(deep_rows, order, "full_outer")
        floors = months.select(order, (F.sum("_s").over(before) / F.sum("_n").over(before)).alias("floor_pin"), F.sum("_n").over(before).alias("n_deep"))
        hist = hist.join(F.broadcast(floors.filter(F.col("n_deep") >= min_deep)), order)
        floor, extra = F.col("floor_pin"), ["n_deep"]
    best = _pick(_box_solve(hist, floor), [order], extra)
    if steps:
        return _descend(rows, x, y, order, best, steps, floor is not None, extra)
    if not zoom:
        return best
    first = cut_lineage(best)
    earlier = rows.select(F.col(order).alias("_t"), x, y).join(F.broadcast(first.select(order)), F.col("_t") < F.col(order)).drop("_t")
    return _zoom(earlier, x, y, [order], first, zoom, floor is not None, extra)


def platt_grid(cells: DataFrame, path: str, real: str, a_values: Column, b_values: Column) -> DataFrame:
    """Sum of squared forecast errors for every (a, b): forecast is the annualised
    mean calibrated monthly probability over the cell's index path (an array)."""
    g = cells.withColumn("a", F.explode(a_values)).withColumn("b", F.explode(b_values))
    mean_p = F.aggregate(path, F.lit(0.0), lambda s, z: s + rates.sigmoid(F.col("a") * z + F.col("b"))) / F.size(path)
    err = rates.smm_to_cpr(mean_p) - F.col(real)
    return g.groupBy("a", "b").agg(F.sum(err * err).alias("sse"), F.count(F.lit(1)).alias("n_cells"))


def platt_recalibrate(train: DataFrame, path: str, real: str, a_grid: list[float], b_grid: list[float], zoom: int = 1) -> DataFrame:
    """Grid search for (a, b) followed by ``zoom`` finer grids around the best
    point; each pass is one aggregate, its best row a scalar for the next."""
    lit = lambda vs: F.array(*[F.lit(float(v)) for v in vs])
    best_of = lambda t: t.agg(F.min(F.struct(F.round("sse", 12).alias("r"), "a", "b", "sse", "n_cells")).alias("m"))
    best = best_of(platt_grid(train, path, real, lit(a_grid), lit(b_grid)))
    sa, sb = (a_grid[1] - a_grid[0]), (b_grid[1] - b_grid[0])
    for _ in range(zoom):
        step = [i / 5 for i in range(-5, 6)]
        near = train.withColumn("_m", best.scalar())
        around = lambda c, s: F.array(*[F.col(f"_m.{c}") + F.lit(s * d) for d in step])
        best = best_of(platt_grid(near, path, real, around("a", sa), around("b", sb)))
        sa, sb = sa / 5, sb / 5
    return best.select("m.a", "m.b", "m.sse", "m.n_cells")


def _platt_rows(cells: DataFrame, path: str, real: str, a: Column, b: Column, keep: list[str] = []) -> DataFrame:
    """Forecast f of every cell (the annualised mean calibrated probability over its index path) and its slopes in a and b."""
    p = "(1/(1 + exp(-(_a*z + _b))))"
    mean = lambda e: f"aggregate(_z, 0D, (s, z) -> s + {e})/size(_z)"
    rows = cells.select(*keep, F.col(path).alias("_z"), F.col(real).cast("double").alias("_r"), a.alias("_a"), b.alias("_b"))
    rows = rows.selectExpr("*", f"{mean(p)} AS _m", f"{mean(f'{p}*(1 - {p})*z')} AS _u", f"{mean(f'{p}*(1 - {p})')} AS _v")
    return rows.selectExpr(*keep, "_r", "1 - pow(1 - _m, 12) AS f", "12*pow(1 - _m, 11)*_u AS fa", "12*pow(1 - _m, 11)*_v AS fb")


def platt_descent(train: DataFrame, path: str, real: str, start: tuple[float, float] = (1.0, -3.0), steps: int = 60, tol: float = 1e-10) -> tuple[float, float, float, int]:
    """(a, b, squared error, cells) by Gauss-Newton: one aggregate of the normal equations per step, the step halved while it
    does not lower the error. The two parameters are a one-row table that the same plan reads at every step."""
    train = cut_lineage(train.select(path, real).filter(F.col(real).isNotNull()))
    sums = ["sum((f - _r)*(f - _r)) AS sse", "sum(fa*fa) AS aa", "sum(fa*fb) AS ab", "sum(fb*fb) AS bb", "sum(fa*(f - _r)) AS ae", "sum(fb*(f - _r)) AS be", "count(*) AS n"]

    def at(a, b):
        pair = train.sparkSession.createDataFrame([((float(a), float(b)),)], "p struct<a: double, b: double>")
        rows = _platt_rows(train.withColumn("_p", pair.scalar()), path, real, F.col("_p.a"), F.col("_p.b"))
        return rows.agg(*[F.expr(e) for e in sums]).first()

    (a, b), now = start, at(*start)
    if not now.n:
        raise ValueError("no cells to fit")
    for _ in range(steps):
        det = now.aa * now.bb - now.ab * now.ab
        if det <= 1e-14 * now.aa * now.bb:
            raise ValueError("the cells do not tell slope and intercept apart")
        da, db = (now.ab * now.be - now.bb * now.ae) / det, (now.ab * now.ae - now.aa * now.be) / det
        while max(abs(da), abs(db)) > tol and not (trial := at(a + da, b + db)).sse < now.sse:
            da, db = da / 2, db / 2
        if max(abs(da), abs(db)) <= tol:
            break
        a, b, now = a + da, b + db, trial
    return a, b, now.sse, now.n


def platt_report(cells: DataFrame, path: str, real: str, a: float, b: float, by: list[str]) -> DataFrame:
    """Mean forecast, mean realized speed and their ratio per key under (a, b), also on cells that the fit has not seen."""
    rows = _platt_rows(cells.filter(F.col(real).isNotNull()), path, real, F.lit(float(a)), F.lit(float(b)), by)
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("forecast"), F.avg("_r").alias("realized"))
    return out.withColumn("ratio", F.try_divide(F.col("forecast"), F.nullif("realized", F.lit(0.0))))
