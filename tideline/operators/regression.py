"""Grouped least squares without leaving the aggregate.

Every fit is: centred second moments per group (Spark's one-pass, mergeable
covariance, so a hot group is combined map-side), then one small symmetric
matrix per group swept inside a column expression. Nothing is collected.

A pivot that is zero to working precision means a singular design. Its
coefficients are then the least-squares solution of minimum norm, intercept
included, from the eigenvalues of the moment matrix (Jacobi rotations);
standard errors are NULL there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions import rates, tdist

PIVOT_TOL = 1e-10
#: Share of the largest eigenvalue below which a direction counts as dependent; rounds of rotations.
EIGEN_TOL, SWEEPS = 1e-11, 8


def jacobi(matrix: str, m: int) -> str:
    """Eigenvalues (the diagonal of ``a``) and eigenvectors (columns of ``v``) of a symmetric row-major m x m array, as SQL
    text: cyclic rotations in one fold, each of them a transform of both arrays."""
    pairs = ", ".join(f"named_struct('p', {p}, 'q', {q})" for p in range(m) for q in range(p + 1, m))
    unit = ", ".join("1D" if i % (m + 1) == 0 else "0D" for i in range(m * m))
    start = f"named_struct('a', {matrix}, 'v', array({unit}))"
    if m == 1:
        return start
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    cols = lambda x: f"transform({x}, (e, i) -> CASE WHEN i % {m} = o.p THEN j.c*e - j.s*get({x}, i - o.p + o.q) WHEN i % {m} = o.q THEN j.s*get({x}, i - o.q + o.p) + j.c*e ELSE e END)"
    row = f"CAST(i DIV {m} AS INT)"
    rows = let("b", cols("acc.a"), f"transform(b, (e, i) -> CASE WHEN {row} = o.p THEN j.c*e - j.s*get(b, i + (o.q - o.p)*{m}) WHEN {row} = o.q THEN j.s*get(b, i - (o.q - o.p)*{m}) + j.c*e ELSE e END)")
    at = lambda r, c: f"get(acc.a, o.{r}*{m} + o.{c})"
    ratio = f"({at('q', 'q')} - {at('p', 'p')})/(2*{at('p', 'q')})"
    tan = f"CASE WHEN {at('p', 'q')} = 0 THEN 0D ELSE " + let("h", ratio, "IF(h < 0, -1D, 1D)/(abs(h) + sqrt(h*h + 1))") + " END"
    turn = let("t", tan, "named_struct('c', 1/sqrt(t*t + 1), 's', t/sqrt(t*t + 1))")
    step = let("j", turn, f"named_struct('a', {rows}, 'v', {cols('acc.v')})")
    return f"aggregate(flatten(array_repeat(array({pairs}), {SWEEPS})), {start}, (acc, o) -> {step})"


def least_norm(eigen: str, rhs: str, m: int) -> str:
    """Minimum-norm solution from the eigenvalues: array of m coefficients, as SQL text."""
    value = lambda l: f"get({eigen}.a, {l}*{m + 1})"
    top = f"array_max(transform(sequence(0, {m - 1}), l -> {value('l')}))"
    dot = f"aggregate(sequence(0, {m - 1}), 0D, (u, r) -> u + get({eigen}.v, r*{m} + l)*get({rhs}, r))"
    part = f"IF({value('l')} > {EIGEN_TOL!r}D*{top}, get({eigen}.v, i*{m} + l)*{dot}/{value('l')}, 0D)"
    return f"transform(sequence(0, {m - 1}), i -> aggregate(sequence(0, {m - 1}), 0D, (s, l) -> s + {part}))"


def _sweep(matrix: str, m: int, pivots: int) -> str:
    """Sweep the first ``pivots`` diagonal entries of a row-major m x m matrix
    column; struct(a, ok) as SQL text.

    Afterwards the top-left block is the inverse, the last column the
    coefficients and the corner the residual sum of squares.
    """
    at = lambda r, c: f"element_at(acc.a, {r} * {m} + {c} + 1)"
    pivot = at("p", "p")
    usable = f"acc.ok AND abs({pivot}) > abs(element_at({matrix}, p * {m + 1} + 1)) * {PIVOT_TOL!r}D AND abs({pivot}) > 0"
    r, c = f"(i DIV {m})", f"(i % {m})"
    d = "acc.d"
    cell = (
        f"CASE WHEN {r} = p AND {c} = p THEN 1.0D / {d} WHEN {r} = p THEN x / {d} WHEN {c} = p THEN -x / {d} "
        f"ELSE x - element_at(acc.a, CAST({r} * {m} + p + 1 AS INT)) * element_at(acc.a, CAST(p * {m} + {c} + 1 AS INT)) / {d} END")
    # the pivot and its test are evaluated once per step by an inner one-row fold
    inner = (
        f"aggregate(array(named_struct('a', acc.a, 'ok', coalesce({usable}, false), 'd', {pivot})), named_struct('a', acc.a, 'ok', acc.ok), "
        f"(o, s) -> named_struct('a', transform(s.a, (x, i) -> {cell.replace('acc.a', 's.a').replace(d, 'IF(s.ok, s.d, 1.0D)')}), 'ok', s.ok))")
    return f"aggregate(sequence(0, {pivots - 1}), named_struct('a', {matrix}, 'ok', true), (acc, p) -> {inner})"


def solve(df: DataFrame, names: list[str], min_n: int) -> DataFrame:
    """From columns n, yy, my, m_<x> (means), s_<x>_<z>, sy_<x> (centred sums) to
    coefficients b_<x>, the inverse v_<x>_<z> and the residual sum sse. Without
    means the sums are raw and the fit goes through the origin. Singular designs
    get the coefficients of minimum norm and no inverse."""
    k = len(names)
    m = k + 1
    name = lambda i: names[i]
    s_ = lambda i, j: f"CAST(`s_{name(min(i, j))}_{name(max(i, j))}` AS DOUBLE)"
    sy = lambda i: f"CAST(`sy_{name(i)}` AS DOUBLE)"
    cells = []
    for i in range(m):
        for j in range(m):
            lo, hi = min(i, j), max(i, j)
            cells.append("CAST(yy AS DOUBLE)" if lo == k else sy(lo) if hi == k else s_(lo, hi))
    swept = df.withColumn("_m", F.expr(f"array({', '.join(cells)})")).withColumn("_s", F.expr(_sweep("_m", m, k)))

    centred = "my" in df.columns
    mean = lambda i: f"`m_{name(i)}`"
    raw = lambda i, j: f"{s_(i, j)} + n*{mean(i)}*{mean(j)}" if centred else s_(i, j)
    size, grid, rhs = k, [[raw(i, j) for j in range(k)] for i in range(k)], [f"{sy(i)} + n*{mean(i)}*my" if centred else sy(i) for i in range(k)]
    if centred:
        size, grid = m, [["n", *[f"n*{mean(i)}" for i in range(k)]], *[[f"n*{mean(i)}", *grid[i]] for i in range(k)]]
        rhs = ["n*my", *rhs]
    known = " AND ".join(f"{c} IS NOT NULL" for c in sorted({x for r in [*grid, rhs] for x in r}))
    as_array = lambda xs: f"array({', '.join(f'CAST({x} AS DOUBLE)' for x in xs)})"
    singular = f"NOT _s.ok AND n >= {min_n} AND {known}"
    full, right = as_array([x for r in grid for x in r]), as_array(rhs)
    swept = swept.withColumn("_e", F.expr(f"IF({singular}, {jacobi(full, size)}, NULL)")).withColumn("_r", F.expr(f"IF(_e IS NOT NULL, {right}, NULL)"))
    swept = swept.withColumn("_l", F.expr(f"IF(_e IS NOT NULL, {least_norm('_e', '_r', size)}, NULL)"))

    val = lambda i, j: F.expr(f"CASE WHEN _s.ok AND n >= {min_n} THEN element_at(_s.a, {i * m + j + 1}) END")
    flat = lambda i: F.expr(f"get(_l, {i + size - k})")
    new = {f"b_{x}": F.coalesce(val(i, k), flat(i)) for i, x in enumerate(names)}
    fitted = swept.withColumns(new)
    quad = " + ".join(f"`b_{name(i)}`*(" + " + ".join(f"{s_(i, j)}*`b_{name(j)}`" for j in range(k)) + f" - 2*{sy(i)})" for i in range(k))
    left = F.when(F.col("_l").isNotNull(), F.expr(f"greatest(CAST(yy AS DOUBLE) + {quad}, 0D)"))
    more = {"sse": F.coalesce(val(k, k), left)}
    more |= {f"v_{x}_{z}": val(i, j) for i, x in enumerate(names) for j, z in enumerate(names) if j >= i}
    return fitted.withColumns(more)


def _v(x: str, z: str, names: list[str]) -> str:
    i, j = sorted((names.index(x), names.index(z)))
    return f"`v_{names[i]}_{names[j]}`"


def _finish(fit: DataFrame, keep: list[str], names: list[str], intercept: bool) -> DataFrame:
    k = len(names) + (1 if intercept else 0)
    s2 = f"(CASE WHEN n > {k} THEN greatest(sse, 0.0D) / (n - {k}) END)"
    terms = {x: (f"`b_{x}`", f"sqrt({s2} * {_v(x, x, names)})") for x in names}
    out = [f"`{c}`" for c in keep] + ["n"]
    ratio = lambda b, se: f"try_divide({b}, nullif({se}, 0.0D))"
    if intercept:
        b0 = "my - (" + " + ".join(f"`b_{x}` * `m_{x}`" for x in names) + ")"
        quad = " + ".join(f"`m_{x}` * {_v(x, z, names)} * `m_{z}`" for x in names for z in names)
        se0 = f"sqrt({s2} * (1.0D / n + {quad}))"
        out += [f"{b0} AS b0", f"{se0} AS se0", f"{ratio('(' + b0 + ')', se0)} AS t0"]
    for x, (b, se) in terms.items():
        out += [b, f"{se} AS `se_{x}`", f"{ratio(b, se)} AS `t_{x}`"]
    return fit.selectExpr(*out, "CASE WHEN tss > 1e-12D THEN 1.0D - sse / tss END AS r2", "sse")


def moments(y: str | Column, xs: dict[str, Column], valid: Column) -> list[Column]:
    """Aggregates for a fit with intercept: means and centred cross-sums."""
    yc = F.when(valid, F.col(y) if isinstance(y, str) else y)
    xc = {n: F.when(valid, c) for n, c in xs.items()}
    n = F.count(yc)
    cols = [n.alias("n"), F.avg(yc).alias("my"), (F.var_pop(yc) * n).alias("yy"), (F.var_pop(yc) * n).alias("tss")]
    names = list(xs)
    for i, a in enumerate(names):
        cols.append(F.avg(xc[a]).alias(f"m_{a}"))
        cols.append((F.covar_pop(xc[a], yc) * n).alias(f"sy_{a}"))
        for z in names[i:]:
            s = F.var_pop(xc[a]) if z == a else F.covar_pop(xc[a], xc[z])
            cols.append((s * n).alias(f"s_{a}_{z}"))
    return cols


def raw_moments(y: Column, xs: dict[str, Column], valid: Column) -> list[Column]:
    """Aggregates for a fit through the origin; R2 stays centred, so it can be
    negative."""
    yc = F.when(valid, y)
    xc = {n: F.when(valid, c) for n, c in xs.items()}
    n = F.count(yc)
    cols = [n.alias("n"), F.sum(yc * yc).alias("yy"), (F.var_pop(yc) * n).alias("tss")]
    names = list(xs)
    for i, a in enumerate(names):
        cols.append(F.sum(xc[a] * yc).alias(f"sy_{a}"))
        for z in names[i:]:
            cols.append(F.sum(xc[a] * xc[z]).alias(f"s_{a}_{z}"))
    return cols


def _as_cols(xs) -> dict[str, Column]:
    return {x: F.col(x) for x in xs} if not isinstance(xs, dict) else xs


def ols(
    df: DataFrame, y: str | Column, xs, by: list[str] = [], min_n: int = 0, intercept: bool = True
) -> DataFrame:
    """Least squares per group: n, b0, b_<x>, se_<x>, t_<x>, r2, sse.

    Rows with a missing y or x drop. Standard errors are NULL when n <= k.
    """
    cols = _as_cols(xs)
    yc = F.col(y) if isinstance(y, str) else y
    valid = yc.isNotNull()
    for c in cols.values():
        valid = valid & c.isNotNull()
    aggs = moments(yc, cols, valid) if intercept else raw_moments(yc, cols, valid)
    grouped = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    names = list(cols)
    need = max(min_n, len(names) + (1 if intercept else 0))
    return _finish(solve(grouped, names, need), by, names, intercept)


def ols_window(df: DataFrame, y: str | Column, xs, window, keep: list[str], min_n: int = 0) -> DataFrame:
    """The same fit over a window frame (rolling or expanding): one row per input
    row. For calendar series; the window bounds the work."""
    cols = _as_cols(xs)
    yc = F.col(y) if isinstance(y, str) else y
    valid = yc.isNotNull()
    for c in cols.values():
        valid = valid & c.isNotNull()
    names = list(cols)
    n = F.count(F.when(valid, yc)).over(window)
    yv = F.when(valid, yc)
    xv = {a: F.when(valid, c) for a, c in cols.items()}
    out = {
        "n": n, "my": F.avg(yv).over(window), "yy": F.var_pop(yv).over(window) * n, "tss": F.var_pop(yv).over(window) * n,
    }
    for i, a in enumerate(names):
        out[f"m_{a}"] = F.avg(xv[a]).over(window)
        out[f"sy_{a}"] = F.covar_pop(xv[a], yv).over(window) * n
        for z in names[i:]:
            s = F.var_pop(xv[a]) if z == a else F.covar_pop(xv[a], xv[z])
            out[f"s_{a}_{z}"] = s.over(window) * n
    framed = df.select(*keep, *[c.alias(f"{name}") for name, c in out.items() if name not in keep])
    need = max(min_n, len(names) + 1)
    return _finish(solve(framed, names, need), keep, names, True)


def residuals(df: DataFrame, fit: DataFrame, y: str, xs: list[str], by: list[str], name: str = "resid") -> DataFrame:
    """Attach residuals of a fitted table (one small row per group)."""
    small = fit.select(*by, F.col("b0").alias("_b0"), *[F.col(f"b_{x}").alias(f"_b_{x}") for x in xs])
    if by:
        out = df.join(small, by)
    else:
        out = df.withColumn("_f", small.select(F.struct("*")).scalar()).select("*", "_f.*").drop("_f")
    hat = F.col("_b0")
    for x in xs:
        hat = hat + F.col(f"_b_{x}") * F.col(x)
    return out.withColumn(name, F.col(y) - hat).drop("_b0", *[f"_b_{x}" for x in xs])


def expanding_history(
    df: DataFrame, order: str, lag_months: int, sums: dict[str, Column], by: list[str] = [], carry: dict[str, str] = {}
) -> DataFrame:
    """For each month m: totals over rows with month < m - lag. Rows are first
    summed per month; the running window sees one row per calendar month."""
    monthly = df.groupBy(*by, order).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(src).alias(dst) for dst, src in carry.items()])
    past = W.partitionBy(*by).orderBy(order).rangeBetween(W.unboundedPreceding, -lag_months - 1)
    return monthly.select(
        *by, order, *carry, *[F.sum(n).over(past).alias(n) for n in sums], F.count(F.lit(1)).over(past).alias("n_months"))


def weighted_line(
    df: DataFrame, x: Column, y: Column, w: Column, order: str, lag_months: int, min_months: int, by: list[str] = []
) -> DataFrame:
    """Expanding weighted straight line: intercept and slope fitted on months
    strictly before each month less the lag; NULL before ``min_months`` of
    history. Moments are taken around the grand weighted mean, one scalar."""
    centre = df.agg((F.sum(w * x) / F.sum(w)).alias("x"), (F.sum(w * y) / F.sum(w)).alias("y"))
    c = df.withColumn("_c", centre.select(F.struct("*")).scalar())
    dx, dy = x - F.col("_c.x"), y - F.col("_c.y")
    hist = expanding_history(
        c, order, lag_months,
        {"sw": w, "sx": w * dx, "sy": w * dy, "sxx": w * dx * dx, "sxy": w * dx * dy, "n_train": F.lit(1)},
        by, {"_cx": "_c.x", "_cy": "_c.y"},
    )
    den = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(
        F.col("n_months") >= min_months,
        F.try_divide(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), F.nullif(den, F.lit(0.0))))
    out = hist.withColumn("slope", slope)
    mean_y = F.col("_cy") + F.col("sy") / F.col("sw")
    mean_x = F.col("_cx") + F.col("sx") / F.col("sw")
    return out.withColumn("intercept", mean_y - F.col("slope") * mean_x).select(
        *by, order, "intercept", "slope", "n_months", "n_train")


def leave_one_out(df: DataFrame, y: str, xs: list[str], keep: list[str], by: list[str] = []) -> DataFrame:
    """Coefficients with each row left out (of its ``by`` group), from the full fit
    and the row's leverage (no refit): b(-i) = b - A x_i e_i / (1 - h_i)."""
    valid = F.col(y).isNotNull()
    for x in xs:
        valid = valid & F.col(x).isNotNull()
    rows = df.filter(valid)
    agg = moments(y, _as_cols(xs), F.lit(True))
    solved = solve(rows.groupBy(*by).agg(*agg) if by else rows.agg(*agg), xs, len(xs) + 1)
    names = ["n", "my", *[f"m_{x}" for x in xs], *[f"b_{x}" for x in xs], *[f"v_{x}_{z}" for i, x in enumerate(xs) for z in xs[i:]]]
    if by:
        out = rows.join(solved.select(*by, F.struct(*names).alias("_f")), by)
    else:
        out = rows.withColumn("_f", solved.select(F.struct(*names)).scalar())
    va = lambda x, z: F.col("_f." + _v(x, z, xs).strip("`"))
    out = out.withColumns({f"_d_{x}": F.col(x) - F.col(f"_f.m_{x}") for x in xs})
    e = F.col(y) - F.col("_f.my")
    h = 1 / F.col("_f.n")
    for x in xs:
        e = e - F.col(f"_f.b_{x}") * F.col(f"_d_{x}")
        for z in xs:
            h = h + F.col(f"_d_{x}") * va(x, z) * F.col(f"_d_{z}")
    out = out.withColumn("_e", F.try_divide(e, F.nullif(1 - h, F.lit(0.0))))
    cols = {}
    for x in xs:
        move = F.lit(0.0)
        for z in xs:
            move = move + va(x, z) * F.col(f"_d_{z}")
        cols[f"b_{x}"] = F.col(f"_f.b_{x}") - move * F.col("_e")
        cols[f"full_{x}"] = F.col(f"_f.b_{x}")
    return out.withColumns(cols).select(*keep, *cols)


def one_sample_t(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:
    """Mean, sample std, n, t against zero and its two-sided p-value; t and p are NULL for one value or no spread."""
    v = F.col(value)
    out = df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))
    out = out.withColumn("t", F.try_divide(F.col("mean"), F.nullif(F.col("std") / F.sqrt("n"), F.lit(0.0))))
    return tdist.with_p_value(out, "t", "n - 1")


def logit_fit(df: DataFrame, y: str, xs: list[str], weight: str | None = None, steps: int = 40, tol: float = 1e-10) -> list[float]:
    """Intercept and slopes of a (weighted) logistic regression by Newton steps.

    Each step is one aggregation of k(k+3)/2 sums and the loss over the rows, and a k x k solve on the driver. The betas are a
    one-row table that the same plan reads at every step. A step that raises the loss is halved; steps end when none of them
    moves a beta by more than ``tol`` of its size. Features that separate the events or depend on each other raise a
    ValueError. Pass rows that are cheap to read again, on comparable scales.
    """
    import numpy as np

    k, spark = len(xs) + 1, df.sparkSession
    row = df.selectExpr(f"CAST(`{y}` AS DOUBLE) AS _y", f"CAST({f'`{weight}`' if weight else '1.0'} AS DOUBLE) AS _w", "1.0D AS _x0", *[f"CAST(`{x}` AS DOUBLE) AS _x{i}" for i, x in enumerate(xs, 1)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [f"sum(_w*(_y - _p)*_x{i}) AS g{i}" for i in range(k)] + [f"sum(_w*_p*(1 - _p)*_x{i}*_x{j}) AS h{i}_{j}" for i, j in pairs]
    sums += ["sum(_w*(greatest(_z, 0D) + log1p(exp(-abs(_z))) - _y*_z)) AS loss", "sum(_w) AS total"]

    def at(beta):
        table = spark.createDataFrame([([float(b) for b in beta],)], "b array<double>")
        z = " + ".join(f"_b[{i}]*_x{i}" for i in range(k))
        scored = row.withColumn("_b", table.scalar()).selectExpr("*", f"{z} AS _z").selectExpr("*", "1/(1 + exp(-_z)) AS _p")
        got = scored.agg(*[F.expr(s) for s in sums]).first()
        if got["total"] is None:
            raise ValueError("no rows to fit")
        hess = np.zeros((k, k))
        for i, j in pairs:
            hess[i, j] = hess[j, i] = got[f"h{i}_{j}"]
        return np.array([got[f"g{i}"] for i in range(k)]), hess, got["loss"], got["total"]

    beta = np.zeros(k)
    grad, hess, loss, total = at(beta)
    for _ in range(steps):
        if loss < 1e-6 * total:
            raise ValueError("the features separate the events; the fit has no finite coefficients")
        scale = np.sqrt(np.diag(hess))
        if not scale.all() or np.linalg.cond(hess / np.outer(scale, scale)) > 1e13:
            raise ValueError("the features depend on each other; the fit is not unique")
        move = np.linalg.solve(hess, grad)
        if np.all(np.abs(move) <= tol * (1 + np.abs(beta))):
            return [float(b) for b in beta + move]
        for _ in range(30):
            trial = at(beta + move)
            if trial[2] <= loss * (1 + 1e-12):
                break
            move = move / 2
        beta, (grad, hess, loss, total) = beta + move, trial
    raise ValueError("the features separate the events; the coefficients grow without end")
