"""SQL text of small least-squares fits by cofactors: the oracle's own route,
independent of the sweep used on the Spark side."""

from __future__ import annotations


def det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    out = []
    for j, head in enumerate(m[0]):
        minor = [row[:j] + row[j + 1:] for row in m[1:]]
        out.append(("-" if j % 2 else "+") + f"({head})*({det(minor)})")
    return "(" + "".join(out) + ")"


def inverse(m: list[list[str]]) -> list[list[str]]:
    k = len(m)
    if k == 1:
        return [[f"(1/{m[0][0]})"]]
    cof = lambda i, j: det([[m[r][c] for c in range(k) if c != j] for r in range(k) if r != i])
    return [[f"(({'-' if (i + j) % 2 else ''}{cof(j, i)})/dt)" for j in range(k)] for i in range(k)]


def ols_sql(rel: str, y: str, xs: list[str], by: str = "", where: str = "", extra: str = "") -> str:
    """Subquery with by, n, b0, b_x, se_x, t_x, r2, sse for a fit with intercept.
    ``extra`` adds aggregates."""
    k = len(xs)
    group = f"GROUP BY {by}" if by else ""
    lead = by + ", " if by else ""
    cond = " AND ".join(f"{c} IS NOT NULL" for c in [y, *xs]) + (f" AND {where}" if where else "")
    aggs = ["count(*) AS n", f"avg({y}) AS my", f"var_pop({y})*count(*) AS syy"]
    for i, a in enumerate(xs):
        aggs.append(f"avg({a}) AS m{i}")
        aggs.append(f"covar_pop({a}, {y})*count(*) AS s{i}y")
        for j in range(i, k):
            aggs.append(f"covar_pop({a}, {xs[j]})*count(*) AS s{i}{j}")
    if extra:
        aggs.append(extra)
    mat = [[f"s{min(i, j)}{max(i, j)}" for j in range(k)] for i in range(k)]
    inv = inverse(mat)
    ivs = ", ".join(f"{inv[i][j]} AS i{i}{j}" for i in range(k) for j in range(k))
    bs = ", ".join("(" + " + ".join(f"i{i}{j}*s{j}y" for j in range(k)) + f") AS b_{xs[i]}" for i in range(k))
    sse = "syy - (" + " + ".join(f"b_{xs[i]}*s{i}y" for i in range(k)) + ")"
    b0 = "my - (" + " + ".join(f"b_{xs[i]}*m{i}" for i in range(k)) + ")"
    quad = " + ".join(f"m{i}*i{i}{j}*m{j}" for i in range(k) for j in range(k))
    ses = ", ".join(f"CASE WHEN n > {k + 1} THEN sqrt(greatest(sse, 0)/nullif(n-{k + 1}, 0)*i{i}{i}) END AS se_{x}" for i, x in enumerate(xs))
    ts = ", ".join(f"b_{x}/nullif(se_{x}, 0) AS t_{x}" for x in xs)
    return f"""(SELECT *, {ts}, b0/nullif(se0, 0) AS t0, CASE WHEN syy > 1e-12 THEN 1 - sse/syy END AS r2 FROM (
 SELECT *, {ses}, CASE WHEN n > {k + 1} THEN sqrt(greatest(sse, 0)/nullif(n-{k + 1}, 0)*(1.0/n + {quad})) END AS se0 FROM (SELECT *, {sse} AS sse, {b0} AS b0 FROM (SELECT *, {bs} FROM (SELECT *, {ivs} FROM (SELECT *, {det(mat)} AS dt FROM (
 SELECT {lead}{", ".join(aggs)} FROM {rel} WHERE {cond} {group}))))))"""+")"
