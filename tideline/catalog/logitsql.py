"""SQL text of logistic fits: Newton steps as a chain of one-row tables, each
solved by elimination. The oracle's own route, apart from the Spark side."""

from __future__ import annotations


def solve_sql(rel: str, k: int) -> str:
    """SELECT x0..x{k-1} from one row of a symmetric system a{i}_{j} (i <= j), r{i}."""
    q = f"SELECT * FROM {rel}"
    for p in range(k):
        cols = [f"a{i}_{j}" for i in range(p + 1) for j in range(i, k)] + [f"r{i}" for i in range(p + 1)]
        for i in range(p + 1, k):
            cols += [f"a{i}_{j} - a{p}_{i}/a{p}_{p}*a{p}_{j} AS a{i}_{j}" for j in range(i, k)] + [f"r{i} - a{p}_{i}/a{p}_{p}*r{p} AS r{i}"]
        q = f"SELECT {', '.join(cols)} FROM ({q})"
    for p in reversed(range(k)):
        rest = "".join(f" - a{p}_{j}*x{j}" for j in range(p + 1, k))
        q = f"SELECT *, (r{p}{rest})/a{p}_{p} AS x{p} FROM ({q})"
    return f"SELECT {', '.join(f'x{i}' for i in range(k))} FROM ({q})"


def logit_ctes(rel: str, xs: list[str], name: str, steps: int = 12, weight: str = "w") -> str:
    """CTEs name0..name{steps} with b0..bk; ``rel`` has y, the weight and xs."""
    k = len(xs) + 1
    x = ["1.0", *xs]
    out = [f"{name}0 AS (SELECT {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(k))})"]
    for s in range(1, steps + 1):
        z = " + ".join(["b0"] + [f"b{i}*{c}" for i, c in enumerate(xs, 1)])
        sums = [f"sum({weight}*(y-p)*{x[i]}) AS r{i}" for i in range(k)]
        sums += [f"sum({weight}*p*(1-p)*{x[i]}*{x[j]}) AS a{i}_{j}" for i in range(k) for j in range(i, k)]
        out.append(f"{name}{s}s AS MATERIALIZED (SELECT {', '.join(sums)} FROM (SELECT r.*, 1/(1+exp(-({z}))) AS p FROM {rel} r, {name}{s - 1}))")
        out.append(f"{name}{s} AS MATERIALIZED (SELECT {', '.join(f'b{i} + x{i} AS b{i}' for i in range(k))} FROM {name}{s - 1}, ({solve_sql(f'{name}{s}s', k)}))")
    return ",\n".join(out)
