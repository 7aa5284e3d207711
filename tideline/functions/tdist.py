"""Student's t distribution as column expressions: the regularised incomplete beta function by its continued fraction."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Steps of the fraction; it settles in a small multiple of the root of the degrees of freedom.
FRACTION_STEPS = 400


def log_gamma(z: str) -> str:
    """Stirling's series at z + 10, stepped back by the product of the ten factors; z > 0."""
    w = f"({z} + 10)"
    series = f"1/(12*{w}) - 1/(360*pow({w}, 3)) + 1/(1260*pow({w}, 5)) - 1/(1680*pow({w}, 7))"
    steps = "*".join(f"({z} + {i})" for i in range(10))
    return f"(({w} - 0.5D)*ln({w}) - {w} + 0.9189385332046728D + {series} - ln({steps}))"


def with_p_value(df: DataFrame, t: str, dof: str, name: str = "p") -> DataFrame:
    """Adds the two-sided p-value of the statistic ``t`` with ``dof`` degrees of freedom (SQL expressions).

    NULL for a NULL statistic or fewer than one degree. The fraction runs on the side where it converges fast; both tails keep
    their relative precision because x and 1 - x are formed from t directly.
    """
    named = [c for c in df.columns if c != name]
    out = df.selectExpr(*[f"`{c}`" for c in named], f"CAST({t} AS DOUBLE) AS _t", f"IF({dof} >= 1, CAST({dof} AS DOUBLE), NULL) AS _n")
    out = out.selectExpr("*", "_n/(_n + _t*_t) AS _x", "_t*_t/(_n + _t*_t) AS _y").selectExpr("*", "_x >= (_n/2 + 1)/(_n/2 + 2.5D) AS _turn")
    out = out.selectExpr("*", "IF(_turn, 0.5D, _n/2) AS _a", "IF(_turn, _n/2, 0.5D) AS _b", "IF(_turn, _y, _x) AS _u", "IF(_turn, _x, _y) AS _v")
    even, odd = "m*(_b - m)*_u/((_a + 2*m - 1)*(_a + 2*m))", "-(_a + m)*(_a + _b + m)*_u/((_a + 2*m)*(_a + 2*m + 1))"
    next_d, next_c = "1/(1 + q*r.d)", "(1 + q/r.c)"
    half = f"(r, q) -> named_struct('c', {next_c}, 'd', {next_d}, 'h', r.h*{next_d}*{next_c})"
    first = "1/(1 - (_a + _b)*_u/(_a + 1))"
    fraction = f"aggregate(sequence(1, {FRACTION_STEPS}), named_struct('c', 1D, 'd', {first}, 'h', {first}), (s, m) -> aggregate(array({even}, {odd}), s, {half})).h"
    front = f"exp(_a*ln(_u) + _b*ln(_v) + {log_gamma('(_a + _b)')} - {log_gamma('_a')} - {log_gamma('_b')})/_a"
    out = out.selectExpr("*", f"IF(_u = 0, 0D, IF(_v = 0, 1D, {front}*{fraction})) AS _i")
    return out.selectExpr(*[f"`{c}`" for c in named], f"IF(_turn, 1 - _i, _i) AS {name}")
