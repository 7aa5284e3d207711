"""Binning and category codes, written as CASE so the closed side is explicit."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# fixed values: incentive bins, closed on the right
INCENTIVE_EDGES = [-math.inf, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0, math.inf]
INCENTIVE_LABELS = ["<-1.5", "-1.5..-1", "-1..-0.5", "-0.5..0", "0..0.5", "0.5..1", "1..1.5", "1.5..2", ">2"]

# fixed values: mapping buckets, closed on the right
MAPPING_EDGES = [-99.0, -2.5, -1.5, -0.5, 0.5, 1.5, 99.0]
MAPPING_LABELS = ["<=-2.5", "-2.5..-1.5", "-1.5..-0.5", "-0.5..0.5", "0.5..1.5", ">1.5"]

# fixed values: source category codes
PURPOSE_CODES = {"R": 0, "C": 1, "P": 2}
PROPERTY_CODES = {"SF": 0, "PU": 1, "CO": 2, "MH": 3}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bin_case(value, edges: list[float], outputs: list, closed: str) -> Column:
    v = _col(value)
    out = None
    for lo, hi, result in zip(edges[:-1], edges[1:], outputs):
        test = v.isNotNull()
        if not math.isinf(lo):
            test = test & ((v > lo) if closed == "right" else (v >= lo))
        if not math.isinf(hi):
            test = test & ((v <= hi) if closed == "right" else (v < hi))
        out = F.when(test, F.lit(result)) if out is None else out.when(test, F.lit(result))
    return out


def bin_index(value, edges: list[float], closed: str = "right") -> Column:
    """0-based bin number, NULL outside the edges or for NULL input."""
    return _bin_case(value, edges, list(range(len(edges) - 1)), closed)


def bin_label(value, edges: list[float], labels: list[str], closed: str = "right") -> Column:
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    return _bin_case(value, edges, labels, closed)


def incentive_bin(value) -> Column:
    return bin_label(value, INCENTIVE_EDGES, INCENTIVE_LABELS, "right")


def seasoning_group(age) -> Column:
    """0 under 60 months, 60, 120; -1 for missing or negative age."""
    a = _col(age)
    return (
        F.when(a.isNull() | (a < 0), F.lit(-1))
        .when(a < 60, F.lit(0))
        .when(a < 120, F.lit(60))
        .otherwise(F.lit(120))
    )


def encode_category(value, codes: dict[str, int], default: float = 0.0) -> Column:
    """Known code to number; anything else, NULL included, to the default."""
    v = _col(value)
    out = F.lit(float(default))
    for code, number in reversed(list(codes.items())):
        out = F.when(v == code, F.lit(float(number))).otherwise(out)
    return out
