"""Portable hash sampling: the same id always gets the same number in [0, 1)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unit_hash(value, seed: int | str = 42) -> Column:
    """52 bits of md5 over ``id|seed`` scaled to [0, 1).

    It depends on nothing but the id and the seed, so a re-run, a retried task
    or another engine draws the same sample.
    """
    c = F.col(value) if isinstance(value, str) else value
    digest = F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def poisson_weight(value, seed, max_count: int = 18) -> Column:
    """Poisson(1) replication count by inverse CDF of the hash: bootstrap weights
    that need no shuffle and are the same on every retry. Beyond ``max_count`` = 18
    the tail (below 1e-17) is finer than the 52 bits of the hash."""
    u = unit_hash(value, 0) if seed is None else _seeded(value, seed)
    cdf, term, total = [], 1.0, 0.0
    import math

    p = math.exp(-1.0)
    for k in range(max_count):
        total += p
        cdf.append(total)
        p /= k + 1
    out = F.lit(max_count)
    for k in range(max_count - 1, -1, -1):
        out = F.when(u < cdf[k], F.lit(k)).otherwise(out)
    return out


def _seeded(value, seed) -> Column:
    if isinstance(seed, Column):
        c = F.col(value) if isinstance(value, str) else value
        digest = F.md5(F.concat(c.cast("string"), F.lit("|"), seed.cast("string")))
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return unit_hash(value, seed)
