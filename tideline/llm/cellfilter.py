"""A bitmap of fixed size over hashes: what it does not hold was not put in, whatever the number of hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

_BUCKET_BITS = 32_768  # of Spark's bitmap functions


def cell_of(hashed: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of 64-bit hashes."""
    return (np.asarray(hashed).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def collected_bits(rows: DataFrame, hashed: Column, bits: int) -> np.ndarray:
    """The bitmap of all hashes of the rows, ``2 ** bits`` bits; Spark builds it bucket by bucket, so the driver gets no more."""
    cell = F.shiftrightunsigned(hashed, 64 - bits) + 1
    buckets = rows.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits"))
    out = np.zeros(max(1 << bits, _BUCKET_BITS) // 8, np.uint8)
    for r in buckets.collect():
        at = (r["bucket"] - 1) * _BUCKET_BITS // 8
        out[at : at + _BUCKET_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def holds(bitmap: np.ndarray, hashed: np.ndarray, bits: int) -> np.ndarray:
    """Whether the cell of each hash is set."""
    cell = cell_of(hashed, bits)
    return (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
