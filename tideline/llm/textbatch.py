"""Vectorised work on the UTF-8 bytes of a batch of texts.

A batch is one byte buffer and the offsets of its texts, as Arrow holds them, so words, lines and their hashes are found for
many texts by a few numpy calls. Hashes have 64 bits; two different words, lines or shingles of one batch share one with a
probability below 1e-6 for a million of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
CHUNK_BYTES = 1 << 20

_M1, _M2, _BASE = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 output bits."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _folded() -> np.ndarray:
    table = _CODES.copy()
    table[65:91] = _CODES[97:123]
    return table


FOLDED = _folded()
EXACT = _CODES


def flags(members: bytes) -> np.ndarray:
    """A table over bytes: 1 for the members."""
    out = np.zeros(256, np.uint8)
    out[list(members)] = 1
    return out


SPACE = flags(b" \t\n\x0b\x0c\r")
LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.uint8)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and int64 offsets of an Arrow string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: first row, end row, bytes, offsets from 0."""
    buf, off = column_bytes(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true bytes; a run never crosses a text's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = ~inside
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    after[-1], after[:-1] = True, gap[1:]
    edge = off[(off > 0) & (off < n)]
    before[edge], after[edge - 1] = True, True
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes other than ASCII white space."""
    return runs(SPACE[buf] == 0, off)


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes other than \\n: the \\n-split lines that are not empty."""
    return runs(buf != 10, off)


def owner(off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The text in which each start lies."""
    return np.searchsorted(off, starts, "right") - 1


def bounds(off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of each text's first span, and the number of spans at the end."""
    return np.searchsorted(starts, off, "left")


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_ODD = 0x5851F42D4C957F2D | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_ODD, _INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            np.cumprod(table, out=table)
            if n <= 2 * SLICE_BYTES:
                _POWERS[i] = table
            else:
                return _long_powers(n)
    return _POWERS[0][:n], _POWERS[1][:n]


def _long_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For a single span beyond a slice; not kept."""
    out = []
    for base in (_ODD, _INVERSE):
        table = np.full(n, base, np.uint64)
        table[0] = 1
        out.append(np.cumprod(table, dtype=np.uint64))
    return out[0], out[1]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = EXACT) -> np.ndarray:
    """A 64-bit hash of each span's bytes, taken from running sums over slices of the buffer."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
        a, b = starts[i], ends[j - 1]
        up, down = _powers(int(b - a) + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(codes[buf[a:b]] * up[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def per_text(marks: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of the marks of each text."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, dtype=np.int64, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def windows(word_hash: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and text of every window of ``size`` words that lies in one text."""
    n = len(word_hash) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value = mix(value * np.uint64(_BASE) + word_hash[k : k + n])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    whole = np.arange(n) + size <= first[1:][text]
    at = np.flatnonzero(whole)
    return value[at], at, text[at]
