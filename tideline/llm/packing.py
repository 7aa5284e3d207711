"""Packing documents into windows by Karmarkar-Karp multiway differencing.

Documents are cut into pieces: as many full windows as they fill, and a rest, itself cut at ``grain`` so that no piece of a
shared window is long. Full pieces are windows of their own. The rests are dealt to groups by a hash of the document id, and in
each group to batches of about ``BATCH_WINDOWS`` windows. A batch of n pieces for k windows starts as n partial partitions with
one piece in one of k bins; the two partitions with the largest spread are merged again and again, the fullest bins of one onto
the emptiest of the other, until one partition is left. If its fullest bin exceeds the window, k rises by one and the
differencing starts anew, so bins are near equal and none is too full.

Null and empty texts are the end id alone. Repeated rows are packed as often as they come.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tideline.llm import textbatch as tb
from tideline.llm.frames import texts
from tideline.llm.simple8b import encoder_of

BATCH_WINDOWS = 48
DOCS_PER_GROUP = 512


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of the sizes in each of ``k`` bins with near-equal sums (largest differencing method for k parts)."""
    zero = np.zeros(k, np.int64)
    states, heap = [], []
    for i, size in enumerate(sizes):
        sums = zero.copy()
        sums[-1] = size
        states.append((sums, {k - 1: [i]}))
        heapq.heappush(heap, (-size, i))
    if not states:
        return [[] for _ in range(k)]
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (left, left_bins), (right, right_bins) = states[a], states[b]
        states[a] = states[b] = None
        joined = left + right[::-1]
        order = np.argsort(joined, kind="stable")
        place = np.empty(k, np.int64)
        place[order] = np.arange(k)
        bins: dict[int, list[int]] = {int(place[i]): list(v) for i, v in left_bins.items()}
        for i, v in right_bins.items():
            bins.setdefault(int(place[k - 1 - i]), []).extend(v)
        joined = joined[order]
        spread = int(joined[-1] - joined[0])
        states.append((joined, bins))
        heapq.heappush(heap, (-spread, len(states) - 1))
    _, bins = states[heap[0][1]]
    return [bins.get(i, []) for i in range(k)]


def balanced_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of near-equal sums, none above the capacity; no size exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        bins = differencing(sizes, k)
        if max(sum(sizes[i] for i in b) for b in bins) <= capacity:
            return [b for b in bins if b]
        k += 1


def batches_of(sizes: np.ndarray, capacity: int, windows: int = BATCH_WINDOWS) -> list[np.ndarray]:
    """Consecutive runs of pieces that fill about ``windows`` windows, the last ones evened out."""
    total = int(sizes.sum())
    many = max(1, round(total / (capacity * windows)))
    mark = np.minimum((np.cumsum(sizes) - sizes) * many // max(1, total), many - 1)
    return [np.flatnonzero(mark == m) for m in range(many) if (mark == m).any()]


def cut_pieces(tokens: int, capacity: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    full, rest = divmod(tokens, capacity)
    out = [(i * capacity, capacity) for i in range(full)]
    if rest:
        parts = -(-rest // grain)
        marks = [full * capacity + rest * i // parts for i in range(parts + 1)]
        out += [(a, b - a) for a, b in zip(marks, marks[1:])]
    return out


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, grain: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: ``_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and ``ids`` (binary, little-endian u32)."""
    source = texts(docs, id_col, text_col)
    schema = T.StructType([T.StructField("_id", source.schema["_id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")] + [T.StructField("ids", T.BinaryType())])

    def work(batches):
        encoder = encoder_of(vocabulary)
        for batch in batches:
            for lo, hi, buf, off in tb.chunks(batch.column(1)):
                ids, begin = encoder.encode(buf, off)
                raw = np.insert(ids, begin[1:], np.uint32(end_id)).astype("<u4").tobytes()
                begin = (begin + np.arange(len(begin))).tolist()
                row, start, length, cells, crc, tokens = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(begin, begin[1:])):
                    for s, n in cut_pieces(b - a, capacity, grain):
                        cell = raw[4 * (a + s) : 4 * (a + s + n)]
                        row.append(i), start.append(s), length.append(n), cells.append(cell), crc.append(zlib.crc32(cell)), tokens.append(b - a)
                own = batch.column(0).slice(lo, hi - lo).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens)), pa.array(cells, pa.binary())], names=schema.names)

    return source.mapInArrow(work, schema)


def packed_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, grain: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where every piece goes: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``.

    The texts are read once and never shuffled; only a narrow row of each piece is. The number of groups follows the number of
    documents, so a group has about ``DOCS_PER_GROUP`` of them at any size, and the plan of a group depends on nothing else.
    """
    groups = max(1, -(-docs.count() // DOCS_PER_GROUP))
    pieces = token_pieces(docs, vocabulary, end_id, capacity, grain, id_col, text_col).drop("ids")
    numeric = not isinstance(pieces.schema["_id"].dataType, T.StringType)  # pandas has no null in a column of integers
    pieces = pieces.select(F.col("_id").isNull().alias("_null"), (F.coalesce("_id", F.lit(0)) if numeric else F.col("_id")).cast(pieces.schema["_id"].dataType).alias("_id"), *pieces.columns[1:])
    pieces = pieces.withColumn("_group", F.pmod(F.xxhash64("_id", "start", "ids_crc32"), F.lit(groups)))
    schema = T.StructType([f for f in pieces.schema.fields if f.name != "_group"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop(columns="_group").sort_values(["_null", "_id", "start", "ids_crc32", "length"], kind="stable").reset_index(drop=True)
        size = frame["length"].to_numpy()
        sequence, offset, made = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64), 0
        full = np.flatnonzero(size == capacity)
        sequence[full] = np.arange(len(full))
        made = len(full)
        rest = np.flatnonzero(size < capacity)
        for mine in batches_of(size[rest], capacity) if len(rest) else []:
            rows = rest[mine]
            for window in balanced_windows(size[rows].tolist(), capacity):
                at = rows[window]
                sequence[at] = made
                offset[at] = np.cumsum(size[at]) - size[at]
                made += 1
        frame["sequence_id"] = (int(key[0]) << 32) + sequence
        frame["offset"] = offset
        return frame

    packed = pieces.groupBy("_group").applyInPandas(pack, schema)
    return packed.select(F.when(~F.col("_null"), F.col("_id")).alias(id_col), *packed.columns[2:])


def packed_windows(docs: DataFrame, plan: DataFrame, vocabulary: str, end_id: int, pad_id: int, capacity: int = 1024, grain: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The windows themselves: ``sequence_id``, ``n_tokens`` and ``ids`` (array, padded to the capacity unless its length is a power of two).

    Ids must be unique here. One shuffle by (id, start) brings the ids of a piece to its place; a window holds at most
    ``capacity`` pieces.
    """
    ids = token_pieces(docs, vocabulary, end_id, capacity, grain, id_col, text_col).select(F.col("_id").alias(id_col), "start", "ids")
    rows = plan.select(id_col, "start", "sequence_id", "offset", "length").join(ids, [id_col, "start"])
    window = rows.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_pieces"))
    hexes = F.concat_ws("", F.transform("_pieces", lambda p: F.hex(p["ids"])))
    ids_of = F.transform(F.sequence(F.lit(0), (F.col("n_tokens") - 1).cast("int")), lambda i: _u32(hexes, i))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1)
    padded = F.concat(ids_of, F.array_repeat(F.lit(pad_id), (F.lit(capacity) - F.col("n_tokens")).cast("int")))
    return window.select("sequence_id", "n_tokens", F.when(power == 0, ids_of).otherwise(padded).alias("ids"))


def _u32(hexes, i):
    """The i-th little-endian number of a hex string."""
    byte = lambda k: F.substring(hexes, i * 8 + 2 * k + 1, F.lit(2))
    return F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("int")
