"""Token ids as Simple-8b words in binary files.

A file is a row of blocks, each closed by a line feed. All numbers are little-endian.

    magic "S8B1" | documents u32 | ids u32 | distinct u32 | words u32 | frames u32 | flags u32 | crc32 of the rest u32
    document ids i64 x documents | null marks u8 x documents | ids of each document u32 x documents
    distinct ids u32 x distinct, most frequent first
    word offset of each frame u32 x (frames + 1)
    words u64 x words

An id is written as its rank among the block's distinct ids, so frequent ids need few bits. Ranks lie in frames of FRAME; a
word holds a selector in its top four bits and as many ranks of one width as fit below. Selector 0 is the escape: the next
word is one value of more than 60 bits. Frames start at known words, so all of them are packed and unpacked side by side.

Files are written by Spark's own text writer (one row per block) and so appear only when their task commits; they are read back
as whole binary files.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window as W

from tideline.llm import textbatch as tb
from tideline.llm.frames import staged, texts
from tideline.llm.segments import Encoder

MAGIC = b"S8B1"
HEAD = struct.Struct("<4s7I")
FRAME = 1024
#: Fixed values: (ranks in a word, bits of each) by selector; 0 is the escape.
LAYOUT = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
LOW = np.uint64((1 << 60) - 1)
BLOCKS_PER_FILE = 32


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    out = np.zeros(values.shape, np.uint8)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= (np.uint64(1) << np.uint64(step))
        out[big] += np.uint8(step)
        rest[big] >>= np.uint64(step)
    return out + (rest > 0).astype(np.uint8)


def _choices(width: np.ndarray) -> np.ndarray:
    """The selector that holds most values from each place on; places after a frame's end have width 0."""
    best = np.where(width > 60, 0, 15).astype(np.uint8)
    reach, size, have = width, 1, {1: width}
    for selector in range(14, 0, -1):
        n, bits = LAYOUT[selector]
        while size < n:
            add = max(k for k in have if k <= n - size)
            other = np.zeros_like(width)
            other[:, : width.shape[1] - size] = have[add][:, size:]
            reach = np.maximum(reach, other)
            size += add
            have[size] = reach
        fits = reach <= bits
        if not fits.any():
            break
        best[fits] = selector
    return best


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word at which each frame begins (with the end)."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    frames = -(-n // FRAME)
    if not frames:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    grid = np.zeros((frames, FRAME + 120), np.uint64)
    flat = np.zeros(frames * FRAME, np.uint64)
    flat[:n] = values
    grid[:, :FRAME] = flat.reshape(frames, FRAME)
    best = _choices(_widths(grid))
    room = np.full(frames, FRAME)
    room[-1] = n - (frames - 1) * FRAME
    counts = np.array([c for c, _ in LAYOUT])
    at, frame, taken = np.zeros(frames, np.int64), np.arange(frames), []
    while len(frame):
        chosen = best[frame, at[frame]]
        taken.append((frame, at[frame].copy(), chosen))
        at[frame] += counts[chosen]
        frame = frame[at[frame] < room[frame]]
    frame, place, chosen = (np.concatenate(x) for x in zip(*taken))
    order = np.lexsort((place, frame))
    frame, place, chosen = frame[order], place[order], chosen[order]
    slots = 1 + (chosen == 0)
    end = np.cumsum(slots)
    where = end - slots
    words = np.zeros(int(end[-1]), np.uint64)
    for selector, (count, bits) in enumerate(LAYOUT):
        mine = np.flatnonzero(chosen == selector)
        if not len(mine):
            continue
        if selector == 0:
            words[where[mine] + 1] = grid[frame[mine], place[mine]]
            continue
        word = np.full(len(mine), selector << 60, np.uint64)
        for k in range(count if bits else 0):
            word |= grid[frame[mine], place[mine] + k] << np.uint64(k * bits)
        words[where[mine]] = word
    return words, np.append(where[np.searchsorted(frame, np.arange(frames))], len(words))


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values again."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    plain = np.ones(len(words), bool)
    if (selector == 0).any():  # a raw word may look like anything, so walk over the escapes
        i = 0
        while i < len(words):
            step = 2 if selector[i] == 0 else 1
            if step == 2:
                plain[i + 1] = False
            i += step
    head = np.flatnonzero(plain)
    count = np.array([c for c, _ in LAYOUT])[selector[head]]
    before = np.cumsum(count) - count
    frame = np.searchsorted(offsets, head, "right") - 1
    first = before[np.searchsorted(head, offsets[:-1])]
    place = before - first[frame] + frame * FRAME
    stop = np.minimum((frame + 1) * FRAME, n)
    for kind, (size, bits) in enumerate(LAYOUT):
        mine = np.flatnonzero(selector[head] == kind)
        if not len(mine) or (kind and not bits):
            continue
        if kind == 0:
            out[place[mine]] = words[head[mine] + 1]
            continue
        low = np.uint64((1 << bits) - 1)
        for k in range(size):
            inside = mine[place[mine] + k < stop[mine]]
            out[place[inside] + k] = (words[head[inside]] >> np.uint64(k * bits)) & low
    return out


def block(doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One block from the ids of some documents, one after another."""
    counts = np.bincount(ids) if len(ids) and int(ids.max()) < 1 << 24 else None
    if counts is None:
        distinct, inverse, seen = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-seen, kind="stable")
        distinct, rank = distinct[order], np.argsort(order, kind="stable")[inverse]
    else:
        present = np.flatnonzero(counts)
        distinct = present[np.argsort(-counts[present], kind="stable")]
        table = np.zeros(len(counts), np.uint32)
        table[distinct] = np.arange(len(distinct))
        rank = table[ids]
    words, offsets = pack(rank)
    parts = [doc_ids.astype("<i8"), null.astype("u1"), lengths.astype("<u4"), distinct.astype("<u4"), offsets.astype("<u4"), words.astype("<u8")]
    body = b"".join(p.tobytes() for p in parts)
    return HEAD.pack(MAGIC, len(doc_ids), len(ids), len(distinct), len(words), len(offsets) - 1, 0, zlib.crc32(body)) + body


def blocks(content: bytes):
    """Document ids, null marks, lengths and ids of every block of a file."""
    at = 0
    while at < len(content):
        magic, docs, n, distinct, words, frames, _, crc = HEAD.unpack_from(content, at)
        size = docs * 13 + distinct * 4 + (frames + 1) * 4 + words * 8
        body = content[at + HEAD.size : at + HEAD.size + size]
        if magic != MAGIC or len(body) != size or zlib.crc32(body) != crc:
            raise ValueError("not a whole Simple-8b block")
        taken = 0

        def part(kind, many):
            nonlocal taken
            out = np.frombuffer(body, kind, many, taken)
            taken += out.nbytes
            return out

        ids, null, lengths, values, offsets = part("<i8", docs), part("u1", docs), part("<u4", docs), part("<u4", distinct), part("<u4", frames + 1)
        yield ids, null, lengths, values[unpack(part("<u8", words), offsets.astype(np.int64), n).astype(np.int64)]
        at += HEAD.size + size + 1


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all documents to ``path`` in ascending order of the id (nulls first), each ended by ``end_id``.

    A null or empty text is the end id alone. Of repeated ids every row is kept, ordered by a hash of the text. One range
    shuffle of the texts; what a task holds is one chunk of them.
    """
    source = texts(docs, id_col, text_col)
    source = source.select(F.col("_id").cast("long").alias("_id"), "_text", F.xxhash64("_text").alias("_tie"))
    ordered = source.repartitionByRange("_id", "_tie").sortWithinPartitions("_id", "_tie").select("_id", "_text")

    def work(batches):
        encoder = encoder_of(vocabulary)
        for batch in batches:
            for lo, hi, buf, off in tb.chunks(batch.column(1)):
                ids, begin = encoder.encode(buf, off)
                own = batch.column(0).slice(lo, hi - lo)
                null = np.asarray(own.is_null())
                payload = block(np.asarray(own.fill_null(0)), null, np.insert(ids, begin[1:], np.uint32(end_id)), np.diff(begin) + 1)
                yield pa.RecordBatch.from_arrays([pa.array([payload], pa.binary())], names=["payload"])

    rows = ordered.mapInArrow(work, "payload binary").select(F.col("payload").cast("string").alias("value"))
    rows.write.option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path)


def token_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: ``part`` and ``piece`` (the file's order), ``row`` in it, ``doc_id`` and ``ids`` (binary, little-endian u32)."""
    schema = "part long, piece long, row long, doc_id long, ids binary"

    def rows(part, piece, ids, null, lengths, values, first):
        ends = np.cumsum(lengths.astype(np.int64))
        raw = values.astype("<u4").tobytes()
        many = len(ids)
        cells = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(np.full(many, part)), pa.array(np.full(many, piece)), pa.array(first + np.arange(many)), pa.array(ids, mask=null.astype(bool)), pa.array(cells, pa.binary())], names=["part", "piece", "row", "doc_id", "ids"])

    return _files(spark, path).mapInArrow(_each_block(rows), schema)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: ``part``, ``piece``, ``row``, ``doc_id``, ``n_tokens``, ``before`` (ids before it in its file) and ``ids_crc32``."""
    schema = "part long, piece long, row long, doc_id long, n_tokens long, before long, ids_crc32 long"

    def work(batches):
        at: dict[tuple[int, int], int] = {}

        def rows(part, piece, ids, null, lengths, values, first):
            lengths = lengths.astype(np.int64)
            ends = np.cumsum(lengths)
            raw = memoryview(values.astype("<u4").tobytes())
            crc = np.fromiter((zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())), np.int64, len(ids))
            base = at.get((part, piece), 0)
            at[part, piece] = base + int(lengths.sum())
            many = len(ids)
            return pa.RecordBatch.from_arrays([pa.array(np.full(many, part)), pa.array(np.full(many, piece)), pa.array(first + np.arange(many)), pa.array(ids, mask=null.astype(bool)), pa.array(lengths), pa.array(base + ends - lengths), pa.array(crc)], names=["part", "piece", "row", "doc_id", "n_tokens", "before", "ids_crc32"])

        yield from _each_block(rows)(batches)

    return _files(spark, path).mapInArrow(work, schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    name = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    piece = F.regexp_extract("path", r"-c(\d+)\.", 1).cast("long")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(name.alias("part"), piece.alias("piece"), "content")


def _each_block(rows):
    def work(batches):
        for batch in batches:
            for part, piece, content in zip(*(c for c in batch.columns)):
                first = 0
                for ids, null, lengths, values in blocks(content.as_buffer().to_pybytes()):
                    yield rows(part.as_py(), piece.as_py(), ids, null, lengths, values, first)
                    first += len(ids)

    return work


def document_starts(digests: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before this one, over all files. The running sum goes over one row per file."""
    files = digests.groupBy("part", "piece").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return digests.join(files.select("part", "piece", before.alias("_base")), ["part", "piece"]).withColumn("start", F.col("_base") + F.col("before")).drop("_base")


def token_file_digests(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to ``path``, read them back, and return ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document."""
    write_token_files(docs, path, vocabulary, end_id, id_col, text_col)
    spark = docs.sparkSession
    return document_starts(staged(token_digests(spark, path), "token-digests")).select(F.col("doc_id").alias(id_col), "start", "n_tokens", "ids_crc32")


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
