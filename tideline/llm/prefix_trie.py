"""Prefix trie of rebuilt conversations by a splitter skeleton.

Every conversation becomes a path: the sequence of its turns' 128-bit keys (MD5 of role and text, with the role's length in
front). Paths are dealt to shards by splitter paths, so a shard holds a contiguous stretch of the sorted order. A trie node whose
members lie in two shards is a prefix of the splitter between them. These nodes, the skeleton, are broadcast; a shard finishes all
its other nodes alone, and gives one partial row per skeleton node, which a reduction combines.

The skeleton has at most ``shards * SPLITTER_TURNS + 1`` nodes. Splitters are pairs (path cut to SPLITTER_TURNS turns, id), so a
conversation that very many ids repeat is split as well. Splitters only balance the work; results do not depend on them.

Defined results: turns are in order of ``turn`` with null first, ties in order of their keys; a null role or text is empty; rows
without a conversation id take no part; repeated rows are turns of their own; an empty table has no node, not even the root; the
base of id ``c`` is ``c - c mod 5`` with a remainder from 0 to 4, also for negative ids. Texts are only hashed and measured where
they are read, so their length does not matter further on. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tideline.llm.frames import staged

KEY_BYTES = 16
SPLITTER_TURNS = 8
SHARD_TURNS = 20_000
MOST_SHARDS = 16_384
SAMPLE_PER_SHARD = 32

NODE = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("parent_conv_id", T.LongType()),
    T.StructField("n_convs", T.LongType()), T.StructField("n_children", T.LongType()), T.StructField("n_leaves", T.LongType()),
    T.StructField("saved_tokens", T.LongType()), T.StructField("ends_sha256", T.StringType()),
])
#: A finished node, or a shard's part of a skeleton node: ``skeleton`` numbers that node, ``parent`` the skeleton node above.
PIECE = T.StructType([*NODE.fields, T.StructField("skeleton", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("n_bytes", T.LongType()), T.StructField("ends", T.StringType())])


def turn_key(role: Column, text: Column) -> Column:
    """128 bits of a turn; the role's length keeps role and text apart."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turns``: every conversation's ordered (key, bytes of the text)."""
    role, text, turn = (F.col(f"`{c}`") for c in (role_col, text_col, turn_col))
    one = F.struct(turn.isNotNull().alias("has"), F.coalesce(turn.cast("long"), F.lit(0)).alias("turn"), turn_key(role, text).alias("key"), F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long").alias("size"))
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), one.alias("one")).filter("conv IS NOT NULL")
    ordered = F.array_sort(F.collect_list("one"))
    return rows.groupBy("conv").agg(F.transform(ordered, lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 5, heads: int = 9, **cols: str) -> DataFrame:
    """``conv, turns`` where the first ``crc32(id) mod heads`` turns come from the first conversation of its family of ids."""
    own = staged(turns_of(conversations, **cols), "turns")
    base = own.filter(F.pmod("conv", F.lit(family)) == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    cut = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    rows = own.withColumn("base", F.col("conv") - F.pmod("conv", F.lit(family))).join(base, "base", "left").withColumn("cut", cut.cast("int"))
    none = F.slice("turns", 1, 0)
    head = F.coalesce(F.expr("slice(head, 1, cut)"), none)
    return rows.select("conv", F.concat(head, F.expr("slice(turns, cut + 1, greatest(size(turns) - cut, 0))")).alias("turns"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path bytes from the arrays of turns."""
    for b in batches:
        turns = b.column(1)
        off = turns.offsets.to_numpy().astype(np.int64)
        inner = turns.values.field("key")
        key = inner.offset * KEY_BYTES
        data = np.frombuffer(inner.buffers()[2], np.uint8)[key:] if len(inner) else np.zeros(0, np.uint8)
        first = np.frombuffer(inner.buffers()[1], np.int32)[inner.offset] if len(inner) else 0
        data = data[first - key :] if len(inner) else data
        path = pa.array([data[a * KEY_BYTES : z * KEY_BYTES].tobytes() for a, z in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), path, pa.ListArray.from_arrays(turns.offsets, turns.values.field("size"))], names=["conv", "path", "sizes"])


def splitters(paths: DataFrame, turns: int) -> list[tuple[bytes, int]]:
    """Borders of the shards: even steps in a bounded sample of (path start, id), drawn by hash."""
    shards = min(MOST_SHARDS, -(-turns // SHARD_TURNS))
    if shards <= 1:
        return []
    many = paths.count()
    share = min(1.0, shards * SAMPLE_PER_SHARD / many)
    drawn = paths.filter(F.xxhash64("conv", F.lit(13)) / 2.0**63 < 2 * share - 1).select(F.expr(f"substring(path, 1, {SPLITTER_TURNS * KEY_BYTES})").alias("path"), "conv")
    sample = sorted((bytes(r["path"]), r["conv"]) for r in drawn.limit(2 * shards * SAMPLE_PER_SHARD).collect())
    return sorted({sample[len(sample) * k // shards] for k in range(1, shards)}) if sample else []


def skeleton_of(borders: list[tuple[bytes, int]]) -> dict[bytes, int]:
    """Number of every prefix of a splitter, the root included."""
    nodes = {b""}
    for path, _ in borders:
        nodes.update(path[: d * KEY_BYTES] for d in range(1, len(path) // KEY_BYTES + 1))
    return {p: k for k, p in enumerate(sorted(nodes))}


def _dealer(borders):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = [bisect.bisect_right(borders.value, row) for row in zip(b.column("path").to_pylist(), b.column("conv").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(where, pa.int32())], names=[*b.schema.names, "shard"])

    return deal


def shard_nodes(conv: list[int], path: list[bytes], sizes: list[list[int]], skeleton: dict[bytes, int], shard: int) -> dict[str, list]:
    """All nodes of one shard, level by level over the sorted paths; skeleton nodes as partial rows."""
    order = sorted(range(len(conv)), key=lambda r: (path[r], conv[r]))
    conv, path, sizes = np.array([conv[r] for r in order], np.int64), [path[r] for r in order], [sizes[r] for r in order]
    length = np.array([len(p) // KEY_BYTES for p in path], np.int64)
    start = np.concatenate([[0], np.cumsum(length)])
    keys = np.frombuffer(b"".join(path), np.uint64).reshape(-1, 2)
    size = np.array([x for s in sizes for x in s], np.int64)

    levels, rows, group = [], np.arange(len(conv)), np.zeros(len(conv), np.int64)
    levels.append({"first": np.zeros(1, np.int64), "parent": np.zeros(1, np.int64), "n": np.array([len(conv)]), "conv": conv.min(keepdims=True), "rows": rows, "group": group, "bytes": np.zeros(1, np.int64)})
    while True:
        d = len(levels)
        keep = length[rows] >= d
        before = np.full(len(conv), -1, np.int64)
        before[rows] = group
        rows, up = rows[keep], group[keep]
        if not len(rows):
            break
        at = start[rows] + d - 1
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1] + 1) | (up[1:] != up[:-1]) | (keys[at[1:]] != keys[at[:-1]]).any(1)
        head = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        levels.append({"first": rows[head], "parent": up[head], "n": np.diff(np.append(head, len(rows))), "conv": np.minimum.reduceat(conv[rows], head), "rows": rows, "group": group, "bytes": size[at[head]]})

    numbers = [np.array([skeleton.get(path[f][: d * KEY_BYTES], -1) for f in lv["first"]], np.int64) if d <= SPLITTER_TURNS else np.full(len(lv["n"]), -1, np.int64) for d, lv in enumerate(levels)]
    for d in range(len(levels) - 1, -1, -1):
        lv, many = levels[d], len(levels[d]["n"])
        kids, leaves, saved = np.zeros(many, np.int64), np.zeros(many, np.int64), np.zeros(many, np.int64)
        if d + 1 < len(levels):
            low, own = levels[d + 1], numbers[d + 1] < 0
            np.add.at(kids, low["parent"][own], 1)
            np.add.at(leaves, low["parent"][own], low["leaves"][own])
            np.add.at(saved, low["parent"][own], low["saved"][own])
        local = numbers[d] < 0
        lv["kids"], lv["leaves"] = kids, np.where(local & (kids == 0), 1, leaves)
        lv["saved"] = saved + np.where(local, (lv["n"] - 1) * lv["bytes"], 0)

    empty = hashlib.sha256(b"").hexdigest()
    out = {f.name: [] for f in PIECE.fields}
    for d, lv in enumerate(levels):
        many, numbered = len(lv["n"]), numbers[d]
        ends = [""] * many
        done = length[lv["rows"]] == d
        done_rows, done_group = lv["rows"][done], lv["group"][done]
        cuts = np.flatnonzero(np.diff(done_group, prepend=-1, append=-1)) if len(done_group) else np.zeros(0, np.int64)
        for a, z in zip(cuts[:-1], cuts[1:]):
            ends[done_group[a]] = ",".join(map(str, conv[done_rows[a:z]].tolist()))
        above = numbers[d - 1][lv["parent"]] if d else np.full(many, -1, np.int64)
        known = levels[d - 1]["conv"][lv["parent"]] if d else np.zeros(many, np.int64)
        local = (numbered < 0).tolist()
        out["conv_id"] += lv["conv"].tolist()
        out["depth"] += [d] * many
        out["parent_conv_id"] += [k if a < 0 and d else None for k, a in zip(known.tolist(), above.tolist())]
        for name, part in (("n_convs", "n"), ("n_children", "kids"), ("n_leaves", "leaves"), ("saved_tokens", "saved"), ("n_bytes", "bytes")):
            out[name] += lv[part].tolist()
        out["ends_sha256"] += [(hashlib.sha256(e.encode()).hexdigest() if e else empty) if own else None for e, own in zip(ends, local)]
        out["skeleton"] += [None if own else k for k, own in zip(numbered.tolist(), local)]
        out["parent"] += [None if a < 0 else a for a in above.tolist()]
        out["shard"] += [shard] * many
        out["ends"] += [None if own else e for e, own in zip(ends, local)]
    return out


_ARROW = pa.schema([pa.field(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64()) for f in PIECE.fields])


def _worker(skeleton):
    def work(key: tuple[pa.Scalar, ...], shard: pa.Table) -> pa.Table:
        found = shard_nodes(shard["conv"].to_pylist(), shard["path"].to_pylist(), shard["sizes"].to_pylist(), skeleton.value, key[0].as_py())
        return pa.table(found, schema=_ARROW)

    return work


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every skeleton node's ids: parts arrive by node and shard, and only the running hash is held."""
    node, digest, begun = None, hashlib.sha256(), False
    done: list[tuple[int, str]] = []
    for b in batches:
        for k, part in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if k != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest, begun = k, hashlib.sha256(), False
            digest.update((("," if begun else "") + part).encode())
            begun = True
    if node is not None:
        done.append((node, digest.hexdigest()))
    yield pa.RecordBatch.from_pydict({"skeleton": [k for k, _ in done], "ends_sha256": [h for _, h in done]}, schema=pa.schema([("skeleton", pa.int64()), ("ends_sha256", pa.string())]))


def _reduced(parts: list[dict], skeleton: dict[bytes, int], ends: dict[int, str]) -> list[tuple]:
    """The finished skeleton nodes, deepest first, from their summed parts."""
    path_of = {k: p for p, k in skeleton.items()}
    have = {r["skeleton"]: dict(r) for r in parts}
    up = {k: skeleton[path_of[k][:-KEY_BYTES]] if path_of[k] else None for k in have}
    empty = hashlib.sha256(b"").hexdigest()
    for k in sorted(have, key=lambda k: -len(path_of[k])):
        me = have[k]
        me["saved_tokens"] += (me["n_convs"] - 1) * me["n_bytes"]
        me["n_leaves"] = me["n_leaves"] if me["n_children"] else 1
        if up[k] is not None:
            above = have[up[k]]
            above["n_children"] += 1
            above["n_leaves"] += me["n_leaves"]
            above["saved_tokens"] += me["saved_tokens"]
    return [(k, me["conv_id"], me["depth"], None if up[k] is None else have[up[k]]["conv_id"], me["n_convs"], me["n_children"], me["n_leaves"], me["saved_tokens"], ends.get(k, empty)) for k, me in have.items()]


def trie_nodes(paths: DataFrame) -> DataFrame:
    """One row per trie node of ``conv, turns`` rows (NODE)."""
    spark = paths.sparkSession
    flat = staged(paths.mapInArrow(_paths, "conv long, path binary, sizes array<long>"), "paths")
    turns = flat.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    borders = splitters(flat, turns)
    skeleton = skeleton_of(borders)
    dealt = flat.mapInArrow(_dealer(spark.sparkContext.broadcast(borders)), "conv long, path binary, sizes array<long>, shard int")
    pieces = staged(dealt.groupBy("shard").applyInArrow(_worker(spark.sparkContext.broadcast(skeleton)), PIECE), "trie")

    own = pieces.filter("skeleton IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = own.groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("n_bytes").alias("n_bytes"), *sums)
    runs = own.filter("ends <> ''").select("skeleton", "shard", "ends").repartition("skeleton").sortWithinPartitions("skeleton", "shard")
    ends = {r[0]: r[1] for r in runs.mapInArrow(_end_hashes, "skeleton long, ends_sha256 string").collect()}
    done = _reduced([r.asDict() for r in parts.collect()], skeleton, ends)
    top = spark.createDataFrame(done, T.StructType([T.StructField("skeleton", T.LongType()), *NODE.fields]))

    names = [f.name for f in NODE.fields]
    above = top.select(F.col("skeleton").alias("parent"), F.col("conv_id").alias("_above"))
    local = pieces.filter("skeleton IS NULL").join(F.broadcast(above), "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    return local.select(*names).unionByName(top.select(*names))


def conversation_trie(conversations: DataFrame, family: int = 5, heads: int = 9, **cols: str) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie_nodes(rebuilt(conversations, family, heads, **cols))
