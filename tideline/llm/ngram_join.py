"""Jaccard self-join of word shingles with a count-vector R-tree.

A document's distinct shingles are hashed into GROUPS groups; the counts of the groups are a point. The overlap of two sets is at
most the sum of the smaller counts, group by group, and for all points below a tree node at most the sum of the smaller of the
point and the node's upper corner. A search walks down only where that sum can still reach the overlap that the sizes ask for;
the pairs that are left are verified on the sets themselves.

Work is spread so that no link is lost and no task meets all points:

1. Equal sets become one node (64-bit set digest), with partial aggregation.
2. Counts of all shingles in a sketch of fixed size say which are frequent. A node's prefix is its rarest
   ``n - ceil(0.8 n) + 1`` shingles: two linked nodes share one of them, because both rank shingles alike.
3. First round: nodes that share one of four minimal hashes fall into blocks; one tree per block finds and verifies links, and a
   union-find skips pairs already joined, so a group of thousands of near copies costs about one verification each.
4. Second round, for completeness: only prefix shingles whose nodes are still in different components count. Trees over the
   nodes of one shingle give the remaining pairs, which are verified. Shingles with many nodes are cut into blocks, and every
   pair of blocks is searched.

Documents without words have no shingles and link with nothing. Fewer words than a shingle are one shingle. Null ids get the
component of equal texts with an id, or null. Repeated rows are copies.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from tideline.llm import textbatch as tb
from tideline.llm.components import components
from tideline.llm.frames import staged, texts

SKETCH_BITS = 20
SKETCH_PARTS = 64
SKETCH_SHARES = 1024
GROUPS = 256
LEAF = 16
BLOCK = 2048
BRIDGES = 64
#: Counts are kept in 16 bits; larger sets pass every bound and go straight to verification.
MOST_COUNTED = (1 << 16) - 1
#: J = part / whole; two sets link when WHOLE * overlap >= PART * union.
PART, WHOLE = 80, 100


# --- sets of shingles -------------------------------------------------------------------------------------------------


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending, and where each text's begin."""
    starts, ends = tb.words(buf, off)
    word = tb.hashes(buf, starts, ends, tb.FOLDED)
    first = tb.bounds(off, starts)
    value, _, text = tb.windows(word, first, size)
    many = np.diff(first)
    short = np.flatnonzero((many > 0) & (many < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            on = many[short] > k
            whole[on] = tb.mix(whole[on] * np.uint64(tb._BASE) + word[first[short[on]] + k])
        value = np.concatenate([value, tb.mix(whole + many[short].astype(np.uint64))])
        text = np.concatenate([text, short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(off)))


def digests(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set; 0 for the empty one."""
    return tb.mix(_sums(tb.mix(value), begin) + np.diff(begin).astype(np.uint64)) * (np.diff(begin) > 0)


def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return total[begin[1:]] - total[begin[:-1]]


def bucket(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


# --- the tree ---------------------------------------------------------------------------------------------------------


class CountTree:
    """An R-tree over count vectors, built from the top by halving along the widest coordinate.

    A node keeps its upper corner and the smallest and largest set size below it.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.order = np.arange(len(sizes))
        nodes: list[tuple[int, int, int, int]] = []  # first, end, left child, right child
        todo = [(0, len(sizes), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            me = len(nodes)
            nodes.append((lo, hi, -1, -1))
            if parent >= 0:
                a, b, left, right = nodes[parent]
                nodes[parent] = (a, b, me, right) if left < 0 else (a, b, left, me)
            if hi - lo > LEAF:
                mine = self.order[lo:hi]
                x = np.concatenate([points[mine], sizes[mine, None]], axis=1)
                axis = int(np.argmax(x.max(0).astype(np.int64) - x.min(0)))
                self.order[lo:hi] = mine[np.argsort(x[:, axis], kind="stable")]
                middle = (lo + hi) // 2
                todo += [(lo, middle, me), (middle, hi, me)]
        self.span = np.array([n[:2] for n in nodes])
        self.child = np.array([n[2:] for n in nodes])
        self.high = np.stack([points[self.order[a:b]].max(0) for a, b in self.span])
        self.least = np.array([sizes[self.order[a:b]].min() for a, b in self.span])
        self.most = np.array([sizes[self.order[a:b]].max() for a, b in self.span])

    def _open(self, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        size = self.sizes[q]
        near = (WHOLE * self.most[node] >= PART * size) & (PART * self.least[node] <= WHOLE * size)
        q, node, size = q[near], node[near], size[near]
        bound = np.minimum(self.points[q], self.high[node]).sum(1, dtype=np.int64)
        keep = ((WHOLE + PART) * bound >= PART * (size + self.least[node])) | (size > MOST_COUNTED)
        at = np.flatnonzero(near)
        return at[keep]

    def candidates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, other point) that the bound lets pass, with the bound."""
        found = []
        for at in range(0, len(queries), 128):
            q = queries[at : at + 128]
            node = np.zeros(len(q), np.int64)
            while len(q):
                keep = self._open(q, node)
                q, node = q[keep], node[keep]
                leaf = self.child[node, 0] < 0
                if leaf.any():
                    lo, hi = self.span[node[leaf]].T
                    many = hi - lo
                    one = np.repeat(q[leaf], many)
                    other = self.order[np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)]
                    found.append(self._pairs(one[one != other], other[one != other]))
                q, node = np.repeat(q[~leaf], 2), self.child[node[~leaf]].ravel()
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found))

    def _pairs(self, a: np.ndarray, b: np.ndarray):
        near = can_link(self.sizes[a], self.sizes[b])
        a, b = a[near], b[near]
        bound, keep = bounded(self.points, self.sizes, a, b)
        return a[keep], b[keep], bound[keep]


def bounded(points: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the smaller counts of pairs of points, and which pairs may still link."""
    bound = np.empty(len(a), np.int64)
    for at in range(0, len(a), 32768):
        bound[at : at + 32768] = np.minimum(points[a[at : at + 32768]], points[b[at : at + 32768]]).sum(1, dtype=np.int64)
    return bound, ((WHOLE + PART) * bound >= PART * (sizes[a] + sizes[b])) | (np.maximum(sizes[a], sizes[b]) > MOST_COUNTED)


def can_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return WHOLE * np.minimum(a, b) >= PART * np.maximum(a, b)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test on two ascending sets."""
    both = np.concatenate([a, b])
    both.sort()
    overlap = int((both[1:] == both[:-1]).sum())
    return WHOLE * overlap >= PART * (len(a) + len(b) - overlap)


def block_links(sets: list[np.ndarray], points: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Labels after all links inside a block, and the links that joined two labels."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    tree = CountTree(points, sizes)
    made = []
    step = 64
    for at in range(0, len(sets), step):
        mine = np.arange(at, min(at + step, len(sets)))
        a, b, bound = tree.candidates(mine)
        ahead = a < b
        a, b, bound = a[ahead], b[ahead], bound[ahead]
        order = np.lexsort((-bound, a))
        a, b = a[order], b[order]
        edge = np.searchsorted(a, np.append(mine, mine[-1] + 1))
        for i, q in enumerate(mine):
            other = b[edge[i] : edge[i + 1]]
            while len(other):
                other = other[labels[other] != labels[q]]
                if not len(other):
                    break
                p, other = other[0], other[1:]
                if linked(sets[q], sets[p]):
                    lo, hi = sorted((labels[q], labels[p]))
                    labels[labels == hi] = lo
                    made.append((q, int(p)))
    return labels, made


# --- the join ---------------------------------------------------------------------------------------------------------


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """A row per document (``part`` null) and, from each task, the shingle counts of its texts in parts."""
    schema = T.StructType([T.StructField("_id", docs.schema["_id"].dataType), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    width = (1 << SKETCH_BITS) // SKETCH_PARTS

    def work(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for lo, hi, buf, off in tb.chunks(batch.column(1)):
                value, begin = shingle_sets(buf, off, size)
                np.add.at(counts, bucket(value), 1) if len(value) < 1000 else counts.__iadd__(np.bincount(bucket(value), minlength=len(counts)).astype(np.uint32))
                many = hi - lo
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, many), pa.array(np.diff(begin)), pa.array(digests(value, begin).view(np.int64)), pa.nulls(many, pa.int32()), pa.nulls(many, pa.binary())], names=schema.names)
        if counts.any():
            cells = [zlib.compress(counts[i * width : (i + 1) * width].tobytes(), 1) for i in range(SKETCH_PARTS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SKETCH_PARTS, kind), pa.nulls(SKETCH_PARTS, pa.int64()), pa.nulls(SKETCH_PARTS, pa.int64()), pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(cells, pa.binary())], names=schema.names)

    return docs.mapInArrow(work, schema)


def _sketch(scan: DataFrame) -> np.ndarray:
    """Counts of all shingles by hash bucket: an array of fixed size, summed part by part in two levels, so that a group has
    the cells of a share of the tasks and then one cell of each share. Counts stop at a limit, which sums of limited sums keep."""
    width = (1 << SKETCH_BITS) // SKETCH_PARTS

    def total(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(width, np.uint64)
        for cell in frame["counts"]:
            out += np.frombuffer(zlib.decompress(cell), np.uint32)
        return pd.DataFrame({"part": [key[0]], "counts": [zlib.compress(np.minimum(out, (1 << 20) - 1).astype(np.uint32).tobytes(), 1)]})

    cells = scan.filter(F.col("part").isNotNull()).select("part", "counts", F.pmod(F.xxhash64("counts"), F.lit(SKETCH_SHARES)).alias("share"))
    some = cells.groupBy("part", "share").applyInPandas(total, "part int, counts binary")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in some.groupBy("part").applyInPandas(total, "part int, counts binary").collect():
        sketch[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return sketch


def _nodes(docs: DataFrame, size: int, sketch) -> DataFrame:
    """One row per distinct set: ``node, _id`` (smallest), ``n, prefix, minima, point``."""
    schema = T.StructType([T.StructField("_id", docs.schema["_id"].dataType), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("minima", T.ArrayType(T.LongType())), T.StructField("point", T.BinaryType())])

    def work(batches):
        seen = sketch.value
        for batch in batches:
            for lo, hi, buf, off in tb.chunks(batch.column(1)):
                value, begin = shingle_sets(buf, off, size)
                n = np.diff(begin)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                text = np.repeat(np.arange(len(n)), n)
                often = seen[bucket(value)].astype(np.uint64)
                rank = (often << np.uint64(44)) | (value & np.uint64((1 << 44) - 1))
                order = np.lexsort((rank, text))
                most = n - (PART * n + WHOLE - 1) // WHOLE + 1
                prefix = value[order][np.arange(len(value)) - begin[text] < most[text]]
                ends = np.concatenate([[0], np.cumsum(most[some])])
                minima = [np.minimum.reduceat(tb.mix(value + np.uint64(k + 1)), begin[:-1][some]) for k in range(4)]
                minima = tb.mix(np.stack(minima, 1) + np.arange(4, dtype=np.uint64)).view(np.int64)
                cell = text * GROUPS + (value & np.uint64(GROUPS - 1)).astype(np.int64)
                points = np.bincount(cell, minlength=len(n) * GROUPS).reshape(len(n), GROUPS)
                points = np.minimum(points, MOST_COUNTED).astype("<u2")[some]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo).take(pa.array(some)), pa.array(n[some]), pa.array(digests(value, begin).view(np.int64)[some]),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(prefix.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(some) + 1, 4), pa.int32()), pa.array(minima.ravel())),
                    pa.array([p.tobytes() for p in points], pa.binary()),
                ], names=schema.names)

    rows = docs.mapInArrow(work, schema)
    return rows.groupBy("node").agg(F.min("_id").alias("_id"), *[F.first(c).alias(c) for c in ("n", "prefix", "minima", "point")])


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``node, values`` (binary) of the wanted ``node, _id`` rows, from the whole texts.

    A table of at most 2^18 hash buckets of the wanted ids thins the texts before they move.
    """
    buckets = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 18))
    few = F.broadcast(wanted.select(buckets("_id").alias("_bucket")).distinct())
    near = docs.withColumn("_bucket", buckets("_id")).join(few, "_bucket", "left_semi").drop("_bucket")
    rows = near.join(wanted.select("_id").distinct(), "_id").select("_text")

    def work(batches):
        for batch in batches:
            for lo, hi, buf, off in tb.chunks(batch.column(0)):
                value, begin = shingle_sets(buf, off, size)
                some = np.flatnonzero(np.diff(begin))
                yield pa.RecordBatch.from_arrays([pa.array(digests(value, begin).view(np.int64)[some]), pa.array([value[begin[i] : begin[i + 1]].tobytes() for i in some], pa.binary())], names=["node", "values"])

    return rows.mapInArrow(work, "node long, values binary").groupBy("node").agg(F.first("values").alias("values"))


def _points(cells) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<u2").reshape(-1, GROUPS).astype(np.int32)


def _first_links(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Links ``a, b`` inside blocks of nodes that share a minimal hash; each node lies in one block."""
    by_key = nodes.select("node", F.explode("minima").alias("key"))
    shared = by_key.withColumn("_least", F.min("node").over(W.partitionBy("key"))).filter(F.col("_least") < F.col("node")).select(F.col("_least").alias("a"), F.col("node").alias("b"))
    family = components(shared)
    sized = family.join(nodes.select("node", "n"), "node")
    blocks = staged(_cuts(sized).join(nodes.select("node", "point", "n"), "node"), "families")
    key = ["label", "_step", "_cut"]

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        points, size, node = _points(frame["point"]), frame["n"].to_numpy(), frame["node"].to_numpy()
        a, _, _ = CountTree(points, size).candidates(np.arange(len(node)))
        return pd.DataFrame({"node": node[np.unique(a)]})

    # only nodes that the bound leaves with a partner need their sets
    wanted = staged(blocks.groupBy(*key).applyInPandas(near, "node long").distinct().join(nodes.select("node", "_id"), "node"), "near-nodes")
    rows = blocks.join(_sets_of(docs, wanted, size), "node").select(*key, "node", "point", "values")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", ignore_index=True)
        sets = [np.frombuffer(v, np.uint64) for v in frame["values"]]
        _, made = block_links(sets, _points(frame["point"]), np.arange(len(sets)))  # a node comes once to a block
        node = frame["node"].to_numpy()
        a, b = (np.array(x, np.int64) for x in zip(*made)) if made else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({"a": node[a], "b": node[b]})

    return rows.groupBy(*key).applyInPandas(work, "a long, b long").distinct()


def _cuts(rows: DataFrame) -> DataFrame:
    """Blocks ``label, _step, _cut`` of every node. A family above a block is cut by set size (in twentieths of its logarithm) and,
    where one size is still too frequent, by a hash. A few nodes of each step come to all cuts of it and of the next, so that the
    parts of a large group of near copies meet. Other pairs across a cut are left to the second round."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_many"))
    step = F.when(F.col("_many") > BLOCK, F.floor(F.log("n") * 20)).otherwise(F.lit(0)).cast("long")
    rows = rows.join(counts, "label").select("node", "label", step.alias("_step"))
    steps = rows.groupBy("label", "_step").agg(F.count(F.lit(1)).alias("_here")).withColumn("_cuts", F.ceil(F.col("_here") / BLOCK))
    placed = rows.join(steps, ["label", "_step"])
    own = placed.select("node", "label", "_step", F.pmod(F.xxhash64("node"), F.col("_cuts")).alias("_cut"))
    # about BRIDGES nodes of a step, drawn by a hash of their own
    drawn = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30)) < F.lit(BRIDGES) / F.col("_here") * (1 << 30)
    few = placed.filter(drawn).select("node", "label", F.explode(F.array("_step", F.col("_step") + 1)).alias("_step"))
    bridges = few.join(steps, ["label", "_step"]).select("node", "label", "_step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1)).alias("_cut"))
    return own.unionByName(bridges).distinct()


def _partnered(nodes: DataFrame) -> DataFrame:
    """``key, node`` rows of prefix shingles that some other node shares at a size and place where the two can still link.

    A set of n shingles whose shared shingle stands at place i of its order has at most n - i more in common with the other, so
    the other has at most (5 n - 9 i) / 4 shingles (for 0.8). Both ends of a linked pair see this at their first common shingle;
    of the rows of a shingle, ordered by size, a row stays if the next larger one is small enough for it, or if it is small
    enough for one of the smaller ones.
    """
    whole, part = WHOLE + PART, PART
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("_at", "key"))
    limit = F.floor(((whole - part) * F.col("n") - whole * F.col("_at")) / part)
    rows = rows.select("key", "node", "n", limit.alias("_limit"))
    order = W.partitionBy("key").orderBy("n", "node")
    larger = F.lead("n").over(order)
    allowed = F.max("_limit").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("_larger", larger).withColumn("_allowed", allowed)
    return marked.filter((F.col("_larger") <= F.col("_limit")) | (F.col("_allowed") >= F.col("n")))


def _open_pairs(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of nodes in different components that share a prefix shingle and pass the bound."""
    by_key = W.partitionBy("key")
    shared = staged(_partnered(nodes).select("key", "node"), "shared-shingles")
    told = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = told.withColumn("_lo", F.min("label").over(by_key)).withColumn("_hi", F.max("label").over(by_key)).withColumn("_many", F.count(F.lit(1)).over(by_key)).filter("_lo < _hi")
    blocks = F.ceil(F.col("_many") / BLOCK)
    rows = split.withColumn("_own", F.pmod(F.xxhash64("node"), blocks)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("key", F.least("_own", "_other").alias("_left"), F.greatest("_own", "_other").alias("_right"), (F.col("_own") <= F.col("_other")).alias("_first"), "node", "label")
    rows = staged(rows, "open-shingles")
    pointed = rows.join(nodes.select("node", "n", "point"), "node")
    ordered = pointed.repartition("key", "_left", "_right").sortWithinPartitions("key", "_left", "_right", "node")

    def pairs_of(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        node, label, size = (frame[c].to_numpy() for c in ("node", "label", "n"))
        group = frame.groupby(["key", "_left", "_right"], sort=False).ngroup().to_numpy()
        points, first = _points(frame["point"]), frame["_first"].to_numpy()
        cross = (frame["_left"] != frame["_right"]).to_numpy()
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        a, b = [], []
        for lo, hi in zip(edges, edges[1:]):
            if hi - lo <= LEAF:  # a tree of one leaf
                i, j = np.triu_indices(hi - lo, 1)
                i, j = i + lo, j + lo
            else:
                i, j, _ = CountTree(points[lo:hi], size[lo:hi]).candidates(np.arange(hi - lo))
                i, j = i[i < j] + lo, j[i < j] + lo
            a.append(i), b.append(j)
        a, b = np.concatenate(a), np.concatenate(b)
        keep = (label[a] != label[b]) & can_link(size[a], size[b]) & ~(cross[a] & (first[a] == first[b]))
        a, b = a[keep], b[keep]
        _, keep = bounded(points, size, a, b)
        return node[a[keep]], node[b[keep]]

    def work(frames):
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = frame[["key", "_left", "_right"]].iloc[-1]
            open_ = (frame[["key", "_left", "_right"]] == last).all(axis=1).to_numpy()
            rest = frame[open_].reset_index(drop=True)
            if not open_.all():
                a, b = pairs_of(frame[~open_].reset_index(drop=True))
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
        if rest is not None and len(rest):
            a, b = pairs_of(rest)
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return ordered.mapInPandas(work, "a long, b long").distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = staged(_sets_of(docs, ends.join(nodes.select("node", "_id"), "node"), size), "open-sets")
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("values").alias("_va")), "a").join(sets.select(F.col("node").alias("b"), F.col("values").alias("_vb")), "b")

    def work(batches):
        for batch in batches:
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return rows.select("a", "b", "_va", "_vb").mapInArrow(work, "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``n_shingles`` and ``component_id`` (the smallest id that links reach, itself included)."""
    spark = docs.sparkSession
    source = texts(docs, id_col, text_col)
    scan = staged(_scan(source, size), "shingle-scan")
    sketch = spark.sparkContext.broadcast(_sketch(scan))
    nodes = staged(_nodes(source, size, sketch), "shingle-nodes")
    links = staged(_first_links(nodes, source, size), "first-links")
    first = components(links)
    pairs = staged(_open_pairs(nodes, first), "open-pairs")
    late = staged(_verified(pairs, nodes, source, size), "late-links")
    labels = components(links.unionByName(late)) if late.limit(1).count() else first
    grouped = nodes.select("node", "_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = grouped.groupBy("label").agg(F.min("_id").alias("_least"))
    named = grouped.join(least, "label").select("node", "_least")
    rows = scan.filter(F.col("part").isNull()).select("_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    out = rows.join(named, "node", "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("_least", "_id").alias("component_id"))
