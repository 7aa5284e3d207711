"""Gradient-boosted trees for a binary label over rows that stay where they were dealt out.

A row is kept as one byte per feature (the bin of its value), its weight, label and score. A level of a tree is one job that
adds up the rows per (node, feature, bin); only those sums reach the driver, which picks the splits. The loss, the first
tree on the labels and the step of 0.1 for the later ones are those of Spark ML's ``GBTClassifier``; cuts come from all rows
instead of a sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from tideline.session import shared_dir

BINS = 32  # fixed value: most bins of a feature
STEP = 0.1  # fixed value: share of each tree but the first
FEW, MANY = 20_000, 1_000_000  # rows of a partition: at least, and before there are more partitions than cores
CHUNK = 1 << 15  # rows that are worked on at once
CUT = 50  # rounds after which the lineage of the scores is cut


def cuts_of(df: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Increasing upper ends of the bins but the last: between all values where they are few, else 1/32 quantiles."""
    near = df.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first()
    few = [f for f in features if near[f] <= 2 * BINS]
    got = df.agg(*[F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 10000).alias(f"q_{f}") for f in features],
                 *[F.max(f).alias(f"m_{f}") for f in features], *[F.collect_set(f).alias(f"s_{f}") for f in few]).first()
    out = []
    for f in features:
        values = np.array(sorted(got[f"s_{f}"] or [])) if f in few else None
        if values is not None and len(values) <= BINS:
            out.append((values[:-1] + values[1:]) / 2)
        else:
            ends = np.unique(np.array(got[f"q_{f}"], dtype=float))
            out.append(ends[ends < got[f"m_{f}"]])
    return out


def codes_of(columns: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """Row-major bytes: the bin of every feature; a value equal to a cut lies below it."""
    return np.column_stack([np.searchsorted(c, np.asarray(x, dtype=float), side="left").astype(np.uint8) for x, c in zip(columns, cuts)])


def best_splits(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none), bin, and the means below and above of the best split per node, from (node, feature, bin, [weight,
    weighted residual]) sums. Gains that agree to nine digits are ties, which go to the first feature and bin."""
    left = hist.cumsum(axis=2)[:, :, :-1]
    whole = hist[:, :1].sum(axis=2, keepdims=True)
    right = whole - left
    eps = 1e-12 * whole[..., 0]
    ok = (left[..., 0] > eps) & (right[..., 0] > eps)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - whole[..., 1] ** 2 / whole[..., 0], -1.0)
    flat = gain.reshape(len(hist), -1)
    top = flat.max(axis=1)
    pick = (flat >= (top - 1e-9 * np.abs(top))[:, None]).argmax(axis=1)
    feature, cut = np.divmod(pick, left.shape[2])
    n = np.arange(len(hist))
    lo, hi = left[n, feature, cut], right[n, feature, cut]
    feature = np.where(top > 1e-12 * whole[:, 0, 0, 0], feature, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return feature, cut, lo[:, 1] / lo[:, 0], hi[:, 1] / hi[:, 0]


def histogram(codes: np.ndarray, weight: np.ndarray, residual: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
    """Sums of weight and weighted residual per (feature, slot, bin); rows of finished nodes are in the slot after the last."""
    cells, base, wr = (slots + 1) * BINS, slot * BINS, weight * residual
    out = np.empty((2, codes.shape[1], cells))
    for f in range(codes.shape[1]):
        at = base + codes[:, f]
        out[0, f], out[1, f] = np.bincount(at, weight, cells), np.bincount(at, wr, cells)
    return out[:, :, : slots * BINS]


class Tree:
    """A regression tree as heap arrays: split feature (-1: leaf), last bin of the lower child, and value of each node."""

    def __init__(self, depth: int):
        self.depth, size = depth, 2 ** (depth + 1) - 1
        self.feature, self.cut, self.value = np.full(size, -1), np.zeros(size, dtype=int), np.zeros(size)

    def split(self, nodes: np.ndarray, hist: np.ndarray) -> np.ndarray:
        """Split ``nodes`` by their sums where that helps; the children."""
        hist = hist.reshape(2, hist.shape[1], len(nodes), BINS).transpose(2, 1, 3, 0)
        if nodes[0] == 0:
            weight, total = hist[0, 0].sum(axis=0)
            self.value[0] = total / weight
        feature, cut, low, high = best_splits(hist)
        at = nodes[feature >= 0]
        self.feature[at], self.cut[at] = feature[feature >= 0], cut[feature >= 0]
        self.value[2 * at + 1], self.value[2 * at + 2] = low[feature >= 0], high[feature >= 0]
        return np.sort(np.concatenate([2 * at + 1, 2 * at + 2]))

    def nodes(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row after so many levels."""
        node = np.zeros(len(codes), dtype=np.int64)
        for _ in range(levels):
            node = descend(codes, self.feature, self.cut, node)
        return node


def descend(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The child of each row's node; rows of a leaf stay."""
    f = feature[node]
    right = codes[np.arange(len(codes)), np.maximum(f, 0)] > cut[node]
    return np.where(f >= 0, 2 * node + 1 + right, node)


def _blocks(cuts: list[np.ndarray]):
    """Arrow batches of features, label and weight to blocks of binned rows."""

    def run(batches):
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if len(batch):
                yield pa.RecordBatch.from_pydict({
                    "codes": [codes_of(cols[:-2], cuts).tobytes()],
                    "weight": [cols[-1].tobytes()], "sign": [(2 * cols[-2] - 1).astype(np.int8).tobytes()]})

    return run


def _open(many: int):
    def run(blocks):
        """The blocks of a partition as one of (codes, weight, sign, score)."""
        got = [(np.frombuffer(r[0], np.uint8).reshape(-1, many), np.frombuffer(r[1]), np.frombuffer(r[2], np.int8)) for r in blocks]
        if got:
            codes, weight, sign = (np.concatenate(x) for x in zip(*got))
            for a in range(0, len(codes), CHUNK):
                yield codes[a : a + CHUNK], weight[a : a + CHUNK], sign[a : a + CHUNK], np.zeros(len(codes[a : a + CHUNK]))

    return run


def _advance(tree: Tree, step: float):
    def run(block):
        codes, weight, sign, score = block
        return codes, weight, sign, score + step * tree.value[tree.nodes(codes, tree.depth)]

    return run


def _sums(tree: Tree, level: int, active: np.ndarray, first: bool):
    slot = np.full(len(tree.feature), len(active))
    slot[active] = np.arange(len(active))

    def run(blocks):
        out = 0.0
        for codes, weight, sign, score in blocks:
            residual = sign if first else 4 * sign / (1 + np.exp(2 * sign * score))
            out = out + histogram(codes, weight, residual, slot[tree.nodes(codes, level)], len(active))
        if np.ndim(out):
            yield out

    return run


class BoostedTrees:
    """Fitted trees; the score is the weighted sum of their values, the probability its logistic function at twice the score."""

    def __init__(self, features: list[str], cuts: list[np.ndarray], trees: list[Tree]):
        self.features, self.cuts, self.trees = features, cuts, trees

    def probability(self) -> Column:
        cuts, trees = self.cuts, self.trees

        def predict(*columns: pd.Series) -> pd.Series:
            codes = codes_of([c.to_numpy() for c in columns], cuts)
            score = np.zeros(len(codes))
            for i, tree in enumerate(trees):
                score += (STEP if i else 1.0) * tree.value[tree.nodes(codes, tree.depth)]
            return pd.Series(1 / (1 + np.exp(-2 * score)))

        return F.pandas_udf(predict, "double")(*[F.col(f).cast("double") for f in self.features])


def fit(df: DataFrame, features: list[str], label: str, weight: str, rounds: int, depth: int = 6) -> BoostedTrees:
    """Boost ``rounds`` trees on weighted rows; ``df`` is read four times, pass it checkpointed. Rows without weight count
    for nothing; features must be known."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    rows = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
    n = rows.count()
    if n == 0:
        raise ValueError("no rows to fit")
    cuts = cuts_of(rows, [f"x{i}" for i in range(len(features))])
    parts = max(1, min(max(sc.defaultParallelism, n // MANY), n // FEW))
    binned = rows.repartition(parts).mapInArrow(_blocks(cuts), "codes binary, weight binary, sign binary")
    held = binned.rdd.mapPartitions(_open(len(features)))
    old, trees = None, []
    for r in range(rounds):
        if trees:
            held = held.map(_advance(trees[-1], STEP if r > 1 else 1.0), preservesPartitioning=True)
        held.persist(StorageLevel.MEMORY_AND_DISK)
        if r % CUT == 0:
            held.checkpoint()
        tree, active = Tree(depth), np.array([0])
        for level in range(depth):
            active = tree.split(active, sum(held.mapPartitions(_sums(tree, level, active, r == 0)).collect()))
            if not len(active):
                break
        trees.append(tree)
        if old is not None:
            old.unpersist()
        old = held
    old.unpersist()
    return BoostedTrees(features, cuts, trees)
