"""Quality scores by a generalised additive model with pairwise interactions.

Every feature of a text falls into a bin, and the score is the sigmoid of a constant plus one table entry per feature and one per
chosen pair of features. The tables are learned by cyclic boosting: in turn each feature gets a shallow tree on the histogram
of the current residuals, shrunk and added to its table; then the pairs that reduce the residuals most get trees with one cut
along each feature. Scoring is looking up and adding, for a whole batch at once.

The model is fitted on the driver from the features (not the texts) of at most ``sample`` labelled documents, those with the
smallest id hash; features and scores are computed where the texts are. Null and empty texts have features too (no words).
Repeated rows score alike. Without labelled rows, or with one class only, the score is the smoothed share of that class.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tideline.llm import textbatch as tb
from tideline.llm.frames import texts, without
from tideline.llm.textstats import ENDS_SENTENCE, SYMBOL_BYTES, Stats, share

FEATURES = [
    "log_words", "word_length", "symbol_share", "upper_share", "digit_share", "stops_per_word", "shouts_per_word", "pipes_per_word",
    "distinct_words", "repeated_words", "repeated_lines", "words_per_line", "lines_ended", "words_with_symbol_end", "wide_share", "log_lines",
]
SAMPLE = 20_000


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    s = Stats(buf, off)
    n, lines = s.n_words(), np.diff(s.first_line)
    letters = s.texts("upper") + s.texts("lower")
    symbol_end = tb.per_text(tb.flags(SYMBOL_BYTES)[buf[s.ends - 1]], s.first_word)
    ended = tb.per_text(ENDS_SENTENCE[buf[s.line_ends - 1]], s.first_line)
    return np.stack([
        np.log1p(n), share(s.word_chars(), n), share(s.texts("symbols"), s.word_chars()), share(s.texts("upper"), letters),
        share(s.texts("digits"), s.word_chars()), share(s.texts("stops"), n), share(s.texts("shouts"), n), share(s.texts("pipes"), n),
        share(s.distinct_words(), n), share(s.repeated_words(), n), share(tb.per_text(s.repeated_lines(), s.first_line), lines),
        np.log1p(share(n, lines)), share(ended, lines), share(symbol_end, n), share(s.texts("wide"), s.texts("chars")), np.log1p(lines),
    ], axis=1)


@dataclass
class Gam:
    """Cuts and tables; ``tables[f][bin]`` and ``pairs[(f, g)][coarse bin of f, coarse bin of g]``."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            raw += table[np.searchsorted(self.cuts[f], x[:, f], "left")]
        for (f, g), table in self.pairs.items():
            raw += table[np.searchsorted(self.coarse[f], x[:, f], "left"), np.searchsorted(self.coarse[g], x[:, g], "left")]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between quantiles; equal values are never parted."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:], method="lower"))
    return values[:-1]


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf values over ordered bins: the best cut again and again, up to ``leaves`` leaves."""
    spans, out = [(0, len(g))], np.zeros(len(g))
    up_g, up_h = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def cut(a: int, b: int):
        if b - a < 2:
            return 0.0, a
        m = np.arange(a + 1, b)
        left = _gain(up_g[m] - up_g[a], up_h[m] - up_h[a], ridge)
        right = _gain(up_g[b] - up_g[m], up_h[b] - up_h[m], ridge)
        both = left + right - _gain(up_g[b] - up_g[a], up_h[b] - up_h[a], ridge)
        best = int(np.argmax(both))
        return float(both[best]), int(m[best])

    while len(spans) < leaves:
        (gain, at), span = max(((cut(*s), s) for s in spans), key=lambda x: x[0][0])
        if gain <= 1e-9:
            break
        spans.remove(span)
        spans += [(span[0], at), (at, span[1])]
    for a, b in spans:
        out[a:b] = (up_g[b] - up_g[a]) / (up_h[b] - up_h[a] + ridge)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best tree with one cut along each axis, and its gain."""
    up_g = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    up_h = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    rows, columns = g.shape

    def corners(up):
        a, b = up[1:rows, columns][:, None], up[rows, 1:columns][None, :]
        first = up[1:rows, 1:columns]
        return first, a - first, b - first, up[rows, columns] - a - b + first

    quarters = list(zip(corners(up_g), corners(up_h)))
    gain = sum(_gain(x, y, ridge) for x, y in quarters)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [x[i, j] / (y[i, j] + ridge) for x, y in quarters]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.15, leaves: int = 4, pairs: int = 6, pair_rounds: int = 40, coarse: int = 8, ridge: float = 3.0) -> Gam:
    """Boost the tables on features ``x`` and 0/1 labels ``y``."""
    prior = (y.sum() + 2) / (len(y) + 2) if len(y) else 1.0
    if not len(y) or y.min() == y.max():
        prior = prior if len(y) == 0 or y.max() == 1 else 2 / (len(y) + 2)
        return Gam(float(np.log(prior / max(1 - prior, 1e-9))))
    model = Gam(float(np.log(prior / (1 - prior))))
    many = x.shape[1]
    model.cuts = [_cuts(x[:, f], bins) for f in range(many)]
    model.coarse = [_cuts(x[:, f], coarse) for f in range(many)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(model.cuts)]
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        for f in range(many):
            p = 1 / (1 + np.exp(-raw))
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(at[f], y - p, size), np.bincount(at[f], p * (1 - p), size), leaves, ridge)
            model.tables[f] += step
            raw += step[at[f]]
    wide = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(model.coarse)]

    def histogram(f, g, p):
        shape = (len(model.coarse[f]) + 1, len(model.coarse[g]) + 1)
        cell = wide[f] * shape[1] + wide[g]
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-raw))
    usable = [f for f in range(many) if len(model.coarse[f])]
    ranked = sorted(((-_quarters(*histogram(f, g, p), ridge)[0], f, g) for i, f in enumerate(usable) for g in usable[i + 1 :]))
    chosen = [(f, g) for _, f, g in ranked[:pairs]]
    model.pairs = {c: np.zeros((len(model.coarse[c[0]]) + 1, len(model.coarse[c[1]]) + 1)) for c in chosen}
    for _ in range(pair_rounds):
        for f, g in chosen:
            p = 1 / (1 + np.exp(-raw))
            step = rate * _quarters(*histogram(f, g, p), ridge)[1]
            model.pairs[f, g] += step
            raw += step[wide[f], wide[g]]
    return model


def with_features(docs: DataFrame) -> DataFrame:
    """``_id, label, x`` (array) of rows with ``_id, _text, label``."""
    schema = T.StructType([docs.schema["_id"], T.StructField("label", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def work(batches):
        for batch in batches:
            for lo, hi, buf, off in tb.chunks(batch.column(1)):
                x = features(buf, off)
                ends = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=schema.names)

    return docs.select("_id", "_text", "label").mapInArrow(work, schema)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Gam:
    """Fit on at most ``sample`` labelled documents. The labels that may be used are the caller's choice of rows."""
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("double").alias("label")).filter(F.col("_id").isNotNull() & F.col("label").isin(0.0, 1.0))
    few = known.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = with_features(texts(docs, id_col, text_col).join(F.broadcast(few), "_id")).orderBy(F.xxhash64("_id"), "_id").limit(sample).toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows["label"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Gam, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with ``score_col`` (it replaces a column of that name); their own columns pass through. No shuffle."""
    docs = without(docs, [score_col])
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    at = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            column = batch.column(at)
            score = [model.score(features(buf, off)) for _, _, buf, off in tb.chunks(column)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(score) if score else np.zeros(0))], names=schema.names)

    return docs.mapInArrow(work, schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are kept for testing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
