"""Line labels by a linear-chain conditional random field.

The lines of a text that hold a word form a chain. Each line has a few coded features; a table gives each code's weight for
content and for boilerplate, and a 2 x 2 table weighs what follows what. Viterbi decoding labels all lines of a batch of texts in
step, and a document is kept if lines labelled content hold at least ``share`` of its word characters.

The weights are learned here, by gradient ascent on the conditional likelihood (forward-backward) over at most ``sample``
labelled documents with ``lines`` lines in all, none with more than ``longest``: a line's target is its document's quality, so
the field learns which lines, in which company, belong to good documents. Before the field come plain rules (too few words, too
many repeated windows).

Null and empty texts have no words and fail the base rules. Very long texts are judged whole; they only take no part in the fit.
Repeated rows get equal verdicts; in the fit the largest text of an id counts. Without labels, or with one class only, every line
is content. An empty table gives an empty result. Columns named like a measure are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from tideline.llm import textbatch as tb
from tideline.llm.frames import staged, texts, without
from tideline.llm.textstats import Stats, share

CONTENT, BOILERPLATE = 0, 1
SAMPLE = 2_000
LINES, LONGEST = 200_000, 2_000  # of the documents that the field is fitted on: in all, and of one
CODES, WIDTH = 10, 6
#: A line ends in a sign of prose (0), in a symbol (1) or in another character (2).
END_CODE = np.zeros(256, np.int64)
END_CODE[[b for b in range(128) if not chr(b).isalnum() and chr(b) not in ".!?,;:'\"-()"]] = 2
END_CODE[list(b"#*$%&|<>")] = 1


def line_codes(s: Stats) -> np.ndarray:
    """Codes below WIDTH of every line: words, symbols, capitals, digits, last character, pipes, shouts, repetition, marks, word length."""
    words, chars = s.line_words, s.in_lines("chars") - s.in_lines("spaces")
    letters = s.in_lines("upper") + s.in_lines("lower")
    last = s.line_ends - 1
    cut = lambda x, marks: np.searchsorted(marks, x, "left")
    return np.stack([
        cut(words, [2, 5, 10, 20]), cut(share(s.in_lines("symbols"), chars), [0, 0.02, 0.1, 0.3]), cut(share(s.in_lines("upper"), letters), [0.1, 0.3, 0.6]),
        cut(share(s.in_lines("digits"), chars), [0, 0.1, 0.3]), END_CODE[s.buf[last]], cut(share(s.in_lines("pipes"), words), [0, 0.2]),
        cut(share(s.in_lines("shouts"), words), [0, 0.2]), s.repeated_lines().astype(np.int64), (s.in_lines("marks") > 0).astype(np.int64),
        cut(share(chars, words), [3, 5, 8, 12]),
    ], axis=1)


@dataclass
class Field:
    """``weights[code position, code, label]``, ``moves[from, to]``."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), 2))
        for k in range(codes.shape[1]):
            out += self.weights[k, codes[:, k]]
        return out

    def decode(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest labels of every chain; ``first`` says where each chain begins, and the end."""
        score, labels = self.emissions(codes), np.zeros(len(codes), np.int8)
        order, starts, alive = _in_step(first)
        back = np.zeros((len(codes), 2), np.int8)
        best = score[starts]
        for t in range(1, len(alive)):
            at = starts[: alive[t]] + t
            through = best[: alive[t], :, None] + self.moves[None]
            back[at] = np.argmax(through, axis=1)
            best[: alive[t]] = through.max(axis=1) + score[at]
        state = np.argmax(best, axis=1).astype(np.int8)
        ends = np.diff(first)[order] - 1
        for t in range(len(alive) - 1, -1, -1):
            mine = slice(0, alive[t])
            at = starts[mine] + t
            labels[at] = state[mine]
            if t:
                state[mine] = back[at, state[mine]]
        assert len(ends) == len(starts)
        return labels


def _in_step(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains that are not empty, longest first: their order, where they start, and how many reach each step."""
    many = np.diff(first)
    order = np.argsort(-many, kind="stable")
    order = order[many[order] > 0]
    size = many[order]
    steps = int(size[0]) if len(size) else 0
    return order, first[:-1][order], np.searchsorted(-size, -np.arange(steps), "left")


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit_field(codes: np.ndarray, first: np.ndarray, target: np.ndarray, rounds: int = 120, rate: float = 0.3, ridge: float = 1.0) -> Field:
    """Weights of largest penalised likelihood for the chains' target labels (Adagrad steps on the exact gradient)."""
    field = Field(np.zeros((codes.shape[1], WIDTH, 2)), np.zeros((2, 2)))
    if not len(target) or target.min() == target.max():
        field.weights[0, :, CONTENT] = 1.0
        return field
    order, starts, alive = _in_step(first)
    seen = np.zeros_like(field.weights)
    for k in range(codes.shape[1]):
        np.add.at(seen[k], (codes[:, k], target), 1)
    inner = np.ones(len(target), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    after = np.flatnonzero(inner)
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (target[after - 1], target[after]), 1)
    grown = [np.full_like(field.weights, 1e-8), np.full_like(field.moves, 1e-8)]
    for _ in range(rounds):
        score = field.emissions(codes)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[starts] = score[starts]
        for t in range(1, len(alive)):
            at = starts[: alive[t]] + t
            forward[at] = score[at] + _log_sum(forward[at - 1][:, :, None] + field.moves[None], 1)
        for t in range(len(alive) - 2, -1, -1):
            at = starts[: alive[t + 1]] + t
            backward[at] = _log_sum(field.moves[None] + (score[at + 1] + backward[at + 1])[:, None, :], 2)
        belief = forward + backward
        belief = np.exp(belief - _log_sum(belief, 1)[:, None])
        pair = forward[after - 1][:, :, None] + field.moves[None] + (score[after] + backward[after])[:, None, :]
        pair = np.exp(pair - _log_sum(pair.reshape(-1, 4), 1)[:, None, None])
        hoped = np.zeros_like(field.weights)
        for k in range(codes.shape[1]):
            for label in (0, 1):
                hoped[k, :, label] = np.bincount(codes[:, k], belief[:, label], WIDTH)
        steps = [(seen - hoped - ridge * field.weights) / len(target), (seen_moves - pair.sum(0) - ridge * field.moves) / len(target)]
        for table, step, sum_ in zip((field.weights, field.moves), steps, grown):
            sum_ += step**2
            table += rate * step / np.sqrt(sum_)
    return field


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fit on the lines of at most ``sample`` labelled documents, those with the smallest id hash, so that the classes keep their
    shares and a line without any sign counts as content where most documents are good. Documents of more than ``longest`` lines
    are passed over, the others taken in hash order while they have ``lines`` lines in all, so what the driver fits is bounded."""
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter(F.col("_id").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("_id").agg(F.max("label").alias("label"))
    few = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    found = texts(docs, id_col, text_col).join(F.broadcast(few), "_id").groupBy("_id").agg(F.max("label").alias("label"), F.max("_text").alias("_text"))
    counted = staged(found.withColumn("_lines", F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1), "rule-sample")
    in_order = W.orderBy(F.xxhash64("_id"), "_id")  # at most ``sample`` narrow rows
    fitting = counted.filter(F.col("_lines") <= longest).select("_id", F.sum("_lines").over(in_order).alias("_so_far")).filter(F.col("_so_far") <= lines)
    chosen = counted.join(F.broadcast(fitting.select("_id")), "_id")
    kind = "doc long, line long, label int, codes array<long>"

    def work(batches):
        for batch in batches:
            for lo, hi, buf, off in tb.chunks(batch.column(1)):
                s = Stats(buf, off)
                codes, text = line_codes(s), s.line_text()
                key = np.asarray(batch.column(2))[lo:hi][text]
                label = np.asarray(batch.column(3))[lo:hi][text]
                ends = pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(len(text)) - s.first_line[text]), pa.array(label, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))], names=["doc", "line", "label", "codes"])

    rows = chosen.select("_id", "_text", F.xxhash64("_id").alias("_key"), "label").mapInArrow(work, kind).toPandas()
    rows = rows.drop_duplicates(["doc", "line"]).sort_values(["doc", "line"], ignore_index=True)
    codes = np.array(rows["codes"].tolist(), np.int64).reshape(len(rows), CODES)
    doc = rows["doc"].to_numpy()
    first = np.append(np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else [], len(doc)).astype(np.int64)
    return fit_field(codes, first, np.where(rows["label"] == 1, CONTENT, BOILERPLATE))


MEASURES = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("content_share", T.DoubleType()), ("kept", T.BooleanType())]


def measures(field: Field, buf: np.ndarray, off: np.ndarray, least: float) -> list[np.ndarray]:
    """MEASURES of every text."""
    s = Stats(buf, off)
    n, repeats = s.n_words(), s.repeated_words()
    base_failed = (n < 10) | (100 * repeats > 20 * n)
    chars = s.in_lines("chars") - s.in_lines("spaces")
    content = field.decode(line_codes(s), s.first_line) == CONTENT
    part = share(tb.per_text(chars * content, s.first_line), s.word_chars())
    return [n, s.word_chars(), s.texts("symbols"), tb.per_text(s.repeated_lines(), s.first_line), repeats, base_failed, part, ~base_failed & (part >= least)]


def judged(docs: DataFrame, field: Field, share: float = 0.5, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The documents with MEASURES (under ``prefix``; they replace columns of those names); other columns pass through. No shuffle."""
    docs = without(docs, [prefix + name for name, _ in MEASURES])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(prefix + name, kind) for name, kind in MEASURES]])
    at = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            parts = [measures(field, buf, off, share) for _, _, buf, off in tb.chunks(batch.column(at))]
            if parts:
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.concatenate(x)) for x in zip(*parts)]], names=schema.names)

    return docs.mapInArrow(work, schema)


def line_labels(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line with a word: the id, ``line`` (from 0), ``label`` (content or boilerplate) and the line's ``text``."""
    source = texts(docs, id_col, text_col)
    schema = T.StructType([source.schema["_id"], T.StructField("line", T.LongType()), T.StructField("label", T.StringType()), T.StructField("text", T.StringType())])

    def work(batches):
        for batch in batches:
            for lo, hi, buf, off in tb.chunks(batch.column(1)):
                s = Stats(buf, off)
                label, text, raw = field.decode(line_codes(s), s.first_line), s.line_text(), buf.tobytes()
                cells = [raw[a:b] for a, b in zip(s.line_starts.tolist(), s.line_ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(text)), pa.array(np.arange(len(text)) - s.first_line[text]), pa.array(np.where(label == CONTENT, "content", "boilerplate")), pa.array(cells, pa.binary()).cast(pa.string())], names=schema.names)

    return source.mapInArrow(work, schema).withColumnRenamed("_id", id_col)
