import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from llm.conftest import PROSE, WORD, collected, frame
from tideline.llm import quality_gam, quality_rules
from tideline.llm import textbatch as tb
from tideline.llm.queries import QUERIES
from tideline.llm.textstats import Stats


def plain(text):
    """Base measures of one text, the slow way."""
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    before, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in before
            before.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), repeats, len(covered)


def measured(field, texts):
    out = []
    for _, _, buf, off in tb.chunks(pa.array(texts, pa.string())):
        out += list(zip(*[x.tolist() for x in quality_rules.measures(field, buf, off, 0.5)]))
    return out


FIELD = quality_rules.Field(np.zeros((quality_rules.CODES, quality_rules.WIDTH, 2)), np.zeros((2, 2)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "#", "<|", " ", "  ", "\n", "\r\n", "\t", "\x0b", " ", "\x1c", "日本"]), max_size=40).map("".join), max_size=5))
def test_base_measures_of_any_text(texts):
    got = measured(FIELD, texts)
    assert [g[:5] for g in got] == [plain(t) for t in texts]
    assert [g[5] for g in got] == [p[0] < 10 or 100 * p[4] > 20 * p[0] for p in map(plain, texts)]


def random_chains(rng, many=6, longest=7):
    sizes = rng.integers(0, longest, many)
    first = np.concatenate([[0], np.cumsum(sizes)])
    return rng.integers(0, quality_rules.WIDTH, (first[-1], 3)), first


def every_path(n):
    return [[(k >> i) & 1 for i in range(n)] for k in range(1 << n)]


def path_score(field, codes, labels):
    score = sum(field.weights[k, c, y] for row, y in zip(codes, labels) for k, c in enumerate(row))
    return score + sum(field.moves[a, b] for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_finds_the_best_of_all_paths(seed):
    rng = np.random.default_rng(seed)
    codes, first = random_chains(rng)
    field = quality_rules.Field(rng.normal(size=(3, quality_rules.WIDTH, 2)), rng.normal(size=(2, 2)))
    got = field.decode(codes, first)
    for a, b in zip(first, first[1:]):
        if b > a:
            best = max(path_score(field, codes[a:b], p) for p in every_path(b - a))
            assert path_score(field, codes[a:b], got[a:b].tolist()) == pytest.approx(best)


def test_fitted_field_maximises_the_likelihood():
    rng = np.random.default_rng(3)
    codes, first = random_chains(rng, 60, 6)
    target = (codes[:, 0] + rng.integers(0, 3, len(codes)) > 4).astype(np.int64)

    def loss(field):
        total = 0.5 * ((field.weights**2).sum() + (field.moves**2).sum())
        for a, b in zip(first, first[1:]):
            if b > a:
                scores = np.array([path_score(field, codes[a:b], p) for p in every_path(b - a)])
                total += np.logaddexp.reduce(scores) - path_score(field, codes[a:b], target[a:b].tolist())
        return total

    fitted = quality_rules.fit_field(codes, first, target, rounds=400)
    at = loss(fitted)
    for _ in range(20):  # no small step in any direction is better
        moved = quality_rules.Field(fitted.weights + rng.normal(size=fitted.weights.shape) * 0.02, fitted.moves + rng.normal(size=(2, 2)) * 0.02)
        assert loss(moved) > at - 1e-3


def junk(i):
    return "\n".join(" ".join(f"w{i}{k}{j}%%% ### |" for j in range(6)) for k in range(5))


def clean(i):
    draw = random.Random(i)
    word = lambda: "".join(draw.choice(["ka", "lo", "mi", "ter", "un", "sol"]) for _ in range(draw.randint(1, 3)))
    return "\n".join(" ".join(word() for _ in range(draw.randint(9, 16))).capitalize() + "." for _ in range(6))


def labelled(spark, many=80):
    rows = [(i, junk(i) if i % 4 == 0 else clean(i), "en", "a", 0) for i in range(many)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(many)], "doc_id long, quality int, toxic int")
    return frame(spark, rows), labels


def test_rules_learn_lines_and_keep_clean_documents(spark):
    docs, labels = labelled(spark)
    field = quality_rules.fit_rules(docs, labels)
    new = frame(spark, [(1000 + i, junk(700 + i), "en", "a", 0) for i in range(9)] + [(2000 + i, clean(900 + i), "en", "a", 0) for i in range(9)])
    got = {r["doc_id"]: r["kept"] for r in collected(quality_rules.judged(new, field))}
    assert got == {i: i >= 2000 for i in got}
    half = frame(spark, [(1, junk(1) + "\n" + clean(2), "en", "a", 0)])
    labels_of = [r["label"] for r in quality_rules.line_labels(half, field).orderBy("line").collect()]
    assert labels_of[:4] == ["boilerplate"] * 4 and labels_of[-5:] == ["content"] * 5


def test_odd_rows_through_the_rules(spark, odd):
    field = quality_rules.fit_rules(odd, spark.createDataFrame([(1, 1), (16, 0), (None, 1), (3, None), (999, 1)], "doc_id long, quality int"))
    got = collected(quality_rules.judged(odd, field))
    assert len(got) == odd.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(r["text"])
        assert not (r["kept"] and r["base_failed"])
        if r["text"] is None or not r["text"].strip():
            assert r["base_failed"] and not r["kept"]


def test_fit_is_bounded_by_lines(spark):
    good, bad = "A quiet line of plain prose, with words.\n" * 3, "| # * | menu\n" * 3
    rows = [(i, good if i % 2 else bad) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(42)], "doc_id long, quality int")
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    field = quality_rules.fit_rules(plain, labels, longest=50)
    # a very long text is passed over, rows that repeat an id count once, and so do smaller texts of that id
    more = spark.createDataFrame([*rows, (40, bad * 500), (41, good * 500), *rows[:5], (1, "A")], "doc_id long, text string")
    again = quality_rules.fit_rules(more, labels, longest=50)
    assert np.allclose(field.weights, again.weights) and np.allclose(field.moves, again.moves)
    none = quality_rules.fit_rules(plain, labels, lines=3)  # a document has four
    assert (none.weights[0, :, quality_rules.CONTENT] == 1).all() and not none.moves.any()


def test_without_labels_nothing_clean_is_lost(spark):
    docs, labels = labelled(spark, 20)
    none = labels.filter("false")
    field = quality_rules.fit_rules(docs, none)
    assert all(r["kept"] != r["base_failed"] for r in collected(quality_rules.judged(docs, field)))
    assert all(r["score"] >= 0.7 for r in collected(quality_gam.scored(docs, quality_gam.fit_quality(docs, none))))


def test_model_separates_planted_classes(spark):
    docs, labels = labelled(spark, 160)
    train = labels.filter(~quality_gam.held_out(F.col("doc_id")))
    got = collected(quality_gam.scored(docs, quality_gam.fit_quality(docs, train)))
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 4 != 0) for r in got)
    again = collected(quality_gam.scored(docs.repartition(5), quality_gam.fit_quality(docs.repartition(3), train)))
    assert {r["doc_id"]: r["score"] for r in got} == {r["doc_id"]: r["score"] for r in again}


def test_model_needs_the_pair():
    # an exclusive or of two features: no sum of single tables can tell it
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    alone = quality_gam.fit(x[:3000], y[:3000], pairs=0)
    assert ((alone.score(x[3000:]) > 0.5) == y[3000:]).mean() < 0.65
    assert (0, 1) in model.pairs


def test_score_is_the_sum_of_tables():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (500, 4)).astype(float)
    model = quality_gam.fit(x, (x[:, 0] + x[:, 2] > 8).astype(float), rounds=30)
    for row, score in zip(x[:50], model.score(x[:50])):
        raw = model.base + sum(model.tables[f][sum(v < row[f] for v in model.cuts[f])] for f in range(4))
        raw += sum(t[sum(v < row[f] for v in model.coarse[f]), sum(v < row[g] for v in model.coarse[g])] for (f, g), t in model.pairs.items())
        assert score == pytest.approx(1 / (1 + np.exp(-raw)))


def test_odd_rows_through_the_model(spark, odd):
    model = quality_gam.fit_quality(odd, spark.createDataFrame([(1, 1), (16, 0), (7, 1), (None, 0), (3, None)], "doc_id long, quality int"))
    got = collected(quality_gam.scored(odd, model))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["text"] == PROSE}) <= 1


def test_features_are_those_of_the_text_alone():
    texts = [PROSE, "", "x", clean(1), junk(2)]
    alone = [quality_gam.features(buf, off) for t in texts for _, _, buf, off in tb.chunks(pa.array([t], pa.string()))]
    for _, _, buf, off in tb.chunks(pa.array(texts, pa.string())):
        assert np.array_equal(np.concatenate(alone), quality_gam.features(buf, off))
        assert Stats(buf, off).distinct_words().tolist() == [len(set(WORD.findall(t))) for t in texts]


def test_held_out_accuracy_on_the_given_tables(spark, sf):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in collected(QUERIES["op10_additive_quality_model"](spark, sf)) if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got) >= 0.95 * len(got) > 0
    kept = {r["doc_id"]: r for r in collected(QUERIES["op1_crf_line_rules"](spark, sf))}
    good = [kept[i] for i, q in truth.items() if q == 1 and not kept[i]["base_failed"]]
    assert all(r["kept"] for r in good)
    bad = [kept[i] for i, q in truth.items() if q == 0]
    assert sum(r["kept"] for r in bad) <= 0.1 * len(bad)
