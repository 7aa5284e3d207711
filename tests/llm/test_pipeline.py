import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from llm.conftest import BYTE_BPE, WORD, collected, odd_rows, SCHEMA
from llm.test_native import plain_targets, words
from llm.test_search import corpus, near_copies, plain_components
from llm.test_text_rules import clean, junk, plain
from llm.test_tokens import check_packing


def rows_of_fixture():
    rows = [(i, junk(i) if i % 4 == 0 else clean(i), "en", f"s{i % 3}", 0) for i in range(120)]
    rows += [(1000 + r[0], r[1], *r[2:]) for r in corpus(1)[:40]]
    rows += [(2000 + i, t, "en", "near", 0) for i, t in enumerate(near_copies(30, 60, 9))]
    return rows + [(None if r[0] is None else 3000 + r[0], *r[1:]) for r in odd_rows()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows_of_fixture(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def key(r):
    return str(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")))


def test_stages_equal_a_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    taken = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), out.schema)
        taken[name] = (before, collected(out))
        docs = out
    before, after = taken["quality_classifier"]
    left = {key(r) for r in after}
    assert all((key(r) in left) == (r["doc_id"] % 4 != 0) for r in before if r["doc_id"] is not None and 0 <= r["doc_id"] < 120 and r["source"].startswith("s"))
    before, after = taken["quality_rules"]
    left = {key(r) for r in after}
    for r in before:
        n, _, _, _, repeats = plain(r["text"])
        if n < 10 or 100 * repeats > 20 * n:
            assert key(r) not in left
        elif r["doc_id"] is not None and 0 <= r["doc_id"] < 120 and r["doc_id"] % 4:
            assert key(r) in left
    before, after = taken["ngram_jaccard_join"]
    stay = {eval(c)[0] for c in plain_components(before) if eval(c)[0] == eval(c)[2]}
    want = [r for r in before if r["doc_id"] is None] + list({(r["doc_id"], r["text"]): r for r in before if r["doc_id"] in stay and r["doc_id"] is not None}.values())
    assert sorted(map(key, after)) == sorted(map(key, want))
    before, after = taken["source_mix"]
    sizes = {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    target = plain_targets(sizes, (5, 2, 1), 3)
    assert {key(r) for r in after} <= {key(r) for r in before}
    for s in sizes:
        assert abs(sum(words(r["text"]) for r in after if r["source"] == s) - target[s]) <= 2 * max(words(r["text"]) for r in before if r["source"] == s)
    check_packing(*taken["packing"])


def test_run_is_the_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(str, collected(docs))) == sorted(map(str, collected(corpus_pipeline.run(spark, folder))))
    assert corpus_pipeline.ORACLE_SQL is None and BYTE_BPE and WORD


def test_empty_input_and_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for extra in (docs.limit(0), docs.limit(60).withColumn("_score", F.lit(1)).withColumn("_r_kept", F.lit(1)).withColumn("kept", F.lit(0)).withColumn("_hash", F.lit(2)).withColumn("_row", F.lit(3))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, extra, folder)
            assert name == "packing" or out.columns == extra.columns
            out.count()
