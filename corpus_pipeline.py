"""Corpus pipeline: quality classifier, quality rules, near duplicates, source mix, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``. The two fitted models
learn from the labelled rows of ``documents`` in ``sf_dir``, whatever the stages before them have already removed.

Null and empty texts are rejected by the rules; null ids are never linked and stay; repeated rows are near duplicates of each
other; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from tideline.llm import mixing, ngram_join, packing, quality_gam, quality_rules
from tideline.llm.frames import fresh, table
from tideline.session import remove, run_dir

#: No SQL: the fitted models and the tokenizer cannot be expressed. Tested against a brute-force version.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores at least 0.7."""
    labels = table(sf_dir, spark, "labels").filter(~quality_gam.held_out(F.col("doc_id")))
    model = quality_gam.fit_quality(table(sf_dir, spark, "documents"), labels)
    score = fresh(docs, "_score")
    return quality_gam.scored(docs, model, score_col=score).filter(F.col(score) >= 0.7).drop(score)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and hold mostly content lines."""
    field = quality_rules.fit_rules(table(sf_dir, spark, "documents"), table(sf_dir, spark, "labels"))
    own = fresh(docs, "_r_")
    return quality_rules.judged(docs, field, prefix=own).filter(F.col(f"{own}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component."""
    found = ngram_join.jaccard_components(docs)
    stays = found.filter(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("_stays")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"))
    nameless = packed.filter(F.col("_doc").isNull())  # all stay, so none of them is moved
    named = packed.filter(F.col("_doc").isNotNull()).join(stays.filter(F.col("_stays").isNotNull()), F.col("_doc") == F.col("_stays")).drop("_stays")
    nth = F.row_number().over(W.partitionBy("_doc", "_hash").orderBy("_hash"))
    once = named.withColumn("_nth", nth).filter((F.col("_nth") == 1) | F.col("_row.text").isNull()).drop("_nth").unionByName(nameless)
    return once.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), max_repeat=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens."""
    return packing.packed_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mix", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder, where a stage's rows go as soon as
    the next one's are written. The rows that the last stage reads stay: a lost task reads them again."""
    docs, before = table(sf_dir, spark, "documents"), None
    for name, stage in STAGES[:-1]:
        found, path = stage(spark, docs, sf_dir), run_dir(spark, name)
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
