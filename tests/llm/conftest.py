import os
import re

import public_tokenizers
import pytest
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that the operators use themselves.
CLASHES = ["_id", "_text", "size", "score", "kept", "n_words", "node", "label", "part", "copies", "start", "vslot", "_key", "_rank"]

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree and say nothing at all"


@pytest.fixture(autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


def odd_rows():
    """Nulls in every column, empty and long texts, copies, repeated rows, and strings that tokenizers treat apart."""
    long = " ".join(f"{w}{i % 97}" for i in range(4000) for w in ("lorem", "ipsum"))
    return [
        (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (3, PROSE + " today", "en", None, 2), (4, None, None, None, None), (5, "", "en", "b", 0),
        (6, " \t\n ", "en", "b", 4), (7, long, "en", "c", 9), (8, "x" * 50_000, "en", "c", 9), (9, "<|endoftext|> a <|endoftext|>", "en", "é", 1),
        (10, "one two three", "en", "b", 1), (11, "ONE two\nthree", "en", "b", 1), (12, "日本語 テキスト　空白 x \x1c é é", None, "𝔘", 3),
        (13, "a\nb\na\nb\na\n\n  \nb", "de", "b", 1), (None, PROSE, "en", "a", 1), (None, "no id here but enough words to count as a text of ten", "en", None, 1),
        (14, "same row " * 20, "en", "a", 3), (14, "same row " * 20, "en", "a", 3), (-15, "negative id " + PROSE, "en", "a", 3),
        (16, "%%% ### $$$ | | | & & <b> *** " * 9, "en", "a", 3), (9007199254740993, "an id beyond 2^53 " + PROSE, "en", "a", 3),
    ]


def frame(spark, rows=None, clash=False):
    df = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])
    return df


@pytest.fixture(params=["plain", "clash", "empty"])
def odd(request, spark):
    """The odd rows, the same with clashing columns, and none."""
    return frame(spark, [] if request.param == "empty" else None, request.param == "clash")


def collected(df):
    return [r.asDict() for r in df.collect()]
