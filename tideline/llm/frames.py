"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.session import run_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The columns an operator reads, under names that cannot clash with its results."""
    taken = [F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")]
    return docs.select(*taken, *[F.col(f"`{c}`") for c in more])


def without(docs: DataFrame, names: list[str]) -> DataFrame:
    """The documents without columns that a result of that name will replace."""
    return docs.drop(*[c for c in docs.columns if c in names])


def fresh(docs: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the documents begins with it."""
    while any(c.startswith(name) for c in docs.columns):
        name = f"_{name}"
    return name


def table(path: str, spark: SparkSession, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")
