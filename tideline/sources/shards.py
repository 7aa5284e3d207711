"""Resumable writes: finished shards are listed in a manifest; a re-run writes
only what is missing and replaces half-written shards."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tideline.operators import joins
from tideline.session import cut_lineage


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def manifest(spark: SparkSession, folder: str, key: str = "vintage") -> DataFrame:
    return read_or_empty(spark, f"{folder}/manifest", f"{key} string, n_rows bigint, is_empty boolean, run string")


def write_missing(df: DataFrame, folder: str, expected: DataFrame, key: str = "vintage") -> DataFrame:
    """Write the shards of ``expected`` keys the manifest does not list, then list
    them (empty ones too) as counted in the written files. Returns the manifest.

    Each run writes its shards to a folder of its own and lists that folder, so
    what a run left behind that died before its manifest is never read, and a key
    that has turned empty has no old rows. The input is computed once.
    """
    spark = df.sparkSession
    todo = cut_lineage(expected.select(key).distinct().join(manifest(spark, folder, key).select(key), key, "left_anti"))
    run = uuid.uuid4().hex[:12]
    df.join(todo, key, "left_semi").write.partitionBy(key).parquet(f"{folder}/data/run={run}")
    kind = T.StructType([f for f in df.schema.fields if f.name != key] + [df.schema[key]])
    counts = spark.read.schema(kind).parquet(f"{folder}/data/run={run}").groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    listed = todo.join(counts, key, "left").select(
        key, F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"), F.col("n_rows").isNull().alias("is_empty"), F.lit(run).alias("run"))
    listed.write.mode("append").parquet(f"{folder}/manifest")
    return manifest(spark, folder, key)


def read_shards(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows of the runs that the manifest lists, in one scan."""
    runs = [r["run"] for r in manifest(spark, folder).filter("NOT is_empty").select("run").distinct().collect()]
    if not runs:
        return spark.createDataFrame([], schema)
    paths = [f"{folder}/data/run={run}" for run in sorted(runs)]
    return spark.read.schema(f"{schema}, run string").option("basePath", f"{folder}/data").parquet(*paths).drop("run")


def merge_partials(spark: SparkSession, folder: str, schema: str, keys: list[str], sums: list[str]) -> DataFrame:
    """Final sums of mergeable partial aggregates, one shard per input file set."""
    return read_shards(spark, folder, schema).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def consistency_gate(old: DataFrame, new: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """One row: overlap, largest and mean absolute difference, and whether the new
    table may replace the old one. Without a common key it may only if there is
    no old row."""
    a, b = old.select(*keys, F.col(value).alias("_o")), new.select(*keys, F.col(value).alias("_n"))
    diff = F.abs(F.col("_o") - F.col("_n"))
    row = a.join(b, keys).agg(F.count(F.lit(1)).alias("n_common"), F.max(diff).alias("max_abs_diff"), F.avg(diff).alias("mean_abs_diff"))
    none_old = ~F.col("_old")
    ok = F.when(F.col("n_common") == 0, none_old).otherwise(F.col("max_abs_diff") < tolerance)
    had = old.limit(1).agg((F.count(F.lit(1)) > 0).alias("_old"))
    return row.withColumn("_old", had.scalar()).withColumn("accept", ok).drop("_old")


def publish(new: DataFrame, folder: str, version: int, gate: DataFrame | None = None) -> str:
    """Write a new version beside the old ones (the backup is the older version).
    With a gate the write fails unless it accepts."""
    df = new
    if gate is not None:
        ok = gate.select(F.when(F.col("accept"), F.lit(True)).otherwise(F.raise_error(F.lit("values changed too much")).cast("boolean")))
        df = new.withColumn("_ok", ok.scalar()).filter("_ok").drop("_ok")
    path = f"{folder}/v{version}"
    df.write.mode("overwrite").parquet(path)
    return path
