"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / size of the source`` times. Documents stand in one order in their source (by
size, then a hash of the id); the running sum of expected copies, moved by one random offset of the source, crosses an integer
once for each copy that is taken. Because sizes rise along the order, the words taken stay within about one document's size of
the target, and no document is taken more than ``ceil(max_repeat)`` times.

The running sum is the rank times a constant, so only ranks are needed. They come from counts of (source, size, hash bucket):
prefix sums over buckets, then over the sizes of a source, then a row number inside one bucket. A source that owns a third of all
rows is never in one task; a task holds one bucket of one size.

Null sources are a source of their own, the last one. Null and empty texts have size 0 and take nothing. Repeated rows are
rows of their own. Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from tideline.llm.frames import staged

WORD = r"[^\x20\x09-\x0D]+"
SCALE = 24
BUCKET_DIGITS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_key(source: Column) -> Column:
    """A key that is never null; null sorts behind every source."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def source_targets(sources: DataFrame, weights: tuple[int, ...], max_repeat: int, share: float = 1.0) -> DataFrame:
    """Targets of ``_key, source_size`` rows: ``target`` and ``capped``.

    Weights repeat along the keys. A share above ``max_repeat`` times its source stops there and the excess goes to the others
    by weight. Sorted by cap over weight, the stopped sources come first, so running sums find them without iterating.
    """
    by_key = W.orderBy("_key")
    cycle = F.array(*[F.lit(w) for w in weights])
    weighted = sources.withColumn("_w", F.get(cycle, (F.row_number().over(by_key) - 1) % len(weights)))
    weighted = weighted.withColumn("_cap", F.col("source_size") * max_repeat)
    everything = W.partitionBy(F.lit(0))
    by_ratio = everything.orderBy(F.col("_cap") / F.col("_w"), "_key")
    stopped_before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    weight_from = F.sum("_w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(everything).cast("double") * share
    level = (total - stopped_before) / weight_from
    marked = weighted.withColumn("capped", level * F.col("_w") >= F.col("_cap")).withColumn("_total", total)
    stopped = F.sum(F.when(F.col("capped"), F.col("_cap")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("_w"))).over(everything)
    fair = (F.col("_total") - stopped) / F.when(open_weight > 0, open_weight) * F.col("_w")
    return marked.select("_key", "source_size", F.when(F.col("capped"), F.col("_cap").cast("double")).otherwise(fair).alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Order columns beside the document, whose own columns are packed so that no name clashes."""
    tie = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(f"`{id_col}`").alias("_id"), source_key(F.col(f"`{source_col}`")).alias("_key"),
        word_count(F.col(f"`{text_col}`").cast("string")).alias("_size"), F.substring(tie, 1, 16).alias("_tie"),
    ).withColumn("_bucket", F.substring("_tie", 1, BUCKET_DIGITS))


def _plan(sizes: DataFrame, weights, max_repeat, share, seed) -> DataFrame:
    """For each (source, size, bucket): the rank of its first document, the rate, offset and target of its source."""
    counts = sizes.groupBy("_key", "_size", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    in_size = W.partitionBy("_key", "_size").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_in_size", F.coalesce(F.sum("_n").over(in_size), F.lit(0)))
    by_size = sizes.groupBy("_key", "_size").agg(F.count(F.lit(1)).alias("_n"))
    in_source = W.partitionBy("_key").orderBy("_size").rowsBetween(W.unboundedPreceding, -1)
    by_size = by_size.select("_key", "_size", F.coalesce(F.sum("_n").over(in_source), F.lit(0)).alias("_smaller"))
    sources = sizes.groupBy("_key").agg(F.sum("_size").alias("source_size"))
    targets = source_targets(sources, weights, max_repeat, share)
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * (1 << SCALE))).otherwise(F.lit(0))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}"), "_key").cast("binary")), 1, SCALE // 4), 16, 10).cast("long")
    targets = targets.withColumn("_rate", expected.cast("long")).withColumn("_offset", start)
    starts = counts.join(by_size, ["_key", "_size"]).select("_key", "_size", "_bucket", (F.col("_in_size") + F.col("_smaller")).alias("_first"))
    return starts.join(targets, "_key")


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``_copies``: the integers between the running sums before and after the document."""
    here = W.partitionBy("_key", "_size", "_bucket").orderBy("_tie", "_id")
    ranked = rows.join(plan, ["_key", "_size", "_bucket"]).withColumn("_rank", F.col("_first") + F.row_number().over(here) - 1)
    at = lambda rank: F.shiftright(rank * F.col("_rate") + F.col("_offset"), SCALE)
    return ranked.withColumn("_copies", at(F.col("_rank") + 1) - at(F.col("_rank")))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, share: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: the id, ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken`` (words)."""
    rows = staged(_keyed(docs, id_col, text_col, source_col).drop("_row"), "mix-sizes")
    mixed = _copies(rows, _plan(rows, weights, max_repeat, share, seed))
    return mixed.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, share: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken. The texts are shuffled once."""
    rows = _keyed(docs, id_col, text_col, source_col)
    plan = _plan(staged(rows.select("_key", "_size", "_bucket"), "mix-sizes"), weights, max_repeat, share, seed)
    mixed = _copies(rows, plan).filter(F.col("_copies") > 0)
    repeated = mixed.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    return repeated.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
