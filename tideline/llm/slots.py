"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots that never changes. The bytes of each slot are summed, and a small versioned table
says which shard owns which slot. Rebalancing or adding shards edits that table: a shard keeps its largest slots up to the mean
and gives up the rest, and the slots given up go, largest first, to the shard with the fewest bytes. Records are then placed by
the newest version. Every table here but the records has one row per slot.

Null and empty texts have 8 bytes (the id). A record's slot follows its id and its text's checksum and size, so null ids and ids that
many rows share spread; only rows equal in id and text lie in one slot. Texts may have any length: only their checksum and size
move. An empty table gives an empty result and a map. Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from tideline.llm.frames import staged

SLOTS = 4096
ROW_BYTES = 8


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt round to the shards."""
    return spark.range(slots).select(F.col("id").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Store one version; earlier ones stay readable."""
    slot_map.select("vslot", "shard").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest by default."""
    stored = spark.read.schema("vslot long, shard int, version int").parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version).select("vslot", "shard")


def slot_bytes(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot, from rows with ``vslot`` and ``size``."""
    return records.groupBy("vslot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def rebalanced(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """An edited map for ``shards`` shards (as many as before, or more) with near-equal bytes; few slots move.

    The fold walks once over the slots that were given up; its state is one number per shard.
    """
    known = slot_map.join(F.broadcast(loads), "vslot", "left").select("vslot", "shard", F.coalesce("slot_bytes", F.lit(0)).alias("_b"))
    mean = F.sum("_b").over(W.partitionBy(F.lit(0))) / F.lit(shards)
    in_shard = W.partitionBy("shard").orderBy(F.desc("_b"), "vslot")
    marked = known.withColumn("_mean", mean).withColumn("_sum", F.sum("_b").over(in_shard.rowsBetween(W.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(in_shard))
    marked = marked.withColumn("_stays", (F.col("_sum") <= F.col("_mean")) | (F.col("_nth") == 1) | (F.col("_b") == 0))
    kept = F.collect_list(F.when(F.col("_stays"), F.struct("shard", "_b")))
    loose = F.collect_list(F.when(~F.col("_stays"), F.struct((-F.col("_b")).alias("less"), "vslot")))
    pool = marked.agg(kept.alias("_kept"), F.array_sort(loose).alias("_pool"))  # a row in all, of one entry per slot
    of_shard = lambda i: F.aggregate(F.filter("_kept", lambda x: x["shard"] == i), F.lit(0).cast("long"), lambda total, x: total + x["_b"])
    pool = pool.withColumn("_loads", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), of_shard))

    def place(state, item):
        target = F.array_position(state["loads"], F.array_min(state["loads"])) - 1
        loads_after = F.transform(state["loads"], lambda x, i: F.when(i == target, x - item["less"]).otherwise(x))
        return F.struct(loads_after.alias("loads"), F.concat(state["moves"], F.array(F.struct(item["vslot"].alias("vslot"), target.cast("int").alias("to")))).alias("moves"))

    empty = F.expr("cast(array() as array<struct<vslot:bigint,to:int>>)")
    moves = pool.select(F.explode(F.aggregate("_pool", F.struct(F.col("_loads").alias("loads"), empty.alias("moves")), place)["moves"]).alias("_m"))
    moves = moves.select(F.col("_m.vslot").alias("vslot"), F.col("_m.to").alias("_to"))
    return slot_map.join(F.broadcast(moves), "vslot", "left").select("vslot", F.coalesce("_to", "shard").alias("shard"))


def records_of(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``size``, ``text_crc32`` and ``vslot`` of every document."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("vslot", slot_of(F.col("_id"), F.col("text_crc32"), F.col("size"), slots=slots))


def sharded(docs: DataFrame, path: str, shards: int, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's shard. Starts a map in the empty folder ``path`` (version 1), rebalances it by bytes (version 2) and places
    all records by the newest version; ``rebalanced`` and ``placed`` carry an existing map on.

    Columns: the id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` (the row's place in its shard, without gaps),
    ``grown_shard`` (null: the map follows bytes), ``vslot`` and ``map_version``. Rows are numbered inside a slot; a slot's
    first number is a sum over the slots before it in its shard.
    """
    spark = docs.sparkSession
    records = staged(records_of(docs, slots, id_col, text_col), "slot-records")
    loads = slot_bytes(records)
    save_map(first_map(spark, shards, slots), path, 1)
    save_map(rebalanced(load_map(spark, path, 1), loads, shards), path, 2)
    return placed(records, load_map(spark, path), loads, id_col).withColumn("map_version", F.lit(2))


def placed(records: DataFrame, slot_map: DataFrame, loads: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Records with their shard and place under a map. The map has one row per slot, so it is broadcast."""
    before = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    owned = slot_map.join(F.broadcast(loads.select("vslot", "slot_rows")), "vslot", "left")
    owned = owned.select("vslot", "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(W.partitionBy("vslot").orderBy("_id", "text_crc32", "size")) - 1
    rows = records.withColumn("_nth", nth).join(F.broadcast(owned), "vslot")
    return rows.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")
