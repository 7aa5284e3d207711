"""Speeds over files that keep arriving.

State lies in the shared folder; a micro-batch adds one version of each part:

* ``months/version=v/bucket=b``: complete (loan, month) rows of the loans of a hash bucket that batch ``v`` touched; a loan's newest
  version is its state, so a later file can move a payoff. Where a bucket has ``fold`` versions, the batch writes all its loans
  instead, and older versions of it are no longer read;
* ``cells/version=v``: the whole speed cube after the batch, that is the cube before it, less what the touched loans gave, plus what
  they give now;
* ``heads/version=v``: which versions of each bucket are to be read. It is written last, so a version counts once this is there.

A batch reads the buckets of its own loans, at most ``fold`` versions each, however many batches came before. It reads versions
below its own only and a replayed batch overwrites its own, so results are exactly-once. The version before the last stays until
a later batch starts, because the last one can be replayed; what is older is removed. Late rows are merged, never dropped: there
is no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tideline.functions import rates
from tideline.operators import survival
from tideline.session import cut_lineage, remove
from tideline.sources.shards import read_or_empty

MONTHS = "loan_id bigint, yyyymm bigint, n_rows bigint, n_valid bigint, w_valid double, month_upb double, month_rate double, version bigint, bucket int"
CELLS = "coupon_bucket double, yyyymm bigint, n_atrisk bigint, n_prepay bigint, upb_atrisk double, upb_prepay double"
HEADS = "bucket int, buckets int, versions array<bigint>, version bigint"
SUMS = ["n_atrisk", "n_prepay", "upb_atrisk", "upb_prepay"]


def heads(spark: SparkSession, folder: str, buckets: int | None = None) -> dict[int, dict[int, list[int]]]:
    """Per version that is kept (three at most), the versions to read of each bucket: as small as the number of buckets. A state
    in another number of ``buckets``, if given, is refused."""
    out: dict[int, dict[int, list[int]]] = {}
    for r in read_or_empty(spark, f"{folder}/heads", HEADS).collect():
        if buckets not in (None, r["buckets"]):
            raise ValueError(f"state is in {r['buckets']} buckets, not {buckets}")
        out.setdefault(r["version"], {})[r["bucket"]] = r["versions"]
    return out


def bucket_rows(spark: SparkSession, folder: str, head: dict[int, list[int]], touched: list[int]) -> DataFrame:
    """Newest (loan, month) rows of every loan in the touched buckets. No other bucket is listed or read."""
    paths = [f"{folder}/months/version={v}/bucket={b}" for b in touched for v in head.get(b, [])]
    if not paths:
        return spark.createDataFrame([], MONTHS).drop("version")
    log = spark.read.schema(MONTHS).option("basePath", f"{folder}/months").parquet(*paths)
    newest = log.withColumn("_newest", F.max("version").over(W.partitionBy("bucket", "loan_id")))
    return newest.filter(F.col("version") == F.col("_newest")).drop("version", "_newest")


def _contributions(months: DataFrame) -> DataFrame:
    state = survival.with_loan_state(months).filter(F.col("first_rate").isNotNull())
    return state.groupBy(rates.coupon_bucket("first_rate").alias("coupon_bucket"), "yyyymm").agg(
        *[F.sum(c).alias(n) for n, c in survival.at_risk_balance().items()])


def _forget(spark: SparkSession, folder: str, known: dict[int, dict[int, list[int]]], last: int) -> None:
    """Remove the versions before ``last`` and the bucket files that ``last`` does not read."""
    read = {(v, b) for b, versions in known[last].items() for v in versions}
    for old in (v for v in known if v < last):
        for v, b in {(v, b) for b, versions in known[old].items() for v in versions} - read:
            remove(spark, f"{folder}/months/version={v}/bucket={b}")
        remove(spark, f"{folder}/cells/version={old}")
        remove(spark, f"{folder}/heads/version={old}")


def merge_batch(folder: str, buckets: int = 256, fold: int = 8):
    """foreachBatch function that folds new panel rows into the state.

    ``buckets`` is fixed by the first batch of a folder; another number is refused later. Take as many as let one bucket's loans
    fit in a task.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = {v: h for v, h in heads(spark, folder, buckets).items() if v < batch_id}
        last = max(known, default=None)
        if last is not None:
            _forget(spark, folder, known, last)
        head = known.get(last, {})
        fresh = cut_lineage(survival.loan_months(batch).withColumn("bucket", F.pmod(F.xxhash64("loan_id"), F.lit(buckets)).cast("int")))
        touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())
        full = [b for b in touched if len(head.get(b, [])) >= fold]
        state = bucket_rows(spark, folder, head, touched)
        ids = fresh.select("bucket", "loan_id").distinct()
        old = cut_lineage(state.join(ids, ["bucket", "loan_id"], "left_semi"))
        merged = cut_lineage(
            old.unionByName(fresh).groupBy("bucket", "loan_id", "yyyymm").agg(
                F.sum("n_rows").alias("n_rows"), F.sum("n_valid").alias("n_valid"), F.sum("w_valid").alias("w_valid"),
                F.max("month_upb").alias("month_upb"), F.max("month_rate").alias("month_rate")))
        rest = state.filter(F.col("bucket").isin(full)).join(ids, ["bucket", "loan_id"], "left_anti") if full else None
        out = merged if rest is None else merged.unionByName(rest)
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/months/version={batch_id}")

        less = _contributions(old).select("coupon_bucket", "yyyymm", *[(-F.col(c)).alias(c) for c in SUMS])
        before = spark.createDataFrame([], CELLS) if last is None else spark.read.schema(CELLS).parquet(f"{folder}/cells/version={last}")
        cells = before.unionByName(less).unionByName(_contributions(merged)).groupBy("coupon_bucket", "yyyymm").agg(*[F.sum(c).alias(c) for c in SUMS])
        cells.write.mode("overwrite").parquet(f"{folder}/cells/version={batch_id}")

        now = {**head, **{b: [batch_id] if b in full else [*head.get(b, []), batch_id] for b in touched}}
        listed = spark.createDataFrame([(b, buckets, v) for b, v in now.items()], HEADS.rsplit(",", 1)[0])
        listed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/heads/version={batch_id}")

    return merge


def cube(spark: SparkSession, folder: str) -> DataFrame:
    """Cells with speeds after the last whole batch. Read it before two more batches have started."""
    last = max(heads(spark, folder), default=None)
    cells = spark.createDataFrame([], CELLS) if last is None else spark.read.schema(CELLS).parquet(f"{folder}/cells/version={last}")
    live = cells.filter(F.col("n_atrisk") > 0)
    return survival.balance_speeds(live).withColumn("implied_mbs_coupon", rates.implied_coupon("coupon_bucket"))


def run_available(stream: DataFrame, folder: str, buckets: int = 256, fold: int = 8) -> None:
    """Process every file there is now, then stop; call again for later files."""
    query = (
        stream.writeStream.foreachBatch(merge_batch(folder, buckets, fold))
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
