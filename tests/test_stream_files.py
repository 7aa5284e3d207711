"""The registered stream's files follow the buckets of its state."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tideline.catalog import sources


def test_a_bucket_lies_in_one_file_per_delivery(spark, sf, monkeypatch):
    seen, real = {}, sources.vintages.stream_vintages

    def spy(session, folder, *args):
        raw = session.read.option("sep", "|").csv(folder).select(F.col("_c1").cast("bigint").alias("loan_id"), F.input_file_name().alias("f"))
        files = raw.groupBy(F.pmod(F.xxhash64("loan_id"), F.lit(sources.BUCKETS)).alias("b")).agg(F.countDistinct("f").alias("n"))
        seen.update({r.b: r.n for r in files.collect()})
        return real(session, folder, *args)

    monkeypatch.setattr(sources.vintages, "stream_vintages", spy)
    assert entry.queries()["L1_stream_vintages"](spark, sf).count() > 0
    assert len(seen) > 8 and max(seen.values()) <= 4
