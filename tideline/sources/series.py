"""Small calendar sources (rates, home prices, prices, curves, parameters) and
result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.functions import periods, rates


def scan_rate_series(spark: SparkSession, path: str) -> DataFrame:
    """Monthly market rate: year, month, rate_30yr, reporting_period (MMYYYY)."""
    df = spark.read.schema("year int, month int, rate_30yr double, reporting_period bigint").option("header", "true").csv(path)
    return df.select(
        periods.to_yyyymm_text("reporting_period").alias("yyyymm"), F.col("reporting_period").alias("mmyyyy"), "rate_30yr",
    ).withColumn("mi", periods.month_index("yyyymm"))


def scan_hpi_long(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("zip3 bigint, reporting_period bigint, hpi double").option("header", "true").csv(path)
    return df.select("zip3", periods.to_yyyymm_text("reporting_period").alias("yyyymm"), "hpi")


def _long(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value).filter(F.col(value).isNotNull())


def hpi_wide_to_long(wide: DataFrame, region: str = "RegionName", from_year: int = 2000) -> DataFrame:
    """One row per zip with a column per YYYY-MM-DD -> mean per zip3 and month."""
    dates = [c for c in wide.columns if c[:4].isdigit() and "-" in c and int(c[:4]) >= from_year]
    zip3 = F.substring(F.lpad(F.col(region).cast("string"), 5, "0"), 1, 3).cast("bigint")
    df = wide.select(zip3.alias("zip3"), *[F.col(f"`{c}`").cast("double").alias(c) for c in dates])
    long = _long(df, ["zip3"], dates, "date_str", "v")
    return long.groupBy("zip3", periods.date_to_yyyymm(F.to_date("date_str")).alias("yyyymm")).agg(F.avg("v").alias("hpi"))


def price_wide_to_long(wide: DataFrame, date: str = "Date", prefix: str = "FNCL ") -> DataFrame:
    """Date x coupon columns -> (date, coupon, price), missing prices dropped."""
    cols = [c for c in wide.columns if c.startswith(prefix)]
    plain = {c: c[len(prefix):].replace(".", "_") for c in cols}
    df = wide.select(F.col(date).cast("date").alias("date"), *[F.col(f"`{c}`").cast("double").alias(p) for c, p in plain.items()])
    long = _long(df, ["date"], list(plain.values()), "name", "price")
    coupon = F.replace(F.col("name"), F.lit("_"), F.lit(".")).cast("double")
    return long.select("date", coupon.alias("coupon"), "price", periods.date_to_yyyymm("date").alias("yyyymm"))


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def scan_params(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Flat JSON parameters as a one-row table; attach with ``.scalar()``."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def sink_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)


def sink_summary(row: DataFrame, path: str) -> None:
    """A one-row nested summary as JSON."""
    row.write.mode("overwrite").json(path)
