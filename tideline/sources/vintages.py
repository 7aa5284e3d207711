"""Raw vintage files: pipe-separated text, no header, leading pipe (so the first
field is empty), one file or folder per origination quarter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tideline.functions import periods, rates

N_FIELDS = 114  # fixed value: the empty first field plus 113 data fields

# fixed values: 0-based field positions
POSITIONS = {
    "loan_id": 1, "mmyyyy": 2, "note_rate": 7, "orig_upb": 9, "upb": 11, "orig_mmyyyy": 13, "file_age": 15,
    "ltv": 19, "dti": 22, "fico": 23, "purpose": 26, "property_type": 27, "zip3": 32, "zbc": 106,
}
TEXT = {"purpose", "property_type"}
WHOLE = {"loan_id", "mmyyyy", "orig_mmyyyy", "file_age", "dti", "fico", "zip3", "zbc"}

RAW_SCHEMA = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(N_FIELDS)])


def vintage_of(path: Column) -> Column:
    """Origination quarter, taken from the file or folder name."""
    return F.regexp_extract(path, "([0-9]{4}Q[1-4])", 1)


def _reader(spark: SparkSession, stream: bool):
    reader = spark.readStream if stream else spark.read
    return reader.format("csv").schema(RAW_SCHEMA).option("sep", "|").option("header", "false").option("mode", "PERMISSIVE")


def typed(raw: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Selected positions as typed columns. Anything that does not parse is NULL;
    rows without a loan or a valid month drop; order keys are YYYYMM."""
    wanted = columns or list(POSITIONS)
    out = []
    for name in wanted:
        c = F.trim(F.col(f"f{POSITIONS[name]}"))
        if name in TEXT:
            out.append(F.nullif(c, F.lit("")).alias(name))
        elif name in WHOLE:
            out.append(rates.lenient_numeric(c, "bigint").alias(name))
        else:
            out.append(rates.lenient_numeric(c, "double").alias(name))
    df = raw.select(*out, vintage_of(F.col("_metadata.file_path")).alias("vintage"))
    if "mmyyyy" in wanted:
        df = df.withColumn("yyyymm", periods.to_yyyymm_text("mmyyyy")).filter(F.col("yyyymm").isNotNull())
    if "orig_mmyyyy" in wanted:
        df = df.withColumn("orig_ym", periods.to_yyyymm_text("orig_mmyyyy"))
    return df.filter(F.col("loan_id").isNotNull()) if "loan_id" in wanted else df


def scan_vintage(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """One vintage. Only the selected fields are parsed (CSV column pruning)."""
    return typed(_reader(spark, False).load(path), columns)


def scan_all(spark: SparkSession, folder: str, vintages: list[str] | None = None, pattern: str = "vintage={}", columns: list[str] | None = None) -> DataFrame:
    """All vintages of a folder, or a named list. A glob with alternatives skips
    names that are not there."""
    names = "*" if vintages is None else "{" + ",".join(vintages) + "}"
    return typed(_reader(spark, False).load(f"{folder}/{pattern.format(names)}"), columns)


def stream_vintages(spark: SparkSession, folder: str, files_per_batch: int = 1, columns: list[str] | None = None) -> DataFrame:
    """The same typed rows as a stream of newly arriving files."""
    raw = _reader(spark, True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return typed(raw, columns)


def raw_fields(panel: DataFrame) -> DataFrame:
    """Panel columns laid out as the raw file's text fields (for writers and tests)."""
    out = []
    at = {pos: name for name, pos in POSITIONS.items()}
    for i in range(N_FIELDS):
        name = at.get(i)
        c = F.col(name).cast("string") if name in panel.columns else F.lit(None).cast("string")
        out.append(c.alias(f"f{i}"))
    return panel.select(*out, *[c for c in ("vintage", "part") if c in panel.columns])


def to_panel_table(df: DataFrame, table: str, folder: str | None = None) -> None:
    """Write the typed panel once: partitioned by vintage for pruning, rows
    range-clustered by loan and month inside it; below ``folder`` if given.

    One layout for every input. Ranges are cut by row count, so a loan with very
    many rows is spread over files instead of filling one.
    """
    ready = df.repartitionByRange("vintage", "loan_id", "yyyymm").sortWithinPartitions("vintage", "loan_id", "yyyymm")
    writer = ready.write.mode("overwrite").partitionBy("vintage").format("parquet")
    (writer.option("path", f"{folder}/{table}") if folder else writer).saveAsTable(table)


def of_vintages(panel: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of a panel table whose vintage a small table names: its files are picked when the small table is known (dynamic
    pruning), so no other vintage is read."""
    return panel.join(wanted.select("vintage"), "vintage", "left_semi")


def to_month_table(months: DataFrame, table: str, folder: str, buckets: int = 200) -> DataFrame:
    """Write (loan, month) rows once, bucketed and sorted by loan, and return the table: what groups, joins or windows by loan
    afterwards meets without an exchange.

    Only combined rows may be laid out so: a loan has at most one row per calendar month and key there, so no bucket can be hot.
    The files lie below ``folder``, which all executors share.
    """
    writer = months.repartition(buckets, "loan_id").write.mode("overwrite").option("path", f"{folder}/{table}").format("parquet")
    writer.bucketBy(buckets, "loan_id").sortBy("loan_id", "yyyymm").saveAsTable(table)
    return months.sparkSession.table(table)
