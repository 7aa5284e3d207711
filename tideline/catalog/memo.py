"""Results that several queries of a session read, written once to the shared folder.

A result is kept for the files it was made from: another file, length or time below the tables' folder makes it anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tideline.session import run_dir

_WRITTEN: dict[tuple, str] = {}


def listing(fx) -> tuple[int, int]:
    """Number and digest of the files below the tables' folder (path, length, time), summed by Spark."""
    files = fx.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(fx.sf_dir)
    digest = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38, 0)"))
    many, total = files.select("path", "length", "modificationTime").agg(F.count(F.lit(1)), digest).first()
    return many, int(total or 0)


def written(fx, name: str, write: Callable[[str], None]) -> str:
    """Path of the named result; ``write`` puts it there if no query of this session has for the same files."""
    if not hasattr(fx, "_listing"):  # once per query
        fx._listing = listing(fx)
    key = (fx.spark.sparkContext.applicationId, fx.sf_dir, fx._listing, name)
    if key not in _WRITTEN:
        path = run_dir(fx.spark, name)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def table(fx, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The named result as a DataFrame; for tables that stay small however large the input is."""
    return fx.spark.read.parquet(written(fx, name, lambda to: make().write.parquet(to)))


def forget() -> None:
    """Makes every result anew from now on (a benchmark of single queries)."""
    _WRITTEN.clear()
