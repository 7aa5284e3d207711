"""Name -> (Spark query, SQL oracle). Modules register with ``@query``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.fixtures.views import Fixtures, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(fx: Fixtures) -> DataFrame``; ``sql`` is its DuckDB twin."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(views, sql)
        return fn

    return register


def rnd(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double so results compare across engines; keep the rest."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType.simpleString()
        if kind == "double":
            c = F.round(c, special.get(field.name, digits)) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def R(expr: str, digits: int = 6) -> str:
    """DuckDB twin of ``rnd`` for one expression."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0)"
