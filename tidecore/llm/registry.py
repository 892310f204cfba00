"""The queries of this folder and, where SQL can say them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

AREAS = ("pair_queries", "text_queries", "search_queries")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its oracle where there is one."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Rows of one Arrow batch: texts and pages are long rows, and a batch stands in memory several times.
ARROW_ROWS = 1024


def long_rows(spark: SparkSession) -> None:
    """Let this application's session send long rows to Python in small batches, unless it chose a size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's default
        spark.conf.set(name, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    long_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    for area in AREAS:
        import_module(f"tidecore.llm.{area}")


def queries() -> dict:
    load()
    return dict(QUERIES)


def oracles() -> dict:
    load()
    return dict(ORACLES)
