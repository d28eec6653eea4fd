"""Name -> query and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is what DuckDB must answer the same to."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


# Rows of a part that ``spread`` makes: what a task does grows with its rows, however few bytes these take in the file.
ROWS = 1 << 17


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A test table. ``spread`` deals the rows of a table with few splits to all cores, and to parts of about ``ROWS`` rows.

    Only small inputs have fewer splits than cores, and only tables of short rows fewer than parts; others are read as
    they are split, without a shuffle. The rows are counted from the files' footers.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    if not spread:
        return rows
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    if rows._jdf.queryExecution().toRdd().getNumPartitions() < parts:
        return rows.repartition(parts, rows.columns[0])
    return rows
