"""Where queries over the driver's tables are gathered, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers f(t) under its name, where t(table) reads a table; sql is its oracle."""

    def put(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return put
