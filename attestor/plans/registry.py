"""Named queries over the driver's tables, each with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestor.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(t), where t(table) reads a table, as a query."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda n: table(spark, sf_dir, n))

        run.__name__, run.__doc__ = name, f.__doc__
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
