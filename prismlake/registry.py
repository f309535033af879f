"""Where queries over the driver's tables and their DuckDB SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prismlake.datasets import Library, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a function of a ``Library`` under its name."""

    def register(f: Callable[[Library], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Library(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register
