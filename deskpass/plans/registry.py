"""Query registry behind ``__spark_entry__.queries()`` and ``oracle_sql()``.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables. The
oracle is DuckDB SQL over the same tables (registered as views by name).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    from deskpass.plans import (requests, rules, relational, metrics, sessions,  # noqa: F401
                                text, vectors, models, streams, files)
