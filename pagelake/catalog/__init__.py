"""Registry of the named queries that the entry module exposes.

Each query is a function ``(spark, sf_dir) -> DataFrame`` over the driver
tables, registered together with the equivalent DuckDB SQL (or ``None`` when
the operator is not SQL-expressible, e.g. iterative or stateful streaming).
Every computed column carries an explicit alias shared by both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module so its queries register."""
    import importlib

    for mod in MODULES:
        importlib.import_module(f"pagelake.catalog.{mod}")


MODULES = ["urls", "extraction", "graph", "reports", "tables", "text", "robots", "limits", "sources", "streams"]
