"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.session import bounded_broadcast, scratch_path, ship_package, small_enough, table

__all__ = ["ASCII_SPACE", "BYTE_LIMIT", "bounded_broadcast", "column", "documents", "free", "fresh", "map_batches", "register",
           "scratch", "small_enough", "spill", "table", "text_or_empty"]

#: The white space of every word contract here: space and tab to carriage return.
ASCII_SPACE = r"[\x20\x09-\x0D]"

#: Bytes of text that one Arrow batch of documents should not exceed by much.
BYTE_LIMIT = 16 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Name a query, with the DuckDB SQL for the same rows where there is one."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def fresh(taken: list[str], base: str) -> str:
    """A column name like ``base`` that clashes with none of ``taken`` (Spark
    compares names without regard to case)."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base = "_" + base
    return base


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The column ``name`` cast to ``kind``; also finds names with dots."""
    return F.col(f"`{name}`").cast(kind)


def text_or_empty(c: Column | str = "text") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def map_batches(df: DataFrame, task, schema) -> DataFrame:
    """``mapInArrow`` with this package importable on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(task, schema)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; it goes when the driver's
    file system closes."""
    path = scratch_path(spark, name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any
    more: its cleaner only learns of them when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it
    back: lineage ends there, a lost executor costs no recomputation, and later
    readers get only the columns they ask for."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
