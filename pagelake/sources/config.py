"""Crawler configuration as filter tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG_SCHEMA = ("crawler STRUCT<max_depth: INT, max_pages: INT, max_file_size_mb: DOUBLE>, "
                 "filters STRUCT<allowed_domains: ARRAY<STRING>, excluded_paths: ARRAY<STRING>, "
                 "allowed_extensions: ARRAY<STRING>, image_extensions: ARRAY<STRING>>")


def write_config(spark: SparkSession, path: str, config: dict) -> None:
    """Write one multi-line JSON config document."""
    text = json.dumps(config, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path)


def filter_table(config: DataFrame, name: str) -> DataFrame:
    """One filter list of the config exploded to a one-column table."""
    return config.select(F.explode(F.col(f"filters.{name}")).alias("value")).distinct()


def filter_lists(config: DataFrame) -> dict[str, list[str]]:
    """All filter lists of a config document (one small row) as Python lists,
    for building native predicates instead of non-equi joins."""
    row = config.select("filters.*").first()
    return {k: list(v or []) for k, v in row.asDict().items()}
