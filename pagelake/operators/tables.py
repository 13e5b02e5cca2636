"""Keyed page/URL/image tables: upserts, ids, lookups and set operations.

W1/W2 first find the winning (order, row hash) of each key, a grouping of narrow
rows that combines on the map side, so a URL that holds a third of all rows
costs one row per map task before the shuffle; then the wide rows semi-join the
winners.  Only rows that repeat a winner entirely meet once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.session import cut_lineage

TOP_K_LIMIT = 100_000


def _keep_by(df: DataFrame, key: list[str], order: str, pick) -> DataFrame:
    quoted = [F.col(f"`{c}`") for c in df.columns]
    late = F.col(order).isNull() if pick is F.min else F.col(order).isNotNull()  # a null order wins last
    placed = df.withColumn("__place", F.struct(late.alias("l"), F.col(order).alias("o"), F.xxhash64(*quoted).alias("h")))
    won = placed.groupBy(*key).agg(pick("__place").alias("__won")).select(*[F.col(c).alias(f"__{c}") for c in key], "__won")
    same = F.col("__place").eqNullSafe(F.col("__won"))
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    kept = placed.join(won, same, "left_semi").drop("__place")
    return kept.dropDuplicates(key).select(*key, *[c for c in df.columns if c not in key])


def insert_or_ignore(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """The first row per key (smallest ``order``) wins."""
    key = [key] if isinstance(key, str) else key
    return _keep_by(df, key, order, F.min)


def upsert_last(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """The last row per key (largest ``order``) wins."""
    key = [key] if isinstance(key, str) else key
    return _keep_by(df, key, order, F.max)


def with_global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Dense 1-based row numbers in ``order`` without a single-task window.

    Range-partition and sort on ``order`` (ties are broken by the remaining
    columns so equal keys cannot pile into one partition), number rows
    within each partition, then add each partition's offset (one small
    row per partition, broadcast).  Exact, and every step is distributed.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = [c for c in df.columns if c not in order]
    ranged = (df.repartitionByRange(n, *order, *tie).sortWithinPartitions(*order, *tie)
              .withColumn("__mid", F.monotonically_increasing_id()))
    ranged = cut_lineage(ranged)  # freeze the ids before reading them twice
    ranged = ranged.withColumns({"__pid": F.shiftright("__mid", 33),
                                 "__local": F.col("__mid").bitwiseAND((1 << 33) - 1)})
    counts = ranged.groupBy("__pid").agg(F.count("*").alias("__n"))
    from pyspark.sql import Window
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    # one row per partition: a bounded broadcast by construction
    out = ranged.join(F.broadcast(offsets), "__pid")
    return out.withColumn(name, F.col("__off") + F.col("__local") + 1).drop("__pid", "__local", "__mid", "__off")


def first_k(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows in ``order`` (exact).  Small k: distributed top-k
    (TakeOrderedAndProject keeps k rows per task).  Large k: global rank."""
    if k <= TOP_K_LIMIT:
        return df.orderBy(*order).limit(k)
    return with_global_rank(df, order, "__rk").where(F.col("__rk") <= k).drop("__rk")


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default, out: str | None = None) -> DataFrame:
    """Left join + default for a missing key (title/path -> "", visited -> false)."""
    d = dim.select(F.col(key), F.col(value).alias("__v")).dropDuplicates([key])
    return df.join(d, key, "left").withColumn(out or value, F.coalesce(F.col("__v"), F.lit(default))).drop("__v")


def exists_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is known in ``other`` (semi join)."""
    return df.join(other.select(key), key, "left_semi")


def not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is absent from ``other`` (anti join)."""
    return df.join(other.select(key), key, "left_anti")


def mark_visited(urls: DataFrame, done: DataFrame, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """Set ``visited`` for keys present in ``done``; only existing rows
    change.  Returns (updated table, keys of ``done`` that matched nothing)."""
    d = done.select(key).distinct().withColumn("__hit", F.lit(True))
    updated = (urls.join(d, key, "left")
               .withColumn("visited", F.col("visited") | F.coalesce(F.col("__hit"), F.lit(False)))
               .drop("__hit"))
    return updated, done.select(key).distinct().join(urls.select(key), key, "left_anti")
