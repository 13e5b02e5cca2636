"""Connected components of a link table by alternating stars.

Each round hangs every node under the smallest neighbour it can see (large
star), then flattens (small star); the number of rounds grows with the
logarithm of a component's width.  Minima are combined map-side, so a hub costs
one row per task; every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import spill


def _to_smallest(pairs: DataFrame, small: bool) -> DataFrame:
    """pairs (u, v), all neighbours v of u: link them to the least of u and v."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    far = pairs.where("v < u") if small else pairs.where("v > u")
    linked = far.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if small:
        linked = linked.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of
    ``links`` (a, b); nodes without links do not appear."""
    edges = spill(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_smallest(both.toDF("u", "v"), small=False)
        large = spill(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "large")
        edges = spill(_to_smallest(large, small=True), "small")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    told = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return told.unionByName(told.select(F.col("component").alias("node"), "component").distinct())
