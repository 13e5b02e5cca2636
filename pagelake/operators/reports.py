"""Crawl statistics (A1-A19): partial/final hash aggregates, one small result.

Every report is a grouped aggregate with map-side partial aggregation; the
only global orders are top-k (TakeOrderedAndProject).  Percent-of-total uses
a one-row total taken as a scalar literal, never by a join or an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.session import cut_lineage


def database_stats(crawled: DataFrame) -> DataFrame:
    """A1: total pages and distinct domains."""
    return crawled.agg(F.count("*").alias("total_pages"), F.countDistinct("domain").alias("domains"))


def pages_per(crawled: DataFrame, col: str) -> DataFrame:
    """A2/A4: page count per domain or per crawl depth."""
    return crawled.groupBy(col).agg(F.count("*").alias("pages"))


def top_by_count(crawled: DataFrame, col: str, k: int = 5) -> DataFrame:
    """A3: top-k groups by count desc, ties by key asc."""
    return pages_per(crawled, col).orderBy(F.desc("pages"), F.asc(col)).limit(k)


def image_stats(images: DataFrame) -> DataFrame:
    """A5: image count, total size in MB (KB / 1024.0), average KB."""
    return images.agg(F.count("*").alias("images"),
                      (F.sum("size_kb") / F.lit(1024.0)).alias("total_mb"),
                      F.avg("size_kb").alias("avg_kb"))


def type_histogram(images: DataFrame, col: str = "image_type") -> DataFrame:
    """Count per type and its percent of all rows."""
    counts = cut_lineage(images.groupBy(col).agg(F.count("*").alias("images")))  # one pass over the images
    total = counts.agg(F.sum("images")).first()[0] or 0
    return counts.withColumn("percent", F.col("images") * F.lit(100.0) / F.lit(float(total)))


def crawl_stats(plan: DataFrame, pages: DataFrame, page_limit: int) -> DataFrame:
    """A8/A10/A17 over a plan with its discovery order: the first
    ``page_limit`` URLs were tried.  Visited URLs are those tried and found,
    failed ones tried without a snapshot row, queued ones not tried yet; bytes
    of the fetched pages, images among the tried URLs; total = all."""
    sizes = pages.groupBy("url").agg(F.max(F.octet_length("html")).alias("__bytes"))
    p = plan.join(sizes, "url", "left").withColumn("__tried", F.col("discovered") <= page_limit)
    visited = F.col("__tried") & F.col("fetched")
    return p.agg(
        F.count("*").alias("total"),
        F.count_if(visited).alias("visited"),
        F.count_if(~F.col("__tried")).alias("queued"),
        F.count_if(F.col("__tried") & ~F.col("fetched") & (F.col("kind") == "page")).alias("failed"),
        F.coalesce(F.sum(F.when(visited, F.col("__bytes"))), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if(F.col("__tried") & (F.col("kind") == "image")).alias("images"))


def progress_percent(visited, max_pages: int):
    """min(100, floor(visited * 100 / max_pages)); 0 when max <= 0."""
    if max_pages <= 0:
        return F.lit(0)
    return F.least(F.lit(100), F.floor(visited * 100 / F.lit(max_pages))).cast("int")


def profile_summary(calls: DataFrame, op: str = "op", seconds: str = "seconds") -> DataFrame:
    """Per operation total time, call count and average (0.0 without
    calls; a row whose ``seconds`` is null names an operation that was started
    and is no call)."""
    return calls.groupBy(op).agg(
        F.coalesce(F.sum(seconds), F.lit(0.0)).alias("total_seconds"), F.count(seconds).alias("calls"),
        F.coalesce(F.sum(seconds) / F.nullif(F.count(seconds), F.lit(0)), F.lit(0.0)).alias("avg_seconds"))


def pair_start_stop(events: DataFrame, op: str, kind: str, ts: str) -> DataFrame:
    """A11 input: each ``stop`` pairs with the latest earlier ``start`` of the
    same operation (a second start overwrites the first; a stop without a
    start is ignored; two stops after one start both count from it).  Every
    started operation also gets a row with null seconds, so that one without a
    stop is reported with no calls.

    The latest start per stop is a running ``max`` of start times over the
    operation's events in time order, computed slice-wise so one hot
    operation spreads over many tasks.  At equal times a stop is ordered
    before a start.
    """
    from pagelake.operators.limits import running_agg
    e = events.withColumn("__t", F.col(ts).cast("timestamp").cast("double")).withColumn(
        "__o", F.when(F.col(kind) == "stop", F.lit(0)).otherwise(F.lit(1)))
    started = running_agg(e, op, ["__t", "__o"], F.when(F.col(kind) == "start", F.col("__t")), "__start", "max")
    stops = started.where((F.col(kind) == "stop") & F.col("__start").isNotNull())
    calls = stops.select(F.col(op).alias("op"), (F.col("__t") - F.col("__start")).alias("seconds"))
    begun = events.where(F.col(kind) == "start").select(F.col(op).alias("op")).distinct()
    return calls.unionByName(begun.withColumn("seconds", F.lit(None).cast("double")))
