"""Derived fixture tables: the crawler's own tables re-derived from the
driver tables, so every report reads data that grows with the input.

* crawled_pages(url, domain, crawl_depth, ts_epoch): one row per page; the
  depth is the strict URL depth (U17), the time a deterministic epoch.
* discovered_images(domain, image_url, image_type, size_kb, ts_epoch): one
  row per derived image reference; type cycles jpg/png/gif/webp by page id.
* url_log(event_id, url, ts): ``events`` rendered as URL visits with repeats.
* crawl_log_lines(line): ``events`` rendered in the simulator log format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import urls as U
from pagelake.operators.extract import derive_image_pages, image_refs
from pagelake.session import table

EPOCH0 = 1_704_067_200  # 2024-01-01T00:00:00Z
IMAGE_TYPES = ["jpg", "png", "gif", "webp"]


def crawled_pages(spark, sf_dir, *keep: str) -> DataFrame:
    """``keep``: further columns of the pages."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id", "url", U.search_domain("url").alias("domain"),
        U.strict_depth("url").alias("crawl_depth"),
        (F.lit(EPOCH0) + F.col("page_id") * 60).cast("bigint").alias("ts_epoch"),
        F.octet_length("html").cast("bigint").alias("bytes"), *keep)


def discovered_images(spark, sf_dir) -> DataFrame:
    p = derive_image_pages(table(spark, sf_dir, "pages"))
    refs = image_refs(p, "strict", keep=("page_id", "url", "html"))
    types = F.array(*[F.lit(t) for t in IMAGE_TYPES])
    return refs.select(
        "page_id", U.search_domain("url").alias("domain"), F.col("target").alias("image_url"),
        F.element_at(types, (F.col("page_id") % 4 + 1).cast("int")).alias("image_type"),
        (F.lit(10) + F.length("html") % 500).cast("bigint").alias("size_kb"),
        (F.lit(EPOCH0) + F.col("page_id") * 60 + F.col("pos")).cast("bigint").alias("ts_epoch"))


def url_log(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".example.com/"),
                 F.col("event_type")).alias("url"))


def crawl_log_lines(spark, sf_dir, busy: bool = False) -> DataFrame:
    """Simulator log format: ``ts [Thread n] Processing URL: u (depth: d)``.
    ``busy``: three lines a second, with a pause of five seconds after every
    hundred lines, in place of the events' times."""
    e = url_log(spark, sf_dir)
    if busy:
        seconds = F.lit(EPOCH0) + F.expr("event_id div 3") + F.expr("event_id div 100") * 5
        e = e.withColumn("ts", F.timestamp_seconds(seconds))
    return e.select(F.format_string(
        "%s [Thread %d] Processing URL: %s (depth: %d)",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), (F.col("user_id") % 8).cast("int"),
        F.col("url"), (F.col("user_id") % 6).cast("int")).alias("line"))
