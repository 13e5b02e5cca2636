"""Structured Streaming queries (ST1-ST6): each drains a file stream over
the driver data with trigger(availableNow) and returns the sink contents."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from pagelake.catalog import register
from pagelake.catalog.limits import RATE_CAP, RATE_WINDOW_S, _fold_sql
from pagelake.catalog.sources import LEVEL_OF_TYPE
from pagelake.session import scratch_path, table
from pagelake.streaming import jobs as SJ


def _table_stream(spark, sf_dir, name):
    """File stream over one driver table, be it a file or a folder of parts."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _events_stream(spark, sf_dir):
    return SJ.url_stream(_table_stream(spark, sf_dir, "events"))


@register("stream_first_seen_urls", """
SELECT DISTINCT 'https://h' || CAST(user_id AS VARCHAR) || '.example.com/' || event_type AS url FROM events
""")
def stream_first_seen_urls(spark, sf_dir):
    """ST1: streaming first-seen URL de-duplication; final rows = distinct URLs."""
    out, ck = scratch_path(spark, "st1_out"), scratch_path(spark, "st1_ck")
    SJ.first_seen_urls(_events_stream(spark, sf_dir), out, ck)
    return spark.read.parquet(out).select("url")


@register("stream_first_seen_bounded", """
SELECT DISTINCT 'https://h' || CAST(user_id AS VARCHAR) || '.example.com/' || event_type AS url FROM events
""")
def stream_first_seen_bounded(spark, sf_dir):
    """ST1 with bounded state: a URL is forgotten 400 days after it was seen
    (longer than the log, so the result is that of the unbounded form)."""
    out, ck = scratch_path(spark, "st1b_out"), scratch_path(spark, "st1b_ck")
    SJ.first_seen_urls(_events_stream(spark, sf_dir), out, ck, within="400 days")
    return spark.read.parquet(out).select("url")


@register("stream_live_counters", """
SELECT event_type, count(*) AS events, round(sum(value), 6) AS value_sum FROM events GROUP BY 1
""")
def stream_live_counters(spark, sf_dir):
    """ST2: running counters per event type."""
    out, ck = scratch_path(spark, "st2_out"), scratch_path(spark, "st2_ck")
    SJ.live_counters(_events_stream(spark, sf_dir), out, ck)
    return spark.read.parquet(out).select("event_type", "events", F.round("value_sum", 6).alias("value_sum"))


@register("stream_daily_counts", """
SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events
FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS b, event_type FROM events)
WHERE b + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
GROUP BY b, event_type
""")
def stream_daily_counts(spark, sf_dir):
    """ST3: events per day and type; append mode emits only windows the
    watermark (max time - 1 day) has closed."""
    out, ck = scratch_path(spark, "st3_out"), scratch_path(spark, "st3_ck")
    SJ.windowed_counts(_events_stream(spark, sf_dir), out, ck)
    return spark.read.parquet(out).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                                          "event_type", "events")


@register("stream_daily_counts_complete", """
SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events
FROM events GROUP BY 1, 2
""")
def stream_daily_counts_complete(spark, sf_dir):
    """ST3 in complete mode: all windows, also those still open."""
    out, ck = scratch_path(spark, "st3c_out"), scratch_path(spark, "st3c_ck")
    SJ.windowed_counts(_events_stream(spark, sf_dir), out, ck, complete=True)
    return spark.read.parquet(out).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                                          "event_type", "events")


@register("stream_rate_limit", _fold_sql("events", "user_id", f"INTERVAL {RATE_WINDOW_S} SECOND",
                                         RATE_CAP, False, "allowed"))
def stream_rate_limit(spark, sf_dir):
    """ST4: the A21 limiter online (transformWithState, one state row per key), fed
    in two time-ordered increments resumed from one checkpoint."""
    return spark.read.parquet(_limited(spark, sf_dir)[0]).select("event_id", "allowed")


def _limited(spark, sf_dir, keep_seconds: int = 0) -> tuple[str, str]:
    """Run the limiter over the events; the folders of its output and checkpoint."""
    e = table(spark, sf_dir, "events")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    mid = lo + (hi - lo) / 2
    src, out, ck = (scratch_path(spark, "st4_src"), scratch_path(spark, "st4_out"), scratch_path(spark, "st4_ck"))
    schema = e.schema
    for part in (e.where(F.col("ts") < F.lit(mid)), e.where(F.col("ts") >= F.lit(mid))):
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
        SJ.rate_limited(stream, "user_id", RATE_WINDOW_S, RATE_CAP, out, ck, keep_seconds=keep_seconds)
    return out, ck


@register("stream_limiter_state", """
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(epoch_us(max(ts)) AS BIGINT) AS last_request,
       max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS idle FROM events GROUP BY user_id
""")
def stream_limiter_state(spark, sf_dir):
    """A22 from the limiter's own state: the newest request of each key, and whether
    it was idle for a day at the newest request of all.  Keys are kept for longer than
    the log, so that none is evicted."""
    state = SJ.limiter_state(spark, _limited(spark, sf_dir, keep_seconds=400 * 86_400)[1])
    newest = state.agg(F.max("last")).first()[0]
    return state.select(F.col("key").cast("long").alias("user_id"), F.col("last").alias("last_request"),
                        (F.col("last") < F.lit(newest) - 86_400_000_000).alias("idle"))


@register("stream_page_ingest", """
SELECT page_id, count(*) AS links FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<a\\s+[^>]*href=["'']([^"'']+)["''][^>]*>', 1)) AS href FROM pages)
GROUP BY 1
""")
def stream_page_ingest(spark, sf_dir):
    """ST5: page files streamed into log-structured page/link tables."""
    tbl, ck = scratch_path(spark, "st5_tables"), scratch_path(spark, "st5_ck")
    SJ.page_ingest(_table_stream(spark, sf_dir, "pages"), tbl, ck)
    _, links = SJ.read_ingested(spark, tbl)
    return links.groupBy("page_id").agg(F.count("*").alias("links"))


def _level_case(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in LEVEL_OF_TYPE.items()) + " END"


@register("stream_log_tail", f"""
SELECT level, CAST(list_position(['DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL'], level) - 1 AS INTEGER)
         AS level_rank, count(*) AS lines
FROM (SELECT {_level_case('event_type')} AS level FROM events) WHERE level IN ('WARNING', 'ERROR', 'CRITICAL')
GROUP BY 1
""")
def stream_log_tail(spark, sf_dir):
    """ST6: tail a level-format log file stream, WARNING and above."""
    src, out, ck = scratch_path(spark, "st6_src"), scratch_path(spark, "st6_out"), scratch_path(spark, "st6_ck")
    e = table(spark, sf_dir, "events")
    lvl = F.create_map(*[F.lit(x) for kv in LEVEL_OF_TYPE.items() for x in kv])[F.col("event_type")]
    e.select(F.format_string("%s [%s] %s", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), lvl,
                             "event_type").alias("value")).write.mode("overwrite").text(src)
    SJ.log_tail(spark.readStream.text(src), out, ck)
    return spark.read.parquet(out)
