"""Crawl log sources (S10-S12) and the level threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The three log line shapes and the level order
PROCESSING_RE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \[Thread ([^\]]+)\] Processing URL: (\S+) \(depth: (-?\d+)\)\s*$"
LEVEL_RE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \[(DEBUG|INFO|WARNING|ERROR|CRITICAL)\] (.*)$"
CTIME_RE = r"^\[([A-Z][a-z]{2}) ([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4})\] (ERROR: )?(.*)$"
LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]


def parse_processing_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """``ts [Thread id] Processing URL: u (depth: d)``; other lines dropped."""
    v = F.col(col)
    ok = lines.where(v.rlike(PROCESSING_RE))
    return ok.select(
        F.to_timestamp(F.regexp_extract(v, PROCESSING_RE, 1), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.regexp_extract(v, PROCESSING_RE, 2).alias("thread"),
        F.regexp_extract(v, PROCESSING_RE, 3).alias("url"),
        F.regexp_extract(v, PROCESSING_RE, 4).cast("int").alias("depth"))


def parse_level_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """``ts [LEVEL] message`` with the level's ordinal for F18."""
    v = F.col(col)
    ok = lines.where(v.rlike(LEVEL_RE))
    level = F.regexp_extract(v, LEVEL_RE, 2)
    return ok.select(
        F.to_timestamp(F.regexp_extract(v, LEVEL_RE, 1), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        level.alias("level"), level_rank(level).alias("level_rank"),
        F.regexp_extract(v, LEVEL_RE, 3).alias("message"))


def level_rank(level) -> F.Column:
    """F18 ordinal: DEBUG < INFO < WARNING < ERROR < CRITICAL."""
    return (F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level) - 1).cast("int")


def at_least(df: DataFrame, threshold: str) -> DataFrame:
    """keep lines at or above the threshold level."""
    return df.where(F.col("level_rank") >= LEVELS.index(threshold))


def parse_ctime_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """``[Www Mmm d hh:mm:ss yyyy] ERROR: msg``.  The weekday is dropped
    (parsers accept it only for formatting) and the space-padded day is
    normalised before ``to_timestamp``."""
    v = F.col(col)
    ok = lines.where(v.rlike(CTIME_RE))
    text = F.concat_ws(" ", F.regexp_extract(v, CTIME_RE, 2), F.regexp_extract(v, CTIME_RE, 3),
                       F.regexp_extract(v, CTIME_RE, 4), F.regexp_extract(v, CTIME_RE, 5))
    return ok.select(F.to_timestamp(text, "MMM d HH:mm:ss yyyy").alias("ts"),
                     (F.regexp_extract(v, CTIME_RE, 6) != "").alias("is_error"),
                     F.regexp_extract(v, CTIME_RE, 7).alias("message"))


def lines_per_second(log: DataFrame) -> DataFrame:
    """(second, lines) from the first to the last second of a parsed log, with
    0 for seconds without a line.  The series is a distributed range."""
    counts = log.groupBy(F.date_trunc("second", "ts").alias("second")).agg(F.count("*").alias("lines")).where("second IS NOT NULL")
    first, last = counts.agg(F.unix_timestamp(F.min("second")), F.unix_timestamp(F.max("second"))).first()
    spark = log.sparkSession
    series = spark.range(first or 0, last + 1 if last is not None else 0).select(F.timestamp_seconds("id").alias("second"))
    return series.join(counts, "second", "left").select("second", F.coalesce("lines", F.lit(0)).alias("lines"))


def worker_sessions(log: DataFrame, gap: str = "3 seconds") -> DataFrame:
    """Per worker thread the stretches of work without a pause longer than
    ``gap``: first and last line and how many."""
    return (log.where("ts IS NOT NULL").groupBy("thread", F.session_window("ts", gap).alias("s"))
            .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("lines"))
            .select("thread", "first_ts", "last_ts", "lines"))
