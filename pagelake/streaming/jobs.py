"""Structured Streaming jobs (ST1-ST6).

Sources are file streams with fixed schemas; sinks are files (append) or
``foreachBatch`` writes for complete-mode aggregates, all under the shared
checkpoint folder.  ``run_available`` drains what is available (trigger
``availableNow``) and returns, so the same job serves batch back-fills and
incremental runs resumed from its checkpoint.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pagelake.sources import logs as LG

# The driver's own Python runner of stateful streams does not see shipped packages.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def run_available(writer, checkpoint: str) -> None:
    """Start with trigger(availableNow) and wait for it to drain."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _overwrite_to(path: str):
    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    return write


def first_seen_urls(stream: DataFrame, out: str, ckpt: str, within: str | None = None) -> None:
    """ST1: online de-duplication of visited URLs.  ``within`` bounds the
    state with ``dropDuplicatesWithinWatermark`` (a URL may reappear after
    that delay); without it the state holds every distinct URL."""
    if within:
        d = stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(["url"])
    else:
        d = stream.dropDuplicates(["url"])
    run_available(d.select("url", "event_id", "ts").writeStream.format("parquet").option("path", out), ckpt)


def live_counters(stream: DataFrame, out: str, ckpt: str) -> None:
    """ST2: running counters per event type (complete mode, rewritten per batch)."""
    agg = stream.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value_sum"))
    run_available(agg.writeStream.outputMode("complete").foreachBatch(_overwrite_to(out)), ckpt)


def windowed_counts(stream: DataFrame, out: str, ckpt: str, window: str = "1 day", delay: str = "1 day",
                    complete: bool = False) -> None:
    """ST3: requests per tumbling window and type.  Append mode emits a window
    once the watermark (max event time - delay) passes its end; ``complete``
    keeps and rewrites all windows, also the open ones."""
    if not complete:
        stream = stream.withWatermark("ts", delay)
    agg = stream.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("events"))
    agg = agg.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                     "event_type", "events")
    if complete:
        run_available(agg.writeStream.outputMode("complete").foreachBatch(_overwrite_to(out)), ckpt)
    else:
        run_available(agg.writeStream.outputMode("append").format("parquet").option("path", out), ckpt)


def window_verdicts(t: np.ndarray, start: int | None, count: int, window_us: int, cap: int):
    """Fixed-window limiter over ascending times of one key, continuing a window that
    began at ``start`` with ``count`` requests let through: (allowed, start, count).
    Works window by window; times before the open window count in it."""
    allowed = np.zeros(len(t), bool)
    i = 0
    while i < len(t):
        if start is None or t[i] - start > window_us:
            start, count = int(t[i]), 0
        end = int(np.searchsorted(t, start + window_us, side="right"))
        passed = min(cap - count, end - i)
        if passed > 0:
            allowed[i:i + passed] = True
            count += passed
        i = end
    return allowed, start, count


class Limiter(StatefulProcessor):
    """ST4: one state row per key: start of the open window, requests let through in
    it, newest request.  A key's rows arrive in pieces of an Arrow batch; only
    their times and ids are held (16 bytes a row) to be put in time order, so a hot
    key costs little more than its rows in the state store's task."""

    def __init__(self, window_us: int, cap: int, forget_us: int):
        self.window_us, self.cap, self.forget_us = window_us, cap, forget_us

    def init(self, handle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start LONG, cnt INT, last LONG")

    def handleInputRows(self, key, rows, timerValues):
        pieces = [(p["t"].to_numpy(), p["event_id"].to_numpy()) for p in rows]
        t, ids = (np.concatenate(c) for c in zip(*pieces))
        order = np.lexsort((ids, t))
        t, ids = t[order], ids[order]
        start, count, last = self.window.get() if self.window.exists() else (None, 0, None)
        allowed, start, count = window_verdicts(t, start, count, self.window_us, self.cap)
        last = max(int(t[-1]), last if last is not None else int(t[-1]))
        self.window.update((start, count, last))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((last + self.forget_us) // 1000 + 1)
        for lo in range(0, len(t), 1 << 16):
            yield pd.DataFrame({"event_id": ids[lo:lo + (1 << 16)], "allowed": allowed[lo:lo + (1 << 16)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.window.clear()  # its next request opens a window anyway
        return iter(())

    def close(self) -> None:
        pass


STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rate_limited(stream: DataFrame, key: str, window_seconds: int, cap: int, out: str, ckpt: str,
                 delay: str = "1 minute", keep_seconds: int = 0) -> None:
    """ST4: run the limiter over a stream of (key, ts, event_id) with
    ``transformWithState``; the state lies in RocksDB under the checkpoint.  Every
    row gets a verdict, however late: one older than its key's open window counts in
    that window.  A timer forgets a key once the watermark (newest ts of the batches
    before, less ``delay``) is a window and ``keep_seconds`` past its newest request.
    A batch's rows bound the memory, so limit batches with ``maxFilesPerTrigger`` or
    ``maxBytesPerTrigger`` on the source."""
    spark = stream.sparkSession
    # The watermark drives the timers; the rows themselves carry a plain number, so none is dropped as late.
    src = (stream.withWatermark("ts", delay)
           .select(F.col(key).alias("k"), F.unix_micros(F.col("ts")).alias("t"), "event_id"))
    res = src.groupBy("k").transformWithStateInPandas(
        Limiter(window_seconds * 1_000_000, cap, (window_seconds + keep_seconds) * 1_000_000),
        outputStructType="event_id LONG, allowed BOOLEAN", outputMode="append", timeMode="EventTime")
    before = spark.conf.get(STATE_PROVIDER)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        run_available(res.writeStream.format("parquet").option("path", out), ckpt)
    finally:
        spark.conf.set(STATE_PROVIDER, before)


def limiter_state(spark: SparkSession, ckpt: str) -> DataFrame:
    """The limiter's state as a table, read from its checkpoint: (key, start, allowed,
    last), times in microseconds."""
    rows = spark.read.format("statestore").option("stateVarName", "window").load(ckpt)
    return rows.select(F.col("key.k").alias("key"), F.col("value.start").alias("start"),
                       F.col("value.cnt").alias("allowed"), F.col("value.last").alias("last"))


def write_ingested(batch: DataFrame, epoch: int, table_dir: str) -> None:
    """One micro-batch of pages and their links, each in the folder of its
    batch; a replayed batch overwrites its own folders."""
    from pagelake.operators.extract import link_edges
    pages = batch.select("page_id", "url", F.octet_length("html").alias("bytes"))
    pages.write.mode("overwrite").parquet(f"{table_dir}/pages/batch={epoch}")
    link_edges(batch, "strict").select("page_id", "pos", "target").write.mode("overwrite").parquet(
        f"{table_dir}/links/batch={epoch}")


def page_ingest(stream: DataFrame, table_dir: str, ckpt: str) -> None:
    """ST5: new page files -> link extraction -> log-structured tables, one
    folder per micro-batch; the read side keeps the latest version per URL (W2
    merge-on-read; of several rows of a URL in one batch the largest page_id)."""
    run_available(stream.writeStream.foreachBatch(lambda b, epoch: write_ingested(b, epoch, table_dir)), ckpt)


def read_ingested(spark: SparkSession, table_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = (spark.read.parquet(f"{table_dir}/pages").groupBy("url")
             .agg(F.max(F.struct("batch", "page_id", "bytes")).alias("v")).select("url", "v.*"))
    links = spark.read.parquet(f"{table_dir}/links").join(pages.select("page_id", "batch"), ["page_id", "batch"])
    return pages, links


def log_tail(lines: DataFrame, out: str, ckpt: str, threshold: str = "WARNING") -> None:
    """ST6: tail a level-format log: parse (S11), keep >= threshold (F18),
    count per level."""
    parsed = LG.at_least(LG.parse_level_log(lines), threshold)
    agg = parsed.groupBy("level", "level_rank").agg(F.count("*").alias("lines"))
    run_available(agg.writeStream.outputMode("complete").foreachBatch(_overwrite_to(out)), ckpt)


def url_stream(events: DataFrame) -> DataFrame:
    """Events as URL visits (the url-log fixture, streaming form)."""
    return events.select("event_id", "event_type", "value", "user_id", F.col("ts").cast("timestamp").alias("ts"),
                         F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".example.com/"),
                                  F.col("event_type")).alias("url"))
