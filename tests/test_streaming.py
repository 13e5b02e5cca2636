"""Streams over folder tables and replayed micro-batches."""

import os
import random

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_streams_read_folder_tables(spark, tmp_path):
    from pagelake import catalog
    catalog.load_all()
    for name in ("events", "pages"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in ("stream_first_seen_urls", "stream_live_counters", "stream_page_ingest"):
        run = catalog.QUERIES[query]
        assert sorted(map(tuple, run(spark, str(tmp_path)).collect())) == sorted(map(tuple, run(spark, SF_SMALL).collect()))


def test_replayed_batch_changes_nothing(spark, tmp_path):
    from pagelake.streaming import jobs as SJ
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url", "html")
    where = str(tmp_path / "ingested")
    os.makedirs(where)
    seen = []
    for epoch in (0, 0, 1):
        SJ.write_ingested(pages, epoch, where)
        found, links = SJ.read_ingested(spark, where)
        seen.append((found.count(), links.count()))
    assert seen[0] == seen[1] == seen[2] and seen[0][0] == pages.select("url").distinct().count()


def test_limiter_answers_equal_and_late_timestamps(spark, tmp_path):
    from datetime import datetime, timedelta

    from pagelake.operators.limits import anchored_windows
    from pagelake.streaming import jobs as SJ
    schema = "event_id long, user_id long, ts timestamp"
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    batches = [[(1, 1, at(0)), (2, 1, at(7000)), (3, 2, at(7000)), (4, None, at(7000))],
               [(5, 1, at(7000)), (6, 2, at(7000)), (7, 3, at(7000)), (8, None, at(7000)), (9, 1, at(7001))],
               [(10, 1, at(10)), (11, 4, at(10)), (12, None, at(20))]]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        SJ.rate_limited(spark.readStream.schema(schema).parquet(src), "user_id", 60, 2, out, ckpt, keep_seconds=86_400)
        seen.append({r.event_id: r.allowed for r in spark.read.parquet(out).collect()})
    requests = spark.read.parquet(src)
    in_time = requests.where("event_id < 10")
    want = {r.event_id: r.allowed for r in anchored_windows(in_time, "user_id", "ts", "event_id", 60, 2).collect()}
    assert seen[1] == want and set(want) == set(range(1, 10))
    # Late rows are answered too: they count in their key's open window; key 4 is new.
    assert seen[2] == want | {10: False, 11: True, 12: False}
    micros = lambda s: int((at(s) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    state = {r.key: (r.start, r.allowed, r.last) for r in SJ.limiter_state(spark, ckpt).collect()}
    assert state == {1: (micros(7000), 2, micros(7001)), 2: (micros(7000), 2, micros(7000)), 3: (micros(7000), 1, micros(7000)),
                     4: (micros(10), 1, micros(10)), None: (micros(7000), 2, micros(7000))}


def test_verdicts_by_window():
    import numpy as np

    from pagelake.streaming.jobs import window_verdicts
    r = random.Random(3)
    for _ in range(200):
        t = np.array(sorted(r.randint(0, 300) for _ in range(r.randint(1, 60))), np.int64)
        window, cap = r.choice([0, 1, 10, 50]), r.choice([0, 1, 2, 5])
        begin, done = r.choice([(None, 0), (40, min(cap, 1))])
        start, count, want = begin, done, []
        for x in t.tolist():
            if start is None or x - start > window:
                start, count = x, 0
            want.append(count < cap)
            count += count < cap
        allowed, s, c = window_verdicts(t, begin, done, window, cap)
        assert allowed.tolist() == want and (s, c) == (start, count)


def test_limiter_with_one_hot_key(spark, tmp_path):
    from pagelake.streaming import jobs as SJ
    rows = spark.range(200_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 500).alias("user_id"),
                                       F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("ts"))
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    rows.repartition(4).write.parquet(src)
    SJ.rate_limited(spark.readStream.schema(rows.schema).parquet(src), "user_id", 1000, 5, out, ckpt)
    got = spark.read.parquet(out)
    assert got.count() == 200_000
    times = sorted((x.ts.timestamp(), x.event_id) for x in rows.where("user_id = -1").collect())
    start, count, want = None, 0, set()
    for t, i in times:
        if start is None or t - start > 1000:
            start, count = t, 0
        if count < 5:
            want.add(i)
            count += 1
    assert {x.event_id for x in got.where("allowed").join(rows.where("user_id = -1"), "event_id").collect()} == want
