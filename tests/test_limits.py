"""Rate limiter, TTL and running totals against sequential brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pagelake.operators import limits as L

T0 = dt.datetime(2024, 1, 1)


def fold(times, window, cap, inclusive=False):
    out, start, cnt = [], None, 0
    for t in times:
        if start is None or (t - start >= window if inclusive else t - start > window):
            start, cnt = t, 0
        if cnt >= cap:
            out.append(False)
        else:
            cnt += 1
            out.append(True)
    return out


def run(spark, rows, window, cap, inclusive=False):
    df = spark.createDataFrame([(i, k, T0 + dt.timedelta(seconds=s)) for i, (k, s) in enumerate(rows)],
                               "event_id long, k string, ts timestamp")
    res = L.anchored_windows(df, "k", "ts", "event_id", window, cap, inclusive)
    got = {r.event_id: r.allowed for r in res.collect()}
    return [got[i] for i in range(len(rows))]


def test_fixture_cap2_window60(spark):
    rows = [("a", s) for s in (0, 1, 2, 60, 61)]
    assert run(spark, rows, 60, 2) == [True, True, False, False, True]


def test_inclusive_reset_ttl(spark):
    rows = [("a", s) for s in (0, 10, 60, 119, 120)]
    assert run(spark, rows, 60, 1, inclusive=True) == [True, False, True, False, True]


def test_random_against_fold(spark):
    rng = random.Random(7)
    rows = []
    for key in "abc":
        t = 0
        for _ in range(300 if key == "a" else 40):   # one hot key
            t += rng.choice([0, 1, 5, 20, 59, 60, 61, 200])
            rows.append((key, t))
    got = run(spark, rows, 60, 3)
    want = {}
    for key in "abc":
        idx = [i for i, r in enumerate(rows) if r[0] == key]
        for i, ok in zip(idx, fold([rows[i][1] for i in idx], 60, 3)):
            want[i] = ok
    assert got == [want[i] for i in range(len(rows))]


def test_rate_limit_rejections_sf001(spark):
    from tests.conftest import SF_CHECK
    from pagelake.session import table
    e = table(spark, SF_CHECK, "events")
    out = L.anchored_windows(e, "user_id", "ts", "event_id", 6 * 3600, 2)
    assert out.where(~F.col("allowed")).count() == 819


def test_running_total_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, i % 5 + 1) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r.k, r.o): r.run for r in L.running_total(df, "k", ["o"], "v", "run").collect()}
    acc = {}
    for k, o, v in sorted(rows, key=lambda r: (r[0], r[1])):
        acc[k] = acc.get(k, 0) + v
        assert got[(k, o)] == acc[k]


def test_pair_start_stop(spark):
    from pagelake.operators.reports import pair_start_stop, profile_summary
    rows = [("load", "stop", 0), ("load", "start", 10), ("load", "start", 20), ("load", "stop", 25),
            ("load", "stop", 30), ("parse", "start", 5), ("save", "stop", 7)]
    df = spark.createDataFrame([(o, k, T0 + dt.timedelta(seconds=s)) for o, k, s in rows],
                               "op string, kind string, ts timestamp")
    calls = pair_start_stop(df, "op", "kind", "ts")
    got = {r.op: (r.total_seconds, r.calls) for r in profile_summary(calls).collect()}
    assert got == {"load": (15.0, 2), "parse": (0.0, 0)}


def test_null_keys_are_a_key(spark):
    rows = [(None, 0), ("a", 0), (None, 1), (None, 2), ("a", 1)]
    assert run(spark, rows, 60, 1) == [True, True, False, False, False]
    df = spark.createDataFrame([(None, 1, 5), ("n", 1, 2), (None, 2, 7)], "k string, o long, v long")
    got = sorted((r.k or "", r.o, r.run) for r in L.running_total(df, "k", ["o"], "v", "run").collect())
    assert got == [("", 1, 5), ("", 2, 12), ("n", 1, 2)]
