"""Metric windows from panes and mergeable distinct counts against the plain log."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagelake.operators import metrics as M
from pagelake.operators import sketches as S


def test_windows_from_panes(spark):
    r = random.Random(2)
    at = lambda s: datetime(2024, 3, 1) + timedelta(seconds=s)
    values = [(r.choice("ab"), r.choice([None, 1.5, float(r.randint(0, 9))]), at(r.choice([60 * r.randint(0, 300), r.uniform(0, 18_000)])))
              for _ in range(3000)] + [("a", 1.0, None), (None, 2.0, at(60))]
    asked = [(i, r.choice(["a", "b", "none"]), at(r.choice([60 * r.randint(0, 310), r.uniform(-500, 19_000)])), r.choice([0, 1, 2, 3, 7, 60, 129, 200]))
             for i in range(400)]
    v = spark.createDataFrame(values, "name string, value double, ts timestamp").repartition(3)
    q = spark.createDataFrame(asked, "id long, name string, end timestamp, minutes int").repartition(2)
    got = {x.id: x for x in M.series(v, q, 200).withColumn("median", M.quantile("kll", 0.5)).collect()}
    assert len(got) == len(asked)
    for i, name, end, minutes in asked:
        own = sorted(x for n, x, t in values if n == name and x is not None and t and end - timedelta(minutes=minutes) <= t <= end)
        assert got[i].n == len(own), (i, minutes)
        if own:
            assert abs(got[i].total - sum(own)) < 1e-6 and (got[i].least, got[i].greatest) == (own[0], own[-1])
            below, up_to = sum(x < got[i].median for x in own), sum(x <= got[i].median for x in own)
            place, slack = (len(own) + 1) // 2, 0.02 * len(own) if len(own) > M.K else 0  # exact while the sketch holds all
            assert below <= place - 1 + slack and up_to >= place - slack
    assert M.series(v.limit(0), q, 200).where("n = 0").count() == len(asked)


def test_sketches_merge_and_subtract(spark):
    n = 60_000  # more values than the theta sketch holds
    log = spark.range(n).select(F.timestamp_seconds(F.col("id") % 3 * 86_400).alias("ts"), F.concat(F.lit("u"), F.col("id") % 40_000).alias("url"),
                                (F.col("id") % 2).alias("type"))
    log = log.unionByName(spark.createDataFrame([(datetime(1970, 1, 1), None, 0)], "ts timestamp, url string, type long"))
    daily = S.distinct_sketches(log, "ts", "url", ["type"])
    assert daily.count() == 6
    whole = S.rolled_up(daily, []).select("n", S.distinct_hll().alias("h"), S.distinct_theta().alias("t")).first()
    assert whole.n == n + 1 and all(abs(x - 40_000) <= S.ERROR * 40_000 for x in (whole.h, whole.t))
    once = S.rolled_up(S.distinct_sketches(log.withColumn("ts", F.lit(0).cast("timestamp")), "ts", "url", []), [])
    assert once.select(S.distinct_hll().alias("h")).first().h == whole.h
    day = {x.d: x for x in S.rolled_up(daily, ["start"]).select(F.dayofyear("start").alias("d"), "theta").collect()}
    pair = spark.createDataFrame([(day[1].theta, day[2].theta)], "a binary, b binary").select(
        S.newcomers("a", "b").alias("new"), S.returning("a", "b").alias("both")).first()
    urls = [{f"u{i % 40_000}" for i in range(n) if i % 3 == d} for d in (0, 1)]
    scale = S.ERROR * len(urls[0] | urls[1])
    assert abs(pair.new - len(urls[0] - urls[1])) <= scale and abs(pair.both - len(urls[0] & urls[1])) <= scale


def test_busy_minutes_and_sketches_on_demand(spark):
    """Values and questions of one minute, and windows too full for a wanted sketch."""
    r = random.Random(5)
    at = lambda s: datetime(2024, 3, 1) + timedelta(seconds=s)
    values = [("a", float(r.randint(0, 99)), at(r.choice([600 + r.randint(0, 59), r.uniform(0, 1200)]))) for _ in range(800)]
    asked = [(i, "a", at(r.choice([600 + r.randint(0, 59), r.uniform(0, 1200)])), r.choice([0, 1, 2, 5])) for i in range(300)]
    v = spark.createDataFrame(values, "name string, value double, ts timestamp")
    q = spark.createDataFrame(asked, "id long, name string, end timestamp, minutes int")
    got = {x.id: x for x in M.series(v, q, 5, sketched=40).withColumn("median", M.quantile("kll", 0.5)).collect()}
    for i, _, end, minutes in asked:
        own = sorted(x for _, x, t in values if end - timedelta(minutes=minutes) <= t <= end)
        assert got[i].n == len(own)
        assert got[i].median == (own[(len(own) - 1) // 2] if 0 < len(own) <= 40 else None)
        assert not own or (got[i].total, got[i].least, got[i].greatest) == (sum(own), own[0], own[-1])
    assert {bool(x.kll) for x in got.values() if x.n} == {True, False}
