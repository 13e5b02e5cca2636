"""Resource limits (A20-A25): quotas, fixed-window rate limits, eviction,
retention and cache TTL, as distributed jobs that tolerate hot keys.

Fixed-window rate limit (A21, and A25 with cap 1)
-------------------------------------------------
Per key, a window opens at a request and lasts ``W``; the first request after
(A21: more than, A25: at least) ``W`` from the window start opens the next
window; within a window the first ``cap`` requests pass.  Rejected requests
never move the window, so the window starts depend on timestamps only:
they are the chain ``first -> nxt -> nxt ...`` where ``nxt(e)`` is the first
request after ``e + W``.  Computed without a per-key sequential pass:

1. ``nxt`` is an as-of lookup: events and probes (``e + W``) are put in
   descending order per key and the nearest later event is a running minimum
   (``running_agg``), which is linear and spreads a hot key over many tasks.
2. The chain from each key's first request is marked by pointer doubling
   (``J[k+1] = J[k] o J[k]``, then ``M |= J[k](M)`` from the largest k down):
   O(log L) equi-joins on unique event ids, L = most windows of a key; rows
   whose jump leaves the data are dropped as the jumps grow.
3. Every request's window start is the running maximum of the marked starts.
4. The ``cap``-th request of each window comes from a per-window top-k
   (partial top-k before the shuffle), joined back one row per window.

A null key is a key of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.session import bounded_broadcast, cut_lineage


def _micros(ts) -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _key_code(key: str) -> F.Column:
    """The key as a string without nulls, so that null is a key of its own."""
    return F.when(F.col(key).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(key).cast("string")))


def _next_after(e: DataFrame, w_us: int, inclusive: bool) -> DataFrame:
    """(eid, nxt): first event of the same key with t > t_e + W (t >= t_e + W
    when ``inclusive``); events without one have no row."""
    none = F.lit(None).cast("long")
    probe_rank = F.lit(0) if inclusive else F.lit(2)  # probe before / after equal-time events
    events = e.select("k", "t", F.lit(1).alias("o"), "eid", none.alias("src"))
    probes = e.select("k", (F.col("t") + w_us).alias("t"), probe_rank.alias("o"), none.alias("eid"), F.col("eid").alias("src"))
    u = events.unionByName(probes)
    event = F.when(F.col("eid").isNotNull(), F.struct("t", "eid"))
    later = running_agg(u, "k", [F.desc("t"), F.desc("o"), F.desc("eid")], event, "later", "min")
    return (later.where(F.col("src").isNotNull() & F.col("later").isNotNull())
            .select(F.col("src").alias("eid"), F.col("later.eid").alias("nxt")))


def anchored_windows(df: DataFrame, key: str, ts: str, event_id: str, window_seconds: float,
                     cap: int, inclusive_reset: bool = False) -> DataFrame:
    """Adds ``window_start`` (event id opening the request's window) and
    ``allowed`` to ``df``.  ``event_id`` must be unique; equal timestamps are
    ordered by it; a null key is a key of its own."""
    w_us = int(window_seconds * 1_000_000)
    e = cut_lineage(df.select(_key_code(key).alias("k"), _micros(ts).alias("t"), F.col(event_id).cast("long").alias("eid")))

    jumps = [cut_lineage(_next_after(e, w_us, inclusive_reset))]
    bucket = F.floor(F.col("t") / F.lit(w_us))
    longest = e.groupBy("k").agg(F.countDistinct(bucket).alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(1, max(1, math.ceil(math.log2(longest + 1)))):
        prev = jumps[-1]
        jumps.append(cut_lineage(prev.alias("a").join(prev.alias("c"), F.col("a.nxt") == F.col("c.eid"))
                                 .select(F.col("a.eid").alias("eid"), F.col("c.nxt").alias("nxt"))))

    marked = e.groupBy("k").agg(F.min(F.struct("t", "eid")).alias("h")).select(F.col("h.eid").alias("eid"))
    for j in reversed(jumps):
        marked = cut_lineage(marked.unionByName(marked.join(j, "eid").select(F.col("nxt").alias("eid"))).distinct())

    opened = e.join(marked.withColumn("opens", F.lit(True)), "eid", "left")
    assigned = running_agg(opened, "k", ["t", "eid"], F.when(F.col("opens"), F.struct("t", "eid")), "s", "max")
    assigned = assigned.select("k", "eid", "t", F.col("s.eid").alias("window_start"))

    wr = Window.partitionBy("window_start").orderBy("t", "eid")
    top = assigned.withColumn("rn", F.row_number().over(wr)).where(F.col("rn") <= cap)
    last_ok = top.groupBy("window_start").agg(F.max(F.struct("t", "eid")).alias("last_ok"))
    flagged = (assigned.join(last_ok, "window_start", "left")
               .select(F.col("eid").alias("__eid"), "window_start",
                       F.coalesce(F.struct("t", "eid") <= F.col("last_ok"), F.lit(False)).alias("allowed")))
    return df.join(flagged, F.col(event_id).cast("long") == F.col("__eid")).drop("__eid")


def running_agg(df: DataFrame, key: str, order: list, value, out: str, how: str = "sum", exclusive: bool = False) -> DataFrame:
    """Running ``sum``, ``max`` or ``min`` of ``value`` per ``key`` in ``order``
    (inclusive, or of the rows before if ``exclusive``) without putting a hot key in one task: range-partition on
    (key, order), aggregate within each (key, partition) slice, and combine
    with the aggregate of the key's earlier slices (one small row per slice).
    The aggregates are associative, so slice results compose exactly.  A null
    key is a key of its own; a running max or min before the first non-null
    value is null."""
    fn = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(value) if isinstance(value, str) else value
    r = cut_lineage(df.withColumns({"__v": v, "__key": _key_code(key)}).repartitionByRange(n, "__key", *order)
                    .withColumn("__pid", F.spark_partition_id()))
    w_local = Window.partitionBy("__key", "__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    local = r.withColumn("__local", fn("__v").over(w_local))
    slices = r.groupBy("__key", "__pid").agg(fn("__v").alias("__slice"))
    w_carry = Window.partitionBy("__key").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = slices.select("__key", "__pid", fn("__slice").over(w_carry).alias("__carry"))
    joined = local.join(bounded_broadcast(carry), ["__key", "__pid"])
    if how == "sum":
        combined = F.coalesce(F.col("__local"), F.lit(0)) + F.coalesce(F.col("__carry"), F.lit(0))
    else:
        combined = (F.greatest if how == "max" else F.least)(F.col("__local"), F.col("__carry"))
    return joined.withColumn(out, combined).drop("__pid", "__local", "__carry", "__v", "__key")


def running_total(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """Running sum per key (see ``running_agg``)."""
    return running_agg(df, key, order, value, out, "sum")


def disk_quota(files: DataFrame, key: str, order: list[str], size: str, quota: int) -> DataFrame:
    """Usage accounting per key; ``admitted`` when usage before the file
    plus its size stays within the quota (every stored file counts)."""
    t = running_total(files, key, order, size, "usage_after")
    return t.withColumn("admitted", F.col("usage_after") <= F.lit(quota))


def idle_keys(df: DataFrame, key: str, ts: str, now, idle_seconds: int) -> DataFrame:
    """Last request per key (touch = max time); keys idle longer
    than the window at ``now`` are evicted."""
    last = df.groupBy(key).agg(F.max(ts).alias("last_request"))
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(idle_seconds)} SECONDS")
    return last.withColumn("evicted", F.col("last_request").cast("timestamp") < cutoff)


def retention(files: DataFrame, ts_epoch: str, size: str, now_epoch: int, max_age_seconds: int) -> DataFrame:
    """Files older than ``max_age`` at ``now`` are removed; count and
    bytes freed vs kept."""
    old = F.lit(now_epoch) - F.col(ts_epoch) > F.lit(max_age_seconds)
    return files.agg(F.count_if(old).alias("removed"),
                     F.coalesce(F.sum(F.when(old, F.col(size))), F.lit(0)).cast("bigint").alias("bytes_freed"),
                     F.count_if(~old).alias("kept"))
