"""Resource-limit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.catalog import register
from pagelake.catalog._sql import crawled_pages as CP
from pagelake.catalog._sql import url_log as UL
from pagelake.operators import limits as L
from pagelake.plans import fixtures as FX
from pagelake.session import table

RATE_WINDOW_S = 6 * 3600
RATE_CAP = 2
ROBOTS_TTL_S = 24 * 3600
QUOTA_BYTES = 50_000
RETENTION_S = 3 * 3600


def _fold_sql(source: str, key: str, window: str, cap: int, inclusive: bool, out: str) -> str:
    """Oracle: the sequential per-key fold as a recursive CTE."""
    reset = f"ev.ts >= r.start + {window}" if inclusive else f"ev.ts > r.start + {window}"
    return f"""
WITH RECURSIVE ev AS (
  SELECT {key} AS k, ts, event_id, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn
  FROM {source}),
r AS (
  SELECT k, rn, ts AS start, 1 AS cnt, true AS ok, event_id FROM ev WHERE rn = 1
  UNION ALL
  SELECT ev.k, ev.rn,
    CASE WHEN {reset} THEN ev.ts ELSE r.start END,
    CASE WHEN {reset} THEN 1 WHEN r.cnt >= {cap} THEN r.cnt ELSE r.cnt + 1 END,
    CASE WHEN {reset} THEN true ELSE r.cnt < {cap} END,
    ev.event_id
  FROM r JOIN ev ON ev.k = r.k AND ev.rn = r.rn + 1)
SELECT event_id, ok AS {out} FROM r"""


@register("rate_limit_flags", _fold_sql("events", "user_id", f"INTERVAL {RATE_WINDOW_S} SECOND",
                                        RATE_CAP, False, "allowed"))
def rate_limit_flags(spark, sf_dir):
    """Fixed-window limiter per user, 6 h window, 2 requests."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    out = L.anchored_windows(e, "user_id", "ts", "event_id", RATE_WINDOW_S, RATE_CAP)
    return out.select("event_id", "allowed")


@register("robots_refetch_due", _fold_sql(
    f"(SELECT event_id, ts, regexp_extract(url, 'https?://([^/]+)', 1) AS domain FROM {UL()})",
    "domain", f"INTERVAL {ROBOTS_TTL_S} SECOND", 1, True, "fetch_due"))
def robots_refetch_due(spark, sf_dir):
    """Robots.txt cache; a lookup refetches when no fetch is cached or
    the cached one is at least 24 h old (same anchored window, cap 1)."""
    from pagelake.functions import urls as U
    log = FX.url_log(spark, sf_dir).select("event_id", "ts", U.search_domain("url").alias("domain"))
    out = L.anchored_windows(log, "domain", "ts", "event_id", ROBOTS_TTL_S, 1, inclusive_reset=True)
    return out.select("event_id", F.col("allowed").alias("fetch_due"))


@register("disk_quota", f"""
SELECT page_id, domain, usage_after, usage_after <= {QUOTA_BYTES} AS admitted FROM (
  SELECT page_id, domain, CAST(sum(bytes) OVER (PARTITION BY domain ORDER BY ts_epoch, page_id
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS usage_after
  FROM {CP()})
""")
def disk_quota(spark, sf_dir):
    """Per-domain storage accounting in crawl order with a quota."""
    cp = FX.crawled_pages(spark, sf_dir).select("page_id", "domain", "ts_epoch", "bytes")
    out = L.disk_quota(cp, "domain", ["ts_epoch", "page_id"], "bytes", QUOTA_BYTES)
    return out.select("page_id", "domain", F.col("usage_after").cast("bigint"), "admitted")


@register("idle_rate_keys", f"""
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_request,
       max(ts) < (SELECT max(ts) FROM events) - INTERVAL {RATE_WINDOW_S} SECOND AS evicted
FROM events GROUP BY 1
""")
def idle_rate_keys(spark, sf_dir):
    """Last request per key; keys idle for more than the window at
    the latest event time are evicted."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    out = L.idle_keys(e, "user_id", "ts", now, RATE_WINDOW_S)
    return out.select("user_id", F.date_format("last_request", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_request"),
                      "evicted")


@register("retention_sweep", f"""
SELECT CAST(count_if(m - ts_epoch > {RETENTION_S}) AS BIGINT) AS removed,
       CAST(coalesce(sum(bytes) FILTER (WHERE m - ts_epoch > {RETENTION_S}), 0) AS BIGINT) AS bytes_freed,
       CAST(count_if(NOT (m - ts_epoch > {RETENTION_S})) AS BIGINT) AS kept
FROM {CP()}, (SELECT max(ts_epoch) AS m FROM {CP()})
""")
def retention_sweep(spark, sf_dir):
    """Remove stored pages older than 3 h at the newest crawl time."""
    cp = FX.crawled_pages(spark, sf_dir)
    now = cp.agg(F.max("ts_epoch")).first()[0]
    return L.retention(cp, "ts_epoch", "bytes", now, RETENTION_S)
