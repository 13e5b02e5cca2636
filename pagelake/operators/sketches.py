"""A7, A18, ST2: distinct counts that merge, split by window and key.

Exact counts stay the default (``live_counters``); they need the log again for
every new grouping.  Here each window and key keeps two sketches of its values, a
few kilobytes whatever the log's size: HyperLogLog for counts of unions, theta for
unions, intersections and differences.  Coarser windows and groups come from
merging sketches, new and returning values from subtracting them; the log is read
once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithms of the sketches' sizes, and the relative error that results
#: stay within (over three standard errors of either sketch: 0.8 % each).
LG_HLL, LG_THETA = 14, 14
ERROR = 0.03


def distinct_sketches(log: DataFrame, ts: str, value: str, by: list[str], window: str = "1 day") -> DataFrame:
    """(start, ``by``, n, hll, theta) per tumbling window of ``ts`` and group; null
    values are not counted as values, only as rows."""
    return (log.groupBy(F.window(ts, window).start.alias("start"), *by)
            .agg(F.count("*").alias("n"), F.hll_sketch_agg(value, F.lit(LG_HLL)).alias("hll"),
                 F.theta_sketch_agg(value, F.lit(LG_THETA)).alias("theta")))


def rolled_up(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches merged to coarser groups (``by`` may be empty or hold ``start``)."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"),
                                     F.theta_union_agg("theta", F.lit(LG_THETA)).alias("theta"))


def distinct_hll(c: str | Column = "hll") -> Column:
    return F.hll_sketch_estimate(c)


def distinct_theta(c: str | Column = "theta") -> Column:
    return F.theta_sketch_estimate(c)


def newcomers(now: str | Column, before: str | Column) -> Column:
    """Estimated values of the theta sketch ``now`` that ``before`` does not have."""
    return F.theta_sketch_estimate(F.theta_difference(now, before))


def returning(now: str | Column, before: str | Column) -> Column:
    """Estimated values that both theta sketches have."""
    return F.theta_sketch_estimate(F.theta_intersection(now, before))


def within(estimate: Column, exact: Column, scale: Column | None = None) -> Column:
    """Whether an estimate is as near as ``ERROR`` promises; the error of a difference
    is relative to the union, ``scale``."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), F.lit(ERROR) * (exact if scale is None else scale))
