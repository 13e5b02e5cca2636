"""Metric series for any (name, end, minutes).

Recorded values (name, value, ts) are pre-aggregated into one-minute panes and
those into panes of 2, 4, 8, ... minutes, each with count, sum, least, greatest and
a KLL quantile sketch.  A window is covered by at most two panes of each size, so
asking is an equi-join of few rows per question, with no range join and no second
look at the log; only the two minutes that the window begins and ends in are read
from the values themselves, so counts, sums and bounds are exact for any instant.
There no question is joined with values: running counts, sums and bounds of the
minute, forwards to a window's end and backwards to its begin, are read off at the
question's place, so a busy minute costs one row per value and question.

Counts, sums and bounds are found first, without the sketches, which are joined
afterwards for the windows that want one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.session import bounded_broadcast, cut_lineage, scratch_path

MINUTE = 60_000_000  # microseconds
#: Quantile sketches are exact up to this many values; beyond, ranks are about 0.5 % off.
K = 512
#: Most panes (without sketches) that are sent to the questions.
BROADCAST_PANES = 1_000_000
STATS = {"n": F.count, "total": F.sum, "least": F.min, "greatest": F.max}


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp")) if isinstance(c, str) else c


def _merged(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"),
                               F.max("greatest").alias("greatest"), F.kll_merge_agg_double("kll", F.lit(K)).alias("kll"))


def levels_for(minutes: int) -> int:
    """Pane sizes that windows of up to ``minutes`` need: of the largest one, no
    window holds two."""
    return max(1, minutes).bit_length()


def panes(values: DataFrame, minutes: int) -> DataFrame:
    """(name, level, pane, n, total, least, greatest, kll): pane ``p`` of level ``l``
    spans the minutes from p * 2^l on.  Levels go as far as windows of ``minutes``
    need; null values are not recorded."""
    rows = values.where("value IS NOT NULL AND ts IS NOT NULL").select(
        "name", F.expr(f"floor(unix_micros(cast(ts as timestamp)) / {MINUTE})").cast("long").alias("pane"),
        F.col("value").cast("double").alias("value"))
    level = rows.groupBy("name", "pane").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest"),
        F.kll_sketch_agg_double("value", F.lit(K)).alias("kll"))
    level = cut_lineage(level)
    out = level.withColumn("level", F.lit(0))
    for i in range(1, levels_for(minutes)):
        level = cut_lineage(_merged(level.withColumn("pane", F.shiftright("pane", 1)), "name", "pane"))
        out = out.unionByName(level.withColumn("level", F.lit(i)))
    return out


def _cover(lo, hi, levels: int):
    """Panes (level, pane) that together are the minutes from ``lo`` to before ``hi``."""
    parts = []
    for i in range(levels):
        first = F.shiftright(lo + ((1 << i) - 1), i)
        last = F.shiftright(hi, i)
        some = first < last
        parts.append(F.when(some & (first % 2 != 0), F.struct(F.lit(i).alias("level"), first.alias("pane"))))
        parts.append(F.when(some & (last % 2 != 0), F.struct(F.lit(i).alias("level"), (last - 1).alias("pane"))))
    return F.filter(F.array(*parts), lambda p: p.isNotNull())


def _running(side: str):
    """Columns {side}_n, ...: the aggregates of ``value`` over the minute's rows up to
    (``to``) or from (``from``) a row's own time, which is included."""
    order = F.asc("__t") if side == "to" else F.desc("__t")
    w = Window.partitionBy("name", "__m").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return {f"{side}_{k}": fn("value").over(w) for k, fn in STATS.items()}


def _edge_stats(at: DataFrame, q: DataFrame) -> DataFrame:
    """(id, n, total, least, greatest) of the values in the minutes that the windows
    of ``q`` begin and end in: a row for each of the two ends that has values."""
    end = lambda m, t, side: F.struct(F.col(m).alias("__m"), F.col(t).alias("__t"), F.lit(side).alias("side"))
    ends = q.where("__a < __b").select("id", "name", F.explode(F.array(end("__b", "__to", "to"), end("__a", "__from", "from"))).alias("e"))
    rows = at.unionByName(ends.select("id", "name", "e.*"), allowMissingColumns=True)
    rows = rows.withColumns(_running("to")).withColumns(_running("from"))
    own = [F.when(F.col("side") == "to", F.col(f"to_{k}")).otherwise(F.col(f"from_{k}")).alias(k) for k in STATS]
    # a window of no minutes is an instant
    then = at.groupBy("name", F.col("__t").alias("__to")).agg(*[fn("value").alias(k) for k, fn in STATS.items()])
    return (rows.where("side IS NOT NULL").select("id", *own).where("n > 0")
            .unionByName(q.where("__from = __to").join(then, ["name", "__to"]).select("id", *STATS)))


def _edge_sketches(at: DataFrame, q: DataFrame, most: int | None) -> DataFrame:
    """(id, kll) of the same values.  Windows of at most ``most`` values only meet the
    first or last ``most`` of a minute."""
    to_at = from_at = at
    if most is not None:
        placed = at.withColumns({"to_n": _running("to")["to_n"], "from_n": _running("from")["from_n"]})
        to_at, from_at = placed.where(F.col("to_n") <= most), placed.where(F.col("from_n") <= most)
    cols = ["name", "__m", "__t", "value"]
    some = q.where("__a < __b")
    parts = (some.withColumn("__m", F.col("__b")).join(to_at.select(*cols), ["name", "__m"]).where("__t <= __to")
             .unionByName(some.withColumn("__m", F.col("__a")).join(from_at.select(*cols), ["name", "__m"]).where("__t >= __from"))
             .select("id", "value")
             .unionByName(q.where("__from = __to").withColumn("__t", F.col("__to")).join(at, ["name", "__t"]).select("id", "value")))
    return parts.groupBy("id").agg(F.kll_sketch_agg_double("value", F.lit(K)).alias("kll"))


def series(values: DataFrame, asked: DataFrame, minutes: int, sketched: int | None = None) -> DataFrame:
    """For each row (id, name, end, minutes) of ``asked`` the values of that name
    from ``end`` - ``minutes`` to ``end``, both included: (id, n, total, least,
    greatest, kll); n is 0 and the others null for a window without values.
    ``minutes`` bounds the longest window.  With ``sketched``, windows of more values
    than that get no ``kll``: a reader of exact quantiles asks for ``K``."""
    spark, levels = values.sparkSession, levels_for(minutes)
    stored = panes(values, minutes)
    q = asked.select("id", "name", _micros("end").alias("__to"), (_micros("end") - F.col("minutes").cast("long") * MINUTE).alias("__from"))
    minute = lambda c: F.expr(f"floor({c} / {MINUTE})").cast("long")
    q = q.withColumn("__a", minute("__from")).withColumn("__b", minute("__to")).where("name IS NOT NULL")
    inside = _cover(F.col("__a") + 1, F.greatest(F.col("__b"), F.col("__a") + 1), levels)
    covered = lambda of: of.select("id", "name", F.explode(inside).alias("p")).select("id", "name", "p.level", "p.pane")
    at = values.select("name", _micros("ts").alias("__t"), F.col("value").cast("double").alias("value"))
    at = at.where("name IS NOT NULL AND __t IS NOT NULL AND value IS NOT NULL").withColumn("__m", minute("__t"))

    # panes grow with names and minutes, not with values: where they fit, the questions stay where they are
    light = bounded_broadcast(stored.select("name", "level", "pane", *STATS), BROADCAST_PANES)
    whole = covered(q).join(light, ["name", "level", "pane"]).select("id", *STATS)
    found = (whole.unionByName(_edge_stats(at, q)).groupBy("id")
             .agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest")))
    path = scratch_path(spark, "series")
    found.write.parquet(path)  # read twice
    found = spark.read.parquet(path)

    few, held = q, stored
    if sketched is not None:
        few = q.join(found.where(F.col("n") <= sketched).select("id"), "id", "left_semi")
        held = stored.where(F.col("n") <= sketched)
    sketches = (covered(few).join(held.select("name", "level", "pane", "kll"), ["name", "level", "pane"]).select("id", "kll")
                .unionByName(_edge_sketches(at, few, sketched)).groupBy("id").agg(F.kll_merge_agg_double("kll", F.lit(K)).alias("kll")))
    return asked.join(found, "id", "left").join(sketches, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def quantile(kll: str, rank: float):
    return F.kll_sketch_get_quantile_double(kll, F.lit(rank))
