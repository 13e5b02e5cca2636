"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a keyed random order.  A document
that ends at ``cum`` words of its queue has the virtual finish time
``cum / target`` of its source; repeats queue up behind the first pass, at
``source_size + cum``.  All tickets are range-sorted on that time and taken
until the budget is used up, so at any point each source has given words in
proportion to its target.

Targets share the budget by weight, none above ``max_repeats`` times its
source; what a full source cannot take is reshared by weight among the rest.

Scale: the texts are read once, for their word counts.  A queue is cut into
slices of a few thousand documents by the leading digits of the shuffle key;
slice totals (combined map-side) give each slice its start, so a source with a
third of all rows runs in many tasks.  The resharing loop moves one row of
totals a round to the driver.  The budget line is found from per-partition
totals; only the partition it crosses is summed row by row.  The verdict per
document is a comparison with that line, without another shuffle.

Defined results: null text has size 0 and takes 0; a null source is a source
of its own, last in order; repeated rows are separate documents; an empty table
gives an empty table; a budget of 0 takes nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import bounded_broadcast, documents, fresh, register, spill, text_or_empty
from pagelake.operators.tables import with_global_rank

WEIGHTS = (3, 1, 2)
BUDGET_SHARE = 1.5
MAX_REPEATS = 2
#: Documents of a queue slice, on average.
SLICE_ROWS = 4_096
#: Rows of a plan that is broadcast at most.
ID_LIMIT = 1_000_000
SEED = "mix"


def word_count(text) -> F.Column:
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def queue_order(doc_id: F.Column) -> F.Column:
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def queue_name(source: F.Column) -> F.Column:
    """A string without nulls that sorts like the source, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, queue, size, h) of every row."""
    return spill(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"),
                             queue_name(F.col("source")).alias("queue"), word_count("text").alias("size"),
                             queue_order(F.col("doc_id")).alias("h")), "sized")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = BUDGET_SHARE, max_repeats: int = MAX_REPEATS):
    """(queue, source_size, target) and the budget in words."""
    per = sizes.groupBy("queue").agg(F.sum("size").alias("source_size"))
    per = with_global_rank(per.select("queue", "source_size"), ["queue"], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    per = per.select("queue", "source_size", weight.alias("weight"),
                     (F.col("source_size") * max_repeats).cast("double").alias("most")).checkpoint()
    total = per.agg(F.sum("source_size")).first()[0] or 0
    budget = share * total
    level, full = 0.0, -1
    while True:  # reshare: sources at or below the level are full; the rest share what is left
        is_full = F.col("most") <= level * F.col("weight")
        n, taken, open_weight = per.agg(
            F.count(F.when(is_full, 1)), F.coalesce(F.sum(F.when(is_full, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not open_weight:
            break
        full, level = n, max(0.0, budget - taken) / open_weight
    target = F.round(F.least(F.col("most"), F.lit(level) * F.col("weight")), 6)
    return per.select("queue", "source_size", target.alias("target")), budget


def queued(sizes: DataFrame, per: DataFrame) -> DataFrame:
    """``sizes`` with source_size, target and cum, the words of the queue up to
    and including the document."""
    rows = sizes.count()
    digits = max(1, math.ceil(math.log(max(2.0, rows / SLICE_ROWS), 16)))
    sizes = sizes.withColumn("slice", F.substring("h", 1, digits))
    before = Window.partitionBy("queue").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.groupBy("queue", "slice").agg(F.sum("size").alias("words"))
              .withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
              .join(per, "queue").select("queue", "slice", "start", "source_size", "target"))
    upto = (Window.partitionBy("queue", "slice").orderBy("h", "doc_id", "uid")
            .rowsBetween(Window.unboundedPreceding, 0))
    return (sizes.withColumn("inner", F.sum("size").over(upto)).join(starts, ["queue", "slice"])
            .withColumn("cum", F.col("start") + F.col("inner")).drop("slice", "start", "inner"))


def finish(turn: int) -> F.Column:
    return (F.col("source_size") * turn + F.col("cum")) / F.col("target")


def ticket(turn: int) -> F.Column:
    """The place of a document's turn in the global order."""
    return F.struct(finish(turn).alias("finish"), "queue", "h", "doc_id", "uid", F.lit(turn).alias("turn"))


def cut_line(q: DataFrame, budget: float, turns: int):
    """The last ticket inside the budget, or None."""
    spark = q.sparkSession
    tickets = (q.where("size > 0 AND target > 0")
               .select("size", F.explode(F.array(*[ticket(t) for t in range(turns)])).alias("t"))
               .select("size", "t.*"))
    order = ["finish", "queue", "h", "doc_id", "uid", "turn"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = spill(tickets.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "tickets")
    left, part = budget, None
    for r in ranged.groupBy("part").agg(F.sum("size").alias("words")).orderBy("part").collect():  # a row a partition
        if r.words > left:
            part = r.part
            break
        left -= r.words
    upto = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = (ranged.where(F.col("part") == part).withColumn("run", F.sum("size").over(upto)).where(F.col("run") <= left)
              if part is not None else ranged)
    last = inside.orderBy(*[F.desc(c) for c in order]).select(*order).limit(1).collect()
    if not last and part:
        last = ranged.where(F.col("part") < part).orderBy(*[F.desc(c) for c in order]).select(*order).limit(1).collect()
    return last[0] if last else None


def mix(docs: DataFrame, weights=WEIGHTS, share: float = BUDGET_SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, uid, size, source_size, target, turns, taken) of every row."""
    sizes = sized(docs)
    per, budget = targets(sizes, weights, share, max_repeats)
    q = spill(queued(sizes, per), "queued")
    line = cut_line(q, budget, max_repeats)
    turns = F.lit(0)
    if line is not None:
        end = F.struct(F.lit(line.finish), F.lit(line.queue), F.lit(line.h),
                       F.lit(line.doc_id).cast("long"), F.lit(line.uid).cast("long"), F.lit(line.turn))
        for t in range(max_repeats):
            turns = turns + F.when((F.col("size") > 0) & (F.col("target") > 0) & (ticket(t) <= end), 1).otherwise(0)
    return q.withColumn("turns", turns).select(
        "doc_id", "uid", "size", "source_size", "target", "turns", (F.col("turns") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, max_repeats: int = MAX_REPEATS, **kw) -> DataFrame:
    """``docs`` with each row as often as the mix takes it.

    The texts stay where they are while the plan is small enough to broadcast.
    Rows that share a doc_id (or have none) and a size cannot be told apart by
    the plan; they share out their turns in order of their texts."""
    plan = mix(docs, max_repeats=max_repeats, **kw)
    no, size, turns, place = (fresh(docs.columns, c) for c in ("doc_key", "size", "turns", "place"))
    total, there, different = plan.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if total == there == different:
        want = spill(plan.where("turns > 0").select(F.col("doc_id").alias(no), F.col("turns").alias(turns)), "turns")
        rows = docs.withColumn(no, F.col("doc_id").cast("long")).join(bounded_broadcast(want, ID_LIMIT), no)
    else:
        key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
        at_least = [F.sum((F.col("turns") >= t).cast("long")).alias(f"{turns}{t}") for t in range(1, max_repeats + 1)]
        want = spill(plan.groupBy(key.alias(no), F.col("size").alias(size)).agg(*at_least), "turns")
        nth = Window.partitionBy(no, size).orderBy(text_or_empty("text"))
        rows = (docs.withColumn(no, key).withColumn(size, word_count("text")).withColumn(place, F.row_number().over(nth))
                .join(want, [no, size])
                .withColumn(turns, sum((F.col(place) <= F.col(f"{turns}{t}")).cast("int") for t in range(1, max_repeats + 1)))
                .where(F.col(turns) > 0))
    return rows.withColumn(turns, F.explode(F.sequence(F.lit(1), F.col(turns)))).select(*[f"`{c}`" for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rk
      FROM d GROUP BY source),
w AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, rk,
             CASE (rk - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight,
             (2 * source_size)::DOUBLE AS most FROM s),
b AS (SELECT 1.5 * sum(size)::DOUBLE AS budget FROM d),
-- the level at which the k sources that fill first are full and the rest share what is left
o AS (SELECT *, sum(most) OVER k - most AS below, sum(weight) OVER r AS rest, most / weight AS fills
      FROM w WINDOW k AS (ORDER BY most / weight, rk), r AS (ORDER BY most / weight DESC, rk DESC)),
l AS (SELECT min_by((budget - below) / rest, fills) FILTER (fills >= (budget - below) / rest) AS level FROM o, b),
t AS (SELECT source, source_size, round(least(most, level * weight), 6) AS target FROM w, l),
q AS (SELECT d.doc_id, d.source, d.size, d.h, t.source_size, t.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT doc_id, size, sum(size) OVER (ORDER BY (source_size * turn + cum)::DOUBLE / target, source IS NULL,
               encode(source), h, doc_id, turn ROWS UNBOUNDED PRECEDING) AS run
      FROM q, (VALUES (0), (1)) AS x(turn) WHERE size > 0 AND target > 0),
n AS (SELECT doc_id, count(*) AS turns FROM k, b WHERE run <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(n.turns, 0) * q.size AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.doc_id = n.doc_id
"""


@register("op7_mix_sources", ORACLE)
def op7_mix_sources(spark, sf_dir):
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
