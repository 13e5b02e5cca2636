"""Level-synchronous breadth-first traversal of a link graph.

The driver loops over *levels*, never over rows: each level is one
distributed join + de-duplication + anti-join, followed by a reliable
checkpoint that cuts the lineage (a lost executor recomputes at most one
level).  Per level:

* frontier ⋈ edges on ``src``.  The edges are dealt once by (src, salt): a hub
  with a large share of all edges has them in many salts, any other node in one.
  The frontier is broadcast, one row a node, only when its counted size is under
  a bound; otherwise it joins on (src, salt), and only hubs are repeated per salt.
* ``distinct`` / ``sum`` of the discovered nodes is partially aggregated on
  the map side, so a popular target costs one row per map task, not one per
  in-link.
* anti-join with the visited set, a table bucketed by ``node`` to which each
  level is appended: only the new candidates shuffle and only they are written.

``bfs_update`` changes a stored plan by new edges: smaller depths spread from the
edges' ends only.  ``resolve_chains`` follows forwarding pointers (canonical
URLs) to their ends, loops included.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.session import BROADCAST_BYTES, cut_lineage, scratch_path, small_enough

FRONTIER_BROADCAST_ROWS = 200_000
#: A node is a hub from this many edges on, and from this share of a partition's edges on.
HUB_EDGES, HUB_SHARE = 100, 8


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _expand(frontier: DataFrame, edges: DataFrame, value_cols: list[str], size: int | None = None) -> DataFrame:
    """Frontier x edges.  ``size`` is the frontier's already-counted row count: a
    large one is not probed; else rows and bytes are, before a broadcast."""
    bound = FRONTIER_BROADCAST_ROWS
    e = edges.select(F.col("src").alias("node"), "salt", "dst")
    if (size is None or size <= bound) and small_enough(frontier, bound, BROADCAST_BYTES):
        found = F.broadcast(frontier).join(e, "node")
    else:
        # at most HUB_SHARE hubs a partition: a bounded broadcast by construction
        hubs = edges.where("salts > 1").select(F.col("src").alias("node"), "salts").distinct()
        f = frontier.join(F.broadcast(hubs), "node", "left")
        f = f.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        found = f.join(e, ["node", "salt"])
    return found.select(F.col("dst").alias("node"), *value_cols)


def salted_edges(edges: DataFrame, partitions: int) -> DataFrame:
    """(src, dst, salt, salts), each edge once, dealt by (src, salt).  Only a hub has
    more than one salt; nothing leads over an edge from null, so there is none."""
    e = cut_lineage(edges.select("src", "dst").where("src IS NOT NULL").distinct())
    part = max(HUB_EDGES, e.count() // (HUB_SHARE * partitions))
    hubs = cut_lineage(e.groupBy("src").agg(F.ceil(F.count("*") / part).cast("int").alias("salts")).where("salts > 1"))
    e = e.join(F.broadcast(hubs), "src", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    e = e.withColumn("salt", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int"))
    return e.select("src", "dst", "salt", "salts").repartition(partitions, "src", "salt")


class _Visited:
    """Rows appended level by level to a table bucketed by ``node``."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.name = f"visited_{uuid.uuid4().hex}"
        self.path = scratch_path(spark, self.name)

    def add(self, level: DataFrame) -> None:
        (level.write.mode("append").bucketBy(self.buckets, "node").option("path", self.path).saveAsTable(self.name))

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> DataFrame:
        """All rows; the name goes, the files stay."""
        rows = self.rows()
        self.spark.sql(f"DROP TABLE {self.name}")
        return rows


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, count_paths: bool = False,
        expandable: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """Nodes reachable from ``seeds`` within ``max_depth`` hops.

    ``edges(src, dst)``, ``seeds(node)``.  Returns ``(node, depth)`` with each
    node once at its minimum depth (G1; G2 gives the same node set).  With
    ``count_paths`` also ``paths``: how many times a level-synchronous crawl
    that de-duplicates only against earlier levels processes the node, i.e.
    its number of shortest paths (G3).  ``expandable(node)`` restricts which
    nodes are expanded (pages that were fetched; the rest are leaves).
    ``budget`` caps the total node count, accepting each level in node order
    until the budget is used (O3).
    """
    n = _partitions(edges)
    edges = cut_lineage(salted_edges(edges, n))
    vals = ["paths"] if count_paths else []

    level = seeds.select("node").distinct()
    if count_paths:
        level = level.withColumn("paths", F.lit(1).cast("long"))
    level = level.withColumn("depth", F.lit(0))
    level = _apply_budget(level, budget, 0)
    level = cut_lineage(level.repartition(n, "node"))
    visited = _Visited(edges.sparkSession, n)
    visited.add(level)
    size = level.count()
    accepted = size
    depth = 0
    while size > 0 and depth < max_depth and (budget is None or accepted < budget):
        frontier = level if expandable is None else level.join(
            expandable.select(F.col("node")).distinct(), "node", "left_semi")
        # without an expandable filter the frontier is the counted level
        found = _expand(frontier, edges, vals, size if expandable is None else None)
        if count_paths:
            found = found.groupBy("node").agg(F.sum("paths").alias("paths"))
        else:
            found = found.distinct()
        found = found.repartition(n, "node").join(visited.rows().select("node"), "node", "left_anti")
        found = found.withColumn("depth", F.lit(depth + 1))
        found = _apply_budget(found, None if budget is None else budget - accepted, depth + 1)
        level = cut_lineage(found)
        size = level.count()
        accepted += size
        visited.add(level)
        depth += 1
    cols = ["node", "depth"] + vals
    return visited.close().select(*cols)


def bfs_update(plan: DataFrame, edges: DataFrame, new_edges: DataFrame, max_depth: int) -> DataFrame:
    """``plan`` (node, depth) of the graph ``edges`` minus ``new_edges`` brought up
    to date: as ``bfs`` over all of ``edges``, which hold the new ones too.

    The first candidates are the ends of new edges; a node whose depth falls (or
    that is new) hands its depth + 1 on over all its edges, until nothing falls.
    Untouched parts of the plan are only read by the joins with the candidates."""
    n = _partitions(edges)
    edges = cut_lineage(salted_edges(edges, n))
    plan = cut_lineage(plan.select("node", F.col("depth").cast("int").alias("depth")))
    changed = None
    front = (plan.where(F.col("depth") < max_depth).join(new_edges.select("src", "dst").distinct(), F.col("node") == F.col("src"))
             .select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")))
    while True:
        found = front.groupBy("node").agg(F.min("depth").alias("depth"))
        known = plan if changed is None else plan.unionByName(changed).groupBy("node").agg(F.min("depth").alias("depth"))
        better = (found.join(known.withColumnRenamed("depth", "old"), "node", "left")
                  .where("old IS NULL OR depth < old").select("node", "depth"))
        better = cut_lineage(better)
        if better.isEmpty():
            break
        changed = better if changed is None else cut_lineage(
            changed.unionByName(better).groupBy("node").agg(F.min("depth").alias("depth")))
        front = _expand(better.where(F.col("depth") < max_depth), edges, [(F.col("depth") + 1).alias("depth")])
    if changed is None:
        return plan
    return plan.unionByName(changed).groupBy("node").agg(F.min("depth").alias("depth"))


def resolve_chains(pointers: DataFrame) -> DataFrame:
    """(key, end, loop) for pointers (key, target): where following the targets ends.
    A target without a pointer of its own, or that points to itself, is an end; a
    loop's keys, and those that lead into it, end at its smallest key.

    Pointer jumping: each round doubles the steps taken, so a chain of n keys takes
    log n joins.  The rounds stop when the keys reached are no longer fewer (they
    are ends and loops then) and no loop's smallest key changes any more."""
    p = pointers.where("key IS NOT NULL").groupBy("key").agg(F.min("target").alias("target"))
    p = p.select("key", F.coalesce("target", "key").alias("jump"))
    ends = p.select(F.col("jump").alias("key")).distinct().join(p.select("key"), "key", "left_anti")
    step = cut_lineage(p.unionByName(ends.select("key", F.col("key").alias("jump")))
                       .select("key", "jump", F.col("key").alias("least"), (F.col("key") == F.col("jump")).alias("fixed")))
    fixed = step.where("fixed").select(F.col("key").alias("jump"), F.lit(True).alias("is_end"))
    state = None
    while True:
        # rows (key, jump, least): the key 2^r steps on and the smallest of the first 2^r keys
        far = step.select(F.col("key").alias("jump"), F.col("jump").alias("far"), F.col("least").alias("ahead"))
        step = cut_lineage(step.join(far, "jump").select("key", F.col("far").alias("jump"), F.least("least", "ahead").alias("least")))
        reached = step.select("jump").distinct()
        held = step.join(reached.withColumnRenamed("jump", "key"), "key", "left_semi")
        now = tuple(held.agg(F.count("*"), F.sum(F.xxhash64("key", "least").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    last = step.select(F.col("key").alias("jump"), F.col("least").alias("end"))
    out = step.select("key", "jump").join(last, "jump").join(fixed, "jump", "left")
    return out.select("key", F.when(F.col("is_end"), F.col("jump")).otherwise(F.col("end")).alias("end"),
                      F.col("is_end").isNull().alias("loop"))


def _apply_budget(level: DataFrame, remaining: int | None, depth: int) -> DataFrame:
    """Keep the first ``remaining`` nodes of a level in node order (exact).
    TakeOrderedAndProject keeps at most ``remaining`` rows per task, so this
    is cheap while budgets are page counts; see ``first_k`` for big ones."""
    if remaining is None:
        return level
    from pagelake.operators.tables import first_k
    return first_k(level, ["node"], max(remaining, 0))


def host_word_edges(links: DataFrame) -> DataFrame:
    """Derived graph fixture: undirected host <-> href-word edges from
    ``links(domain, href)``."""
    fwd = links.select(F.col("domain").alias("src"), F.col("href").alias("dst"))
    return fwd.unionByName(fwd.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), either
    way, for every node of an edge.

    Each round a node and the node it hangs under learn the smallest component among
    its neighbours, then every node moves up to what its component hangs under; the
    rounds grow with the logarithm of a component's width.  Minima are combined
    map-side, so a hub costs one row per task."""
    some = edges.where("a <> b").select("a", "b")
    both = cut_lineage(some.unionByName(some.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    place = cut_lineage(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(place, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        seen = place.join(near, F.col("node") == F.col("a")).where("m < component").select(
            F.explode(F.array("node", "component")).alias("hung"), "m").groupBy("hung").agg(F.min("m").alias("m"))
        hooked = (place.join(seen, F.col("node") == F.col("hung"), "left")
                  .select("node", F.least("component", "m").alias("component"), F.col("component").alias("old")))
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("top"))
        moved = cut_lineage(hooked.join(up, "component").select("node", F.col("top").alias("component"), "old"))
        place = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return place
