"""Merkle manifest of a data set: sixteen-ary trees per source, one above them.

H is the lower-case hex SHA-256; digests enter it as hex text.  The leaf of a row
is H of doc_id, source, lang, n_chars and text, each ``-`` if null, else its UTF-8
byte count, ``:`` and its value.  Leaves of a source ascend by doc_id; while more
than one node is left, every sixteen consecutive ones become their H.  What
remains is the source's subroot, and the subroots, ordered by source, become the
root in the same way.

``build`` ranks the leaves by range partitioning (no single-task window) and
writes, level by level, node rows linked to their parents:

* level 1, ``units``: one row for each run of at most sixteen leaves, with its
  leaves (a source of one leaf has a unit without a node of its own);
* higher levels and the tree of subroots, ``nodes``: (id, kids, up, slot), where
  ``kids`` holds the children's digests, ``up`` names the parent and ``slot`` is the
  place among the parent's children.

``climb`` is one recursive SQL query: the anchor folds each leaf, as it is now,
with its siblings; each step joins the parent row, appends the siblings found there
and folds once more, until a row has no parent.  The leaves of a unit share every
sibling above it, so they ascend together: one state row holds their folds and one
list of siblings, about 32 bytes a leaf and level.  High nodes have many
descendants; a node of level l is stored in up to 16^(l-2) copies (``COPIES`` at
most) and the climbers are dealt to them, so no join key gathers a source.

Defined results: leaves with the same doc_id ascend by digest, equal rows are
separate leaves with equal results; a null doc_id comes first in its source and is
never tampered with; a null source is a source of its own and comes first; a
lone leaf is its own subroot, and the root if it is the only one (its proof is
empty); an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import documents, fresh, register, spill

ARITY = 16
#: Copies of a high node at most; each serves its share of the climbing rows.
COPIES = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Manifest:
    """Stored tree: ``units`` and ``nodes`` as described above, and the root (None
    if there are no leaves)."""
    units: DataFrame
    nodes: DataFrame
    root: str | None


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def node_digest(kids: Column) -> Column:
    """H of digests given as concatenated bytes."""
    return F.unhex(F.sha2(F.lower(F.hex(kids)), 256))


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def ranked(df: DataFrame, order: list, name: str, by: str) -> DataFrame:
    """``df`` with 0-based row numbers ``name`` in ``order``: range partitions are
    numbered within and their counts (one row a partition) carried over."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mid = fresh(df.columns, "mid")
    # The ids are written before they are read twice.
    rows = spill(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                 .withColumn(mid, F.monotonically_increasing_id()), by)
    part = F.shiftright(F.col(mid), 33)
    sizes = {r.part: r.rows for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    starts = spark.createDataFrame(list(before.items()), f"{mid}_part long, {mid}_start long")
    return (rows.join(F.broadcast(starts), part == F.col(f"{mid}_part"))
            .withColumn(name, F.col(f"{mid}_start") + F.col(mid).bitwiseAND((1 << 33) - 1))
            .drop(mid, f"{mid}_part", f"{mid}_start"))


def leaves(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, now): ``now`` is the digest of the row with the text
    ``now``, or null where that is null."""
    values = [F.col(f) for f in FIELDS]
    other = leaf_digest(*values[:-1], now) if now is not None else F.lit(None).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       leaf_digest(*values).alias("leaf"),
                       (F.when(now.isNotNull(), other) if now is not None else other).alias("now"))


def _above(count: Column) -> Column:
    """Nodes that a level of ``count`` nodes becomes."""
    return F.floor((count + (ARITY - 1)) / ARITY).cast("long")


def _levels(count: int) -> int:
    """Levels above ``count`` nodes until one is left."""
    levels = 0
    while ARITY ** levels < count:
        levels += 1
    return levels


def _joined(parts: Column, item) -> Column:
    """Digests of up to sixteen sorted children, concatenated."""
    return F.concat(*[F.coalesce(item(F.get(parts, F.lit(i))), F.lit(bytearray())) for i in range(ARITY)])


def _name(tree: str, level: int, owner: Column, place: Column) -> Column:
    return F.concat_ws("/", F.lit(f"{tree}{level}"), owner.cast("string"), place.cast("string"))


def _grouped(level: DataFrame) -> DataFrame:
    """The next level: every sixteen nodes of an owner that has more than one."""
    return (level.where("count > 1")
            .groupBy("owner", F.col("count").alias("below"), F.expr(f"place div {ARITY}").alias("at"))
            .agg(F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("own"))
            .withColumn("kids", _joined(F.col("own"), lambda kid: kid["hash"]))
            .select("owner", F.col("at").alias("place"), _above(F.col("below")).alias("count"), "kids",
                    node_digest(F.col("kids")).alias("hash")))


def _units(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Runs of at most sixteen leaves of a source, with the run's digest."""
    own = owners.select(F.col("source").alias("own"), "start", "n", "owner")
    placed = (rows.join(own, F.col("source").eqNullSafe(F.col("own")))
              .withColumn("pos", F.col("rank") - F.col("start")))
    return (placed.groupBy("owner", "n", F.expr(f"pos div {ARITY}").alias("place"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "doc_id", "leaf", "now"))).alias("leaves"))
            .withColumn("kids", _joined(F.col("leaves"), lambda kid: kid["leaf"]))
            .withColumn("lone", F.col("n") == 1)
            .withColumn("hash", F.when(F.col("lone"), F.col("kids")).otherwise(node_digest(F.col("kids"))))
            .withColumn("unit", F.concat_ws("/", F.col("owner").cast("string"), F.col("place").cast("string")))
            .withColumn("climber", F.shiftrightunsigned(F.xxhash64("unit"), 1))
            .withColumn("count", _above(F.col("n"))))


NODE = "id string, kids binary, up string, slot int, copies int, top binary"
UNIT = ("unit string, leaves array<struct<pos: long, doc_id: long, leaf: binary, now: binary>>, kids binary, "
        "lone boolean, climber long, up string, slot int, copies int, top binary")


def build(leaf_rows: DataFrame) -> Manifest:
    """Rank the leaves and write the levels."""
    spark = leaf_rows.sparkSession
    nodes = spark.createDataFrame([], NODE)
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    rows = ranked(leaf_rows, order, "rank", "leaves")
    per = spill(rows.groupBy("source").agg(F.min("rank").alias("start"), F.count("*").alias("n")), "sources")
    sources, biggest = per.agg(F.count("*"), F.max("n")).first()
    if not sources:
        return Manifest(spark.createDataFrame([], UNIT), nodes, None)
    units = spill(_units(rows, ranked(per, [F.col("start")], "owner", "owners")), "units")
    depth, upper, climbers = max(1, _levels(biggest)), _levels(sources), units.count()

    def copies(tree: str, level: int) -> int:
        if tree == "d":
            return min(COPIES, ARITY ** max(0, level - 2))
        return max(1, min(COPIES, climbers // ARITY // math.ceil(sources / ARITY ** level)))

    def linked(df: DataFrame, tree: str, level: int) -> DataFrame:
        """``df`` with its nodes' parent, their slot in it, its copies and the
        digest of those that are a source's subroot."""
        more = F.col("count") > 1
        place = F.when(more, F.col("place")).otherwise(F.col("owner"))
        link = F.when(more, _name(tree, level + 1, F.col("owner"), F.expr(f"place div {ARITY}")))
        served = F.when(more, F.lit(copies(tree, level + 1)))
        if tree == "d" and upper:
            link = link.otherwise(_name("s", 1, F.lit(0), F.expr(f"owner div {ARITY}")))
            served = served.otherwise(F.lit(copies("s", 1)))
        return (df.withColumn("up", link).withColumn("slot", F.pmod(place, F.lit(ARITY)).cast("int")).withColumn("copies", served)
                .withColumn("top", F.when(~more, F.col("hash")) if tree == "d" else F.lit(None).cast("binary")))

    level = units.select("owner", "place", "count", "hash")
    subroots = level.where("count = 1").select("owner", "hash")
    tree, height = "d", 1
    while True:
        if tree == "d" and height == depth:
            tree, height = "s", 0
            level = subroots.select(F.lit(0).cast("long").alias("owner"), F.col("owner").alias("place"),
                                    F.lit(sources).cast("long").alias("count"), "hash")
        if tree == "s" and height == upper:
            break
        height += 1
        level = spill(_grouped(level), f"{tree}{height}")
        if tree == "d":
            subroots = subroots.unionByName(level.where("count = 1").select("owner", "hash"))
        stored = (linked(level, tree, height)
                  .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies(tree, height) - 1))))
                  .withColumn("id", F.concat_ws("/", _name(tree, height, F.col("owner"), F.col("place")), F.col("copy").cast("string"))))
        nodes = nodes.unionByName(stored.select("id", "kids", "up", "slot", "copies", "top"))
    root = level.select(hexed(F.col("hash")).alias("root")).first().root
    return Manifest(linked(units, "d", 1).drop("owner", "place", "n", "count", "hash"), spill(nodes, "nodes"), root)


CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT unit, climber, concat(up, '/', pmod(climber, copies)) AS at, slot, folds, CAST('' AS BINARY) AS above, top AS subroot
  FROM {{units}}
  UNION ALL
  SELECT c.unit, c.climber, concat(n.up, '/', pmod(c.climber, n.copies)), n.slot,
         transform(c.folds, f -> unhex(sha2(lower(hex(concat(
             substring(n.kids, 1, 32 * c.slot), f, substring(n.kids, 32 * c.slot + 33)))), 256))),
         concat(c.above, substring(n.kids, 1, 32 * c.slot), substring(n.kids, 32 * c.slot + 33)),
         coalesce(c.subroot, n.top)
  FROM climb c JOIN {{nodes}} n ON n.id = c.at
)
SELECT unit, folds, above, subroot FROM climb WHERE at IS NULL
"""


def _without(kids: Column, slot: Column) -> tuple[Column, Column]:
    return F.substring(kids, F.lit(1), slot * 32), F.substring(kids, slot * 32 + 33, F.lit(32 * ARITY))


def climb(tree: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, proof_sha256, folded_root) of every leaf, as hex."""
    spark = tree.units.sparkSession

    def folded(x: Column, i: Column) -> Column:
        now = F.coalesce(x["now"], x["leaf"])
        left, right = _without(F.col("kids"), i)
        return F.when(F.col("lone"), now).otherwise(node_digest(F.concat(left, now, right)))

    anchor = tree.units.select("unit", "climber", "up", "slot", "copies", "top", F.transform("leaves", folded).alias("folds"))
    # The recursion has one step a level; only the row limit of the session has to go, while it runs.
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        done = spill(spark.sql(CLIMB, units=anchor, nodes=tree.nodes), "climbed")
    finally:
        spark.conf.set(limit, before)
    each = (tree.units.select("unit", "kids", "lone", "leaves").join(done, "unit")
            .select("*", F.posexplode("leaves").alias("i", "x")))
    left, right = _without(F.col("kids"), F.col("i"))
    own = F.when(F.col("lone"), F.lit(bytearray())).otherwise(F.concat(left, right))
    return each.select(F.col("x.doc_id").alias("doc_id"), hexed(F.col("x.leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"),
                       F.sha2(hexed(F.concat(own, F.col("above"))), 256).alias("proof_sha256"),
                       hexed(F.get("folds", F.col("i"))).alias("folded_root"))


def verify(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """Build the manifest of ``docs`` and check every row against it, with ``now``
    in place of the text where that is not null."""
    tree = build(leaves(docs, now))
    root = F.lit(tree.root).cast("string")
    return (climb(tree).withColumn("root", root)
            .select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


@register("op13_merkle_manifest", r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS meta FROM documents),
h AS (
  SELECT doc_id, source, sha256(meta || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(meta || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '-')) AS low FROM f),
bits AS (  -- CRC-32 of the digits of doc_id, one digit after the other
  SELECT doc_id, doc_id::VARCHAR AS s, 0 AS i, 4294967295::UBIGINT AS crc FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, s, i + 1, xor(x >> 1, 3988292384::UBIGINT * (x % 2))
  FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(crc, ascii(s[(i // 8) + 1])::UBIGINT) ELSE crc END AS x
        FROM bits WHERE i < 8 * length(s))),
tampered AS (SELECT doc_id FROM bits WHERE i = 8 * length(s) AND xor(crc, 4294967295::UBIGINT) % 5 = 0),
l AS (
  SELECT doc_id, source, leaf, CASE WHEN doc_id IN (SELECT doc_id FROM tampered) THEN low ELSE leaf END AS now,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS owner FROM h),
t AS (  -- trees of the sources
  SELECT 0 AS lvl, owner, n, pos, leaf AS hash FROM l
  UNION ALL
  SELECT lvl + 1, owner, (n + 15) // 16, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM t WHERE n > 1
  GROUP BY lvl, owner, n, pos // 16),
s AS (  -- tree of the subroots
  SELECT 0 AS lvl, (SELECT count(DISTINCT owner) FROM l) AS n, owner AS pos, hash FROM t WHERE n = 1
  UNION ALL
  SELECT lvl + 1, (n + 15) // 16, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM s WHERE n > 1
  GROUP BY lvl, n, pos // 16),
nodes AS (
  SELECT 't' || owner AS tree, lvl, pos // 16 AS run, list(hash ORDER BY pos) AS kids FROM t WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT 's', lvl, pos // 16, list(hash ORDER BY pos) FROM s WHERE n > 1 GROUP BY ALL),
c AS (  -- climb of every leaf: position, fold and proof so far
  SELECT row_number() OVER () AS r, doc_id, leaf, owner, 't' || owner AS tree, 0 AS lvl, pos, n, now AS fold, '' AS proof FROM l
  UNION ALL
  SELECT r, doc_id, leaf, owner, CASE WHEN n = 1 THEN 's' ELSE c.tree END, CASE WHEN n = 1 THEN 0 ELSE c.lvl + 1 END,
         CASE WHEN n = 1 THEN owner ELSE pos // 16 END,
         CASE WHEN n = 1 THEN (SELECT count(DISTINCT owner) FROM l) ELSE (n + 15) // 16 END,
         CASE WHEN n = 1 THEN fold ELSE sha256(array_to_string(kids[:pos % 16], '') || fold || array_to_string(kids[pos % 16 + 2:], '')) END,
         CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(kids[:pos % 16], '') || array_to_string(kids[pos % 16 + 2:], '') END
  FROM c LEFT JOIN nodes ON nodes.tree = c.tree AND nodes.lvl = c.lvl AND nodes.run = c.pos // 16
  WHERE n > 1 OR c.tree <> 's')
SELECT c.doc_id, c.leaf, t.hash AS subroot, s.hash AS root, sha256(c.proof) AS proof_sha256, c.fold AS folded_root,
       c.fold = s.hash AS verified
FROM c JOIN t ON t.owner = c.owner AND t.n = 1 JOIN s ON s.n = 1
WHERE c.tree = 's' AND c.n = 1
""")
def op13_merkle_manifest(spark, sf_dir):
    lower = F.when(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.translate("text", _UPPER, _LOWER))
    return verify(documents(spark, sf_dir), lower)
