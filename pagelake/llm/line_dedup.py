"""Line de-duplication over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at both ends, A-Z in lower
case; its hash is the first 128 bits of a SHA-256.  A key found in ``min_docs``
documents or more is frequent and loses all its lines.

``LineRuns`` counts documents per key as a log-structured store:

* A **run** is a Parquet table (hash, documents), bucketed and sorted by hash, in
  the shared checkpoint folder.  All runs have the same buckets, so joining or
  merging runs needs no shuffle.
* ``add(batch)`` counts the batch's keys once (partial counts before the only
  shuffle), merge-anti-joins them with the runs that already hold frequent keys
  (nothing more has to be learnt about those) and writes the rest as a run of
  level 0.
* When a level has ``fanout`` runs they are **compacted** into one run of the next
  level: bucket by bucket, counts of equal hashes are added.
* ``frequent()`` merges the runs that are left.

With ``min_docs`` = 1 the store is a plain set of known lines, and ``unseen``
gives the keys of a batch that no run has.

``drop_lines`` feeds the documents in batches, then removes the lines.  Slim
(hash, document, position) rows are matched with the frequent keys; the most
frequent ones, ``HEAVY_KEYS`` at most, are broadcast, so a line found in a third of
all documents is settled where it lies, and the others meet in a shuffle.

Defined results: a null or empty text is one empty line; keys without a code
point are never dropped; each row counts as one document, so a row repeated ten
times makes its lines frequent; repeated rows lose the same lines; a null doc_id
is kept as null; an empty table gives an empty table; columns beyond doc_id and
text are carried unchanged, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import documents, fresh, register, scratch, small_enough, spill, text_or_empty

MIN_DOCS = 10
#: Batches that ``drop_lines`` deals the documents to, and runs of a level that are compacted.
BATCHES = 6
FANOUT = 2
#: Frequent keys that are broadcast at most (16 bytes each).
HEAVY_KEYS = 100_000

_BLANKS = " \t\n\x0b\f\r"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def folded(text: Column | str = "text") -> Column:
    """A form of the text that is equal for texts equal but for the case of A-Z,
    and only for them.  The UTF-8 bytes are lower-cased as ISO-8859-1, which is much
    faster than mapping letters.  Of the bytes above 0x7F only lead bytes C0-DE
    change, to E0-FE; the number of bytes that follow still tells which one it was."""
    return F.lower(F.decode(text_or_empty(text).cast("binary"), "ISO-8859-1"))


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def key_hash(key: Column) -> Column:
    return F.substring(F.unhex(F.sha2(key, 256)), 1, 16)


def line_keys(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` columns and the hash ``k`` of each distinct key of a document."""
    keys = F.array_distinct(F.transform(split_lines(folded()), trimmed))
    names = docs.select(*keep).columns
    return docs.select(*keep, F.explode(keys).alias("key")).where("key <> ''").select(*names, key_hash(F.col("key")).alias("k"))


class LineRuns:
    """Levelled sorted runs (k, n): hash of a line key and documents that have it."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def runs(self) -> list[DataFrame]:
        """All runs, oldest first within a level."""
        return [self.spark.table(name) for level in self.levels for name in level]

    def unseen(self, keys: DataFrame, least: int = 1) -> DataFrame:
        """Rows of ``keys`` whose ``k`` no run holds with ``least`` documents or more."""
        for run in self.runs():
            keys = keys.join(run.where(F.col("n") >= least).select("k"), "k", "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Count a batch, one row per document and key ``k``, and store its run."""
        counted = keys.groupBy("k").agg(F.count("*").alias("n"))
        self._store(self.unseen(counted, self.min_docs), 0)

    def _store(self, counted: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (counted.select("k", "n").write.bucketBy(self.buckets, "k").sortBy("k")
         .option("path", scratch(self.spark, name)).saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        self._store(self._merged([self.spark.table(name) for name in old]), level + 1)
        self._drop(old)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Runs added up by merge joins, bucket by bucket.  (A union of bucketed scans
        keeps their partitioning on paper, but concatenates their partitions.)"""
        both = runs[0]
        for run in runs[1:]:
            both = both.join(run.withColumnRenamed("n", "m"), "k", "full").select(
                "k", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return both

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def frequent(self) -> DataFrame:
        """(k, n) of the keys with ``min_docs`` documents or more, written once."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "k binary, n long")
        return spill(self._merged(runs).where(F.col("n") >= self.min_docs), "frequent_lines")

    def close(self) -> None:
        """Forget the runs; their files go with the other scratch tables."""
        self._drop([name for level in self.levels for name in level])
        self.levels = [[]]


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(k, n) of the frequent keys of ``docs``, counted batch after batch."""
    spark = docs.sparkSession
    where = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(batches)).cast("int").alias("batch")
    path = scratch(spark, "line_keys")
    line_keys(docs, where).write.partitionBy("batch").parquet(path)
    keys = spark.read.schema("k binary, batch int").parquet(path)
    store = LineRuns(spark, min_docs, fanout)
    for i in range(batches):
        store.add(keys.where(F.col("batch") == i))
    found = store.frequent()
    store.close()
    return found


def matched(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """Rows of ``lines`` whose ``k`` is frequent."""
    if small_enough(frequent, HEAVY_KEYS, HEAVY_KEYS * 64):
        return lines.join(F.broadcast(frequent.select("k")), "k", "left_semi")
    heavy = spill(frequent.orderBy(F.desc("n"), "k").limit(HEAVY_KEYS).select("k"), "heavy_lines")
    rest = frequent.select("k").join(F.broadcast(heavy), "k", "left_anti")
    return (lines.join(F.broadcast(heavy), "k", "left_semi")
            .unionByName(lines.join(F.broadcast(heavy), "k", "left_anti").join(rest, "k", "left_semi")))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with the lines left in ``text``, and n_lines, n_dropped (suffixed
    by underscores in front where ``docs`` has such columns)."""
    frequent = frequent_lines(docs, min_docs, batches, fanout)
    taken = list(docs.columns)

    def name(base: str) -> str:
        taken.append(fresh(taken, base))
        return taken[-1]

    row, sha, gone = name("row"), name("sha"), name("gone")
    total, dropped = name("n_lines"), name("n_dropped")
    # Rows with the same doc_id and text lose the same lines, so these two are the key.
    ident = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(row), key_hash(text_or_empty()).alias(sha)]
    places = (docs.select(*ident, F.posexplode(split_lines(folded())).alias("pos", "line"))
              .select(row, sha, "pos", trimmed(F.col("line")).alias("key")).where("key <> ''")
              .select(row, sha, "pos", key_hash(F.col("key")).alias("k")))
    losses = matched(places, frequent).groupBy(row, sha).agg(F.collect_set("pos").alias(gone))
    out = docs.select("*", *ident).join(losses, [row, sha], "left")
    lines = split_lines(text_or_empty())
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    # The outer transform binds the lines once.
    joined = F.transform(F.array(lines), lambda own: F.array_join(F.transform(kept, lambda i: F.get(own, i)), "\n"))
    text = F.when(F.col(gone).isNull(), text_or_empty()).otherwise(F.get(joined, F.lit(0)))
    return out.select(*[text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns],
                      F.size(lines).cast("long").alias(total),
                      F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(dropped))


@register("op12_line_dedup", r"""
WITH l AS (
  SELECT rowid AS r, doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
v AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM v GROUP BY r
""")
def op12_line_dedup(spark, sf_dir):
    kept = drop_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))
