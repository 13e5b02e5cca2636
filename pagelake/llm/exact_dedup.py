"""Exact duplicates by a heavy-hitter split.

Texts are equal when identical after each run of ASCII white space became one
space; the SHA-256 of that form is the digest.

1. ``digests``: one pass over the texts writes (doc_id, row id, digest).
2. ``heavy_winners``: a Misra-Gries summary of the digests.  Spark's
   ``approx_top_k`` is that summary in mergeable form (counters are
   decremented in batches and merged map-side), so no digest is shuffled.
   Each reported digest is then verified: its exact count and its winner (the
   row with the smallest doc_id) come from a second, map-side combined pass.
   At most ``HEAVY_DIGESTS`` rows come out whatever the input, so this table
   is broadcast.
3. Rows with a heavy digest are resolved map-side by that broadcast, wherever
   they lie; a text holding a third of all rows is never gathered.  All other
   digests are below the summary's threshold and go through one ordinary
   shuffle of 60-byte rows.

Defined results: a null text counts as empty; a null doc_id sorts after every
other one; of repeated rows (same doc_id, equal text) exactly one is kept;
an empty table gives an empty table; columns beyond doc_id and text are not
read by ``resolve`` and are carried unchanged by ``drop_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import ASCII_SPACE, bounded_broadcast, documents, fresh, register, spill, text_or_empty

#: Rows of the broadcast winners table at most, and counters of the summary.
HEAVY_DIGESTS = 1_000
TRACKED_DIGESTS = 50_000
#: A digest is only worth the broadcast from so many copies on.
HEAVY_COPIES = 64


def normalised(text) -> F.Column:
    return F.regexp_replace(text_or_empty(text), ASCII_SPACE + "+", " ")


def digest(text) -> F.Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, sha): uid numbers the rows, so repeated rows differ."""
    return spill(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                             F.monotonically_increasing_id().alias("uid"),
                             digest("text").alias("sha")), "digests")


def first_row() -> F.Column:
    """Order of the rows of a group: doc_id, nulls last, then the row id."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")


def heavy_winners(dig: DataFrame) -> DataFrame:
    """(sha, winner, group_size) of the verified heavy digests."""
    top = dig.select(F.xxhash64("sha").alias("k")).agg(
        F.expr(f"approx_top_k(k, {HEAVY_DIGESTS}, {TRACKED_DIGESTS})").alias("top"))
    keys = (top.select(F.explode("top").alias("t")).where(F.col("t.count") >= HEAVY_COPIES)
            .select(F.col("t.item").alias("k")))
    counted = (dig.withColumn("k", F.xxhash64("sha")).join(F.broadcast(keys), "k", "left_semi")
               .groupBy("sha").agg(F.min(first_row()).alias("winner"), F.count("*").alias("group_size")))
    return counted.checkpoint()


def resolve(dig: DataFrame) -> DataFrame:
    """(doc_id, uid, sha, keep_id, group_size, kept) for every row."""
    heavy = heavy_winners(dig)
    hot = dig.join(F.broadcast(heavy), "sha")
    same = Window.partitionBy("sha")
    cold = (dig.join(F.broadcast(heavy.select("sha")), "sha", "left_anti")
            .withColumn("winner", F.min(first_row()).over(same))
            .withColumn("group_size", F.count("*").over(same)))
    return hot.unionByName(cold).select(
        "doc_id", "uid", "sha", F.col("winner.doc_id").alias("keep_id"), "group_size",
        (F.col("uid") == F.col("winner.uid")).alias("kept"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that lose, all columns kept.

    The texts are not shuffled: losers are found on the slim digests and join
    back by (doc_id, digest).  Rows that repeat both doc_id and text cannot be
    told apart by that key; of such rows (normally none) one is taken.
    """
    verdicts = spill(resolve(digests(docs)), "verdicts")
    sha, no = fresh(docs.columns, "sha"), fresh(docs.columns, "doc_key")
    key = verdicts.select(F.col("sha").alias(sha), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(no),
                          "kept")
    per = key.groupBy(sha, no).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where(~F.col("kept") | (F.col("n") > 1))
    per = spill(per, "losers")
    names = [f"`{c}`" for c in docs.columns]
    keyed = docs.withColumn(sha, digest("text")).withColumn(
        no, F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    out = keyed.join(bounded_broadcast(per.select(sha, no)), [sha, no], "left_anti").select(*names)
    repeated = per.where("kept").select(sha, no)
    if repeated.isEmpty():
        return out
    row = fresh(docs.columns, "whole_row")
    twins = (keyed.join(repeated, [sha, no], "left_semi").groupBy(sha, no)
             .agg(F.first(F.struct(*names)).alias(row)))
    return out.unionByName(twins.select(f"{row}.*"))


@register("op5_exact_dedup", r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS sha FROM documents)
WINDOW g AS (PARTITION BY sha)
""")
def op5_exact_dedup(spark, sf_dir):
    return (resolve(digests(documents(spark, sf_dir)))
            .select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")))
