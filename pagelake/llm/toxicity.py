"""Toxicity: boosted trees over dense features, calibrated isotonically.

Features of a text (nothing else is looked at): densities of a seed lexicon
and of two learned lexicons (words, word beginnings), how close their hits
stand to second-person words, capitals, punctuation, and obfuscation (letters
mixed with digits or signs, and hits found only after undoing that).

Labelled rows fall into five parts by crc32(doc_id) mod 5: part 0 is held out
and never read.  Parts 1 to 3 train Spark's gradient-boosted trees, part 4
fits the isotonic calibration.  The learned lexicons are cross-fitted: the
features of a labelled row come from a lexicon counted without its part, those
of all other rows from the counts of parts 1 to 4.

Bounds: at most about ``LABELLED_ROWS`` labelled rows are used (a keyed hash
of doc_id picks them when there are more); their ids are broadcast, so the
texts are never shuffled.  The lexicons hold ``LEXICON_SIZE`` entries at most.
Scoring is one narrow pass over all documents.

Defined results: null and empty texts get the score of their all-zero
features; without labelled rows of both classes every document scores the
share of toxic training rows (0 without any); repeated labels of a document
count once, as toxic if any says so; a null doc_id hashes as the empty text;
repeated rows get equal scores; all columns of the input are carried.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import documents, fresh, register, spill, table, text_or_empty
from pagelake.llm.toxicity_features import count_entries, with_features

LABELLED_ROWS = 40_000
LEXICON_SIZE = 4_000
#: Toxic documents in which a learned entry must occur at least, and its log-odds.
LEXICON_SUPPORT, LEXICON_ODDS = 3, 1.5
TREES, DEPTH, STEP = 20, 4, 0.3
THRESHOLD = 0.5
PARTS, TREE_PARTS = (1, 2, 3, 4), (1, 2, 3)


def part_of(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def labelled(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(text, toxic, part) of a bounded set of labelled rows, none of part 0."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .withColumn("part", part_of(F.col("doc_id"))).where("part <> 0"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return texts.join(F.broadcast(known), "doc_id").select("text", "toxic", "part")


def learn_lexicons(rows: DataFrame) -> dict[int, tuple[dict[bytes, float], dict[bytes, float]]]:
    """Words and word beginnings that mark toxic rows, with their log-odds.

    Under key p stands the lexicon learned without the rows of part p, under 0
    the one of all rows.  First come the entries with support among toxic rows,
    combined per batch and counted by Spark; then, for those alone, the counts
    among clean rows."""
    def count(wanted, toxic):
        return (count_entries(rows.where(F.col("toxic") == toxic), wanted).groupBy("kind", "entry")
                .agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("part") == p, F.col("n")).otherwise(0)).alias(f"n{p}")
                                              for p in PARTS]))

    sizes = {(r.toxic, int(r.part)): r.n for r in rows.groupBy("toxic", "part").agg(F.count("*").alias("n")).collect()}
    all_toxic = sum(n for (y, _), n in sizes.items() if y == 1)
    support = max(LEXICON_SUPPORT, round(0.005 * all_toxic))
    hot = {(r.kind, bytes(r.entry)): r for r in count(None, 1).where(F.col("n") >= support)
           .orderBy(F.desc("n"), "kind", "entry").limit(10 * LEXICON_SIZE).collect()}
    wanted = [{e for k, e in hot if k == kind} for kind in (0, 1)]
    clean = {(r.kind, bytes(r.entry)): r for r in count(wanted, 0).collect()}
    out = {}
    for without in (0, *PARTS):
        used = [p for p in PARTS if p != without]
        n_toxic, n_clean = (sum(sizes.get((y, p), 0) for p in used) for y in (1, 0))
        odds = {}
        for key, r in hot.items():
            t = sum(r[f"n{p}"] for p in used)
            c = sum(clean[key][f"n{p}"] for p in used) if key in clean else 0
            if t >= support * len(used) / len(PARTS):
                odds[key] = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        best = sorted((k for k, v in odds.items() if v >= LEXICON_ODDS), key=lambda k: (-odds[k], k))[:LEXICON_SIZE]
        out[without] = tuple({e: round(odds[k, e], 4) for k, e in best if k == kind} for kind in (0, 1))
    return out


class Model:
    """Lexicons, trees and calibration; any of the last two may be missing."""

    def __init__(self, lexicons, trees, calibration, prior):
        self.lexicons, self.trees, self.calibration, self.prior = lexicons, trees, calibration, prior

    def score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """``docs`` with a score from 0 to 1 in column ``name``."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(float(self.prior)))
        made, vec, raw, prob, pred, cal = (fresh(docs.columns, c) for c in (
            "made_features", "feature_vector", "raw_score", "tree_probability", "tree_class", "calibrated"))
        trees = self.trees.copy()
        trees.setFeaturesCol(vec).setRawPredictionCol(raw).setProbabilityCol(prob).setPredictionCol(pred)
        rows = trees.transform(with_features(docs, {0: self.lexicons[0]}, made).withColumn(vec, array_to_vector(made)))
        rows = rows.withColumn(prob, vector_to_array(prob)[1])
        score = F.col(prob)
        if self.calibration is not None:
            rows = self.calibration.copy().setFeaturesCol(prob).setPredictionCol(cal).transform(rows)
            # a thousandth of the uncalibrated value orders documents on a step of the calibration
            score = 0.999 * F.col(cal) + 0.001 * F.col(prob)
        return rows.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).select(*[f"`{c}`" for c in docs.columns], name)


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    known = spill(labelled(docs, labels, rows), "labelled")
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    lexicons = learn_lexicons(known)
    made = spill(with_features(known, lexicons, "made", "part").drop("text"), "features")
    both = {(r.part in TREE_PARTS, r.toxic) for r in made.select("part", "toxic").distinct().collect()}  # eight rows
    if not {(True, 0), (True, 1)} <= both:
        return Model(lexicons, None, None, prior)
    made = made.select(F.col("part").isin(*TREE_PARTS).alias("grow"), F.col("toxic").cast("double").alias("label"),
                       array_to_vector("made").alias("features"))
    few = max(1, min(8, int(made.sparkSession.sparkContext.defaultParallelism)))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, maxBins=32, minInstancesPerNode=2).fit(
        made.where("grow").coalesce(few))
    calibration = None
    if {(False, 0), (False, 1)} <= both:
        scored = trees.transform(made.where("NOT grow").coalesce(few)).select("label", vector_to_array("probability")[1].alias("p"))
        calibration = IsotonicRegression(featuresCol="p", labelCol="label").fit(scored)
    return Model(lexicons, trees, calibration, prior)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more."""
    name = fresh(docs.columns, "score")
    return fit(docs, labels).score(docs, name).where(F.col(name) < threshold).drop(name)


@register("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    scored = fit(docs, table(spark, sf_dir, "labels")).score(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return scored.select("doc_id", (part_of(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
