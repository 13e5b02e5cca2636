"""Text and vector helper goldens."""

import math

import numpy as np
from pyspark.sql import functions as F

from pagelake.functions import text as TX
from pagelake.operators import features as FE


def one(spark, col_fn, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col_fn(F.col("x")).alias("y")).first().y


def test_preprocess_golden(spark):
    assert one(spark, TX.preprocess, "<b>Hi</b>THERE, É!") == "hithere "


def test_spam_terms(spark):
    assert one(spark, TX.is_spam, "Win a <i>Free</i> Money prize") is True
    assert one(spark, TX.is_spam, "nothing here") is False


def test_relevance_duplicates_and_cap(spark):
    docs = spark.createDataFrame([(1, "banana"), (2, "a b c d e f")], "doc_id long, text string")
    qs = spark.createDataFrame([(10, "a a zz"), (11, "a b c d e f")], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.relevance for r in FE.relevance_top_k(docs, qs, 5).collect()}
    assert math.isclose(got[(10, 1)], 0.4) and math.isclose(got[(11, 2)], 1.0)


def test_relevance_against_plain_search(spark):
    """Hits are not shuffled one by one; rows of one doc_id are one document."""
    import random
    r = random.Random(3)
    text = lambda n, k: " ".join("".join(r.choices("abc1", k=r.randint(1, k))) for _ in range(n))
    docs = [(i % 33, text(r.choice([0, 1, 4, 12]), 9)) for i in range(40)] + [(None, "ab"), (None, "ca"), (90, None), (91, "abcab" * 2000)]
    asked = [(i, text(r.choice([0, 2, 5]), 7)) for i in range(20)] + [(20, "a a b ccccc " + "abcab" * 3), (21, None)]
    pres: dict = {}
    for d, t in docs:
        pres.setdefault(d, []).append(t or "")
    want = {}
    for q, t in asked:
        hits = {d: sum(any(w in x for x in ts) for w in (t or "").split()) for d, ts in pres.items()}
        best = sorted((-min(5, h), -1 if d is None else d) for d, h in hits.items() if h)[:3]
        want |= {(q, None if d < 0 else d): (i + 1, round(-h * 0.2, 6)) for i, (h, d) in enumerate(best)}
    found = FE.relevance_top_k(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                               spark.createDataFrame(asked, "query_id long, text string"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc_id" in plan
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and ("w#" in x or "token#" in x)]
    assert {(x.query_id, x.doc_id): (x.rank, round(x.relevance, 6)) for x in found.collect()} == want


def test_entities_ascii_boundaries(spark):
    assert one(spark, TX.entities, "Paris and Émile met Bob_x and Alice.") == ["Paris", "Alice"]
    assert one(spark, lambda c: TX.entities(c, compat=True), "Paris") == []


def test_softmax_matches_numpy(spark):
    v = [1.0, 2.0, 3.5, -1.0]
    got = one(spark, TX.softmax, v, "x array<float>")
    e = np.exp(np.array(v) - max(v))
    assert np.allclose(got, e / e.sum())
    assert one(spark, TX.argmax, [0.1, 0.7, 0.7], "x array<float>") == 1


def test_format_g(spark):
    vals = [0.75, 1.0, 0.6000000000000001, 123456789.0, 0.0001234]
    got = [one(spark, TX.format_g, v, "x double") for v in vals]
    assert got == ["%g" % v for v in vals]


def test_token_hash_range(spark):
    h = one(spark, TX.tokenize, "  a\tbb  ccc ")
    assert len(h) == 3 and all(0 <= x < 1 for x in h)


def test_describe_image_and_roundtrip(spark, tmp_path):
    """M2 description; S16 image table with array columns survives parquet."""
    df = spark.createDataFrame(
        [("http://h/a.png", ["cat", "dog", "ball"], [0.9, 0.25], ["pet"], "hi"),
         ("http://h/b.png", [], [], ["x", "y"], "")],
        "url string, objects array<string>, confidence array<float>, labels array<string>, ocr string")
    path = str(tmp_path / "images")
    df.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    got = {r.url: r.d for r in back.select("url", FE.describe_image("objects", "confidence", "labels", "ocr")
                                           .alias("d")).collect()}
    assert got["http://h/a.png"] == ("Detected objects: cat (0.9), dog (0.25), ball, \n"
                                     "Image categories: pet, \nExtracted text: hi")
    assert got["http://h/b.png"] == "Detected objects: \nImage categories: x, y, "


def test_features_to_string(spark):
    df = spark.createDataFrame([("en", ["news", "technology"], 0.75, False)],
                               "lang string, topics array<string>, rel double, spam boolean")
    s = df.select(FE.features_to_string("lang", "topics", "rel", "spam").alias("s")).first().s
    assert s == "Language: en, Topics: news, technology, Relevance: 0.75, IsSpam: 0"


def test_preprocess_only_lowers_ascii(spark):
    """Letters whose Unicode lower case is ASCII are no letters; named classes, as ranges are slow."""
    column = lambda xs: spark.createDataFrame([(x,) for x in xs], "x string")
    odd = ["AİKKb <b>x\n\ty</b> \U0001f600z  Q1_w<", "", "  ", "<a", "Été ÀB", None]
    want = ["a k b x y z q1 w ", "", " ", " a", " t a b", None]
    got = column(odd).coalesce(1).select(TX.preprocess("x").alias("p"), TX.plain_words("x").alias("w"), TX.words(TX.preprocess("x")).alias("v")).collect()
    assert [r.p for r in got] == want and all(r.w == r.v for r in got)
    assert column(["Abc Ab_c éAbc A Bcd9 Efgé"]).select(TX.entities("x").alias("e")).first().e == ["Abc", "Abc", "Efg"]
