"""Text feature jobs over documents or pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions import text as TX
from pagelake.operators.tables import with_global_rank
from pagelake.session import bounded_broadcast, cut_lineage


def contained(tokens_: DataFrame, words: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, w, token): the words ``w`` that stand inside each token with the same
    ``by`` columns.

    The distinct tokens are cut into q-grams, in time linear in their length;
    those that occur among the words are kept.  Each word looks up its rarest
    q-gram, and the tokens found there are searched for the word.  No pair of
    token and word is formed that does not share that q-gram."""
    ws = cut_lineage(words.select(*by, "w").where(F.length("w") > 0).distinct())
    of_word = ws.select(*by, "w", F.explode(TX.word_grams("w")).alias("g"))
    wanted = bounded_broadcast(of_word.select(*by, "g").distinct())
    held = cut_lineage(tokens_.select(*by, "token").distinct().select(*by, "token", F.explode(TX.qgrams("token")).alias("g"))
                       .join(wanted, [*by, "g"], "left_semi"))
    df = held.groupBy(*by, "g").agg(F.count("*").alias("n"))
    # A q-gram that no token has rules its words out.
    least = (of_word.join(df, [*by, "g"], "left").groupBy(*by, "w")
             .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("rarest")).where("rarest.n > 0"))
    keyed = cut_lineage(least.select(*by, "w", F.col("rarest.g").alias("g")))
    return held.join(bounded_broadcast(keyed), [*by, "g"]).where(F.contains("token", F.col("w"))).select(*by, "w", "token")


#: Words that share a row of ``_words_held``, one bit each; characters that a word is looked
#: up by, if it has fewer than ``LONG`` or as many.
WORD_BITS = 60
PREFIX = 3
LONG = 5
ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"


def _looked_up(words: DataFrame) -> DataFrame:
    """``words`` (w) by what a text may have at their place (key): ``LONG`` characters, or for
    shorter words ``PREFIX``, or fewer at the end of a token.  A word of less than
    ``PREFIX`` has a row for each way to go on."""
    tails = [""] + list(ALNUM)
    keyed = words.withColumn("key", F.left("w", F.when(F.length("w") < LONG, PREFIX).otherwise(LONG)))
    for _ in range(1, PREFIX):
        key = F.explode(F.when(F.length("key") < PREFIX, F.transform(F.array(*[F.lit(t) for t in tails]), lambda t: F.concat("key", t)))
                        .otherwise(F.array("key")))
        keyed = keyed.select(*words.columns, key.alias("key")).distinct()
    return keyed


def _words_held(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, block, bits): which of the ``words`` (wid, w) stand inside each document.

    Each place of a distinct token looks up the words that begin with its next
    characters.  Hits are combined map-side into bits, ``WORD_BITS`` words a row, so
    neither tokens nor hits are shuffled one by one.  Rows of one doc_id are one document."""
    longest = words.agg(F.max(F.length("w"))).first()[0] or 0
    longest = max(longest, LONG)
    cut = lambda c: F.col(c).cast("binary")  # noqa: E731  words of [a-z0-9]: cut as bytes, in time linear in a token's length
    # a word within PREFIX stands where its key does; those of a key share a row
    rest = F.when(F.length("w") > PREFIX, F.col("w")).otherwise("")
    keyed = _looked_up(words).groupBy("key", rest.alias("w"), _block().alias("block")).agg(F.bit_or(_bit()).alias("bits"))
    keyed = bounded_broadcast(cut_lineage(keyed.select(cut("key").alias("key"), cut("w").alias("w"), F.length("w").alias("n"), "block", "bits")))
    tok = docs.select("doc_id", F.explode(F.array_distinct(TX.plain_words(F.col("text")))).alias("token"))
    places = tok.select("doc_id", cut("token").alias("token"), F.explode(F.sequence(F.lit(1), F.length("token"))).alias("i"))
    ahead = (places.select("doc_id", F.substr("token", F.col("i"), F.lit(longest)).alias("ahead"), F.explode(F.array(F.lit(PREFIX), F.lit(LONG))).alias("k"))
             .where(f"k = {PREFIX} OR length(ahead) >= k").select("doc_id", "ahead", F.substr("ahead", F.lit(1), F.col("k")).alias("key")))
    hits = ahead.join(keyed, "key").where(F.substr("ahead", F.lit(1), F.col("n")) == F.col("w"))
    return hits.groupBy("doc_id", "block").agg(F.bit_or("bits").alias("bits"))


def _block():
    return F.expr(f"wid div {WORD_BITS}")


def _bit():
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("wid", F.lit(WORD_BITS)).cast("int"))


def relevance_top_k(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """T2 per (query, document): min(1, 0.2 x query words found as substrings
    of the preprocessed document; repeated query words count again), and the
    top-k documents per query (ties by doc id).

    Preprocessed words hold no spaces, so a hit lies inside one token.  The bits of a
    document (``_words_held``) meet in one task, which scores it for all queries, a
    block of words at a time; each task passes on its top-k of a query.
    """
    qw = cut_lineage(queries.select(F.col("query_id"), F.explode(TX.plain_words(F.col("text"))).alias("w"))
                     .groupBy("query_id", "w").agg(F.count("*").alias("mult")))
    # frequent words share blocks, and so do the words that one query alone has
    common = qw.groupBy("w").agg((-F.count("*")).alias("common"), F.min("query_id").alias("first"))
    words = cut_lineage(with_global_rank(common, ["common", "first", "w"], "wid").select("wid", "w"))
    masks = qw.join(words, "w").groupBy(_block().alias("block"), "query_id", "mult").agg(F.bit_or(_bit()).alias("mask"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = _words_held(docs, words).repartition(n, "doc_id")
    found = F.bit_count(F.col("bits").bitwiseAND(F.col("mask"))) * F.col("mult")
    rel = (held.join(bounded_broadcast(cut_lineage(masks)), "block").where(F.col("bits").bitwiseAND(F.col("mask")) != 0)
           .groupBy("query_id", "doc_id").agg(F.sum(found).alias("hits"))
           .withColumn("relevance", TX.relevance_from_hits(F.col("hits"))))
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.asc("doc_id"))
    return (rel.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "doc_id", "relevance", "rank"))


def tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, word) for every whitespace token of the preprocessed text."""
    return docs.select("doc_id", F.explode(TX.plain_words(F.col(text_col))).alias("word"))


def keywords_tfidf(docs: DataFrame, k: int = 3) -> DataFrame:
    """T5: top-k words per document by tf x ln(N / df), ties by word.
    df is a grouped count (map-side combined, so a word in every document is
    one row per task); tf joins df on the word with AQE skew handling."""
    tf = cut_lineage(tokens(docs).groupBy("doc_id", "word").agg(F.count("*").alias("tf")))  # texts are read once
    df_ = tf.groupBy("word").agg(F.count("*").alias("df"))
    n_docs = docs.count()  # one scalar, used as a literal (no join)
    scored = tf.join(df_, "word").withColumn("score", F.col("tf") * F.log(F.lit(float(n_docs)) / F.col("df")))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.asc("word"))
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("doc_id", "word", "score", "rank"))


def topics_by_group(docs: DataFrame, group: str, k: int = 3) -> DataFrame:
    """Class-TF-IDF topic terms per group: tf in the group x
    ln(groups / groups containing the word); top-k per group, ties by word."""
    tok = docs.select(group, F.explode(TX.plain_words(F.col("text"))).alias("word"))
    tf = cut_lineage(tok.groupBy(group, "word").agg(F.count("*").alias("tf")))  # texts are read once
    gdf = tf.groupBy("word").agg(F.count("*").alias("gdf"))
    n_groups = tf.agg(F.countDistinct(group)).first()[0]  # groups holding at least one token
    scored = tf.join(gdf, "word").withColumn("score", F.col("tf") * F.log(F.lit(float(n_groups)) / F.col("gdf")))
    w = Window.partitionBy(group).orderBy(F.desc("score"), F.asc("word"))
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(group, "word", "score", "rank"))


def detected_language(text, default: str = "en"):
    """T7 as an expression: the language with most stop-word hits among the
    words of a text (ties by language code), ``default`` without any hit."""
    from pagelake.functions.rfc import let

    def hits(ws, stop):
        return F.size(F.filter(ws, lambda w: w.isin(*stop)))

    def votes(ws):
        return F.greatest(*[F.struct(hits(ws, stop).alias("hits"), F.lit(-place).alias("order"), F.lit(lang).alias("lang"))
                            for place, (lang, stop) in enumerate(sorted(TX.STOP_WORDS.items()))])

    best = let(TX.plain_words(text), votes)
    return let(best, lambda v: F.when(v["hits"] > 0, v["lang"]).otherwise(F.lit(default)))


def language_vote(docs: DataFrame, default: str = "en") -> DataFrame:
    """(doc_id, detected), one narrow pass."""
    return docs.select("doc_id", detected_language(F.col("text"), default).alias("detected"))


def spam_confusion(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Spam verdict (F21) against ``labels.toxic``: confusion counts."""
    j = docs.select("doc_id", TX.is_spam(F.col("text")).alias("spam")).join(labels, "doc_id")
    t = F.col("toxic") == 1
    return j.agg(F.count_if(F.col("spam") & t).alias("tp"), F.count_if(F.col("spam") & ~t).alias("fp"),
                 F.count_if(~F.col("spam") & ~t).alias("tn"), F.count_if(~F.col("spam") & t).alias("fn"))


def page_metadata(pages: DataFrame) -> DataFrame:
    """``<meta name=... content=...>`` (key, value) entries in document
    order (an array, since names may repeat), html ``lang`` and charset."""
    h = F.col("html")
    metas = F.regexp_extract_all(h, F.lit(r"(?is)<meta\b[^>]*\bname\s*=[^>]*>"), 0)
    from pagelake.functions.html import attr
    entries = F.transform(metas, lambda m: F.struct(F.lower(attr(m, "name")).alias("key"),
                                                    attr(m, "content").alias("value")))
    return pages.select(
        "page_id",
        F.filter(entries, lambda e: e["key"] != "").alias("meta"),
        F.regexp_extract(h, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1).alias("html_lang"),
        F.lower(F.regexp_extract(h, r"(?is)<meta\b[^>]*\bcharset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1)).alias("charset"))


def describe_image(objects, confidence, labels, ocr_text):
    """M2: ``Detected objects: o1 (c1), o2, \\nImage categories: l1, l2, `` plus
    ``\\nExtracted text: ...`` when OCR text exists.  Objects and confidences
    are zipped by position; an object without a confidence is printed alone.
    Confidences print like a C++ stream (6 significant digits)."""
    zipped = F.arrays_zip(F.col(objects).alias("o"), F.col(confidence).alias("c"))
    obj_part = F.array_join(F.transform(
        F.filter(zipped, lambda z: z["o"].isNotNull()),
        lambda z: F.when(z["c"].isNotNull(),
                         F.concat(z["o"], F.lit(" ("), TX.format_g(z["c"].cast("double")), F.lit("), ")))
        .otherwise(F.concat(z["o"], F.lit(", ")))), "")
    label_part = F.array_join(F.transform(F.col(labels), lambda x: F.concat(x, F.lit(", "))), "")
    ocr = F.col(ocr_text)
    return F.concat(F.lit("Detected objects: "), obj_part, F.lit("\nImage categories: "), label_part,
                    F.when(F.coalesce(ocr, F.lit("")) != "", F.concat(F.lit("\nExtracted text: "), ocr))
                    .otherwise(F.lit("")))


def features_to_string(language, topics, relevance, is_spam):
    """``Language: l, Topics: t1, t2, Relevance: r, IsSpam: 0|1``."""
    return F.concat(F.lit("Language: "), F.col(language), F.lit(", Topics: "),
                    F.array_join(F.transform(F.col(topics), lambda t: F.concat(t, F.lit(", "))), ""),
                    F.lit("Relevance: "), TX.format_g(F.col(relevance).cast("double")),
                    F.lit(", IsSpam: "), F.col(is_spam).cast("int").cast("string"))
