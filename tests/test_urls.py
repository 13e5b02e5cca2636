"""Inline goldens for the URL helpers (derived by reading the crawlers)."""

from pyspark.sql import functions as F

from pagelake.functions import urls as U


def evaluate(spark, fn, values, *, pair=None):
    if pair is None:
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
        out = df.select("i", fn(F.col("x")).alias("y"))
    else:
        df = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(values)],
                                   "i int, b string, r string")
        out = df.select("i", fn(F.col("b"), F.col("r")).alias("y"))
    return [r.y for r in sorted(out.collect(), key=lambda r: r.i)]


def test_normalise_variants(spark):
    inputs = ["http://A.com/B/#Top", "http://a.com/", "http://a.com/x#f/", "http://a.com//"]
    assert evaluate(spark, U.normalize_lower_slash_fragment, inputs) == [
        "http://a.com/b/", "http://a.com", "http://a.com/x", "http://a.com/"]
    assert evaluate(spark, U.normalize_fragment_slash, inputs) == [
        "http://A.com/B", "http://a.com", "http://a.com/x", "http://a.com/"]
    assert evaluate(spark, U.normalize_lower_slash, inputs) == [
        "http://a.com/b/#top", "http://a.com", "http://a.com/x#f", "http://a.com/"]


def test_normalise_converges(spark):
    # U8 is not one-step idempotent on multi-slash tails, but it converges
    once = evaluate(spark, U.normalize_fragment_slash, ["http://a.com/x//"])
    twice = evaluate(spark, U.normalize_fragment_slash, once)
    thrice = evaluate(spark, U.normalize_fragment_slash, twice)
    assert once == ["http://a.com/x/"] and twice == ["http://a.com/x"] and thrice == twice


BASE = "http://h/a/b.html"
HREFS = ["c.html", "/c", "../c", "//cdn/x", "?q=1", "mailto:x@y", "https://z/"]


def test_resolve_variants(spark):
    pairs = [(BASE, h) for h in HREFS]
    assert evaluate(spark, U.resolve_strict, pairs, pair=True) == [
        "http://h/a/c.html", "http://h/c", "http://h/a/../c", "http://h//cdn/x",
        "http://h/a/?q=1", "http://h/a/mailto:x@y", "https://z/"]
    assert evaluate(spark, U.resolve_append, pairs, pair=True) == [
        "http://h/a/b.html/c.html", "http://h/c", "http://h/a/b.html/../c",
        "http://h//cdn/x", "http://h/a/b.html/?q=1", "http://h/a/b.html/mailto:x@y",
        "https://z/"]
    assert evaluate(spark, U.resolve_dirname, pairs, pair=True) == [
        "http://h/a/c.html", "http://h/c", "http://h/a/../c", "http://h//cdn/x",
        "http://h/a/?q=1", "http://h/a/mailto:x@y", "https://z/"]


def test_resolve_base_without_path(spark):
    pairs = [("http://h", "/c"), ("http://h", "c")]
    assert evaluate(spark, U.resolve_strict, pairs, pair=True) == ["http://h/c", "http://h/c"]
    assert evaluate(spark, U.resolve_append, pairs, pair=True) == ["http://h/c", "http://h/c"]
    assert evaluate(spark, U.resolve_dirname, pairs, pair=True) == ["/c", "http://c"]


def test_strict_components(spark):
    urls = ["https://a.com?x=1#f", "http://A.com/b/#top"]
    assert evaluate(spark, U.strict_host, urls) == ["a.com?x=1#f", "A.com"]
    assert evaluate(spark, U.strict_path, urls) == ["/", "/b/#top"]
    assert evaluate(spark, U.strict_query, urls) == ["", ""]
    assert evaluate(spark, U.strict_fragment, urls) == ["", ""]


def test_validity_variants(spark):
    urls = ["http://a", "http://ab", "ftp://a.com", "http://a b.com"]
    assert evaluate(spark, U.strict_valid, urls) == [True, True, False, False]
    assert evaluate(spark, U.prefix_valid, urls) == [False, True, False, True]
    assert evaluate(spark, U.pattern_valid, urls) == [False, True, False, True]


def test_depth_variants(spark):
    urls = ["http://e.com/a/b/", "http://e.com", "http://e.com/a//b", "http://e.com/a?x=/1/2", "http://h"]
    assert evaluate(spark, U.strict_depth, urls) == [2, 0, 3, 3, 0]
    assert evaluate(spark, U.slash_depth, urls) == [3, 0, 3, 3, 2]


def test_image_extensions(spark):
    urls = ["http://h.com/x.png?v=1", "http://h.com", "http://h/x.PNG", "http://h/x"]
    assert evaluate(spark, U.image_extension_any, urls) == ["png", "com", "PNG", "jpg"]
    assert evaluate(spark, U.image_extension_known, urls) == [".png", ".jpg", ".jpg", ".jpg"]


def test_domain_helpers(spark):
    urls = ["http://a.com:8080/x?y", "https://u@h.org", "no-scheme/x", "http://a.com?q=/1"]
    assert evaluate(spark, U.search_domain, urls) == ["a.com:8080", "u@h.org", "", "a.com?q="]
    assert evaluate(spark, U.delimited_domain, urls) == ["a.com:8080", "u@h.org", "", "a.com?q="]
    assert evaluate(spark, U.netloc, urls) == ["a.com:8080", "u@h.org", "", "a.com"]
    assert evaluate(spark, U.lenient_domain, ["https://a.com:80/x", "a.com/x"]) == ["a.com", "a.com"]
    assert evaluate(spark, U.lenient_scheme, ["https://a.com:80/x", "a.com/x"]) == ["https", "http"]


def test_host_classes(spark):
    hosts = ["www.example.com", "blog.example.com", "localhost", "fr.wikipedia.org"]
    assert evaluate(spark, U.base_domain, hosts) == ["example.com", "example.com", "localhost", "wikipedia.org"]
    assert evaluate(spark, U.wiki_language, hosts) == ["en", "blog", "localhost", "fr"]
    assert evaluate(spark, U.site_class, ["en.wikipedia.org", "github.com", "x.org"]) == [
        "wikipedia", "github", "other"]


def test_list_helpers(spark):
    out = evaluate(spark, U.split_list, [" a, b ,,\tc ,", ""])
    assert out == [["a", "b", "c"], []]
    assert evaluate(spark, lambda c: U.split_list(c, keep_empty=True), ["a,,b,"]) == [["a", "", "b"]]


def test_url_predicates(spark):
    urls = ["http://h/x.JPG", "http://h/x.png?v=1", "http://h/a.pdf", ".pdf", "http://h/a.PDF"]
    assert evaluate(spark, U.is_image_url, urls) == [True, False, False, False, False]
    assert evaluate(spark, U.has_excluded_extension, urls) == [False, False, True, False, False]
    assert evaluate(spark, U.is_webpage_url, urls) == [False, False, False, False, False]
    assert evaluate(spark, U.is_webpage_url, ["http://h/a.html", "http://h/x.png?v=1"]) == [True, False]
    assert evaluate(spark, U.is_followable_href, ["#top", "javascript:x()", "/a"]) == [False, False, True]
