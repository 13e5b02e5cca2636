"""Character references against the standard library."""

import html
import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from pagelake.functions import html as H
from pagelake.functions.html import decode_entities

CASES = ["&#38;lt;", "&amp;lt;", "&copy; &eacute; &mdash; &nbsp;|", "&#128512; &#x1F600; &#xFB01; &#39;", "&unknown; & &x",
         "a&lt;b&gt;c &quot;q&quot;", "&copy 2024", "&#150;&#0;&#xD800;&#x110000;", "no references", "&notit;", "&#65&#66", ""]


def test_decode_entities(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, x string").repartition(2)
    got = {r.i: r.y for r in df.select("i", decode_entities(F.col("x")).alias("y")).collect()}
    for i, text in enumerate(CASES):
        if text != "&notit;":  # a browser would read the prefix &not; whole names only here
            assert got[i] == html.unescape(text), text
    assert spark.createDataFrame([(None,)], "x string").select(decode_entities("x")).first()[0] is None


def test_substring_words(spark):
    from pagelake.operators.features import contained
    words = spark.createDataFrame([("an",), ("banana",), ("x",), ("",), ("nab",)], "w string")
    tok = spark.createDataFrame([("banana",), ("bananabc",), ("",), ("q",)], "token string")
    got = sorted((r.token, r.w) for r in contained(tok, words).collect())
    assert got == [("banana", "an"), ("banana", "banana"), ("bananabc", "an"), ("bananabc", "banana"), ("bananabc", "nab")]


class _Seen(HTMLParser):
    """Start tags as the standard library sees them; of repeated attributes the last one."""

    def __init__(self, text):
        super().__init__()
        self.tags = []
        self.feed(text)

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, {k: v or "" for k, v in attrs}))


PIECES = ['<!-- <a href="/c1"> -->', "<script>var s = '<a href=\"/s\"></a>'; if (a<b) {}</script>", '<style>a>b{}</style>', '<a-x href="/x">',
          '<a title="a>b" href="/ok2">', "<a href='/single' id=x>", "<A HREF=/bare>", '<a href = "/spaced">', '<a href="/1" href="/2">',
          '<a data-href="/no">', "<a href>", '<a\nclass="k"\thref="/lines"/>', "</a>", "text & <b>bold</b>", '<a href="/q?a=1&amp;b=2">',
          "<!DOCTYPE html>", "<!---->", "<br/>", "<a title='it\"s' href='/mix'>", '<a class="a"href="/tight">', "<abbr href='/abbr'>",
          '<img alt="x>y" src="/i.png">', "<IMG SRC=/j.png>", "<imgx src='/k.png'>", "<p title='<a href=\"/attr\">'>", "1 < 2 <3 > 2",
          "<script src='/x.js'></script>", "<SCRIPT>'<img src=/s.png>'</SCRIPT >", "<?php '<a' ?>"]


def test_tags_as_a_parser_sees_them(spark):
    r = random.Random(7)
    pages = ["".join(r.choices(PIECES, k=r.randint(1, 12))) for _ in range(400)] + PIECES + ["", "no tags"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").repartition(4)
    for name, key in (("a", "href"), ("img", "src")):
        got = df.select("i", F.transform(H.tags("html", name), lambda t: H.tag_attr(t, key)).alias("v")).collect()
        for row in got:
            assert row.v == [a.get(key) for t, a in _Seen(pages[row.i]).tags if t == name], pages[row.i]


def test_tags_of_broken_pages(spark):
    """Cut and degenerate markup: a defined result, in linear time and without deep recursion."""
    many = "<a " + " ".join(f'k{i}="v>{i}"' for i in range(30_000)) + ' href="/end">'
    cases = [('<a href="/x', []), ('<!-- open <a href="/x">', []), ("<script>'<a href=\"/x\">'", []), ('<a href="/x>y" <a href="/z">', ["/z"]),
             ("<a " * 200_000, []), ("<!--" * 200_000, []), ("<script>" * 100_000, []), (many, ["/end"]), ("<" * 300_000, []), (None, None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, html string")
    got = {r.i: r.v for r in df.select("i", F.transform(H.tags("html", "a"), lambda t: H.tag_attr(t, "href")).alias("v")).collect()}
    for i, (text, expected) in enumerate(cases):
        assert got[i] == expected, (text or "")[:40]


def test_titles(spark):
    from pagelake.operators.extract import parsed_title
    cases = [("<title>a &amp; b</title><title>c</title>", "a & b"), ("<!-- <title>x</title> --><title lang='a>b'>y</title>", "y"), ("<p>", "No Title"),
             ("<title></title>", None), ("<title>a<b>c</b></title>", None), ("<titles>x</titles>", "No Title"), ("<title>open 1 < 2", "open 1 < 2"), (None, None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, html string")
    got = {r.i: r.t for r in df.select("i", parsed_title("html").alias("t")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(cases)}
