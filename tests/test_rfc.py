"""U13 against urllib.parse.urljoin (the reference's resolver)."""

import itertools
from urllib.parse import urljoin as py_urljoin


from pagelake.functions.rfc import with_urljoin

BASES = ["http://h/a/b.html", "http://h", "https://h.com/a/b/", "http://h/a/b?x=1#f",
         "https://u@h.org:8080/p/q/r.php?z"]
REFS = ["c.html", "/c", "../c", "../../../c", "//cdn/x", "?q=1", "mailto:x@y", "https://z/",
        "#frag", "./", ".", "..", "a/./b/../c", "http:rel", "", "g?y/./x", "g#s/../x", "?",
        "/a/../b/./c/", "x//y", "HTTPS://Up/x"]


def spark_join(spark, pairs):
    df = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "i int, b string, r string")
    rows = with_urljoin(df, "b", "r", "y").select("i", "y").collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_urljoin_table(spark):
    pairs = [(b, r) for b in BASES for r in REFS]
    got = spark_join(spark, pairs)
    want = [py_urljoin(b, r) for b, r in pairs]
    bad = [(p, g, w) for p, g, w in zip(pairs, got, want) if g != w]
    assert not bad, bad[:10]


def test_urljoin_segment_combinations(spark):
    """Every 1-4 segment relative path over a small alphabet, in one job."""
    alphabet = ["a", "..", ".", "", "c.html"]
    refs = set()
    for n in range(1, 5):
        for combo in itertools.product(alphabet, repeat=n):
            for lead in ("", "/"):
                refs.add(lead + "/".join(combo))
    pairs = [(b, r) for r in sorted(refs) for b in ("http://h/p/q/r", "http://h/p/")]
    got = spark_join(spark, pairs)
    want = [py_urljoin(b, r) for b, r in pairs]
    bad = [(p, g, w) for p, g, w in zip(pairs, got, want) if g != w]
    assert not bad, bad[:10]
