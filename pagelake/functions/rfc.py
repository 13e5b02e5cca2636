"""RFC 3986 reference resolution (the ``urllib.parse.urljoin`` rules)
as native Spark expressions.

Dot segments are removed with the higher-order ``aggregate`` over the split
path, so the whole resolution stays JVM-side (no Python worker).  Scope: the
base is a hierarchical URL (http, https, ftp, file ...); ``;params`` are kept
as part of the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# RFC 3986 / urllib split pattern and relative-capable schemes
SPLIT_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
RELATIVE_SCHEMES = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https",
                    "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh",
                    "ws", "wss"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _clean(u: Column) -> Column:
    """urlsplit pre-processing: strip leading C0/space, drop tab/CR/LF."""
    return F.regexp_replace(F.regexp_replace(u, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def remove_dot_segments(segments: Column) -> Column:
    """Resolve ``.``/``..`` in an array of path segments."""
    empty = F.array().cast("array<string>")
    resolved = F.aggregate(
        segments, empty,
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
                              .otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))))
    last = F.element_at(segments, -1)
    return F.when(last.isin(".", ".."), F.concat(resolved, F.array(F.lit("")))).otherwise(resolved)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body(value)``: the expression tree
    stays linear however often the body reads the bound value, so filters
    pushed through projections do not blow up the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def urljoin(base, ref) -> Column:
    """``urljoin(base, ref)`` as one linear-size native expression."""
    v = F.struct(F.coalesce(_c(base), F.lit("")).alias("raw"),
                 _clean(_c(base)).alias("b"), _clean(_c(ref)).alias("r"))
    v = let(v, lambda s: s
            .withField("bs", F.lower(F.regexp_extract(s.b, SPLIT_RE, 1)))
            .withField("bn", F.regexp_extract(s.b, SPLIT_RE, 2))
            .withField("bp", F.regexp_extract(s.b, SPLIT_RE, 3))
            .withField("bq", F.regexp_extract(s.b, SPLIT_RE, 4))
            .withField("rs", F.lower(F.regexp_extract(s.r, SCHEME_RE, 1))))
    # a reference with the base's own scheme is resolved relative to it
    v = let(v, lambda s: s.withField(
        "same", (s.rs != "") & (s.rs == s.bs) & s.bs.isin(*RELATIVE_SCHEMES)))
    v = let(v, lambda s: s.withField(
        "rel0", F.when(s.same, F.regexp_replace(s.r, SCHEME_RE, "")).otherwise(s.r)))
    v = let(v, lambda s: s.withField("auth", s.rel0.rlike(r"^//[^/?#]")))
    # an empty authority ("//" then path) keeps the base authority
    v = let(v, lambda s: s.withField(
        "rel", F.when(s.rel0.startswith("//") & ~s.auth, s.rel0.substr(F.lit(3), F.lit(1 << 30)))
        .otherwise(s.rel0)))
    v = let(v, lambda s: s
            .withField("rp", F.regexp_extract(s.rel, r"^([^?#]*)", 1))
            .withField("rq", F.regexp_extract(s.rel, r"^[^?#]*\?([^#]*)", 1))
            .withField("rf", F.regexp_extract(s.rel, r"^[^#]*#(.*)\z", 1))
            .withField("bparts", F.split(s.bp, "/", -1)))
    v = let(v, lambda s: s.withField(
        "merged", F.concat(F.when(F.element_at(s.bparts, -1) != "",
                                  F.slice(s.bparts, 1, F.size(s.bparts) - 1)).otherwise(s.bparts),
                           F.split(s.rp, "/", -1))))
    v = let(v, lambda s: s.withField(
        "segs", F.when(s.rp.startswith("/"), F.split(s.rp, "/", -1))
        .when(F.size(s.merged) >= 2, F.concat(
            F.slice(s.merged, 1, 1),
            F.filter(F.slice(s.merged, 2, F.greatest(F.size(s.merged) - 2, F.lit(0))), lambda x: x != ""),
            F.slice(s.merged, -1, 1)))
        .otherwise(s.merged)))
    v = let(v, lambda s: s.withField("j0", F.array_join(remove_dot_segments(s.segs), "/")))
    v = let(v, lambda s: s.withField(
        "joined", F.when(s.j0 == "", F.lit("/"))
        .when(~s.j0.startswith("/"), F.concat(F.lit("/"), s.j0))  # urlunsplit rule
        .otherwise(s.j0)))

    def finish(s):
        def unsplit(path_, query_):
            return F.concat(s.bs, F.lit("://"), s.bn, path_,
                            F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(F.lit("")),
                            F.when(s.rf != "", F.concat(F.lit("#"), s.rf)).otherwise(F.lit("")))
        resolved = (F.when(s.rp == "", unsplit(s.bp, F.when(s.rq != "", s.rq).otherwise(s.bq)))
                    .otherwise(unsplit(s.joined, s.rq)))
        return (F.when(s.raw == "", s.r)
                .when(s.r == "", s.b)
                .when((s.rs != "") & ~s.same, s.r)
                .when(s.auth, F.concat(s.bs, F.lit(":"), s.rel))
                .otherwise(resolved))

    return let(v, finish)


def with_urljoin(df: DataFrame, base: str, ref: str, out: str) -> DataFrame:
    """Add column ``out`` = ``urljoin(df[base], df[ref])``."""
    return df.withColumn(out, urljoin(F.col(base), F.col(ref)))
