"""Extraction jobs over a page table (one row -> many rows).

All of them are narrow: ``regexp_extract_all`` + ``posexplode`` inside the
scan's stage, no shuffle.  ``pos`` keeps document order (0-based), which the
per-page fan-out cap (W5) and first-occurrence de-duplication (X5) rely on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import html as H
from pagelake.functions import urls as U
from pagelake.functions.rfc import with_urljoin

LINK_VARIANTS = ("strict", "double_quote", "icase", "absolute", "wiki", "parser")


def _explode_matches(df: DataFrame, pattern: str, group: int, keep: list[str], name: str) -> DataFrame:
    return df.select(*keep, F.posexplode(F.regexp_extract_all(F.col("html"), F.lit(pattern), group))
                     .alias("pos", name))


def link_edges(pages: DataFrame, variant: str = "strict", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Links found in each page, resolved the way a given crawler did.

    Output: ``keep`` columns, ``pos`` (document order), ``href`` (raw
    capture) and ``target`` (resolved URL).

    * strict (X1): ``<a ... href='..'|"..">`` any quote, resolved with U10.
    * double_quote (X2): ``<a[^>]+href="..."``, resolved with U11.
    * icase (X3): case-insensitive, double quotes, resolved with U12.
    * absolute (X4): as strict but not resolved: normalised (U8), kept only if
      valid (U16) and not an excluded extension (F5), so relative links vanish.
    * wiki (X5): ``/wiki/`` paths without ``#``/``:``, prefixed with the wiki
      origin, distinct per page in first-occurrence order.
    * parser (X6): every ``<a>`` element that a parser sees (none in comments,
      scripts, styles or attribute values) with an href in any attribute order and
      quote style, entities decoded, ``#``/``javascript:`` skipped (F7),
      RFC 3986 resolution (U13), web pages only (F6).
    """
    keep = list(keep)
    base = F.col("url")
    if variant == "strict":
        e = _explode_matches(pages, H.LINK_ANY_QUOTE_RE, 1, keep, "href")
        return e.withColumn("target", U.resolve_strict(base, F.col("href")))
    if variant == "double_quote":
        e = _explode_matches(pages, H.LINK_DOUBLE_QUOTE_RE, 1, keep, "href")
        return e.withColumn("target", U.resolve_append(base, F.col("href")))
    if variant == "icase":
        e = _explode_matches(pages, H.LINK_ICASE_RE, 1, keep, "href")
        return e.withColumn("target", U.resolve_dirname(base, F.col("href")))
    if variant == "absolute":
        e = _explode_matches(pages, H.LINK_ANY_QUOTE_RE, 1, keep, "href")
        e = e.withColumn("target", U.normalize_fragment_slash(F.col("href")))
        return e.where((F.col("target") != "") & U.pattern_valid(F.col("target"))
                       & ~U.has_excluded_extension(F.col("target")))
    if variant == "wiki":
        paths = F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(H.WIKI_LINK_RE), 1))
        for ns in H.WIKI_SKIPPED_NAMESPACES:
            paths = F.filter(paths, lambda p, ns=ns: ~p.contains(ns))
        return (pages.select(*keep, F.posexplode(paths).alias("pos", "href"))
                .withColumn("target", F.concat(F.lit(H.WIKI_ORIGIN), F.col("href"))))
    if variant == "parser":
        e = (pages.select(*keep, F.posexplode(H.tags("html", "a")).alias("pos", "tag"))
             .withColumn("href", H.tag_attr("tag", "href")).drop("tag")
             .where((F.col("href") != "") & U.is_followable_href(F.col("href"))))
        return with_urljoin(e, "url", "href", "target").where(U.is_webpage_url(F.col("target")))
    raise ValueError(f"unknown link variant {variant!r}; choose from {LINK_VARIANTS}")


def image_refs(pages: DataFrame, variant: str = "strict", compat: bool = False,
               keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Images referenced by each page.

    * strict (X7): ``<img ... src=..>``, resolved with U10; output ``src``, ``target``.
    * with_alt (X8): (src, alt) pairs, not resolved, normalised (U8), valid
      (U16) only.  The source pattern's greedy ``[^>]*`` before its optional
      alt group means alt is always ""; ``compat=True`` reproduces that,
      the default reads the real ``alt`` attribute of the matched tag.
    * parser (X9): every ``<img>`` element that a parser sees, any attribute order,
      RFC 3986 resolution, alt default "".
    """
    keep = list(keep)
    base = F.col("url")
    if variant == "strict":
        e = _explode_matches(pages, H.IMG_ANY_QUOTE_RE, 1, keep, "src")
        return e.withColumn("target", U.resolve_strict(base, F.col("src")))
    if variant == "with_alt":
        tags = pages.select(*keep, F.posexplode(F.regexp_extract_all(F.col("html"), F.lit(H.IMG_WITH_ALT_RE), 0))
                            .alias("pos", "tag"))
        e = tags.select(*keep, "pos",
                        F.regexp_extract(F.col("tag"), H.IMG_WITH_ALT_RE, 1).alias("src"),
                        (F.lit("") if compat else H.attr(F.col("tag"), "alt")).alias("alt"))
        e = e.withColumn("target", U.normalize_fragment_slash(F.col("src")))
        return e.where((F.col("target") != "") & U.pattern_valid(F.col("target")))
    if variant == "parser":
        e = (pages.select(*keep, F.posexplode(H.tags("html", "img")).alias("pos", "tag"))
             .withColumn("src", H.tag_attr("tag", "src"))
             .where(F.col("src") != "")
             .withColumn("alt", F.coalesce(H.tag_attr("tag", "alt"), F.lit("")))
             .drop("tag"))
        return with_urljoin(e, "url", "src", "target")
    raise ValueError(f"unknown image variant {variant!r}")


def parsed_title(html) -> F.Column:
    """Decoded text of the first title element that a parser sees; "No Title"
    without one, null where it holds no text or more than one text."""
    texts = H.element_text(html, "title")
    first = F.try_element_at(texts, F.lit(1))
    return (F.when(F.size(texts) == 0, F.lit("No Title"))
            .when((first != "") & ~first.rlike("<[A-Za-z/!?]"), H.decode_entities(first)))


def page_titles(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """X10-X15 title variants side by side."""
    h = F.col("html")
    first_icase = F.regexp_extract(h, H.TITLE_ICASE_RE, 1)
    return pages.select(
        *keep,
        H.first_title(h, H.TITLE_RE, "No title").alias("title_min"),        # X10
        H.first_title(h, H.TITLE_RE, "Untitled").alias("title_basic"),      # X11
        H.first_title(h, H.TITLE_ICASE_RE, "No Title").alias("title_icase"),  # X12
        H.first_title(h, H.TITLE_RE, "").alias("title_plain"),              # X13
        parsed_title(h).alias("title_decoded"),                             # X14
        F.concat(F.lit("Page "), F.col("url")).alias("title_placeholder"),  # X15
        (h.rlike(H.TITLE_ICASE_RE) & (first_icase == "")).alias("title_empty"),
    )


def sanitized_key(url) -> "F.Column":
    """Every byte that is not alnum, ``-``, ``_`` or ``.`` becomes ``_``
    (a 2-byte UTF-8 character gives ``__``, a 3-byte one ``___``)."""
    u = F.col(url) if isinstance(url, str) else url
    u = F.regexp_replace(u, r"[\x{10000}-\x{10FFFF}]", "____")
    u = F.regexp_replace(u, r"[\x{800}-\x{FFFF}]", "___")
    u = F.regexp_replace(u, r"[\x{80}-\x{7FF}]", "__")
    return F.regexp_replace(u, r"[^A-Za-z0-9._\-]", "_")


def page_records(pages: DataFrame, base_dir: str = "pages") -> DataFrame:
    """X16 + S18: the stored page record in one pass: url, placeholder title,
    content, file path and content byte size."""
    return pages.select(
        "page_id", "url",
        F.concat(F.lit("Page "), F.col("url")).alias("title"),
        F.col("html").alias("content"),
        F.concat(F.lit(base_dir.rstrip("/") + "/"), sanitized_key("url")).alias("file_path"),
        F.octet_length("html").cast("bigint").alias("bytes"),
    )


def derive_image_pages(pages: DataFrame, origin: str = "", tag: str = "img") -> DataFrame:
    """Derived fixture: every ``<a href="X">`` becomes ``<img src="X.png" alt="X">``
    (``origin`` prefixes X to make the reference absolute; ``tag="a"`` keeps
    it a link), so the image extractors have input: the corpus has no images."""
    attr = "src" if tag == "img" else "href"
    return pages.withColumn("html", F.regexp_replace(
        "html", r'<a href="([^"]*)">', f'<{tag} {attr}="{origin}$1.png" alt="$1">'))


#: Markup in which a bare tag pattern goes wrong, with the page's id for ``%d``.
TRICKY_HEADS = ['<!-- <title>hidden</title> -->', '<script>var t = "<title>s</title>";</script>',
                '<title lang="a>b">First &amp; %d</title>', '<title></title>']
TRICKY_TAIL = """<!-- <a href="/c%d"> <img src="/c%d.png"> --><script>var s = '<a href="/s%d"><img src="/s%d.png">';</script>
<style>a > b {}</style><a-x href="/x%d"><img-x src="/x%d.png"><a title="a>b" href="/ok%d"><img alt="a>b &lt;" src="/ok%d.png">
<A class=k HREF='/up%d'><a href="/one" href="/last%d"><a data-href="/d%d"><IMG SRC=/bare%d.png></A><a href="/cut%d" """


def derive_tricky_pages(pages: DataFrame) -> DataFrame:
    """Derived fixture: every page gets a head and a tail with comments, scripts,
    custom elements, quoted ``>``, repeated and bare attributes, a cut tag."""
    pid = F.col("page_id").cast("string")
    head = F.element_at(F.array(*[F.lit(h) for h in TRICKY_HEADS]), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    return pages.withColumn("html", F.concat(F.replace(head, F.lit("%d"), pid), "html", F.replace(F.lit(TRICKY_TAIL), F.lit("%d"), pid)))
