"""Extraction queries (X1-X16, U10-U13, S18, S19, F4-F6) over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.catalog import register
from pagelake.catalog._sql import q, strict_host, strict_path, strict_scheme
from pagelake.functions import html as H
from pagelake.functions import urls as U
from pagelake.operators import extract as X
from pagelake.session import table


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _exploded_sql(pattern: str, source: str = "pages", group: int = 1, name: str = "href") -> str:
    return f"""
  SELECT page_id, url, unnest(l) AS {name}, CAST(unnest(range(len(l))) AS BIGINT) AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, {q(pattern)}, {group}) AS l FROM {source})"""


_ORIGIN = f"({strict_scheme('url')} || '://' || {strict_host('url')})"
_DIR = f"regexp_extract({strict_path('url')}, '^(.*/)', 1)"
_IMG_PAGES = ("(SELECT page_id, url, regexp_replace(html, '<a href=\"([^\"]*)\">', "
              "'<img src=\"\\1.png\" alt=\"\\1\">', 'g') AS html FROM pages)")
_IMG_PAGES_ABS = ("(SELECT page_id, url, regexp_replace(html, '<a href=\"([^\"]*)\">', "
                  "'<img src=\"http://img.example.com\\1.png\" alt=\"\\1\">', 'g') AS html FROM pages)")


def _resolve_strict_sql(ref: str) -> str:
    return (f"CASE WHEN prefix({ref}, 'http://') OR prefix({ref}, 'https://') THEN {ref} "
            f"WHEN prefix({ref}, '/') THEN {_ORIGIN} || {ref} "
            f"ELSE {_ORIGIN} || (CASE WHEN {_DIR} = '' THEN '/' ELSE {_DIR} END) || {ref} END")


# prefix of url up to (not including) the first '/' after '://', NULL when none
_AFTER = "substring(url, instr(url, '://') + 3)"
_PREFIX = (f"(CASE WHEN instr({_AFTER}, '/') > 0 "
           f"THEN substring(url, 1, instr(url, '://') + 1 + instr({_AFTER}, '/')) END)")


@register("links_strict", f"""
SELECT page_id, pos, href, {_resolve_strict_sql('href')} AS target
FROM ({_exploded_sql(H.LINK_ANY_QUOTE_RE)})
""")
def links_strict(spark, sf_dir):
    """X1 + U10: every link in document order, resolved against the page."""
    return X.link_edges(_pages(spark, sf_dir), "strict").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "href", "target")


@register("links_double_quote", f"""
SELECT page_id, pos, href,
  CASE WHEN prefix(href, 'http') THEN href
       WHEN prefix(href, '/') THEN
         CASE WHEN instr(url, '://') = 0 THEN href
              WHEN {_PREFIX} IS NOT NULL THEN {_PREFIX} || href
              ELSE url || href END
       WHEN suffix(url, '/') THEN url || href
       ELSE url || '/' || href END AS target
FROM ({_exploded_sql(H.LINK_DOUBLE_QUOTE_RE)})
""")
def links_double_quote(spark, sf_dir):
    """X2 + U11."""
    return X.link_edges(_pages(spark, sf_dir), "double_quote").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "href", "target")


@register("links_icase", f"""
SELECT page_id, pos, href,
  CASE WHEN prefix(href, 'http') THEN href
       WHEN prefix(href, '/') THEN
         CASE WHEN instr(url, '://') > 0 AND {_PREFIX} IS NOT NULL THEN {_PREFIX} || href
              ELSE href END
       WHEN regexp_extract(url, '^(.*/)', 1) <> '' THEN regexp_extract(url, '^(.*/)', 1) || href
       ELSE href END AS target
FROM ({_exploded_sql(H.LINK_ICASE_RE)})
""")
def links_icase(spark, sf_dir):
    """X3 + U12."""
    return X.link_edges(_pages(spark, sf_dir), "icase").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "href", "target")


_NORM_B = ("(CASE WHEN suffix(split_part(href, '#', 1), '/') THEN "
           "substring(split_part(href, '#', 1), 1, length(split_part(href, '#', 1)) - 1) "
           "ELSE split_part(href, '#', 1) END)")
_EXCL = " OR ".join(f"(suffix(t, {q(e)}) AND length(t) > {len(e)})" for e in U.EXCLUDED_EXTENSIONS)


@register("links_absolute", f"""
SELECT page_id, pos, href, t AS target FROM (
  SELECT *, {_NORM_B} AS t FROM ({_exploded_sql(H.LINK_ANY_QUOTE_RE, _IMG_PAGES_ABS.replace('<img src', '<a href'))}))
WHERE t <> '' AND coalesce(regexp_matches(t, {q(U.VALID_C_RE)}), false) AND NOT ({_EXCL})
""")
def links_absolute(spark, sf_dir):
    """Unresolved absolute links only (normalised U8, valid U16, not F5).
    Input: pages whose links point at an absolute host (derived fixture)."""
    pages = X.derive_image_pages(_pages(spark, sf_dir), origin="http://img.example.com", tag="a")
    return X.link_edges(pages, "absolute").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "href", "target")


_WIKI_PAGES = ("(SELECT page_id, url, regexp_replace(html, 'href=\"/([^\"]*)\"', CASE page_id % 3 WHEN 0 THEN "
               "'href=\"/wiki/Help/wiki/Talk:\\1\"' ELSE 'href=\"/wiki/\\1\"' END, 'g') AS html FROM pages)")


@register("links_wiki", f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first_pos) - 1 AS BIGINT) AS pos,
       href, 'https://en.wikipedia.org' || href AS target
FROM (
  SELECT page_id, href, min(pos) AS first_pos FROM ({_exploded_sql(H.WIKI_LINK_RE, _WIKI_PAGES)})
  WHERE NOT (contains(href, '/wiki/Special:') OR contains(href, '/wiki/Help:')
     OR contains(href, '/wiki/Talk:') OR contains(href, '/wiki/Wikipedia:')
     OR contains(href, '/wiki/Template:') OR contains(href, '/wiki/File:'))
  GROUP BY page_id, href)
""")
def links_wiki(spark, sf_dir):
    """Wiki article links, distinct per page in first-occurrence order.
    Input: pages whose links point at wiki articles (derived fixture; a third
    of the pages links names that the rule skips)."""
    pages = _pages(spark, sf_dir).withColumn("html", F.regexp_replace(
        F.col("html"), F.lit(r'href="/([^"]*)"'),
        F.when(F.col("page_id") % 3 == 0, F.lit('href="/wiki/Help/wiki/Talk:$1"')).otherwise(F.lit('href="/wiki/$1"'))))
    return X.link_edges(pages, "wiki").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "href", "target")


# The same tokens for DuckDB, whose patterns have no lookaround and never backtrack.
_ATTR = r"""[^\s/>][^\s/=>]*(?:\s*=+\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?"""
_ATTRS = rf"(?:[\s/]+|{_ATTR})*"


def _wanted_sql(wanted: str) -> str:
    """List of what ``wanted`` (with one group) matches outside comments, scripts and other tags."""
    raw = "|".join(rf"<{n}(?:[\s/]{_ATTRS})?>.*?(?:</{n}[\s/>]|\z)" for n in H.RAW_TEXT)
    pattern = rf"(?is)<!--.*?(?:--\s*>|\z)|<[!?][^>]*(?:>|\z)|{raw}|{wanted}|</?[a-z][^\s/>]*{_ATTRS}(?:>|\z)"
    return f"list_filter(regexp_extract_all(html, {q(pattern)}, 1), lambda x: x <> '')"


def _tags_sql(name: str, source: str) -> str:
    return f"""SELECT page_id, url, unnest(l) AS tag, CAST(unnest(range(len(l))) AS BIGINT) AS pos
  FROM (SELECT page_id, url, {_wanted_sql(rf"(<{name}(?:[\s/]{_ATTRS})?>)")} AS l FROM {source})"""


def _decoded_sql(e: str) -> str:
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        e = f"replace({e}, '{ref}', '{char}')"
    return e


def _attr_sql(tag: str, name: str) -> str:
    own = (f"list_filter(regexp_extract_all(regexp_replace({tag}, '^<[^\\s/>]+', ''), {q('(?s)' + _ATTR)}, 0), "
           f"lambda a: regexp_matches(a, {q(rf'(?is)^{name}(?:[=]|[ ]*=|$)')}))[-1]")
    value = f"regexp_replace({own}, {q(r'(?s)^[^\s=]+(?:\s*=+\s*)?')}, '')"
    return _decoded_sql(f"regexp_replace({value}, {q(chr(40) + '?s)^[' + chr(34) + chr(39) + '](.*)[' + chr(34) + chr(39) + ']$')}, '\\1')")


def _absolute_sql(ref: str) -> str:
    return f"""CASE WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {ref}
         WHEN prefix({ref}, '/') AND NOT prefix({ref}, '//')
           THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || {ref} END"""


def _parser_links_sql(source: str) -> str:
    return f"""
SELECT page_id, pos, href, target FROM (
  SELECT page_id, pos, href, {_absolute_sql('href')} AS target
  FROM (SELECT page_id, url, pos, {_attr_sql('tag', 'href')} AS href FROM ({_tags_sql('a', source)}))
  WHERE href <> '' AND NOT prefix(href, '#') AND NOT prefix(href, 'javascript:'))
WHERE NOT ({" OR ".join(f"suffix(lower(regexp_extract(target, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)), {q(e)})" for e in U.NON_PAGE_EXTENSIONS)})
"""


def _parser_images_sql(source: str) -> str:
    return f"""
SELECT page_id, pos, src, alt, {_absolute_sql('src')} AS target
FROM (SELECT page_id, url, pos, {_attr_sql('tag', 'src')} AS src, coalesce({_attr_sql('tag', 'alt')}, '') AS alt
      FROM ({_tags_sql('img', source)}))
WHERE src <> ''
"""


def _title_sql() -> str:
    """X14: 'No Title' without a title element, null without one text in the first."""
    first = f"""({_wanted_sql(rf"(<title(?:[\s/]{_ATTRS})?>.*?)(?:</title[\s/>]|\z)")})[1]"""
    text = f"regexp_replace({first}, {q(rf'(?is)^<title(?:[\s/]{_ATTRS})?>')}, '')"
    return f"""CASE WHEN {first} IS NULL THEN 'No Title'
    WHEN {text} <> '' AND NOT regexp_matches({text}, '<[A-Za-z/!?]') THEN {_decoded_sql(text)} END"""


_TRICKY_PAGES = (f"(SELECT page_id, url, replace([{', '.join(q(h) for h in X.TRICKY_HEADS)}][page_id % 4 + 1], '%d', page_id::VARCHAR) "
                 f"|| html || replace({q(X.TRICKY_TAIL)}, '%d', page_id::VARCHAR) AS html FROM pages)")


@register("links_parser", _parser_links_sql("pages"))
def links_parser(spark, sf_dir):
    """X6 + U13 + F6 + F7: parser-style links, RFC-resolved, web pages only.
    (The SQL oracle covers the corpus's root-relative and absolute hrefs.)"""
    return X.link_edges(_pages(spark, sf_dir), "parser").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "href", "target")


@register("links_structured", _parser_links_sql(_TRICKY_PAGES))
def links_structured(spark, sf_dir):
    """X6 over pages with links in comments, scripts and attribute values, custom
    elements, repeated and bare attributes (derived fixture)."""
    return X.link_edges(X.derive_tricky_pages(_pages(spark, sf_dir)), "parser").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "href", "target")


@register("images_structured", _parser_images_sql(_TRICKY_PAGES))
def images_structured(spark, sf_dir):
    """X9 over the same fixture."""
    return X.image_refs(X.derive_tricky_pages(_pages(spark, sf_dir)), "parser").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "src", "alt", "target")


@register("titles_structured", f"SELECT page_id, {_title_sql()} AS title FROM {_TRICKY_PAGES}")
def titles_structured(spark, sf_dir):
    """X14 over the same fixture: titles in comments and scripts do not count."""
    return X.derive_tricky_pages(_pages(spark, sf_dir)).select("page_id", X.parsed_title("html").alias("title"))


@register("images_strict", f"""
SELECT page_id, pos, src, {_resolve_strict_sql('src')} AS target
FROM ({_exploded_sql(H.IMG_ANY_QUOTE_RE, _IMG_PAGES, name='src')})
""")
def images_strict(spark, sf_dir):
    """X7 + U10 over the derived image fixture (links rewritten to images)."""
    pages = X.derive_image_pages(_pages(spark, sf_dir))
    return X.image_refs(pages, "strict").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "src", "target")


_ALT_ATTR = r"""(?is)[\s<]alt\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


@register("images_with_alt", f"""
SELECT page_id, pos, src, alt, t AS target FROM (
  SELECT page_id, pos, regexp_extract(tag, {q(H.IMG_WITH_ALT_RE)}, 1) AS src,
    regexp_extract(tag, {q(_ALT_ATTR)}, 1) || regexp_extract(tag, {q(_ALT_ATTR)}, 2)
      || regexp_extract(tag, {q(_ALT_ATTR)}, 3) AS alt,
    {_NORM_B.replace('href', "regexp_extract(tag, " + q(H.IMG_WITH_ALT_RE) + ", 1)")} AS t
  FROM ({_exploded_sql(H.IMG_WITH_ALT_RE, _IMG_PAGES_ABS, group=0, name='tag')}))
WHERE t <> '' AND coalesce(regexp_matches(t, {q(U.VALID_C_RE)}), false)
""")
def images_with_alt(spark, sf_dir):
    """(src, alt) pairs, normalised, valid only; real alt text (the
    compat flag reproduces the always-empty alt of the source pattern)."""
    pages = X.derive_image_pages(_pages(spark, sf_dir), origin="http://img.example.com")
    return X.image_refs(pages, "with_alt").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "src", "alt", "target")


@register("images_parser", _parser_images_sql(_IMG_PAGES))
def images_parser(spark, sf_dir):
    """Any attribute order, RFC resolution, alt default ""."""
    pages = X.derive_image_pages(_pages(spark, sf_dir))
    return X.image_refs(pages, "parser").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "src", "alt", "target")


_T = q(H.TITLE_RE)
_TI = q(H.TITLE_ICASE_RE)


@register("page_titles", f"""
SELECT page_id,
  CASE WHEN regexp_matches(html, {_T}) THEN regexp_extract(html, {_T}, 1) ELSE 'No title' END AS title_min,
  CASE WHEN regexp_matches(html, {_T}) THEN regexp_extract(html, {_T}, 1) ELSE 'Untitled' END AS title_basic,
  CASE WHEN regexp_matches(html, {_TI}) THEN regexp_extract(html, {_TI}, 1) ELSE 'No Title' END AS title_icase,
  CASE WHEN regexp_matches(html, {_T}) THEN regexp_extract(html, {_T}, 1) ELSE '' END AS title_plain,
  {_title_sql()} AS title_decoded,
  'Page ' || url AS title_placeholder,
  regexp_matches(html, {_TI}) AND regexp_extract(html, {_TI}, 1) = '' AS title_empty
FROM pages
""")
def page_titles(spark, sf_dir):
    """The title variants side by side."""
    return X.page_titles(_pages(spark, sf_dir), keep=("page_id",))


@register("page_records", r"""
SELECT page_id, url, 'Page ' || url AS title,
  'pages/' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(url,
     '[\x{10000}-\x{10FFFF}]', '____', 'g'), '[\x{800}-\x{FFFF}]', '___', 'g'),
     '[\x{80}-\x{7FF}]', '__', 'g'), '[^A-Za-z0-9._\-]', '_', 'g') AS file_path,
  CAST(strlen(html) AS BIGINT) AS bytes,
  md5(url) AS storage_key
FROM pages
""")
def page_records(spark, sf_dir):
    """X16 + S18 + S19: stored page record with sanitised file path, byte size
    and a content-addressed key (md5 of the URL: portable, unlike std::hash)."""
    return (X.page_records(_pages(spark, sf_dir))
            .select("page_id", "url", "title", "file_path", "bytes",
                    F.md5("url").alias("storage_key")))


_KEY_SQL = r"""'pages/' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(url,
     '[\x{10000}-\x{10FFFF}]', '____', 'g'), '[\x{800}-\x{FFFF}]', '___', 'g'),
     '[\x{80}-\x{7FF}]', '__', 'g'), '[^A-Za-z0-9._\-]', '_', 'g')"""


@register("storage_key_collisions", f"""
SELECT file_path, count(*) AS pages, count(DISTINCT url) AS urls FROM (
  SELECT url, {_KEY_SQL} AS file_path FROM (
    SELECT url FROM pages UNION ALL SELECT replace(url, '/', '~') FROM pages WHERE page_id % 2 = 0))
GROUP BY file_path HAVING count(DISTINCT url) > 1
""")
def storage_key_collisions(spark, sf_dir):
    """Distinct URLs that sanitise to the same file path (every other
    page also under a URL that differs only in replaced characters)."""
    p = _pages(spark, sf_dir)
    twins = p.where(F.col("page_id") % 2 == 0).withColumn("url", F.replace("url", F.lit("/"), F.lit("~")))
    rec = X.page_records(p.unionByName(twins))
    return (rec.groupBy("file_path")
            .agg(F.count("*").alias("pages"), F.countDistinct("url").alias("urls"))
            .where(F.col("urls") > 1))
