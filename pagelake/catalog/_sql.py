"""DuckDB text for the oracle side: small macros for repeated expressions.

The oracle is written independently of the Spark code paths (different
engine, different functions); these helpers only avoid retyping patterns.
"""

from pagelake.functions import urls as U

UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LO = "abcdefghijklmnopqrstuvwxyz"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lower_ascii(e: str) -> str:
    return f"translate({e}, '{UP}', '{LO}')"


def pop_slash(e: str, min_len: int = 1) -> str:
    return (f"(CASE WHEN suffix({e}, '/') AND length({e}) >= {min_len} "
            f"THEN substring({e}, 1, length({e}) - 1) ELSE {e} END)")


def strict_valid(e: str) -> str:
    return f"coalesce(regexp_matches({e}, {q(U.STRICT_URL_RE)}), false)"


def strict_path(e: str) -> str:
    g = f"regexp_extract({e}, {q(U.STRICT_URL_RE)}, 3)"
    return (f"(CASE WHEN NOT {strict_valid(e)} THEN '' WHEN {g} = '' THEN '/' ELSE {g} END)")


def strict_host(e: str) -> str:
    return f"regexp_extract({e}, {q(U.STRICT_URL_RE)}, 2)"


def strict_scheme(e: str) -> str:
    return f"regexp_extract({e}, {q(U.STRICT_URL_RE)}, 1)"


def search_domain(e: str) -> str:
    return f"regexp_extract({e}, {q(U.DOMAIN_SEARCH_RE)}, 1)"


def count_char(e: str, ch: str) -> str:
    return f"(length({e}) - length(replace({e}, {q(ch)}, '')))"


def after(e: str, pos: str) -> str:
    """Characters of e from 1-based position pos to the end."""
    return f"substring({e}, {pos})"


def strict_depth(e: str) -> str:
    p1 = f"regexp_replace({strict_path(e)}, '^/', '')"
    p2 = f"(CASE WHEN suffix({p1}, '/') THEN substring({p1}, 1, length({p1}) - 1) ELSE {p1} END)"
    return (f"(CASE WHEN NOT {strict_valid(e)} OR {p2} = '' THEN 0 "
            f"ELSE length({p2}) - length(replace({p2}, '/', '')) + 1 END)")


def crawled_pages() -> str:
    return (f"(SELECT page_id, url, {search_domain('url')} AS domain, "
            f"CAST({strict_depth('url')} AS INTEGER) AS crawl_depth, "
            f"CAST(1704067200 + page_id * 60 AS BIGINT) AS ts_epoch, CAST(strlen(html) AS BIGINT) AS bytes "
            f"FROM pages)")


def discovered_images() -> str:
    from pagelake.functions import html as H
    img_pages = ("(SELECT page_id, url, regexp_replace(html, '<a href=\"([^\"]*)\">', "
                 "'<img src=\"\\1.png\" alt=\"\\1\">', 'g') AS html FROM pages)")
    origin = f"({strict_scheme('url')} || '://' || {strict_host('url')})"
    d = f"regexp_extract({strict_path('url')}, '^(.*/)', 1)"
    resolve = (f"CASE WHEN prefix(src, 'http://') OR prefix(src, 'https://') THEN src "
               f"WHEN prefix(src, '/') THEN {origin} || src "
               f"ELSE {origin} || (CASE WHEN {d} = '' THEN '/' ELSE {d} END) || src END")
    return f"""(SELECT page_id, {search_domain('url')} AS domain, {resolve} AS image_url,
   ['jpg', 'png', 'gif', 'webp'][page_id % 4 + 1] AS image_type,
   CAST(10 + length(html) % 500 AS BIGINT) AS size_kb,
   CAST(1704067200 + page_id * 60 + pos AS BIGINT) AS ts_epoch
 FROM (SELECT page_id, url, html, unnest(l) AS src, unnest(range(len(l))) AS pos
       FROM (SELECT page_id, url, html, regexp_extract_all(html, {q(H.IMG_ANY_QUOTE_RE)}, 1) AS l
             FROM {img_pages})))"""


def url_log() -> str:
    return ("(SELECT event_id, user_id, event_type, value, ts, "
            "'https://h' || CAST(user_id AS VARCHAR) || '.example.com/' || event_type AS url FROM events)")


def pre_sql(e: str) -> str:
    """T1 text preprocessing in DuckDB."""
    return (f"regexp_replace(regexp_replace(regexp_replace(translate({e}, '{UP}', '{LO}'), "
            f"'<[^>]*>', '', 'g'), '[^a-z0-9 \\t\\n\\x0B\\f\\r]', ' ', 'g'), "
            f"'[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')")
