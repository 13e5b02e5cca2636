"""URL column helpers: components, normalisation, resolution, validity, depth.

Every helper maps ``Column -> Column`` with built-in Spark expressions, so it
stays inside whole-stage codegen and filters built on it push below joins and
explodes.  Several variants exist because the crawlers this engine replaces
disagree; each variant keeps its source behaviour, quirks included, and the
docstring states the quirk.

Java regex ``$`` also matches before a final line terminator, so the strict
full-match patterns here end in ``\\z`` to mean "end of input" exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the crawler behaviour being reproduced)
# ---------------------------------------------------------------------------
STRICT_URL_RE = r"^(https?)://([^/\s]+)(/[^\s]*)?(\?[^\s#]*)?(#[^\s]*)?\z"
LENIENT_URL_RE = r"^(https?://)?([^/:]+)(:[0-9]+)?(/.*)?\z"
DOMAIN_SEARCH_RE = r"https?://([^/]+)"
VALID_C_RE = r"^https?://[^\s/$.?#].[^\s]*\z"
IMAGE_EXT_A_RE = r"\.([^./?]+)(?:[?#].*)?\z"
IMAGE_EXT_B_RE = r"\.(jpg|jpeg|png|gif|bmp|webp)(\z|\?.*\z)"
NETLOC_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
URLPARSE_PATH_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"

IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".svg"]
EXCLUDED_EXTENSIONS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar",
                       ".exe", ".mp3", ".mp4", ".avi"]
NON_PAGE_EXTENSIONS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
                       ".zip", ".rar", ".tar", ".gz", ".jpg", ".jpeg", ".png",
                       ".gif", ".mp3", ".mp4", ".avi", ".mov"]
SITE_CLASSES = [("wikipedia.org", "wikipedia"), ("github.com", "github"),
                ("stackoverflow.com", "stackoverflow")]
# ---------------------------------------------------------------------------

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(x) -> Column:
    """C ``tolower`` semantics: only A-Z change (``lower`` is Unicode)."""
    return F.translate(_c(x), _UPPER, _LOWER)


def pop_trailing_slash(x, min_len: int = 1) -> Column:
    """Remove exactly one trailing ``/`` when the string is at least min_len long."""
    x = _c(x)
    return F.when(x.endswith("/") & (F.length(x) >= min_len),
                  x.substr(F.lit(1), F.length(x) - 1)).otherwise(x)


def cut_at(x, ch: str) -> Column:
    """Everything before the first ``ch`` (whole string when absent)."""
    return F.substring_index(_c(x), ch, 1)


def count_char(x, ch: str) -> Column:
    x = _c(x)
    return F.length(x) - F.length(F.replace(x, F.lit(ch), F.lit("")))


# --- U1 / U6 / U14 / U17: strict parser -----------------------------------

def strict_valid(url) -> Column:
    """Full match of the strict URL pattern."""
    return F.coalesce(_c(url).rlike(STRICT_URL_RE), F.lit(False))


def strict_scheme(url) -> Column:
    return F.regexp_extract(_c(url), STRICT_URL_RE, 1)


def strict_host(url) -> Column:
    """Host; keeps port and userinfo, and ``?x#y`` when there is no path.
    "" for an invalid URL."""
    return F.regexp_extract(_c(url), STRICT_URL_RE, 2)


def strict_path(url) -> Column:
    """Greedy non-space path, so query and fragment stay inside it;
    ``/`` when absent, "" for an invalid URL."""
    url = _c(url)
    p = F.regexp_extract(url, STRICT_URL_RE, 3)
    return F.when(~strict_valid(url), F.lit("")).when(p == "", F.lit("/")).otherwise(p)


def strict_query(url) -> Column:
    """U1 quirk: always "" (the greedy path group swallows it)."""
    return F.regexp_extract(_c(url), STRICT_URL_RE, 4)


def strict_fragment(url) -> Column:
    return F.regexp_extract(_c(url), STRICT_URL_RE, 5)


def strict_depth(url) -> Column:
    """Number of path segments after one leading and one trailing ``/``
    are dropped; empty inner segments count; 0 when invalid."""
    url = _c(url)
    p = strict_path(url)
    p = F.regexp_replace(p, r"^/", "")
    p = F.when(p.endswith("/"), p.substr(F.lit(1), F.length(p) - 1)).otherwise(p)
    return (F.when(~strict_valid(url) | (p == ""), F.lit(0))
            .otherwise(count_char(p, "/") + 1)).cast("int")


# --- U2 / U15: lenient parser ---------------------------------------------

def lenient_valid(url) -> Column:
    return F.coalesce(_c(url).rlike(LENIENT_URL_RE), F.lit(False))


def lenient_scheme(url) -> Column:
    """Scheme without ``://``; ``http`` when absent."""
    url = _c(url)
    s = F.regexp_extract(url, LENIENT_URL_RE, 1)
    return (F.when(~lenient_valid(url), F.lit(""))
            .when(s == "", F.lit("http")).otherwise(F.regexp_replace(s, "://$", "")))


def lenient_domain(url) -> Column:
    """Domain with the port dropped."""
    return F.regexp_extract(_c(url), LENIENT_URL_RE, 2)


def lenient_path(url) -> Column:
    url = _c(url)
    p = F.regexp_extract(url, LENIENT_URL_RE, 4)
    return F.when(~lenient_valid(url), F.lit("")).when(p == "", F.lit("/")).otherwise(p)


def prefix_valid(url) -> Column:
    """Byte length > 8 and an http(s) prefix (so ``http://a`` fails)."""
    url = _c(url)
    return F.coalesce((F.octet_length(url) > 8)
                      & (url.startswith("http://") | url.startswith("https://")), F.lit(False))


# --- U3 / U4 / U5: domain extraction ---------------------------------------

def search_domain(url) -> Column:
    """``https?://([^/]+)`` searched anywhere; "" when absent."""
    return F.regexp_extract(_c(url), DOMAIN_SEARCH_RE, 1)


def delimited_domain(url) -> Column:
    """U4: text after the first ``://`` up to the first ``/``; only when there
    is no ``/``, up to the first ``?``, else the first ``#``, else the end."""
    url = _c(url)
    pos = F.instr(url, "://")
    rest = url.substr(pos + 3, F.lit(1 << 30))
    return (F.when(pos == 0, F.lit(""))
            .when(rest.contains("/"), F.substring_index(rest, "/", 1))
            .when(rest.contains("?"), F.substring_index(rest, "?", 1))
            .when(rest.contains("#"), F.substring_index(rest, "#", 1))
            .otherwise(rest))


def netloc(url) -> Column:
    """Network location as ``urllib.parse.urlparse`` gives it (keeps port
    and userinfo); "" when the URL has no ``//`` authority."""
    return F.regexp_extract(_c(url), NETLOC_RE, 1)


def urlparse_path(url) -> Column:
    """Path as ``urlparse`` gives it: after the authority, before ``?``/``#``,
    with ``;params`` of the last segment removed."""
    p = F.regexp_extract(_c(url), URLPARSE_PATH_RE, 1)
    return F.when(p.rlike(";[^/]*$"), F.substring_index(p, ";", 1)).otherwise(p)


# --- U7 / U8 / U9: normalisation ------------------------------------------

def normalize_lower_slash_fragment(url) -> Column:
    """ASCII-lowercase, pop one trailing ``/``, then cut at ``#``
    (in that order, so ``/b/#t`` keeps its slash)."""
    return cut_at(pop_trailing_slash(ascii_lower(url)), "#")


def normalize_fragment_slash(url) -> Column:
    """U8: cut at ``#``, then pop one trailing ``/``; case kept."""
    return pop_trailing_slash(cut_at(url, "#"))


def normalize_lower_slash(url) -> Column:
    """ASCII-lowercase, pop a trailing ``/`` when longer than 1; fragment kept."""
    return pop_trailing_slash(ascii_lower(url), min_len=2)


# --- U10 / U11 / U12: link resolution --------------------------------------

def _is_absolute_http(x: Column) -> Column:
    return x.startswith("http://") | x.startswith("https://")


def resolve_strict(base, rel) -> Column:
    """Absolute http(s) kept; leading ``/`` -> scheme://host + link;
    otherwise the base path up to its last ``/`` + link.  No ``..``/``//``
    handling.  The base is taken apart with the strict parser."""
    base, rel = _c(base), _c(rel)
    origin = F.concat(strict_scheme(base), F.lit("://"), strict_host(base))
    path = strict_path(base)
    dir_ = F.regexp_extract(path, r"^(.*/)", 1)
    dir_ = F.when(dir_ == "", F.lit("/")).otherwise(dir_)
    return (F.when(_is_absolute_http(rel), rel)
            .when(rel.startswith("/"), F.concat(origin, rel))
            .otherwise(F.concat(origin, dir_, rel)))


def _origin_prefix(base: Column) -> tuple[Column, Column]:
    """(has '://' flag, prefix up to but excluding the first '/' after it or null)."""
    sep = F.instr(base, "://")
    after = base.substr(sep + 3, F.lit(1 << 30))
    slash_in_after = F.instr(after, "/")
    prefix = F.when(slash_in_after > 0,
                    base.substr(F.lit(1), sep + 1 + slash_in_after))
    return sep > 0, prefix


def resolve_append(base, rel) -> Column:
    """``http`` prefix kept; leading ``/`` -> base up to the first ``/``
    after the scheme (whole base when it has none); otherwise base + ``/`` +
    link (the last segment is **not** dropped)."""
    base, rel = _c(base), _c(rel)
    has_sep, prefix = _origin_prefix(base)
    rooted = (F.when(~has_sep, rel)
              .when(prefix.isNotNull(), F.concat(prefix, rel))
              .otherwise(F.concat(base, rel)))
    relative = F.when(base.endswith("/"), F.concat(base, rel)).otherwise(F.concat(base, F.lit("/"), rel))
    return (F.when(rel.startswith("http"), rel)
            .when(rel.startswith("/"), rooted)
            .otherwise(relative))


def resolve_dirname(base, rel) -> Column:
    """``http`` prefix kept; leading ``/`` as U11 but left unresolved when
    the base has no path; otherwise base up to its last ``/`` + link."""
    base, rel = _c(base), _c(rel)
    has_sep, prefix = _origin_prefix(base)
    rooted = F.when(has_sep & prefix.isNotNull(), F.concat(prefix, rel)).otherwise(rel)
    dir_ = F.regexp_extract(base, r"^(.*/)", 1)
    relative = F.when(dir_ != "", F.concat(dir_, rel)).otherwise(rel)
    return (F.when(rel.startswith("http"), rel)
            .when(rel.startswith("/"), rooted)
            .otherwise(relative))


# --- U16 / U18: validity C and slash depth ---------------------------------

def pattern_valid(url) -> Column:
    """U16: ``^https?://[^\\s/$.?#].[^\\s]*$``."""
    return F.coalesce(_c(url).rlike(VALID_C_RE), F.lit(False))


def slash_depth(url) -> Column:
    """``/`` count after the first occurrence of the U3 domain text in
    the URL (a host ``h`` is found inside ``http``: ``http://h`` gives 2)."""
    url = _c(url)
    d = search_domain(url)
    pos = F.instr(url, d)
    rest = url.substr(pos + F.length(d), F.lit(1 << 30))
    return F.when((d == "") | (pos == 0), F.lit(0)).otherwise(count_char(rest, "/")).cast("int")


# --- U19 / U20: image extensions -------------------------------------------

def image_extension_any(url) -> Column:
    """Last ``.ext`` before an optional ``?``/``#`` tail; ``jpg`` when none
    (a bare host yields its TLD)."""
    e = F.regexp_extract(_c(url), IMAGE_EXT_A_RE, 1)
    return F.when(e == "", F.lit("jpg")).otherwise(e)


def image_extension_known(url) -> Column:
    """One of six image extensions at the end or before ``?``, with the
    dot; ``.jpg`` by default; case-sensitive."""
    e = F.regexp_extract(_c(url), IMAGE_EXT_B_RE, 1)
    return F.when(e == "", F.lit(".jpg")).otherwise(F.concat(F.lit("."), e))


# --- U21 / U22 / U23: host classes -----------------------------------------

def site_class(domain) -> Column:
    """First matching domain substring class, else ``other``."""
    d = _c(domain)
    out = None
    for needle, name in SITE_CLASSES:
        out = (F.when(d.contains(needle), F.lit(name)) if out is None
               else out.when(d.contains(needle), F.lit(name)))
    return out.otherwise(F.lit("other"))


def base_domain(domain) -> Column:
    """Strip a leading ``www.``, else drop the first label; a domain
    without a dot is kept whole."""
    d = _c(domain)
    return (F.when(d.startswith("www."), d.substr(F.lit(5), F.lit(1 << 30)))
            .when(d.contains("."), d.substr(F.instr(d, ".") + 1, F.lit(1 << 30)))
            .otherwise(d))


def wiki_language(domain) -> Column:
    """First label; ``www`` and ``wikipedia`` mean ``en``."""
    first = F.substring_index(_c(domain), ".", 1)
    return F.when(first.isin("www", "wikipedia"), F.lit("en")).otherwise(first)


# --- U24 / U25: list strings ----------------------------------------------

def split_list(x, sep: str = ",", keep_empty: bool = False) -> Column:
    """Split on ``sep``; trim spaces/tabs and drop empties unless
    ``keep_empty`` (then items are kept verbatim, like a plain getline split;
    a trailing separator does not create a last empty item)."""
    parts = F.split(_c(x), _regex_escape(sep), -1)
    if keep_empty:
        return F.when(_c(x).endswith(sep), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    trimmed = F.transform(parts, lambda s: F.regexp_replace(s, r"^[ \t]+|[ \t]+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def join_list(arr, sep: str = ",") -> Column:
    """Array to a ``sep``-joined string."""
    return F.array_join(_c(arr), sep)


def _regex_escape(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\\" else ch for ch in s)


# --- F4 / F5 / F6 / F7: URL predicates --------------------------------------

def _endswith_any(x: Column, exts: list[str]) -> Column:
    cond = None
    for e in exts:
        c = x.endswith(e)
        cond = c if cond is None else (cond | c)
    return cond


def _suffix_re(exts: list[str]) -> str:
    return r"\.(" + "|".join(e.lstrip(".") for e in exts) + r")\z"


def is_image_url(url) -> Column:
    """ASCII-lowercased URL ends with an image extension (a query string
    defeats it)."""
    return F.coalesce(ascii_lower(url).rlike(_suffix_re(IMAGE_EXTENSIONS)), F.lit(False))


def has_excluded_extension(url) -> Column:
    """URL ends with an excluded extension and is longer than it; case-sensitive."""
    url = _c(url)
    cond = None
    for e in EXCLUDED_EXTENSIONS:
        c = url.endswith(e) & (F.length(url) > len(e))
        cond = c if cond is None else (cond | c)
    return F.coalesce(cond, F.lit(False))


def is_webpage_url(url) -> Column:
    """lowercased URL path (``;params`` of the last segment excluded)
    does not end in a download extension.  One reference to ``url`` so the
    predicate stays small when a filter is pushed through projections."""
    pat = r"\.(" + "|".join(e.lstrip(".") for e in NON_PAGE_EXTENSIONS) + r")(;[^/]*)?\z"
    path = F.regexp_extract(_c(url), URLPARSE_PATH_RE, 1)
    return ~F.coalesce(F.lower(path).rlike(pat), F.lit(False))


def is_followable_href(href) -> Column:
    """skip in-page anchors and ``javascript:`` links."""
    h = _c(href)
    return ~(h.startswith("#") | h.startswith("javascript:"))
