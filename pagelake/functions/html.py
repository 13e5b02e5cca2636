"""HTML column helpers: link/image/title patterns and entity decoding."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Extraction patterns of the crawlers being reproduced
# ---------------------------------------------------------------------------
LINK_ANY_QUOTE_RE = r"""<a\s+[^>]*href=["']([^"']+)["'][^>]*>"""         # X1, X4
LINK_DOUBLE_QUOTE_RE = r"""<a[^>]+href="([^"]+)\""""                     # X2
LINK_ICASE_RE = r"""(?i)<a\s+(?:[^>]*?\s+)?href="([^"]*)\""""            # X3
WIKI_LINK_RE = r"""href="(/wiki/[^"#:]+)\""""                             # X5
WIKI_SKIPPED_NAMESPACES = ["/wiki/Special:", "/wiki/Help:", "/wiki/Talk:",
                           "/wiki/Wikipedia:", "/wiki/Template:", "/wiki/File:"]
WIKI_ORIGIN = "https://en.wikipedia.org"
IMG_ANY_QUOTE_RE = r"""<img\s+[^>]*src=["']([^"']+)["'][^>]*>"""         # X7
IMG_WITH_ALT_RE = (r"""<img\s+[^>]*src=["']([^"']+)["'][^>]*"""
                   r"""(?:alt=["']([^"']*)["'])?[^>]*>""")               # X8
TITLE_RE = r"<title>([^<]+)</title>"                                      # X10, X11, X13
TITLE_ICASE_RE = r"(?i)<title>([^<]*)</title>"                            # X12
CANONICAL_TAG_RE = r"""(?i)<link\b[^>]*\brel=["']?canonical["']?[^>]*>"""  # F22
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def attr(tag, name: str) -> Column:
    """Value of attribute ``name`` in an HTML tag string, in any quote style
    (double, single, bare); "" when absent.  Attribute names are
    case-insensitive, as in an HTML parser."""
    pat = (r"(?is)[\s<]" + name + r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
    t = _c(tag)
    return F.concat(F.regexp_extract(t, pat, 1), F.regexp_extract(t, pat, 2),
                    F.regexp_extract(t, pat, 3))


# One attribute: a name, perhaps with a value that is quoted or bare.  A quote that
# never closes begins no value, so the tag still ends at its ">".
_ATTR = r"""[^\s/>][^\s/=>]*+(?:\s*+=++\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+"""
_ATTRS = rf"(?:[\s/]++|{_ATTR})*+"
_NAME_END = r"(?=[\s/>])"
RAW_TEXT = ("script", "style")


def token_pattern(wanted: str) -> str:
    """Pattern of the tokens of a page, for one scan from left to right; group 1
    is what ``wanted`` matches where a tag may begin.

    Comments, declarations, script and style elements, and all other tags are
    tokens too, so nothing inside them is taken for a tag: neither a link in a
    comment or in a script's string, nor a ">" in a quoted value.  An unclosed comment,
    script or tag reaches to the end of the page.  Every repetition is possessive
    or lazy over single characters: no backtracking, no recursion, linear time."""
    raw = "|".join(rf"<{n}{_NAME_END}{_ATTRS}(?<!/)>.*?(?:</{n}{_NAME_END}|\z)" for n in RAW_TEXT)
    return (rf"(?is)<!--.*?(?:--\s*+>|\z)|<[!?][^>]*+(?:>|\z)|{raw}|({wanted})"
            rf"|</?[a-z][^\s/>]*+{_ATTRS}(?:>|\z)")


def _wanted(html, pattern: str) -> Column:
    return F.filter(F.regexp_extract_all(_c(html), F.lit(token_pattern(pattern)), F.lit(1)), lambda t: t != "")


def tags(html, name: str) -> Column:
    """Start tags of elements ``name`` of a page, as written, in document order."""
    return _wanted(html, rf"<{name}{_NAME_END}{_ATTRS}>")


def tag_attr(tag, name: str) -> Column:
    """Attribute ``name`` of a start tag, character references decoded: "" without
    a value, null if absent; of repeated attributes the last one counts."""
    body = F.regexp_replace(_c(tag), r"^<[^\s/>]++", "")
    own = F.filter(F.regexp_extract_all(body, F.lit(f"(?s){_ATTR}"), F.lit(0)), lambda a: a.rlike(rf"(?is)^{name}(?:\s*=|\z)"))
    value = F.regexp_replace(F.try_element_at(own, F.lit(-1)), r"(?s)^[^\s=]++(?:\s*+=++\s*+)?+", "")
    return decode_entities(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2"))


def element_text(html, name: str) -> Column:
    """Raw texts of the elements ``name`` of a page, from the start tag to the next
    end tag of that name or the end of the page."""
    start = rf"<{name}{_NAME_END}{_ATTRS}>"
    return F.transform(_wanted(html, rf"{start}.*?(?=</{name}{_NAME_END}|\z)"),
                       lambda t: F.regexp_replace(t, rf"(?is)^{start}", ""))


def canonical_link(html) -> Column:
    """the href of the first ``<link>`` whose rel holds "canonical"; null without one."""
    links = F.filter(tags(html, "link"), lambda t: F.array_contains(F.split(F.lower(F.coalesce(tag_attr(t, "rel"), F.lit(""))), r"\s+"), "canonical"))
    return F.nullif(tag_attr(F.try_element_at(links, F.lit(1)), "href"), F.lit(""))


ENTITY_RE = r"&(?:#[0-9]{1,9};?|#[xX][0-9a-fA-F]{1,8};?|[A-Za-z][A-Za-z0-9]*;?)"


def _entity_map() -> Column:
    """All named references of HTML 5 (with or without the closing semicolon,
    as the standard lists them), as one constant map."""
    from html.entities import html5
    return F.from_json(F.lit(json.dumps(html5)), "map<string,string>")


def decode_entities(x) -> Column:
    """Named, decimal and hexadecimal character references, each decoded once
    (``&amp;lt;`` and ``&#38;lt;`` become ``&lt;``).  As browsers do, codes 128
    to 159 are read as Windows-1252 and codes that are no character become
    U+FFFD; unknown names stay as they are."""
    s = _c(x)
    names = _entity_map()
    # fixed by rule: what Windows-1252 has at 128 to 159
    old = F.create_map(*[F.lit(v) for c in range(128, 160) for v in (c, bytes([c]).decode("cp1252", "ignore") or chr(c))])

    def decode_piece(p):
        dec = F.regexp_extract(p, r"^&#([0-9]{1,9});?$", 1)
        hx = F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]{1,8});?$", 1)
        code = F.when(dec != "", dec.try_cast("long")).when(hx != "", F.conv(hx, 16, 10).try_cast("long"))
        bad = (code == 0) | ((code >= 0xD800) & (code < 0xE000)) | (code > 0x10FFFF)
        char = (F.when(bad, F.lit("\ufffd")).when((code >= 128) & (code < 160), old[code.cast("int")])
                .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        return F.when(code.isNotNull(), char).otherwise(F.coalesce(names[F.substring(p, 2, 64)], p))

    found = F.transform(F.regexp_extract_all(s, F.lit(ENTITY_RE), F.lit(0)), decode_piece)
    joined = F.array_join(F.zip_with(F.split(s, ENTITY_RE, -1), found, lambda gap, e: F.concat(gap, F.coalesce(e, F.lit("")))), "")
    return F.when(s.contains("&"), joined).otherwise(s)


def first_title(html, pattern: str = TITLE_RE, default: str = "No title") -> Column:
    """First captured title; ``default`` when the pattern is absent.
    A matched-but-empty title (possible with X12's ``*``) stays ""."""
    h = _c(html)
    return F.when(h.rlike(pattern), F.regexp_extract(h, pattern, 1)).otherwise(F.lit(default))
