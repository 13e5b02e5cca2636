"""Fetch-log predicates (F8-F13) over recorded status codes and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.urls import is_image_url

# The supported content types, exact match
SUPPORTED_CONTENT_TYPES = ["text/html", "text/plain", "application/xhtml+xml", "application/xml",
                           "text/xml", "application/rss+xml", "application/atom+xml",
                           "application/json", "application/javascript", "text/css"]
CONTENT_TYPE_RE = r"Content-Type:\s*([^\r\n]+)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_ok_status(status) -> Column:
    """F8: HTTP status 200."""
    return F.coalesce(_c(status) == 200, F.lit(False))


def header_content_type(headers) -> Column:
    """``Content-Type:`` value from raw response headers ("" if none)."""
    return F.regexp_extract(_c(headers), CONTENT_TYPE_RE, 1)


def accepts_body(url, content_type) -> Column:
    """keep a fetched body when its type contains ``text/html`` or the
    URL is an image URL."""
    return F.coalesce(_c(content_type).contains("text/html"), F.lit(False)) | is_image_url(url)


def is_supported_type(content_type) -> Column:
    """exact match against the supported list (parameters such as
    ``; charset=utf-8`` make it unsupported)."""
    return F.coalesce(_c(content_type).isin(*SUPPORTED_CONTENT_TYPES), F.lit(False))


def is_binary_type(content_type) -> Column:
    """none of ``text/``, ``application/json``, ``application/xml`` in it."""
    ct = F.coalesce(_c(content_type), F.lit(""))
    return ~(ct.contains("text/") | ct.contains("application/json") | ct.contains("application/xml"))


def should_follow(content_type, robots_allowed) -> Column:
    """follow a link when the content is not binary and robots allow it."""
    return ~is_binary_type(content_type) & _c(robots_allowed)
