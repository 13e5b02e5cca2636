"""URL profile job: every URL component/normal form/validity as columns.

One narrow projection over a URL column (no shuffle).  Callers select the
columns they need; Catalyst prunes the rest, so an unused variant costs
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import urls as U


def url_profile(df: DataFrame, url_col: str = "url") -> DataFrame:
    u = F.col(url_col)
    return df.select(
        "*",
        # U1 / U6 / U14 / U17 strict parser
        U.strict_scheme(u).alias("strict_scheme"),
        U.strict_host(u).alias("strict_host"),
        U.strict_path(u).alias("strict_path"),
        U.strict_query(u).alias("strict_query"),
        U.strict_fragment(u).alias("strict_fragment"),
        U.strict_valid(u).alias("strict_valid"),
        U.strict_depth(u).alias("strict_depth"),
        # U2 / U4 / U15 lenient parser
        U.lenient_scheme(u).alias("lenient_scheme"),
        U.lenient_domain(u).alias("lenient_domain"),
        U.lenient_path(u).alias("lenient_path"),
        U.lenient_valid(u).alias("lenient_valid"),
        U.delimited_domain(u).alias("delimited_domain"),
        U.prefix_valid(u).alias("prefix_valid"),
        # U3 / U5 domains
        U.search_domain(u).alias("domain"),
        U.netloc(u).alias("netloc"),
        # U7 / U8 / U9 normal forms
        U.normalize_lower_slash_fragment(u).alias("norm_a"),
        U.normalize_fragment_slash(u).alias("norm_b"),
        U.normalize_lower_slash(u).alias("norm_c"),
        # U16 / U18
        U.pattern_valid(u).alias("pattern_valid"),
        U.slash_depth(u).alias("slash_depth"),
        # U19 / U20 extensions; F4 / F5 / F6 predicates
        U.image_extension_any(u).alias("ext_any"),
        U.image_extension_known(u).alias("ext_known"),
        U.is_image_url(u).alias("is_image"),
        U.has_excluded_extension(u).alias("excluded_ext"),
        U.is_webpage_url(u).alias("is_webpage"),
    ).withColumns({
        # U21 / U22 / U23 on the search domain
        "site_class": U.site_class(F.col("domain")),
        "base_domain": U.base_domain(F.col("domain")),
        "wiki_lang": U.wiki_language(F.col("domain")),
    })
