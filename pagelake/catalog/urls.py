"""URL queries over ``pages.url``."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.catalog import register
from pagelake.catalog._sql import discovered_images as DI
from pagelake.catalog._sql import (
    count_char, lower_ascii, pop_slash, q, search_domain, strict_host, strict_path,
    strict_scheme, strict_valid,
)
from pagelake.functions import urls as U
from pagelake.operators.url_profile import url_profile
from pagelake.session import table


def _profile(spark, sf_dir):
    return url_profile(table(spark, sf_dir, "pages").select("page_id", "url"))


# ---- A2 / A3: pages per domain, top 5 -------------------------------------

@register("top_domains", f"""
SELECT {search_domain('url')} AS domain, count(*) AS pages
FROM pages GROUP BY 1 ORDER BY pages DESC, domain LIMIT 5
""")
def top_domains(spark, sf_dir):
    """A3: top-5 domains by page count; ties broken by domain.  Partial
    aggregation map-side, then TakeOrderedAndProject (no global sort)."""
    return (_profile(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("pages"))
            .orderBy(F.desc("pages"), F.asc("domain")).limit(5))


@register("pages_per_domain", f"""
SELECT {search_domain('url')} AS domain, count(*) AS pages FROM pages GROUP BY 1
""")
def pages_per_domain(spark, sf_dir):
    """A2: pages per U3 domain."""
    return _profile(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("pages"))


# ---- U1 / U6 / U14 / U17 ---------------------------------------------------

@register("url_strict_parts", f"""
SELECT page_id, strict_scheme, strict_host, strict_path, strict_query, strict_fragment,
       strict_valid,
       CAST(CASE WHEN NOT strict_valid OR p2 = '' THEN 0
                 ELSE length(p2) - length(replace(p2, '/', '')) + 1 END AS BIGINT) AS strict_depth
FROM (
  SELECT *, CASE WHEN suffix(p1, '/') THEN substring(p1, 1, length(p1) - 1) ELSE p1 END AS p2
  FROM (
    SELECT page_id,
           {strict_scheme('url')} AS strict_scheme,
           {strict_host('url')} AS strict_host,
           {strict_path('url')} AS strict_path,
           regexp_extract(url, {q(U.STRICT_URL_RE)}, 4) AS strict_query,
           regexp_extract(url, {q(U.STRICT_URL_RE)}, 5) AS strict_fragment,
           {strict_valid('url')} AS strict_valid,
           regexp_replace({strict_path('url')}, '^/', '') AS p1
    FROM pages))
""")
def url_strict_parts(spark, sf_dir):
    return _profile(spark, sf_dir).select(
        "page_id", "strict_scheme", "strict_host", "strict_path", "strict_query",
        "strict_fragment", "strict_valid", F.col("strict_depth").cast("bigint").alias("strict_depth"))


# ---- U2 / U4 / U15 ----------------------------------------------------------

_LV = f"coalesce(regexp_matches(url, {q(U.LENIENT_URL_RE)}), false)"
_LS = f"regexp_extract(url, {q(U.LENIENT_URL_RE)}, 1)"
_LP = f"regexp_extract(url, {q(U.LENIENT_URL_RE)}, 4)"
_REST = "substring(url, instr(url, '://') + 3)"


@register("url_lenient_parts", f"""
SELECT page_id,
  CASE WHEN NOT {_LV} THEN '' WHEN {_LS} = '' THEN 'http'
       ELSE regexp_replace({_LS}, '://$', '') END AS lenient_scheme,
  regexp_extract(url, {q(U.LENIENT_URL_RE)}, 2) AS lenient_domain,
  CASE WHEN NOT {_LV} THEN '' WHEN {_LP} = '' THEN '/' ELSE {_LP} END AS lenient_path,
  {_LV} AS lenient_valid,
  CASE WHEN instr(url, '://') = 0 THEN ''
       WHEN contains({_REST}, '/') THEN split_part({_REST}, '/', 1)
       WHEN contains({_REST}, '?') THEN split_part({_REST}, '?', 1)
       WHEN contains({_REST}, '#') THEN split_part({_REST}, '#', 1)
       ELSE {_REST} END AS delimited_domain,
  coalesce(strlen(url) > 8 AND (prefix(url, 'http://') OR prefix(url, 'https://')), false)
    AS prefix_valid
FROM pages
""")
def url_lenient_parts(spark, sf_dir):
    return _profile(spark, sf_dir).select(
        "page_id", "lenient_scheme", "lenient_domain", "lenient_path", "lenient_valid",
        "delimited_domain", "prefix_valid")


# ---- U3 / U5 / U7 / U8 / U9 / U16 / U18 ------------------------------------

_D = search_domain("url")


@register("url_forms", f"""
SELECT page_id,
  {_D} AS domain,
  regexp_extract(url, {q(U.NETLOC_RE)}, 1) AS netloc,
  split_part({pop_slash(lower_ascii('url'))}, '#', 1) AS norm_a,
  {pop_slash("split_part(url, '#', 1)")} AS norm_b,
  {pop_slash(lower_ascii('url'), 2)} AS norm_c,
  coalesce(regexp_matches(url, {q(U.VALID_C_RE)}), false) AS pattern_valid,
  CAST(CASE WHEN {_D} = '' OR instr(url, {_D}) = 0 THEN 0
       ELSE {count_char(f"substring(url, instr(url, {_D}) + length({_D}))", '/')} END AS BIGINT)
    AS slash_depth
FROM pages
""")
def url_forms(spark, sf_dir):
    return _profile(spark, sf_dir).select(
        "page_id", "domain", "netloc", "norm_a", "norm_b", "norm_c", "pattern_valid",
        F.col("slash_depth").cast("bigint").alias("slash_depth"))


# ---- U21 / U22 / U23 roll-ups ------------------------------------------------

@register("site_class_counts", f"""
SELECT CASE WHEN contains(d, 'wikipedia.org') THEN 'wikipedia'
            WHEN contains(d, 'github.com') THEN 'github'
            WHEN contains(d, 'stackoverflow.com') THEN 'stackoverflow'
            ELSE 'other' END AS site_class,
       count(*) AS pages, count(DISTINCT d) AS domains
FROM (SELECT {_D} AS d FROM pages) GROUP BY 1
""")
def site_class_counts(spark, sf_dir):
    """Pages and hosts per site class."""
    return (_profile(spark, sf_dir).groupBy("site_class")
            .agg(F.count("*").alias("pages"), F.countDistinct("domain").alias("domains")))


@register("base_domain_rollup", f"""
SELECT CASE WHEN prefix(d, 'www.') THEN substring(d, 5)
            WHEN contains(d, '.') THEN substring(d, instr(d, '.') + 1)
            ELSE d END AS base_domain,
       count(*) AS pages, count(DISTINCT d) AS hosts
FROM (SELECT {_D} AS d FROM pages) GROUP BY 1
""")
def base_domain_rollup(spark, sf_dir):
    """Pages and distinct hosts per base domain."""
    return (_profile(spark, sf_dir).groupBy("base_domain")
            .agg(F.count("*").alias("pages"), F.countDistinct("domain").alias("hosts")))


@register("wiki_language_counts", f"""
SELECT CASE WHEN split_part(d, '.', 1) IN ('www', 'wikipedia') THEN 'en'
            ELSE split_part(d, '.', 1) END AS wiki_lang,
       count(*) AS pages
FROM (SELECT {_D} AS d FROM pages) GROUP BY 1
""")
def wiki_language_counts(spark, sf_dir):
    """Language code of the first host label."""
    return _profile(spark, sf_dir).groupBy("wiki_lang").agg(F.count("*").alias("pages"))


_IMG_A = q(U.IMAGE_EXT_A_RE)
_IMG_B = q(U.IMAGE_EXT_B_RE)


@register("image_extensions", f"""
SELECT image_url,
  CASE WHEN regexp_extract(image_url, {_IMG_A}, 1) = '' THEN 'jpg' ELSE regexp_extract(image_url, {_IMG_A}, 1) END
    AS ext_any,
  CASE WHEN regexp_extract(image_url, {_IMG_B}, 1) = '' THEN '.jpg' ELSE '.' || regexp_extract(image_url, {_IMG_B}, 1) END
    AS ext_known,
  coalesce(regexp_matches({lower_ascii('image_url')}, '\\.(jpg|jpeg|png|gif|bmp|webp|svg)\\z'), false) AS is_image
FROM (SELECT DISTINCT image_url FROM {DI()}
      UNION SELECT url FROM pages)
""")
def image_extensions(spark, sf_dir):
    """U19/U20/F4 over every image URL discovered plus every page URL."""
    from pagelake.plans import fixtures as FX
    urls = (FX.discovered_images(spark, sf_dir).select("image_url").distinct()
            .union(table(spark, sf_dir, "pages").select(F.col("url").alias("image_url"))).distinct())
    return urls.select("image_url", U.image_extension_any("image_url").alias("ext_any"),
                       U.image_extension_known("image_url").alias("ext_known"),
                       U.is_image_url("image_url").alias("is_image"))


@register("title_word_lists", """
SELECT item_id, CAST(len(items) AS BIGINT) AS n_items, array_to_string(items, ',') AS rejoined FROM (
  SELECT item_id, list_filter(list_transform(string_split(text, ','),
                   lambda s: regexp_replace(s, '^[ \\t]+|[ \\t]+$', '', 'g')), lambda s: s <> '') AS items
  FROM benchmark)
""")
def title_word_lists(spark, sf_dir):
    """Comma-separated lists parsed (trimmed, empties dropped) and
    joined back, over every benchmark text."""
    b = table(spark, sf_dir, "benchmark").select("item_id", U.split_list("text").alias("items"))
    return b.select("item_id", F.size("items").cast("bigint").alias("n_items"),
                    U.join_list("items").alias("rejoined"))
