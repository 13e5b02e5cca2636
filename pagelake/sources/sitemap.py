"""Sitemap XML (S14, B3): per-host sitemap documents and their parse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SITEMAP_SCHEMA = ("url ARRAY<STRUCT<loc: STRING, lastmod: STRING, changefreq: STRING, "
                  "priority: DOUBLE>>")
MAX_URLS_PER_SITEMAP = 50_000  # protocol limit per sitemap file


def _xml_escape(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def build_sitemaps(entries: DataFrame) -> DataFrame:
    """``entries(domain, loc, lastmod, changefreq, priority)`` -> one XML
    document per (domain, chunk).  Chunks hold at most the protocol's URL
    limit (hash-spread), so no host's document grows with the data."""
    counts = entries.groupBy("domain").agg(F.count("*").alias("__n"))
    e = entries.join(counts, "domain").withColumn(
        "chunk", F.pmod(F.xxhash64("loc"), F.ceil(F.col("__n") / MAX_URLS_PER_SITEMAP)))
    item = F.concat(F.lit("<url><loc>"), _xml_escape(F.col("loc")), F.lit("</loc><lastmod>"), F.col("lastmod"),
                    F.lit("</lastmod><changefreq>"), F.col("changefreq"), F.lit("</changefreq><priority>"),
                    F.format_string("%.1f", F.col("priority")), F.lit("</priority></url>"))
    docs = e.groupBy("domain", "chunk").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return docs.select("domain", "chunk", F.concat(
        F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
        F.array_join("items", ""), F.lit("</urlset>")).alias("xml"))


def parse_sitemaps(docs: DataFrame) -> DataFrame:
    """Parse each document with ``from_xml`` and explode its entries;
    B3: the union over all domains is the exploded table itself."""
    parsed = docs.select("domain", F.from_xml("xml", SITEMAP_SCHEMA).alias("s"))
    return parsed.select("domain", F.explode("s.url").alias("u")).select(
        "domain", F.col("u.loc").alias("loc"), F.to_timestamp("u.lastmod").alias("last_modified"),
        F.col("u.priority").cast("float").alias("priority"), F.col("u.changefreq").alias("change_frequency"))
