"""Crawl plan over a fetched-page snapshot.

The snapshot ``pages(url, html)`` stands for the fetch results: a URL with a
row was fetched, any other URL is a failed fetch and stays a leaf.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import urls as U
from pagelake.operators.extract import image_refs, link_edges
from pagelake.operators.tables import with_global_rank
from pagelake.plans.graph import bfs
from pagelake.session import bounded_broadcast

DOMAIN_RULES = ("exact", "suffix", "substring")


def host_suffixes(host) -> "F.Column":
    """All dot-suffixes of a host: a.b.c -> [a.b.c, b.c, c]."""
    from pagelake.functions.rfc import let
    return let(F.split(host, r"\."), lambda parts: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def domain_filter(df: DataFrame, url_col: str, allowed: DataFrame | list[str] | None,
                  rule: str = "suffix") -> DataFrame:
    """Keep rows whose URL host passes an allowed-domain rule table.

    * exact (F1): host equals an allowed domain: broadcast equi semi join.
    * suffix (F2): host equals one or ends with ``.domain``: the host's
      dot-suffixes are exploded and equi-joined, so it scales with long lists
      (no nested-loop join).
    * substring (F3): domain text anywhere in the host: the distinct hosts'
      substrings of the rules' lengths equi-join the rules, then the rows
      equi-semi-join the matching hosts.
    An empty or missing list allows everything.
    """
    if allowed is None:
        return df
    spark = df.sparkSession
    if isinstance(allowed, list):
        if not allowed:
            return df
        allowed = spark.createDataFrame([(d,) for d in allowed], "allowed string")
    else:
        allowed = allowed.toDF("allowed")
    host = U.search_domain(F.col(url_col))
    if rule == "exact":
        return df.join(bounded_broadcast(allowed), host == F.col("allowed"), "left_semi")
    if rule == "suffix":
        # match the distinct hosts (far fewer than rows) by their exploded
        # dot-suffixes, then equi-semi-join the rows on the host
        hosts = df.select(host.alias("__host")).distinct()
        ok_hosts = (hosts.withColumn("__sfx", F.explode(host_suffixes(F.col("__host"))))
                    .join(bounded_broadcast(allowed), F.col("__sfx") == F.col("allowed"), "left_semi")
                    .select("__host").distinct())
        return df.join(bounded_broadcast(ok_hosts), host == F.col("__host"), "left_semi")
    if rule == "substring":
        from pagelake.operators.features import contained
        hosts = df.select(host.alias("token")).distinct()
        ok_hosts = contained(hosts, allowed.select(F.col("allowed").alias("w"))).select(F.col("token").alias("__host")).distinct()
        return df.join(bounded_broadcast(ok_hosts), host == F.col("__host"), "left_semi")
    raise ValueError(f"rule must be one of {DOMAIN_RULES}")


def crawl_edges(pages: DataFrame, allowed=None, rule: str = "suffix", variant: str = "strict") -> DataFrame:
    """Page -> resolved link target edges that pass the domain rule."""
    e = link_edges(pages, variant).select(F.col("url").alias("src"), F.col("target").alias("dst"))
    return domain_filter(e.distinct(), "dst", allowed, rule)


def crawl_plan(pages: DataFrame, seeds: DataFrame, allowed=None, max_depth: int = 3,
               budget: int | None = None, rule: str = "suffix", images_from: DataFrame | None = None) -> DataFrame:
    """G4 (+G5 when ``images_from`` is given): breadth-first crawl plan.

    Returns ``(url, depth, fetched, kind)``.  Image targets of
    ``images_from`` are scheduled at depth+1 without the domain rule and are
    leaves (G5).
    """
    edges = crawl_edges(pages, allowed, rule)
    if images_from is not None:
        img = image_refs(images_from, "strict").select(F.col("url").alias("src"), F.col("target").alias("dst"))
        edges = edges.unionByName(img.distinct())
    fetched = pages.select(F.col("url").alias("node")).distinct()
    plan = bfs(edges, seeds, max_depth, expandable=fetched, budget=budget)
    plan = plan.join(fetched.withColumn("fetched", F.lit(True)), "node", "left")
    return plan.select(F.col("node").alias("url"), "depth",
                       F.coalesce(F.col("fetched"), F.lit(False)).alias("fetched"),
                       F.when(U.is_image_url(F.col("node")), F.lit("image")).otherwise(F.lit("page")).alias("kind"))


def crawl_report(plan: DataFrame) -> DataFrame:
    """URL, domain, depth and discovery order (level order, then URL)."""
    ranked = with_global_rank(plan.select("url", "depth"), ["depth", "url"], "discovered")
    return ranked.select("url", U.search_domain(F.col("url")).alias("domain"),
                         F.col("depth").cast("bigint").alias("depth"), F.col("discovered").cast("bigint"))
