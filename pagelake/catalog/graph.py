"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.catalog import register
from pagelake.catalog._sql import q, search_domain
from pagelake.catalog.extraction import _resolve_strict_sql
from pagelake.functions import html as H
from pagelake.plans import crawl
from pagelake.plans.graph import bfs, host_word_edges
from pagelake.session import cut_lineage, table

MAX_DEPTH = 6
CRAWL_ALLOWED = ["example.com", "example.org"]
CRAWL_DEPTH = 3


def _links_sql() -> str:
    return (f"SELECT {search_domain('url')} AS domain, "
            f"unnest(regexp_extract_all(html, {q(H.LINK_ANY_QUOTE_RE)}, 1)) AS href FROM pages")


def _host_word_levels_sql(max_depth: int, paths: bool) -> str:
    """Oracle: BFS levels unrolled for a fixed depth (exact, no recursion)."""
    ctes = [
        f"links AS ({_links_sql()})",
        "e AS (SELECT DISTINCT domain AS src, href AS dst FROM links "
        "UNION SELECT DISTINCT href AS src, domain AS dst FROM links)",
        f"l0 AS (SELECT min({search_domain('url')}) AS node, CAST(1 AS BIGINT) AS paths FROM pages)",
        "v0 AS (SELECT node FROM l0)",
    ]
    for d in range(1, max_depth + 1):
        ctes.append(
            f"l{d} AS (SELECT e.dst AS node, CAST(sum(l.paths) AS BIGINT) AS paths "
            f"FROM l{d-1} l JOIN e ON e.src = l.node "
            f"WHERE NOT EXISTS (SELECT 1 FROM v{d-1} v WHERE v.node = e.dst) GROUP BY e.dst)")
        ctes.append(f"v{d} AS (SELECT node FROM v{d-1} UNION ALL SELECT node FROM l{d})")
    cols = "node, CAST({d} AS BIGINT) AS depth" + (", paths" if paths else "")
    body = " UNION ALL ".join(f"SELECT {cols.format(d=d)} FROM l{d}" for d in range(max_depth + 1))
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _host_word_graph(spark, sf_dir):
    from pagelake.functions import urls as U
    from pagelake.operators.extract import link_edges
    pages = table(spark, sf_dir, "pages")
    links = link_edges(pages, "strict").select(U.search_domain("url").alias("domain"), "href")
    seed = pages.select(F.min(U.search_domain("url")).alias("node"))
    return host_word_edges(links), seed


@register("bfs_host_word", _host_word_levels_sql(MAX_DEPTH, paths=False))
def bfs_host_word(spark, sf_dir):
    """Every node once at its minimum depth (<= MAX_DEPTH)."""
    edges, seed = _host_word_graph(spark, sf_dir)
    out = bfs(edges, seed, MAX_DEPTH)
    return out.select("node", F.col("depth").cast("bigint").alias("depth"))


@register("bfs_incremental", _host_word_levels_sql(MAX_DEPTH, paths=False))
def bfs_incremental(spark, sf_dir):
    """G1/G4 kept up to date: the first third of the pages gives the plan, two more
    batches of pages change it from their new edges only."""
    from pagelake.functions import urls as U
    from pagelake.operators.extract import link_edges
    from pagelake.plans.graph import bfs_update
    pages = table(spark, sf_dir, "pages")
    seed = pages.select(F.min(U.search_domain("url")).alias("node"))
    links = link_edges(pages, "strict").select("page_id", U.search_domain("url").alias("domain"), "href")
    batch = lambda keep: cut_lineage(host_word_edges(links.where(keep)))
    edges = batch("page_id % 3 = 0")
    plan = bfs(edges, seed, MAX_DEPTH)
    for i in (1, 2):
        new = batch(f"page_id % 3 = {i}")
        edges = edges.unionByName(new)
        plan = cut_lineage(bfs_update(plan, edges, new, MAX_DEPTH))
    return plan.select("node", F.col("depth").cast("bigint").alias("depth"))


@register("bfs_path_counts", _host_word_levels_sql(MAX_DEPTH, paths=True))
def bfs_path_counts(spark, sf_dir):
    """Level-synchronous crawl that de-duplicates only against earlier
    levels, carried as a per-node count (number of shortest paths)."""
    edges, seed = _host_word_graph(spark, sf_dir)
    out = bfs(edges, seed, MAX_DEPTH, count_paths=True)
    return out.select("node", F.col("depth").cast("bigint").alias("depth"), "paths")


# ---- crawl plan over the real URL graph ------------------------------------

def _crawl_sql(budget: str | None = None) -> str:
    """Oracle: ``plan`` (node, depth) level by level; ``budget`` is SQL for the
    most nodes that are accepted, in order of level and node."""
    allowed = ", ".join(q(d) for d in CRAWL_ALLOWED)
    cut = "" if budget is None else f" ORDER BY node LIMIT greatest(({budget}) - (SELECT count(*) FROM v0), 0)"
    cut2 = "" if budget is None else f" ORDER BY node LIMIT greatest(({budget}) - (SELECT count(*) FROM v1), 0)"
    seed = "" if budget is None else f" ORDER BY node LIMIT ({budget})"
    return f"""
WITH pg AS (SELECT DISTINCT url FROM pages),
links AS (
  SELECT url AS src, {_resolve_strict_sql('href')} AS dst
  FROM (SELECT url, unnest(regexp_extract_all(html, {q(H.LINK_ANY_QUOTE_RE)}, 1)) AS href FROM pages)),
ok AS (SELECT DISTINCT src, dst FROM links, (SELECT unnest([{allowed}]) AS d) r
       WHERE {search_domain('dst')} = r.d OR suffix({search_domain('dst')}, '.' || r.d)),
v0 AS (SELECT url AS node FROM pg{seed}),
l1 AS (SELECT DISTINCT ok.dst AS node FROM v0 JOIN pg ON pg.url = v0.node JOIN ok ON ok.src = v0.node
       WHERE ok.dst NOT IN (SELECT node FROM v0){cut}),
v1 AS (SELECT node FROM v0 UNION ALL SELECT node FROM l1),
l2 AS (SELECT DISTINCT ok.dst AS node FROM l1 JOIN pg ON pg.url = l1.node JOIN ok ON ok.src = l1.node
       WHERE ok.dst NOT IN (SELECT node FROM v1){cut2}),
plan AS (SELECT node, 0 AS depth FROM v0 UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2)
"""


_PLAN_SQL = """SELECT node AS url, CAST(depth AS BIGINT) AS depth,
       EXISTS (SELECT 1 FROM pg WHERE pg.url = plan.node) AS fetched FROM plan"""


def _page_crawl(spark, sf_dir, budget: int | None = None):
    pages = table(spark, sf_dir, "pages")
    return crawl.crawl_plan(pages, seeds=pages.select(F.col("url").alias("node")), allowed=CRAWL_ALLOWED,
                            max_depth=CRAWL_DEPTH - 1, budget=budget)


@register("crawl_plan", _crawl_sql() + _PLAN_SQL)
def crawl_plan(spark, sf_dir):
    """All fetched pages seed the crawl; links resolved (X1/U10), kept
    when the target host is an allowed domain or a sub-domain of one (F2),
    expanded only from fetched pages (S1: unfetched targets are failed
    fetches, J8), depth bound (F19), no page budget."""
    return _page_crawl(spark, sf_dir).select("url", F.col("depth").cast("bigint").alias("depth"), "fetched")


@register("crawl_plan_budget", _crawl_sql("SELECT count(*) * 6 // 5 FROM pg") + _PLAN_SQL)
def crawl_plan_budget(spark, sf_dir):
    """O3: the same crawl under a page budget of 1.2 times the stored pages,
    used up within the first hop: levels are accepted in URL order."""
    budget = table(spark, sf_dir, "pages").select("url").distinct().count() * 6 // 5
    return _page_crawl(spark, sf_dir, budget).select("url", F.col("depth").cast("bigint").alias("depth"), "fetched")


@register("crawl_report", _crawl_sql() + f"""SELECT node AS url, {search_domain('node')} AS domain, CAST(depth AS BIGINT) AS depth,
       CAST(row_number() OVER (ORDER BY depth, node) AS BIGINT) AS discovered
FROM plan""")
def crawl_report(spark, sf_dir):
    """The crawl report (URL, domain, depth, discovery order) that the
    crawled-pages CSV holds, from the G4 plan joined to the URL profile."""
    return crawl.crawl_report(_page_crawl(spark, sf_dir))


_RULE_DOMAINS = ["example.com", "thther.example.org", "example"]


@register("domain_rule_counts", f"""
WITH {_links_sql().replace('SELECT', 'l0 AS (SELECT url, ', 1)}),
t AS (SELECT DISTINCT {_resolve_strict_sql('href')} AS target FROM l0),
h AS (SELECT target, {search_domain('target')} AS host FROM t),
r AS (SELECT unnest([{", ".join(q(d) for d in _RULE_DOMAINS)}]) AS d)
SELECT 'exact' AS rule, count(*) AS passing FROM h WHERE EXISTS (SELECT 1 FROM r WHERE host = d)
UNION ALL SELECT 'suffix', count(*) FROM h WHERE EXISTS (SELECT 1 FROM r WHERE host = d OR suffix(host, '.' || d))
UNION ALL SELECT 'substring', count(*) FROM h WHERE EXISTS (SELECT 1 FROM r WHERE contains(host, d))
""")
def domain_rule_counts(spark, sf_dir):
    """F1 exact / F2 dot-suffix / F3 substring allowed-domain rules over every
    distinct link target."""
    from pyspark.sql.functions import lit
    from pagelake.operators.extract import link_edges
    targets = link_edges(table(spark, sf_dir, "pages"), "strict").select("target").distinct()
    out = None
    for rule in ("exact", "suffix", "substring"):
        c = crawl.domain_filter(targets, "target", _RULE_DOMAINS, rule).agg(F.count("*").alias("passing"))
        c = c.select(lit(rule).alias("rule"), "passing")
        out = c if out is None else out.unionByName(c)
    return out


def _g5_plan_sql() -> str:
    """Oracle: ``kinds`` (node, depth, kind) of the crawl with images."""
    allowed = ", ".join(q(d) for d in CRAWL_ALLOWED)
    img = ("(SELECT url, regexp_replace(html, '<a href=\"([^\"]*)\">', "
           "'<img src=\"\\1.png\" alt=\"\\1\">', 'g') AS html FROM pages)")
    return f"""
WITH pg AS (SELECT DISTINCT url FROM pages),
links AS (SELECT {_resolve_strict_sql('href')} AS dst
  FROM (SELECT url, unnest(regexp_extract_all(html, {q(H.LINK_ANY_QUOTE_RE)}, 1)) AS href FROM pages)),
ok AS (SELECT DISTINCT dst FROM links, (SELECT unnest([{allowed}]) AS d) r
       WHERE {search_domain('dst')} = r.d OR suffix({search_domain('dst')}, '.' || r.d)),
imgs AS (SELECT DISTINCT {_resolve_strict_sql('src')} AS dst
  FROM (SELECT url, unnest(regexp_extract_all(html, {q(H.IMG_ANY_QUOTE_RE)}, 1)) AS src FROM {img})),
l1 AS (SELECT dst AS node FROM ok UNION SELECT dst FROM imgs EXCEPT SELECT url FROM pg),
plan AS (SELECT url AS node, 0 AS depth FROM pg UNION ALL SELECT node, 1 FROM l1),
kinds AS (SELECT node, depth, CASE WHEN regexp_matches(
    translate(node, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '\\.(jpg|jpeg|png|gif|bmp|webp|svg)\\z') THEN 'image' ELSE 'page' END AS kind FROM plan)"""


def image_crawl(spark, sf_dir):
    """The crawl in which image references are scheduled too."""
    from pagelake.operators.extract import derive_image_pages
    pages = table(spark, sf_dir, "pages")
    return crawl.crawl_plan(pages, seeds=pages.select(F.col("url").alias("node")), allowed=CRAWL_ALLOWED,
                            max_depth=2, images_from=derive_image_pages(pages))


@register("crawl_with_images", _g5_plan_sql() + " SELECT node AS url, CAST(depth AS BIGINT) AS depth, kind FROM kinds")
def crawl_with_images(spark, sf_dir):
    """Image references are scheduled at depth+1 without the domain rule
    and stay leaves (image input: the derived image fixture)."""
    return image_crawl(spark, sf_dir).select("url", F.col("depth").cast("bigint").alias("depth"), "kind")
