"""robots.txt queries (S13, W4, J6, J7, F12, F24) over a per-host robots
corpus derived from the pages' own links."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.catalog import register
from pagelake.catalog._sql import q, search_domain
from pagelake.catalog.extraction import _resolve_strict_sql
from pagelake.functions import html as H
from pagelake.functions import urls as U
from pagelake.operators import robots as RB
from pagelake.operators.extract import link_edges
from pagelake.operators.limits import running_agg
from pagelake.session import table

AGENT = "pagelake-bot"

_LINKS = f"""links AS (SELECT url, {search_domain('url')} AS domain, href, {_resolve_strict_sql('href')} AS target
  FROM (SELECT url, unnest(regexp_extract_all(html, {q(H.LINK_ANY_QUOTE_RE)}, 1)) AS href FROM pages))"""

_CORPUS = """corpus AS (SELECT domain, concat_ws(chr(10), 'User-agent: *',
    'Crawl-delay: ' || CAST(count(DISTINCT url) AS VARCHAR),
    array_to_string(coalesce(list_sort(list(DISTINCT 'Disallow: ' || href) FILTER (WHERE regexp_matches(href, '^/[A-Z]'))), []), chr(10)),
    'User-agent: pagelake-bot', 'Disallow: /private',
    array_to_string(coalesce(list_sort(list(DISTINCT 'Allow: ' || href) FILTER (WHERE regexp_matches(href, '^/[a-z]{1,3}$'))), []), chr(10))
  ) AS content FROM links GROUP BY domain)"""

_PARSE = r"""lines AS (SELECT domain, unnest(string_split(content, chr(10))) AS line,
    generate_subscripts(string_split(content, chr(10)), 1) - 1 AS ln FROM corpus),
toks AS (SELECT domain, ln, list_filter(string_split_regex(line, '[ \t\n\x0B\f\r]+'), lambda t: t <> '') AS t FROM lines),
k AS (SELECT domain, ln, t[1] AS directive, coalesce(t[2], '') AS value, len(t) >= 2 AS has_value,
    CASE t[1] WHEN 'User-agent:' THEN 'ua' WHEN 'Allow:' THEN 'allow' WHEN 'Disallow:' THEN 'disallow'
              WHEN 'Crawl-delay:' THEN 'delay' END AS kind FROM toks),
p AS (SELECT *, last_value(CASE WHEN kind IN ('ua', 'allow', 'disallow') THEN kind END IGNORE NULLS)
    OVER (PARTITION BY domain ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM k WHERE kind IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN kind = 'ua' AND prev IN ('allow', 'disallow') THEN 1 ELSE 0 END)
    OVER (PARTITION BY domain ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS group_id FROM p),
grp AS (SELECT domain, CAST(group_id AS BIGINT) AS group_id,
    arg_max(value, ln) FILTER (WHERE kind = 'ua' AND has_value) AS agent,
    arg_max(coalesce(TRY_CAST(regexp_extract(value, '^[+-]?[0-9]+', 0) AS INTEGER), 0), ln)
      FILTER (WHERE kind = 'delay') AS delay,
    list(value ORDER BY ln) FILTER (WHERE kind = 'allow') AS allow,
    list(value ORDER BY ln) FILTER (WHERE kind = 'disallow') AS disallow
  FROM g GROUP BY 1, 2),
rules AS (SELECT domain, group_id, coalesce(agent, CASE WHEN group_id = 0 THEN '*' ELSE '' END) AS user_agent,
    CAST(coalesce(delay, 0) AS BIGINT) AS crawl_delay, coalesce(allow, []) AS allow,
    coalesce(disallow, []) AS disallow FROM grp WHERE allow IS NOT NULL OR disallow IS NOT NULL)"""

_WITH = f"WITH {_LINKS},\n{_CORPUS},\n{_PARSE}\n"


def _files(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    links = link_edges(pages, "strict").select("url", U.search_domain("url").alias("domain"), "href", "target")
    return links, RB.robots_corpus(links)


@register("robots_groups", _WITH + """
SELECT domain, group_id, user_agent, crawl_delay, array_to_string(allow, ' ') AS allow,
       array_to_string(disallow, ' ') AS disallow FROM rules
""")
def robots_groups(spark, sf_dir):
    """Rule groups parsed from every host's robots.txt."""
    rules = RB.parse_robots(_files(spark, sf_dir)[1])
    return rules.select("domain", F.col("group_id").cast("bigint"), "user_agent",
                        F.col("crawl_delay").cast("bigint"),
                        F.array_join("allow", " ").alias("allow"), F.array_join("disallow", " ").alias("disallow"))


@register("robots_rules", _WITH + """
SELECT domain, group_id, user_agent, crawl_delay, kind, CAST(row_number() OVER (PARTITION BY domain ORDER BY ln) AS BIGINT) AS place, value AS path
FROM g JOIN rules USING (domain, group_id) WHERE kind IN ('allow', 'disallow')
""")
def robots_rules(spark, sf_dir):
    """S13/W4 as rows, one for each rule line, numbered within its file."""
    rules = RB.robots_rules(_files(spark, sf_dir)[1])
    placed = running_agg(rules, "domain", ["ln"], F.lit(1).cast("long"), "place", "sum")
    return placed.select("domain", F.col("group_id").cast("bigint"), "user_agent", F.col("crawl_delay").cast("bigint"), "kind", "place", "path")


@register("robots_verdicts", _WITH + f"""
, flat AS (SELECT domain, group_id, 0 AS ord, unnest(disallow) AS path FROM rules WHERE user_agent IN ('*', '{AGENT}')
  UNION ALL SELECT domain, group_id, 1 AS ord, unnest(allow) AS path FROM rules WHERE user_agent IN ('*', '{AGENT}')),
urls AS (SELECT DISTINCT target AS url FROM links),
dec AS (SELECT u.url, min(f.group_id * 2 + f.ord) AS first FROM urls u
  JOIN flat f ON {search_domain('u.url')} = f.domain WHERE contains(u.url, f.path) GROUP BY 1)
SELECT {search_domain('url')} AS domain, CAST(count_if(allowed) AS BIGINT) AS allowed, CAST(count_if(NOT allowed) AS BIGINT) AS denied
FROM (SELECT u.url, coalesce(d.first % 2 = 1, true) AS allowed FROM urls u LEFT JOIN dec d USING (url)) GROUP BY 1
""")
def robots_verdicts(spark, sf_dir):
    """Allow decision for every discovered link target, per domain."""
    links, lines = _files(spark, sf_dir)
    urls = links.select(F.col("target").alias("url")).distinct()
    dec = RB.robots_decisions(urls, RB.robots_rules(lines), AGENT)
    return dec.groupBy(U.search_domain("url").alias("domain")).agg(
        F.count_if(F.col("allowed")).alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"))


@register("crawl_delays", _WITH + """
SELECT d.domain, coalesce(s.crawl_delay, 0) AS crawl_delay
FROM (SELECT DISTINCT domain FROM links) d
LEFT JOIN (SELECT domain, arg_min(crawl_delay, group_id) AS crawl_delay FROM rules WHERE user_agent = '*'
           GROUP BY 1) s USING (domain)
""")
def crawl_delays(spark, sf_dir):
    """Crawl delay of each host (first ``*`` group, default 0)."""
    links, lines = _files(spark, sf_dir)
    out = RB.crawl_delays(RB.robots_rules(lines), links.select("domain"))
    return out.select("domain", F.col("crawl_delay").cast("bigint"))
