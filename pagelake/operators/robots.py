"""robots.txt: parse to rule groups (S13, W4), allow decisions (J6, F12,
F24) and crawl delays (J7).

A file is rows (domain, ln, line).  Reading it is an automaton over its lines
whose state is the kind of the last structural line (agent or rule) and the
number of groups opened: a ``User-agent:`` line that follows a rule line
opens a group.  Both parts of the state compose (the latest line wins, numbers
add up), so lines are dealt in ranges of (domain, ln), each range becomes one
state transition, and the ranges are joined by their carries
(``running_agg``): a host with a third of all lines spans many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import urls as U
from pagelake.functions.text import C_SPACE
from pagelake.operators.features import contained
from pagelake.operators.limits import running_agg
from pagelake.operators.tables import with_global_rank
from pagelake.session import bounded_broadcast, cut_lineage


def robots_lines(robots: DataFrame, domain: str = "domain", content: str = "content") -> DataFrame:
    """(domain, ln, line) of files that come as one text each."""
    return robots.select(F.col(domain).alias("domain"), F.posexplode(F.split(F.col(content), "\n")).alias("ln", "line"))


def _directives(lines: DataFrame) -> DataFrame:
    """(domain, ln, kind, value, has_value, group_id) of the lines that count."""
    toks = F.filter(F.split(F.col("line"), C_SPACE + "+"), lambda t: t != "")
    lines = lines.select("domain", "ln", F.get(toks, 0).alias("directive"),
                         F.coalesce(F.get(toks, 1), F.lit("")).alias("value"),
                         (F.size(toks) >= 2).alias("has_value"))
    kind = (F.when(F.col("directive") == "User-agent:", F.lit("ua"))
            .when(F.col("directive") == "Allow:", F.lit("allow"))
            .when(F.col("directive") == "Disallow:", F.lit("disallow"))
            .when(F.col("directive") == "Crawl-delay:", F.lit("delay")))
    lines = lines.withColumn("kind", kind).where(F.col("kind").isNotNull()).drop("directive")
    structural = F.when(F.col("kind") != "delay", F.struct("ln", "kind"))
    lines = running_agg(lines, "domain", ["ln"], structural, "before", "max", exclusive=True)
    opens = F.coalesce((F.col("kind") == "ua") & F.col("before.kind").isin("allow", "disallow"), F.lit(False))
    lines = lines.withColumn("opens", opens.cast("int")).drop("before")
    return running_agg(lines, "domain", ["ln"], "opens", "group_id", "sum").drop("opens")


def robots_rules(lines: DataFrame) -> DataFrame:
    """W4 as rows: (domain, group_id, user_agent, crawl_delay, ln, kind, path), one for
    each ``Allow:`` and ``Disallow:`` line, whatever the size of its group.

    Directives are case-sensitive first tokens (``User-agent:``, ``Allow:``,
    ``Disallow:``, ``Crawl-delay:``); the value is the next token ("" when
    absent).  A ``User-agent:`` line only opens a group when the current one
    has rules, otherwise it overwrites the agent; the first group defaults to
    ``*``; groups without rules are dropped; a delay that does not parse as an
    integer is 0.
    """
    d = cut_lineage(_directives(lines))
    delay = F.coalesce(F.regexp_extract(F.col("value"), r"^[+-]?[0-9]+", 0).try_cast("int"), F.lit(0))
    head = d.groupBy("domain", "group_id").agg(
        # last value of each directive in the group (max of (line, value) ignores other lines)
        F.max(F.when((F.col("kind") == "ua") & F.col("has_value"), F.struct("ln", "value")))["value"].alias("agent"),
        F.max(F.when(F.col("kind") == "delay", F.struct(F.col("ln"), delay.alias("d"))))["d"].alias("delay"))
    head = head.select(
        "domain", "group_id", F.coalesce(F.col("agent"), F.when(F.col("group_id") == 0, F.lit("*")).otherwise(F.lit(""))).alias("user_agent"),
        F.coalesce(F.col("delay"), F.lit(0)).alias("crawl_delay"))
    rules = d.where(F.col("kind").isin("allow", "disallow")).select("domain", "group_id", "ln", "kind", F.col("value").alias("path"))
    return rules.join(head, ["domain", "group_id"]).select("domain", "group_id", "user_agent", "crawl_delay", "ln", "kind", "path")


def parse_robots(lines: DataFrame) -> DataFrame:
    """One row per rule group with its paths as arrays: ``(domain, group_id,
    user_agent, crawl_delay, allow, disallow)``; see ``robots_rules``."""
    of = lambda kind: F.transform(F.array_sort(F.collect_list(
        F.when(F.col("kind") == kind, F.struct("ln", "path")))), lambda r: r["path"]).alias(kind)
    return (robots_rules(lines).groupBy("domain", "group_id", "user_agent", "crawl_delay").agg(of("allow"), of("disallow")))


def robots_decisions(urls: DataFrame, rules: DataFrame, user_agent: str, url_col: str = "url",
                     compat_empty_disallow: bool = True) -> DataFrame:
    """Add ``allowed`` for every URL, by ``robots_rules`` rows.

    In group order, a group of the URL's domain (U3) for ``*`` or
    ``user_agent`` decides on its first disallow path found in the URL
    (substring, deny) before its allow paths (allow); no deciding group ->
    allowed.  Paths meet the URLs of their domain by q-grams (``contained``).
    ``compat_empty_disallow`` keeps the source behaviour where an empty
    ``Disallow:`` matches every URL.
    """
    flat = cut_lineage(rules.where(F.col("user_agent").isin("*", user_agent)).groupBy("domain", F.col("path").alias("w")).agg(
        F.min(F.struct("group_id", (F.col("kind") == "allow").cast("int").alias("order"))).alias("rule")))
    keyed = urls.withColumn("__dom", U.search_domain(F.col(url_col)))
    asked = keyed.select(F.col("__dom").alias("domain"), F.col(url_col).alias("token")).distinct()
    hits = contained(asked, flat.select("domain", "w"), by=("domain",)).join(bounded_broadcast(flat), ["domain", "w"])
    decided = hits.groupBy(F.col("token").alias("__u")).agg(F.min("rule").alias("__first"))
    out = keyed.join(decided, keyed[url_col] == decided["__u"], "left")
    first = F.col("__first")
    if compat_empty_disallow:
        always = flat.where("w = ''").select(F.col("domain").alias("__any"), F.col("rule").alias("__always"))
        out = out.join(bounded_broadcast(always), F.col("__dom") == F.col("__any"), "left")
        first = F.least("__first", "__always")  # nulls are skipped
    return out.withColumn("allowed", F.coalesce(first["order"] == 1, F.lit(True))).select(*urls.columns, "allowed")


def crawl_delays(rules: DataFrame, domains: DataFrame) -> DataFrame:
    """Delay of the first ``*`` group of each domain, default 0."""
    star = (rules.where(F.col("user_agent") == "*").groupBy("domain")
            .agg(F.min_by("crawl_delay", "group_id").alias("crawl_delay")))
    return (domains.select("domain").distinct().join(star, "domain", "left")
            .select("domain", F.coalesce("crawl_delay", F.lit(0)).alias("crawl_delay")))


def robots_corpus(links: DataFrame) -> DataFrame:
    """Derived fixture: one robots.txt per host built from its own links, as rows
    (domain, ln, line): ``*`` disallows every capitalised link path, a named agent
    group disallows ``/private`` and allows the short lowercase paths, and the crawl
    delay is the host's page count.  ``ln`` ascends within a host."""
    part = lambda df, no, line: df.select("domain", F.lit(no).alias("part"), line.alias("line"))
    hosts = links.groupBy("domain").agg(F.countDistinct("url").alias("n_pages"))
    paths = links.select("domain", "href").distinct()
    rows = (part(hosts, 0, F.lit("User-agent: *"))
            .unionByName(part(hosts, 1, F.concat(F.lit("Crawl-delay: "), F.col("n_pages").cast("string"))))
            .unionByName(part(paths.where(F.col("href").rlike("^/[A-Z]")), 2, F.concat(F.lit("Disallow: "), "href")))
            .unionByName(part(hosts, 3, F.lit("User-agent: pagelake-bot")))
            .unionByName(part(hosts, 4, F.lit("Disallow: /private")))
            .unionByName(part(paths.where(F.col("href").rlike("^/[a-z]{1,3}$")), 5, F.concat(F.lit("Allow: "), "href"))))
    return with_global_rank(rows, ["domain", "part", "line"], "ln").select("domain", "ln", "line")
