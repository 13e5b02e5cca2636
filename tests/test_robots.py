"""robots.txt goldens (sequential semantics read from the crawler)."""

from pyspark.sql import functions as F

import random

from pagelake.operators import robots as RB


def parse(spark, text):
    df = spark.createDataFrame([("h", text)], "domain string, content string")
    rows = RB.parse_robots(RB.robots_lines(df)).orderBy("group_id").collect()
    return [(r.user_agent, r.crawl_delay, list(r.allow), list(r.disallow)) for r in rows]


def test_agent_overwritten_until_rules(spark):
    assert parse(spark, "User-agent: a\nUser-agent: b\nDisallow: /x") == [("b", 0, [], ["/x"])]


def test_empty_disallow_is_a_rule(spark):
    assert parse(spark, "User-agent: *\nDisallow:") == [("*", 0, [], [""])]


def test_unknown_directive_skipped(spark):
    assert parse(spark, "user-agent: *\nDisallow: /x") == [("*", 0, [], ["/x"])]


def test_delay_carries_into_next_agent(spark):
    assert parse(spark, "User-agent: a\nCrawl-delay: 5\nUser-agent: *\nDisallow: /x") == [("*", 5, [], ["/x"])]


def test_groups_split_after_rules_and_ruleless_dropped(spark):
    text = "Disallow: /a\nUser-agent: b\nAllow: /c\nCrawl-delay: x\nUser-agent: c\nCrawl-delay: 7"
    assert parse(spark, text) == [("*", 0, [], ["/a"]), ("b", 0, ["/c"], [])]


def decide(spark, text, urls, ua="bot", compat=True):
    robots = spark.createDataFrame([("h", text)], "domain string, content string")
    rules = RB.robots_rules(RB.robots_lines(robots))
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    out = {r.url: r.allowed for r in RB.robots_decisions(df, rules, ua, compat_empty_disallow=compat).collect()}
    return [out[u] for u in urls]


def test_disallow_checked_before_allow(spark):
    text = "User-agent: *\nDisallow: /p\nAllow: /p/ok"
    assert decide(spark, text, ["http://h/p/ok", "http://h/q"]) == [False, True]


def test_substring_not_prefix(spark):
    assert decide(spark, "User-agent: *\nDisallow: /x", ["http://h/a/x"]) == [False]


def test_empty_disallow_compat_and_sensible(spark):
    text = "User-agent: *\nDisallow:"
    assert decide(spark, text, ["http://h/a"], compat=True) == [False]
    assert decide(spark, text, ["http://h/a"], compat=False) == [True]


def test_other_agents_ignored_and_unknown_domain_allowed(spark):
    text = "User-agent: other\nDisallow: /"
    assert decide(spark, text, ["http://h/a", "http://z/a"]) == [True, True]


def test_crawl_delay_first_star_group(spark):
    robots = spark.createDataFrame([("h", "User-agent: a\nCrawl-delay: 3\nDisallow: /x\n"
                                          "User-agent: *\nCrawl-delay: 9\nDisallow: /y")],
                                   "domain string, content string")
    rules = RB.robots_rules(RB.robots_lines(robots))
    doms = spark.createDataFrame([("h",), ("z",)], "domain string")
    got = {r.domain: r.crawl_delay for r in RB.crawl_delays(rules, doms).collect()}
    assert got == {"h": 9, "z": 0}


def sequential(lines):
    """Rule lines with their group, one line after the other."""
    out, group, state = [], 0, None
    for ln, line in lines:
        t = line.split()
        if t and t[0] == "User-agent:":
            group += state == "rule"
            state = "agent"
        elif t and t[0] in ("Allow:", "Disallow:"):
            state = "rule"
            out.append((group, ln, t[1] if len(t) > 1 else ""))
    return out


def test_long_files_are_read_in_slices(spark, monkeypatch):
    r = random.Random(5)
    pieces = ["User-agent: a", "User-agent: *", "Allow: /x", "Disallow: /y", "Crawl-delay: 3", "", "# note", "Disallow:", "Sitemap: z"]
    files = {"hot": [(i, r.choice(pieces)) for i in range(6000)], "one": [(0, "Allow: /")], "none": [(0, "")],
             "few": [(i * 7, r.choice(pieces)) for i in range(20)]}
    lines = spark.createDataFrame([(d, ln, x) for d, own in files.items() for ln, x in own], "domain string, ln int, line string")
    got = {}
    for x in RB.robots_rules(lines.repartition(3)).collect():
        got.setdefault(x.domain, []).append((x.group_id, x.ln, x.path))
    assert {d: sorted(v, key=lambda t: t[1]) for d, v in got.items()} == {d: sequential(own) for d, own in files.items() if sequential(own)}
    plan = RB._directives(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and all("__pid" in x for x in plan.split("\n") if "Window [" in x and "__local" in x)


def test_urls_meet_only_the_paths_of_their_domain(spark):
    lines = spark.createDataFrame([("h", 0, "Disallow: /a"), ("z", 0, "Disallow: /b"), ("z", 1, "Allow: /"), ("z", 2, "Disallow: ab")],
                                  "domain string, ln int, line string")
    urls = spark.createDataFrame([("http://h/a",), ("http://h/b",), ("http://z/a",), ("http://z/b",), ("http://z/ab",)], "url string")
    got = {x.url: x.allowed for x in RB.robots_decisions(urls, RB.robots_rules(lines), "bot").collect()}
    assert got == {"http://h/a": False, "http://h/b": True, "http://z/a": True, "http://z/b": False, "http://z/ab": False}
