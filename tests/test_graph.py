"""BFS, shortest-path counts and budgets against a Python BFS."""

from collections import deque

from pyspark.sql import functions as F

from pagelake.plans.graph import bfs

EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f"),
         ("f", "d"), ("c", "g"), ("g", "g"), ("x", "y")]


def py_bfs(edges, seed, max_depth):
    adj = {}
    for s, d in edges:
        adj.setdefault(s, []).append(d)
    depth, paths, q = {seed: 0}, {seed: 1}, deque([seed])
    while q:
        u = q.popleft()
        if depth[u] >= max_depth:
            continue
        for v in adj.get(u, []):
            if v not in depth:
                depth[v], paths[v] = depth[u] + 1, 0
                q.append(v)
            if depth[v] == depth[u] + 1:
                paths[v] += paths[u]
    return depth, paths


def frames(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    return e, spark.createDataFrame([("a",)], "node string")


def test_bfs_min_depth_and_paths(spark):
    e, s = frames(spark)
    depth, paths = py_bfs(EDGES, "a", 10)
    got = {r.node: (r.depth, r.paths) for r in bfs(e, s, 10, count_paths=True).collect()}
    assert got == {n: (depth[n], paths[n]) for n in depth}


def test_depth_bound(spark):
    e, s = frames(spark)
    depth, _ = py_bfs(EDGES, "a", 2)
    got = {r.node: r.depth for r in bfs(e, s, 2).collect()}
    assert got == depth


def test_mark_at_dequeue_same_nodes(spark):
    """G2 (mark at dequeue) reaches the same node set as G1."""
    e, s = frames(spark)
    seen, q, order = set(), deque([("a", 0)]), []
    adj = {}
    for a, b in EDGES:
        adj.setdefault(a, []).append(b)
    while q:
        u, d = q.popleft()
        if u in seen or d > 3:
            continue
        seen.add(u)
        q.extend((v, d + 1) for v in adj.get(u, []))
    assert {r.node for r in bfs(e, s, 3).collect()} == seen


def test_budget_accepts_levels_in_node_order(spark):
    e, s = frames(spark)
    got = {r.node for r in bfs(e, s, 10, budget=4).collect()}
    assert got == {"a", "b", "c", "d"}


def test_expandable_restricts_expansion(spark):
    e, s = frames(spark)
    fetched = spark.createDataFrame([("a",), ("b",)], "node string")
    got = {r.node: r.depth for r in bfs(e, s, 10, expandable=fetched).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_fixture_level_sizes_sf001(spark):
    from tests.conftest import SF_CHECK
    import __spark_entry__ as entry
    out = entry.queries()["bfs_host_word"](spark, SF_CHECK)
    sizes = [r["n"] for r in out.groupBy("depth").agg(F.count("*").alias("n")).orderBy("depth").collect()]
    assert sizes[:5] == [1, 12, 6, 119, 47]


def test_hub_edges_are_spread(spark):
    """A hub with a third of the edges fills no partition above twice the mean."""
    from pagelake.plans.graph import salted_edges
    rows = [("hub", f"n{i}") for i in range(20_000)] + [(f"n{i}", f"m{i % 977}") for i in range(40_000)]
    e = spark.createDataFrame(rows, "src string, dst string")
    sizes = [r["count"] for r in salted_edges(e, 16).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 2 * 60_000 / 16


def test_plan_updates_equal_a_new_plan(spark):
    """After each of three batches of new edges, at several depths."""
    import random

    from pagelake.plans.graph import bfs_update
    r = random.Random(9)
    seed = spark.createDataFrame([("n0",)], "node string")
    for most in (2, 5, 30):
        chain = [(f"n{i}", f"n{i + 1}") for i in range(40)]
        edges, plan = chain[:20], bfs(spark.createDataFrame(chain[:20], "src string, dst string"), seed, most)
        for batch in (chain[20:] + [("n3", "n30")], [(f"n{r.randrange(41)}", f"n{r.randrange(60)}") for _ in range(12)], [("n0", "n17"), ("x", "y"), ("n59", "n0")]):
            edges = edges + batch
            e, new = (spark.createDataFrame(x, "src string, dst string") for x in (edges, batch))
            plan = bfs_update(plan, e, new, most)
            depth, _ = py_bfs(edges, "n0", most)
            assert {x.node: x.depth for x in plan.collect()} == depth


def test_chains_loops_and_ends(spark):
    import random

    from pagelake.plans.graph import resolve_chains

    def follow(ptr, k):
        path = [k]
        while ptr.get(path[-1], path[-1]) not in path:
            path.append(ptr[path[-1]])
        end = ptr.get(path[-1], path[-1])
        return (end, False) if end == path[-1] else (min(path[path.index(end):]), True)

    r = random.Random(6)
    cases = [{f"c{i:02}": f"c{i + 1:02}" for i in range(50)}, {"a": "b", "b": "c", "c": "d", "d": "b", "e": "e", "f": None},
             {f"k{i}": f"k{(i + 1) % 17}" for i in range(17)}, {f"r{i}": f"r{r.randrange(40)}" for i in range(30)}, {}]
    for ptr in cases:
        df = spark.createDataFrame(list(ptr.items()) * 2 + [(None, "a")], "key string, target string")
        got = {x.key: (x.end, x.loop) for x in resolve_chains(df).collect()}
        plain = {k: v if v is not None else k for k, v in ptr.items()}
        assert {k: got[k] for k in ptr} == {k: follow(plain, k) for k in ptr}


def test_levels_are_appended(spark):
    """Each level is written once: the visited table holds every node in one file set."""
    e, s = frames(spark)
    out = bfs(e, s, 10)
    assert out.count() == len(py_bfs(EDGES, "a", 10)[0])
    assert all("visited_" in f for f in out.inputFiles())
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("visited_")]


def test_upserts_with_nulls_ties_and_repeats(spark):
    from pagelake.operators.tables import insert_or_ignore, upsert_last
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", None, "n"), ("c", 3, "t"), ("c", 3, "t"), (None, 5, "k"), (None, 4, "j"), ("d", None, "p"), ("d", 7, "q")]
    df = spark.createDataFrame(rows, "key string, at int, v string").repartition(3)
    first = sorted((str(x.key), x.at, x.v) for x in insert_or_ignore(df, "key", "at").collect())
    assert first == [("None", 4, "j"), ("a", 1, "x"), ("b", None, "n"), ("c", 3, "t"), ("d", 7, "q")]
    last = sorted((str(x.key), x.at, x.v) for x in upsert_last(df, "key", "at").collect())
    assert last == [("None", 5, "k"), ("a", 2, "y"), ("b", None, "n"), ("c", 3, "t"), ("d", 7, "q")]
    tied = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y")], "key string, at int, v string")
    assert insert_or_ignore(tied, "key", "at").count() == 1


def test_only_hubs_are_repeated_per_salt(spark, monkeypatch):
    """A frontier is joined as it is: broadcast without copies, and past the broadcast
    bound with copies of hubs only; the crawl is the same either way (F7, F8, F9, F11, F12)."""
    from pagelake.plans import graph
    rows = [("s", "hub")] + [("hub", f"n{i}") for i in range(3_000)] + [(f"n{i}", f"m{i % 97}") for i in range(3_000)]
    e = spark.createDataFrame(rows + rows[:500] + [(None, "n1"), (None, "z")], "src string, dst string")
    seed = spark.createDataFrame([("s",), (None,)], "node string")
    dealt = graph.cut_lineage(graph.salted_edges(e, 8))
    salts = {r.src: (r.n, r.rows) for r in dealt.groupBy("src").agg(F.countDistinct("salt").alias("n"), F.count("*").alias("rows")).collect()}
    assert salts["hub"][0] > 8 and salts["hub"][1] == 3_000 and len(salts) == 3_002
    assert all(v == (1, 1) for k, v in salts.items() if k != "hub")
    front = spark.createDataFrame([("hub",)] + [(f"n{i}",) for i in range(50)] + [(None,), ("none",)], "node string")
    want = sorted([f"n{i}" for i in range(3_000)] + [f"m{i}" for i in range(50)])
    plain = graph._expand(front, dealt, [])
    assert "Generate" not in plain._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.node for r in plain.collect()) == want
    few = bfs(e, seed, 5, count_paths=True).collect()
    monkeypatch.setattr(graph, "FRONTIER_BROADCAST_ROWS", 0)
    assert sorted(r.node for r in graph._expand(front, dealt, []).collect()) == want
    assert sorted(few, key=str) == sorted(bfs(e, seed, 5, count_paths=True).collect(), key=str)
    depth, paths = py_bfs(rows, "s", 5)
    assert {r.node: (r.depth, r.paths) for r in few if r.node} == {n: (depth[n], paths[n]) for n in depth}
