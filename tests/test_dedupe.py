"""Near-duplicate detection against brute-force Jaccard on a small fixture."""

from itertools import combinations

from pagelake.operators.dedupe import near_duplicates, shingles

BASE = ("the quick brown fox jumps over the lazy dog while the cat sleeps in the warm sun "
        "and the birds sing songs about the long summer days near the quiet river bank")
DOCS = [
    (1, BASE),
    (2, BASE.replace("lazy", "sleepy")),                 # one word changed
    (3, BASE),                                           # exact copy
    (4, "completely different text about databases and query engines and joins and shuffles"),
    (5, BASE + " today"),
    (6, "another unrelated note on graphs frontiers levels and checkpoints for iterative jobs"),
]


def test_near_duplicates_precision_and_recall(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {(r.doc_id, r.rep_id): r.jaccard for r in near_duplicates(df, threshold=0.7).collect()}
    sets = {}
    for r in shingles(df).collect():
        sets.setdefault(r.doc_id, set()).add(r.shingle)
    for (d, rep), j in got.items():                      # every reported pair is truly similar
        a, b = sets.get(d, set()), sets.get(rep, set())
        assert j >= 0.7 and abs(j - len(a & b) / len(a | b)) < 1e-9
    linked = {frozenset(p) for p in got}
    assert frozenset({1, 3}) in linked                   # exact copy
    assert frozenset({1, 2}) in linked and frozenset({1, 5}) in linked
    for x, y in combinations([4, 6], 2):
        assert frozenset({x, y}) not in linked


def test_clusters_equal_reachable_documents(spark):
    """One row per document; families, chains, copies and texts without shingles."""
    import random

    from pagelake.operators.dedupe import near_duplicate_clusters
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    rows = [(900, ""), (901, None), (902, "one"), (903, "one"), (904, "one two three")]
    for f in range(5):
        base = [word() for _ in range(60)]
        for i in range(15):
            own = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                own[r.randrange(60)] = word()
            rows.append((100 * f + i, " ".join(own)))
        rows += [(100 * f + 50 + i, " ".join(base[2 * i:] + [f"t{f}x{j}" for j in range(2 * i)])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pairs = [(x.doc_id, x.rep_id) for x in near_duplicates(df).collect()]
    root = {d: d for d, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {x.doc_id: x.cluster_id for x in near_duplicate_clusters(df).collect()}
    assert got == {d: top(d) for d, _ in rows}
    assert len(set(got.values())) < 40


def test_components(spark):
    from pagelake.plans.graph import components
    edges = [(1, 2), (3, 2), (10, 11), (11, 12), (12, 13), (13, 14), (20, 20), *[(100, i) for i in range(30, 60)], *[(i, i + 1) for i in range(200, 260)]]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **{i: 10 for i in range(10, 15)}, 100: 30, **{i: 30 for i in range(30, 60)}, **{i: 200 for i in range(200, 261)}}


def test_sets_hold_only_shingles_that_meet_others(spark):
    """Texts that share nothing are not written; rows of one doc_id are one set."""
    from pagelake.operators.dedupe import _prefixes
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    norm, sets, _ = _prefixes(df, 0.7, 3)
    whole = {r.doc_id: r["count"] for r in shingles(df).groupBy("doc_id").count().collect()}
    got = {r.doc_id: (r.size, len(r.held)) for r in sets.collect()}
    assert norm.count() == len(DOCS) and set(got) == {1, 2, 5}
    assert all(size == whole[d] and held <= size for d, (size, held) in got.items())
    assert got[2][1] < got[2][0]
    twice = spark.createDataFrame([*DOCS, *DOCS, (2, BASE.replace("cat", "dog"))], "doc_id long, text string")
    assert {r.doc_id: r.size for r in _prefixes(twice, 0.7, 3)[1].collect()}[2] == len(
        {x.shingle for x in shingles(twice.where("doc_id = 2")).select("shingle").collect()})
