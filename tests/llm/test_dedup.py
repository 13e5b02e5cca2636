"""Exact duplicates, n-gram join and repeated passages against brute force."""

import random

import pytest

from pagelake.llm import exact_dedup, graph, ngram_join, substrings
from tests.llm import helpers as H


def _groups(rows):
    by = {}
    for d, t in rows:
        by.setdefault(H.sha(H.SPACE.sub(" ", t or "")), []).append(d)
    return by


@pytest.mark.parametrize("copies", [64, 2])
def test_exact_dedup_rows(spark, monkeypatch, copies):
    monkeypatch.setattr(exact_dedup, "HEAVY_COPIES", copies)  # 2: the broadcast path settles every group
    rows = H.awkward() + [(100 + i, "same  text" if i % 3 else f"text {i}") for i in range(60)]
    by = _groups(rows)
    got = exact_dedup.resolve(exact_dedup.digests(H.table(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = by[r.sha]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(by)


def test_exact_dedup_drop(spark):
    rows = H.awkward()
    docs = H.table(spark, rows).withColumnRenamed("lang", "sha").withColumnRenamed("n_chars", "kept")
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(_groups(rows))
    assert sorted(_groups(got)) == sorted(_groups(rows))
    assert {d for d, t in got if t == "x"} == {8}
    assert exact_dedup.drop_duplicates(docs.limit(0)).count() == 0
    assert exact_dedup.resolve(exact_dedup.digests(docs.limit(0))).count() == 0


@pytest.mark.parametrize("words,percent,group,seed", [(3, 90, 32, 1), (5, 80, 3, 2), (3, 90, 2, 3)])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, words, percent, group, seed):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    rows = H.near_copies(seed) + [(900, None), (901, ""), (902, " \n"), (903, "a"), (904, "A"), (905, "x y z")]
    expected = H.components(rows, words, percent)
    found = ngram_join.join(H.table(spark, rows), words, percent)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found.collect())
    assert got == expected
    assert sum(c != d for d, _, c, _ in expected) > 20
    kept = ngram_join.keep_one(H.table(spark, rows), words, percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c, _ in expected})


def test_ngram_join_awkward_rows(spark):
    docs = H.table(spark, H.awkward()).withColumnRenamed("lang", "node").withColumnRenamed("n_chars", "component_id")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.join(docs, 3, 90).collect()}
    assert got[(1, 1)] == got[(2, 1)] == got[(10, 1)] == got[(None, 1)] == 1
    assert got[(6, len(H.grams(H.awkward()[5][1], 3)))] == 6
    assert [c for (d, _), c in got.items() if d == 7] == [6]
    assert got[(3, 0)] == 3 and got[(4, 0)] == 4
    kept = ngram_join.keep_one(docs, 3, 90)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {3, 4, 5} <= set(ids) and 2 not in ids and 7 not in ids
    assert ngram_join.join(docs.limit(0), 3, 90).count() == 0


def test_words_longer_than_a_block(monkeypatch):
    giant = b"Q" * 300
    texts = [b"a b c " * 20 + giant + b" d", b"x " + giant.lower() + b" d e", b"a b c"]
    whole = ngram_join.token_sets(texts, 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 256)
    owner, token = ngram_join.token_sets(texts, 2)
    sets = [set(token[owner == i].tolist()) for i in range(3)]
    assert [len(s) for s in sets] == [len(set(whole[1][whole[0] == i].tolist())) for i in range(3)]
    assert len(sets[0] & sets[1]) == 1  # the giant word and its follower


def test_part_signatures_meet_for_every_linked_pair():
    import numpy as np
    r = random.Random(4)
    for _ in range(300):
        n, percent = r.choice([1, 2, 5, 9, 10, 11, 19, 20, 40, 100]), r.choice([80, 90])
        a = set(r.sample(range(10**6), n))
        b = set(a)
        for _ in range(r.randint(0, n // 4)):
            if r.random() < 0.5 and b:
                b.discard(r.choice(sorted(b)))
            else:
                b.add(r.randrange(10**6))
        if not b or 100 * len(a & b) < percent * len(a | b):
            continue
        sets = [ngram_join._mix(np.array(sorted(s), np.uint64)) for s in (a, b)]
        token = np.concatenate([np.sort(s) for s in sets])
        owner = np.repeat([0, 1], [len(a), len(b)])
        own, sign = ngram_join.signatures(owner, token, np.array([len(a), len(b)]), percent)
        assert set(sign[own == 0].tolist()) & set(sign[own == 1].tolist())


def test_components(spark):
    r = random.Random(6)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(500, 540)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    expected = {(x, top(x)) for p in pairs for x in p if p[0] != p[1]}
    got = {(x.node, x.component) for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(n, c) for n, c in expected}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _passages(seed):
    r = random.Random(seed)
    words = lambda k: " ".join("".join(r.choice("abcdeéö") for _ in range(r.randint(1, 7))) for _ in range(k))
    shared = [words(30) for _ in range(4)] + ["a" * 250, "ab" * 120, "x " * 150]
    rows = []
    for i in range(120):
        t = words(r.randint(0, 50))
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            t += " " + (p[r.randint(0, len(p) // 3):] if r.random() < 0.5 else p) + words(r.randint(0, 15))
        rows.append((i * 3 % 1000, t))
    rows += [(2000 + i, r.choice(rows)[1]) for i in range(15)]
    return rows + [(5000, None), (5001, ""), (5002, "short"), (5003, "short")]


@pytest.mark.parametrize("bucket_rows", [10_000, 2])
def test_substrings_equal_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(substrings, "BUCKET_ROWS", bucket_rows)  # 2: buckets are split and settled across splits
    rows = _passages(5)
    got = {r.doc_id: [tuple(r)[1:]] for r in substrings.cut_repeats(H.table(spark, rows)).collect()}
    assert got == H.cut(rows)


def test_substrings_awkward_rows(spark):
    rows = [(i, t) for i, t in H.awkward() if i not in (6, 7)] + [(20, "q" * 30 + "rs" * 200), (20, "q" * 30 + "rs" * 200), (None, "z" * 130)]
    docs = H.table(spark, rows).withColumnRenamed("lang", "doc").withColumnRenamed("n_chars", "part")
    out = substrings.cut_repeats(docs, with_text=True)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        if r.kept is not None:
            assert H.sha(bytes(r.kept)) == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
    expected = H.cut(rows)
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in expected.items()}
    assert substrings.cut_repeats(docs.limit(0)).count() == 0


def test_substrings_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 150)
    r = random.Random(9)
    part = "".join(r.choice("abcdefgh ") for _ in range(420))
    rows = [(1, "k" * 7 + part), (2, part[100:] + "tail"), (3, part[:210])]
    docs = sorted((d, 0, t.encode()) for d, t in rows)
    batch = substrings._runs_of(docs).to_pydict()
    assert max(p >> 8 for p in batch["place"]) > 150
    got = {r.doc_id: [tuple(r)[1:]] for r in substrings.cut_repeats(H.table(spark, rows)).collect()}
    assert got == H.cut(rows)


def test_keep_one_links_away_from_the_leader(spark, monkeypatch):
    """Members of a family that link with each other but not with its least document, and
    chains whose ends do not link."""
    monkeypatch.setattr(ngram_join, "GROUP", 2)
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    rows = []
    for f in range(6):
        base = [word() for _ in range(200)]
        rows.append((100 * f, " ".join(base[:130] + [word() for _ in range(70)])))  # shares much, links with none
        for i in range(1, 12):
            own = list(base)
            own[150 + i] = word()
            rows.append((100 * f + i, " ".join(own)))
        for i in range(20, 40):  # each shifted by ten words against the one before
            rows.append((100 * f + i, " ".join(base[i - 20:] + [f"t{f}x{j}" for j in range(i - 20)])))
    expected = H.components(rows, 5, 80)
    assert len({c for _, _, c, _ in expected}) < len(rows) / 2
    kept = ngram_join.keep_one(H.table(spark, rows), 5, 80)
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for _, _, c, _ in expected})
    found = ngram_join.join(H.table(spark, rows), 5, 80, count_links=False)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found.collect()) == [e[:3] for e in expected]
