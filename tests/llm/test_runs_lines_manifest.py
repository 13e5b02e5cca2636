"""Periodic runs, line de-duplication and the Merkle manifest against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelake.llm import line_dedup, merkle, periodic
from tests.llm import helpers as H


def brute_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, size = i, j + q - i
            if size >= max(6, 4 * q) and not any(all(w[s + k] == w[s + k + r] for k in range(size - r)) for r in range(1, q)):
                out.add((s, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(words, doc_id):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def run_row(doc_id, text):
    w = planted(H.WORD.findall(text or ""), doc_id)
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            H.sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), H.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_texts(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        size, k = r.choice([0, 1, 5, 6, 7, 20, 50, 120]), r.choice([1, 2, 3, 30])
        w = [r.choice("abcdefghijklmnopqrstuvwxyzäöü"[:k]) for _ in range(size)]
        for _ in range(r.randint(0, 3)):
            if size > 8:
                a = r.randrange(size)
                p = r.randint(1, max(1, (size - a) // 4))
                for i in range(a, min(size, a + p * r.randint(3, 9))):
                    w[i] = w[a + (i - a) % p]
        out.append(r.choice([" ", "\n", " \t"]).join(w))
    return out


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def test_periodic_rows(spark):
    awkward = [(d, t) for d, t in H.awkward() if len(t or "") < 10_000]
    rows = awkward + list(enumerate(periodic_texts(1, 400), 100)) + [(90, "x " * 60), (91, "a b " * 5 + "c " * 6)]
    got = periodic.periodic_runs(H.table(spark, rows).withColumnRenamed("lang", "start"), plant=True)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((run_row(d, t) for d, t in rows), key=key)
    assert sum(run_row(d, t)[1] for d, t in rows) > 100
    assert periodic.periodic_runs(H.table(spark, rows).limit(0)).count() == 0


def test_periodic_slabs_and_long_texts(monkeypatch):
    texts = [t.encode() for t in periodic_texts(2, 60)]
    whole = [f for _, f, _ in periodic.scan(texts)]
    monkeypatch.setattr(periodic, "SLAB", 64)
    assert [f for _, f, _ in periodic.scan(texts)] == whole
    monkeypatch.undo()
    words = [f"w{i % 40_000}" for i in range(200_000)]
    _, found, _ = periodic.scan([" ".join(words).encode()])[0]
    assert found == [(0, 200_000, 40_000)]
    assert periodic.scan([b"z " * 500_000])[0][1] == [(0, 500_000, 1)]


def test_transform_is_exact():
    import numpy as np
    r = np.random.default_rng(3)
    for size in (2, 8, 64):
        x = r.integers(0, periodic.PRIME, (size, 3))
        back = periodic._backward(periodic._forward(x.copy())) * pow(size, periodic.PRIME - 2, periodic.PRIME) % periodic.PRIME
        assert (back == x).all()


def drop(rows, least):
    fold = lambda l: H.lower_ascii(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", l))
    count = Counter(k for _, t in rows for k in {fold(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if count[fold(x)] < least]
        out.append((d, "\n".join(kept), len(own), len(own) - len(kept)))
    return out


@pytest.mark.parametrize("least,batches,fanout,heavy", [(10, 6, 2, 100_000), (3, 5, 3, 2), (1, 2, 2, 100_000)])
def test_line_dedup_rows(spark, monkeypatch, least, batches, fanout, heavy):
    monkeypatch.setattr(line_dedup, "HEAVY_KEYS", heavy)
    r = random.Random(least)
    lines = [f"{'Line' if i % 2 else 'ÀÉ İK'} {i}" for i in range(40)] + ["", " ", "\t", "Ω", "à", "À"]
    rows = H.awkward() + [(d, "\n".join(r.choice(["", " ", "\x0b"]) + r.choice([str.lower, str, str.upper])(x)
                                        for x in r.choices(lines, k=r.randint(0, 9)))) for d in range(100, 220)]
    docs = H.table(spark, rows).withColumnRenamed("lang", "pos").withColumnRenamed("n_chars", "n_lines")
    out = line_dedup.drop_lines(docs, least, batches, fanout)
    assert out.columns == [*docs.columns, "_n_lines", "n_dropped"]
    got = sorted(((x.doc_id, x.text, x[-2], x[-1]) for x in out.collect()), key=key)
    assert got == sorted(drop(rows, least), key=key)
    assert sum(x[3] for x in got) > 50
    assert line_dedup.drop_lines(docs.limit(0)).count() == 0


def test_line_runs_levels(spark):
    store = line_dedup.LineRuns(spark, min_docs=5, fanout=2)
    batches = [[(f"k{i}",) for i in range(lo, lo + 30)] for lo in (0, 10, 20, 0, 10)]
    frames = [spark.createDataFrame(b, "s string").select(F.col("s").cast("binary").alias("k")) for b in batches]
    for f in frames:
        store.add(f)
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert store.unseen(frames[0]).count() == 0 and store.unseen(frames[0], 4).count() == 20
    plan = store._merged(store.runs()).groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") <= 1  # the merge itself shuffles no run
    count = Counter(k for b in batches for k, in b)
    assert {bytes(x.k).decode() for x in store.frequent().collect()} == {k for k, n in count.items() if n >= 5}
    store.close()
    assert store.runs() == []


def manifest(rows):
    """{row: results} by plain recursion; rows (doc_id, text, lang, source, n_chars, text now)."""
    digest = lambda *x: H.sha("".join(x))
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for d, text, lang, source, n, now in rows:
        head = [part(d), part(source), part(lang), part(n)]
        leaf = digest(*head, part(text))
        by.setdefault(source, []).append(((d is not None, d or 0), leaf, leaf if now is None else digest(*head, part(now)), d))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[1] for x in sorted(by[s], key=lambda x: x[:2])]) for s in order}
    upper = levels([trees[s][-1][0] for s in order])
    root, out = upper[-1][0], []
    for at, s in enumerate(order):
        for i, (_, leaf, now, d) in enumerate(sorted(by[s], key=lambda x: x[:2])):
            fold, proof = now, []
            for tree, pos in ((trees[s], i), (upper, at)):
                for level in tree[:-1]:
                    g = pos // 16 * 16
                    run, j = level[g:g + 16], pos - g
                    proof += run[:j] + run[j + 1:]
                    fold = digest(*run[:j], fold, *run[j + 1:])
                    pos //= 16
            out.append((d, leaf, trees[s][-1][0], root, digest(*proof), fold, fold == root))
    return sorted(out, key=key)


def check_manifest(spark, rows):
    fields = [*H.DOCS.split(", "), "now string"]
    docs = spark.createDataFrame([(d, t, l, s, n, w) for d, t, l, s, n, w in rows], ", ".join(fields)).repartition(3)
    got = merkle.verify(docs.withColumn("leaf", F.lit(1)), F.col("now")).collect()
    assert sorted(map(tuple, got), key=key) == manifest(rows)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17, 1], [300, 1, 40], [3] * 40, [270] + [1] * 20])
def test_merkle_rows(spark, sizes):
    rows = [(1000 * i + j, f"Text É {i} {j}", "en" if j % 3 else None, f"sé{i}" if i else None, j if j % 5 else None,
             f"text é {i} {j}" if j % 4 == 0 else None) for i, n in enumerate(sizes) for j in range(n)]
    check_manifest(spark, rows)


def test_merkle_awkward_rows(spark):
    rows = [(d, t, "en", f"s{(d or 0) % 3}" if d != 4 else None, None, None if t is None else H.lower_ascii(t)) for d, t in H.awkward()]
    check_manifest(spark, rows)
    docs = H.table(spark, H.awkward())
    assert merkle.verify(docs.limit(0)).count() == 0


def test_merkle_hot_nodes_are_copied(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 4)
    docs = H.table(spark, [(i, f"t{i}") for i in range(0, 24_000, 4)])  # sources of 5,999 leaves and one
    tree = merkle.build(merkle.leaves(docs))
    ids = [r.id for r in tree.nodes.select("id").collect()]
    assert Counter(i.split("/")[0] for i in ids) == {"d2": 24, "d3": 8, "d4": 4, "s1": 4}
    done = merkle.climb(tree)
    assert done.where(F.col("folded_root") == tree.root).count() == 6000
