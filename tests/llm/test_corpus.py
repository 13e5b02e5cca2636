"""Mixing, archives, tokenizer and the pipeline."""

import gzip
import io
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from pagelake.llm import archives, bpe, mixing
from pagelake.llm.common import scratch
from tests.conftest import SF_SMALL
from tests.llm import helpers as H


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _odd_texts(seed=1, n=400):
    r = random.Random(seed)
    pool = [chr(x) for x in [*range(0x300), 0x2028, 0x3000, 0x180E, 0x200B, 0xFEFF, 0x1F600, 0x4E2D, 0x660, 0x2160, 0x88F, 0x323B0]]
    texts = ["".join(r.choice(pool) if r.random() < 0.5 else r.choice(" a b1'\n\t  ") for _ in range(r.randint(0, 60))) for _ in range(n)]
    anywhere = lambda: chr(r.choice([r.randrange(0xD800), r.randrange(0xE000, 0x110000)]))
    return texts + ["".join(anywhere() for _ in range(30)) for _ in range(n)] + ["a" * 50_000, "ab " * 400_000, "<|endoftext|>"]


def test_perfect_hash(ranks):
    keys = list(ranks)[:3000]
    whole = bpe.PerfectHash(keys)
    assert sorted(whole.find(keys)) == list(range(len(keys)))
    assert whole.find([b"\xff\xfe not a key", b""]) == [-1, -1]


def test_codec_equals_reference(ranks, reference):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN, bpe.PerfectHash(list(ranks)))
    for text in _odd_texts():
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_round_trip(spark, reference):
    rows = H.awkward() + list(enumerate(_odd_texts(2, 60), 1000))
    docs = H.table(spark, rows).withColumnRenamed("lang", "ids").withColumnRenamed("n_chars", "n_tokens")
    expected = []
    for d, t in rows:
        ids = reference.encode_ordinary(t or "")
        expected.append((d, len(ids), H.sha(",".join(map(str, ids))), H.sha(t or "")))
    assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=repr) == sorted(expected, key=repr)
    tokens = bpe.encode(docs)
    back = sorted(((r.doc_id, bytes(r.bytes)) for r in bpe.decode(tokens).collect()), key=repr)
    assert back == sorted(((d, (t or "").encode()) for d, t in rows), key=repr)
    assert bpe.round_trip(docs.limit(0)).count() == 0


def _level(sizes, weights, budget):
    full = set()
    while True:
        rest = sum(w for s, w in weights.items() if s not in full)
        level = (budget - sum(2 * sizes[s] for s in full)) / rest if rest else 0
        more = {s for s in sizes if s not in full and 2 * sizes[s] <= level * weights[s]}
        if not more:
            return {s: 2 * sizes[s] if s in full else level * weights[s] for s in sizes}
        full |= more


def test_mix_targets_and_limits(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randint(0, 40))) for i in range(1500)]
    names = ["a", "B", "c", None, "d", "é"]
    full = [(d, t, "en", r.choice(names + ["a"] * 4), 0) for d, t in rows]
    docs = spark.createDataFrame(full, H.DOCS).repartition(4)
    sizes = {}
    for _, t, _, s, _ in full:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    ordered = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(ordered)}
    want = _level(sizes, weights, 1.5 * sum(sizes.values()))
    plan = mixing.mix(docs).collect()
    source = {d: s for d, _, _, s, _ in full}
    took = {s: 0 for s in sizes}
    for x in plan:
        assert x.taken in (0, x.size, 2 * x.size) and x.source_size == sizes[source[x.doc_id]]
        assert abs(x.target - want[source[x.doc_id]]) < 1e-5
        took[source[x.doc_id]] += x.taken
    assert all(abs(took[s] - want[s]) <= 80 for s in sizes)
    assert sorted(map(tuple, mixing.mix(docs.repartition(2)).drop("uid").collect())) == sorted(tuple(x)[:1] + tuple(x)[2:] for x in plan)
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    assert sorted(x.doc_id for x in out.collect()) == sorted(x.doc_id for x in plan for _ in range(x.turns))


def test_mix_awkward_rows(spark):
    docs = H.table(spark, H.awkward()).withColumnRenamed("lang", "turns").withColumnRenamed("n_chars", "size")
    plan = mixing.mix(docs).collect()
    assert len(plan) == len(H.awkward())
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    words = sum(len(H.WORD.findall(x.text or "")) for x in out.collect())
    assert words == sum(x.taken for x in plan)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.apply_mix(docs.limit(0)).count() == 0


PAGES = [(5, "http://a/x y", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (9, None, None), (8, "http://c", ""),
         (None, "http://d", "<p>é</p>"), (7, "u", "a\r\n\r\nWARC/1.1\nfiledesc: x\n\n"), (11, "u2", "z" * 300_000),
         (7, "u", "a\r\n\r\nWARC/1.1\nfiledesc: x\n\n"), (12, "u2", "z" * 300_000)]


@pytest.mark.parametrize("version,per_file", [(1, 1000), (2, 2)])
def test_archives(spark, monkeypatch, version, per_file):
    monkeypatch.setattr(archives, "FILE_RECORDS", per_file)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    archives.write_arc(pages, arc, version)
    archives.convert(spark, arc, warc)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest)
                  for r in archives.page_records(archives.read_warc(spark, warc)).collect()), key=repr)
    digest = {p: archives.base32_sha1((h or "").encode()) for p, _, h in PAGES}
    kind = {3: [("response", None)], 5: [("revisit", 3)], None: [("revisit", 3)], 8: [("response", None)], 9: [("revisit", 8)],
            7: [("response", None), ("revisit", 7)], 11: [("response", None)], 12: [("revisit", 11)]}
    expected = [(p, len(next((h or "").encode() for q, _, h in PAGES if q == p)), k, to, digest[p])
                for p, ks in kind.items() for k, to in ks]
    assert got == sorted(expected, key=repr)
    payloads = archives.read_warc(spark, warc, payloads=True).where("record_type = 'response'").collect()
    assert sorted((r.page_id, r.payload) for r in payloads) == sorted({(p, h or "") for p, _, h in PAGES if p in (3, 7, 8, 11)})


def test_archives_empty_and_bad(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    archives.write_arc(pages, arc)
    archives.convert(spark, arc, warc)
    assert archives.page_records(archives.read_warc(spark, warc)).count() == 0
    with pytest.raises(ValueError):
        list(archives.parse_arc(io.BytesIO(b"filedesc://x 0.0.0.0 1 text/plain 10\n3 0 x\nA B\n")))
    with pytest.raises(ValueError):
        list(archives.parse_warc(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))))


def test_pipeline_stages(spark, reference):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, texts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.spill(stage(spark, docs, SF_SMALL), name)
        after = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == columns and {r.doc_id for r in after} <= {r.doc_id for r in before}
        if name == "exact_dedup":
            least = {}
            for r in before:
                key = H.SPACE.sub(" ", r.text or "")
                least[key] = min(least.get(key, r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(least.values())
        if name == "ngram_join":
            expected = {c for _, _, c, _ in H.components([(r.doc_id, r.text) for r in before], 5, 80)}
            assert sorted(r.doc_id for r in after) == sorted(expected)
        if name == "mixing":
            words = lambda rows: sum(len(H.WORD.findall(r.text or "")) for r in rows)
            assert words(after) <= 1.5 * words(before)
            texts = {r.doc_id: r.text for r in after}
        if name == "byte_bpe":
            assert len(after) == len(before)
            for r in after[:40]:
                ids = reference.encode_ordinary(texts[r.doc_id] or "")
                assert (r.n_tokens, r.ids_sha256) == (len(ids), H.sha(",".join(map(str, ids))))


def test_pipeline_empty(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.spill(stage(spark, docs, SF_SMALL), name)
        assert docs.count() == 0


def test_pipeline_awkward_rows(spark):
    """Nulls in any column, blanks, a long text, ties, repeated rows, and extra columns
    whose names clash with the stages' own."""
    real = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = H.awkward() + [(50, "one two three four five six"), (50, "one two three four five six"), (51, "ONE two three four five  six")]
    docs = H.table(spark, odd).select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        real.limit(60).select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", real["doc_id"] + 1000))
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    extra = {c: docs["doc_id"] for c in ("node", "score", "sha", "turns", "component_id", "size", "kept")}
    docs = corpus_pipeline.spill(docs.withColumns(extra), "awkward")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.spill(stage(spark, docs, SF_SMALL), name)
        after = docs.collect()
        seen.append((name, len(before), len(after)))
        if name == "byte_bpe":
            assert len(after) == len(before)
            continue
        assert docs.columns == columns
        assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "exact_dedup":
            kinds = {H.SPACE.sub(" ", r.text or "") for r in before}
            assert sorted(H.SPACE.sub(" ", r.text or "") for r in after) == sorted(kinds)
        if name == "ngram_join":  # documents without words all stay
            assert sum(not H.WORD.findall(r.text or "") for r in after) == sum(not H.WORD.findall(r.text or "") for r in before)
        if name == "mixing":
            words = lambda rows: sum(len(H.WORD.findall(r.text or "")) for r in rows)
            assert words(after) <= 1.5 * words(before)
    assert seen[0][1] == len(odd) + 61 and seen[0][2] >= len(odd) + 40
