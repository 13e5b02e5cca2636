"""Repeated passages by suffix buckets, refined by content hashes.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts
earlier in the corpus (in a smaller document, or further up in the same one).
Suffix positions are put into buckets by q-gram, and buckets with more than one
string of ``LENGTH`` bytes are refined by a hash of that string; there are no
rounds of pointers to the bucket ids of later offsets.

Not every position needs a bucket.  Of each window of ``LENGTH`` bytes the
q-gram with the smallest hash decides, so equal windows meet in the bucket of
the same q-gram, and neighbouring windows with the same q-gram form one run:
about two rows for every ``LENGTH - Q`` bytes.

1. ``runs``: each document's runs, (gram, run) being the identifiers of its
   q-gram and of all its bytes.  Runs that repeat inside an Arrow batch are
   settled there, which keeps a passage of a third of all documents from
   travelling once per document.
2. The q-gram buckets meet in one shuffle and are refined by run: every later
   run with equal bytes goes whole.  What is left to decide are buckets with
   different runs (where a match starts or ends), some per cent of all rows.
3. For those alone the bytes are fetched, and identifiers of 8 bytes are
   doubled to 16, 32, 64 and ``LENGTH``; a window whose identifier came earlier
   goes, after a comparison of the bytes.  Buckets with very many different
   runs are split by salt; what is first in its split is settled across splits
   by one more (map-side combined) grouping.
4. The spans of a document are merged and cut out.

Whole copies of a text never enter the buckets: they go at once by digest.

Identifiers of grams and runs are 64-bit hashes of the bytes.  Texts are
shuffled only for documents with something to decide or to cut.

Defined results: null text has no bytes; rows that repeat doc_id and text are
copies of one another; of different texts under one doc_id the order is that
of their hash; a null doc_id comes last; texts shorter than ``LENGTH`` lose
nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import bounded_broadcast, documents, map_batches, register, spill, text_or_empty

LENGTH, Q = 100, 32
#: Window starts that one call of the run finder takes; longer texts come in several.
BLOCK = 1 << 18
#: Bytes of text whose runs are settled together, and of contexts refined together.
BATCH_BYTES, CONTEXT_BYTES = 8 << 20, 2 << 20
#: Different runs of a bucket from which it is split, and ids that are broadcast at most.
BUCKET_ROWS, ID_LIMIT = 50_000, 1_000_000
LAST = (1 << 63) - 1

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64, from the zeroth."""
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(BLOCK + LENGTH, base, np.uint64))))


_POWER, _UNPOWER = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    rest = width - done
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def find_runs(data: np.ndarray):
    """(gram, run, first window, windows) of the runs of a byte array of at
    most BLOCK + LENGTH - 1 bytes."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWER[:n], out=total[1:])
    gram = _mix((total[Q:] - total[:n - Q + 1]) * _UNPOWER[:n - Q + 1])
    bits = _U(20)
    keys = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)  # ties go to the left
    anchor = (_sliding_min(keys, LENGTH - Q + 1) & _U((1 << 20) - 1)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
    windows = np.diff(np.concatenate((first, [len(anchor)])))
    end = first + windows + LENGTH - 1
    run = _mix((total[end] - total[first]) * _UNPOWER[first] + (end - first).astype(np.uint64))
    return gram[anchor[first]], run, first, windows


def _merged(doc: np.ndarray, lo: np.ndarray, end: np.ndarray):
    """Maximal spans of rows ordered by (doc, lo) whose ends do not fall within a document."""
    if not len(doc):
        return doc, lo, end
    cut = np.concatenate(([True], (doc[1:] != doc[:-1]) | (lo[1:] > end[:-1])))
    last = np.concatenate((np.flatnonzero(cut)[1:] - 1, [len(doc) - 1]))
    return doc[cut], lo[cut], end[last]


def _runs_of(docs: list[tuple[int, int, bytes]]):
    """Rows (gram, run, doc, part, place) of some documents: place packs the
    first window, the number of windows and a bit that marks spans already
    settled here (their end is then in ``run``)."""
    docs = sorted(docs)
    parts = []
    for i, (_, _, text) in enumerate(docs):
        data = np.frombuffer(text, np.uint8)
        for at in range(0, len(data) - LENGTH + 1, BLOCK):
            gram, run, first, windows = find_runs(data[at:at + BLOCK + LENGTH - 1])
            parts.append((gram, run, np.full(len(gram), i), first + at, windows))
    if not parts:
        return None
    gram, run, owner, first, windows = (np.concatenate(c) for c in zip(*parts))
    key = _mix(gram ^ (run * _U(_BASE)))
    order = np.argsort(key, kind="stable")  # ties stay in order of document and place
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    o, lo, end = _merged(owner[again], first[again], (first + windows + LENGTH - 1)[again])
    doc, part = (np.array([d[k] for d in docs], np.int64) for k in (0, 1))
    new = ~again
    spread = _mix(doc[o].view(np.uint64) * _U(_BASE) + lo.astype(np.uint64))
    columns = [np.concatenate((gram[new], spread)).view(np.int64), np.concatenate((run[new].view(np.int64), end)),
               np.concatenate((doc[owner[new]], doc[o])), np.concatenate((part[owner[new]], part[o])),
               np.concatenate((first[new] << 8 | windows[new] << 1, lo << 8 | 1))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "run", "doc", "part", "place"])


def _run_batches(batches):
    for b in batches:
        held, size = [], 0
        for doc, part, text in zip(b.column("doc").to_pylist(), b.column("part").to_pylist(), b.column("text")):
            text = text.as_py().encode()
            held.append((doc, part, text))
            size += len(text)
            if size > BATCH_BYTES:
                if (rows := _runs_of(held)) is not None:
                    yield rows
                held, size = [], 0
        if held and (rows := _runs_of(held)) is not None:
            yield rows


def runs(texts: DataFrame) -> DataFrame:
    return map_batches(texts, _run_batches, "gram long, run long, doc long, part long, place long")


def identifiers(data: np.ndarray) -> np.ndarray:
    """Identifier of the LENGTH bytes at every place of a byte array: those of
    8 bytes, doubled by pairing each with the one at the later offset."""
    n = len(data) - 7
    ids = np.zeros(max(n, 0), np.uint64)
    for j in range(8):
        ids |= data[j:j + n].astype(np.uint64) << _U(8 * j)
    ids, size = _mix(ids), 8
    while size < LENGTH:
        step = min(size, LENGTH - size)
        ids = _mix(ids[:-step] * _U(_BASE) + (ids[step:] ^ _U(size)) * _U(0xD6E8FEB86659FD93))
        size += step
    return ids


def _refine(rows: list[tuple]):
    """Spans that go, and the firsts of split buckets, among whole buckets of
    rows (gram, salt, split, doc, part, at, context) ordered by document."""
    data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
    size = np.array([len(r[6]) for r in rows], np.int64)
    begin = np.cumsum(size) - size
    windows = size - LENGTH + 1
    row = np.repeat(np.arange(len(rows)), windows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    where = begin[row] + place
    bucket = np.array([hash((r[0], r[1])) for r in rows], np.int64).view(np.uint64)
    ids = identifiers(data)[where]
    key = _mix(ids ^ (bucket[row] * _U(_BASE)))
    order = np.argsort(key, kind="stable")
    opens = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
    first = np.empty(len(key), np.int64)
    first[order] = order[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
    later = np.flatnonzero(first != np.arange(len(key)))
    span = np.arange(LENGTH)
    for at in range(0, len(later), 50_000):  # the bytes decide
        some = later[at:at + 50_000]
        if (data[where[some][:, None] + span] != data[where[first[some]][:, None] + span]).any():
            seen: dict[tuple, int] = {}  # two strings share an identifier: take the bytes themselves
            first = np.array([seen.setdefault((b, data[w:w + LENGTH].tobytes()), i)
                              for i, (b, w) in enumerate(zip(bucket[row].tolist(), where.tolist()))], np.int64)
            later = np.flatnonzero(first != np.arange(len(key)))
            break
    at = np.array([r[5] for r in rows], np.int64)
    lo = at[row[later]] + place[later]
    o, lo, end = _merged(row[later], lo, lo + LENGTH)
    doc, part = (np.array([r[k] for r in rows], np.int64) for k in (3, 4))
    split = np.array([r[2] for r in rows], bool)
    firsts = np.flatnonzero((first == np.arange(len(key))) & split[row])
    n, m = len(o), len(firsts)
    columns = [np.concatenate((np.ones(n, bool), np.zeros(m, bool))),
               np.concatenate((np.zeros(n, np.int64), ids[firsts].view(np.int64))),
               np.concatenate((doc[o], doc[row[firsts]])), np.concatenate((part[o], part[row[firsts]])),
               np.concatenate((lo, at[row[firsts]] + place[firsts])),
               np.concatenate((end, at[row[firsts]] + place[firsts] + LENGTH))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["settled", "id", "doc", "part", "lo", "end"])


def _refine_batches(batches):
    held, size, bucket = [], 0, None
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("gram", "salt", "split", "doc", "part", "at", "context")]
        for r in zip(*columns):
            if r[:2] != bucket and size > CONTEXT_BYTES:  # only between buckets
                yield _refine(held)
                held, size = [], 0
            bucket = r[:2]
            held.append(r)
            size += len(r[6])
    if held:
        yield _refine(held)


def _context_batches(batches):
    for b in batches:
        out: list[list] = [[] for _ in range(7)]
        for doc, part, text, wanted in zip(b.column("doc").to_pylist(), b.column("part").to_pylist(), b.column("text"),
                                           b.column("wanted")):
            data = text.as_py().encode()
            for w in wanted.as_py():
                for c, v in zip(out, (w["gram"], w["salt"], w["split"], doc, part, w["at"],
                                      data[w["at"]:w["at"] + w["windows"] + LENGTH - 1])):
                    c.append(v)
            if len(out[0]) > 20_000:
                yield _context_rows(out)
                out = [[] for _ in range(7)]
        yield _context_rows(out)


def _context_rows(out):
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                      ["gram", "salt", "split", "doc", "part", "at", "context"])


def _cut_batches(batches):
    for b in batches:
        made = []
        for doc, part, text, spans in zip(b.column("doc").to_pylist(), b.column("part").to_pylist(), b.column("text"),
                                          b.column("spans")):
            data = text.as_py().encode()
            merged: list[list[int]] = []
            for s in sorted((s["lo"], s["end"]) for s in spans.as_py()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            edges = [0, *(x for s in merged for x in s), len(data)]
            kept = b"".join(data[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2))
            made.append((doc, part, len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept,
                         [{"lo": s[0], "end": s[1]} for s in merged]))
        if made:
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(),
                                        pa.list_(pa.struct([("lo", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)],
                                             ["doc", "part", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


def _order_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


class Corpus:
    """The rows of a table: ``slim`` has one per row, without texts; ``firsts``
    gives the text of each different (document, text) that is no copy."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select(_order_key().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"),
                                text_or_empty("text").alias("text"))
        sha = F.sha2(F.col("text").cast("binary"), 256)
        slim = spill(self.docs.select("doc", "doc_id", F.xxhash64("text").alias("part"), sha.alias("sha"),
                                      F.octet_length("text").cast("long").alias("n_bytes"),
                                      F.monotonically_increasing_id().alias("row")), "slim")
        first = slim.groupBy("sha").agg(F.min(F.struct("doc", "part", "row")).alias("first"), F.count("*").alias("n"))
        repeated = spill(first.where("n > 1"), "repeated")
        copied = slim.join(bounded_broadcast(repeated, ID_LIMIT), "sha")
        is_first = F.col("row") == F.col("first.row")
        self.copies = spill(copied.where(~is_first).select("doc", "part", "row", "doc_id", "n_bytes", "sha"), "copies")
        self.slim = slim.join(self._small(self.copies.select("row")), "row", "left_anti")
        # rows that repeat both doc_id and text: one of them stands for all
        same = copied.where(is_first).select("doc", "part").join(self.copies.select("doc", "part"), ["doc", "part"], "left_semi")
        self.same = spill(same.distinct(), "same")
        self.any_same = not self.same.isEmpty()

    def _small(self, ids: DataFrame) -> DataFrame:
        return bounded_broadcast(ids, ID_LIMIT)

    def firsts(self, only: DataFrame | None = None) -> DataFrame:
        """(doc, part, text), of the documents in ``only`` where it is given."""
        texts = self.docs.select("doc", F.xxhash64("text").alias("part"), "text")
        if only is not None:
            texts = texts.join(self._small(only), ["doc", "part"], "left_semi")
        once = texts.join(self._small(self.copies.select("doc", "part").distinct()), ["doc", "part"], "left_anti")
        if not self.any_same:
            return once
        again = texts.join(self._small(self.same), ["doc", "part"], "left_semi").groupBy("doc", "part").agg(
            F.first("text").alias("text"))
        return once.unionByName(again)


def repeated_spans(corpus: Corpus) -> DataFrame:
    """(doc, part, lo, end): spans of bytes that go, possibly overlapping."""
    by_run, by_gram = Window.partitionBy("gram", "run"), Window.partitionBy("gram")
    rows = (runs(corpus.firsts()).repartition("gram")
            .withColumn("settled", F.col("place").bitwiseAND(F.lit(1).cast("long")) == 1)
            .withColumn("at", F.shiftright("place", 8)).withColumn("windows", F.shiftright("place", 1).bitwiseAND(F.lit(127).cast("long")))
            .drop("place"))
    me = F.struct("doc", "part", "at")
    rows = rows.withColumn("first", me == F.min(me).over(by_run))
    rows = rows.withColumn("runs", F.sum(F.col("first").cast("long")).over(by_gram))
    marks = spill(rows.where("settled OR NOT first OR runs > 1"), "marks")
    gone = marks.where("settled OR NOT first").select(
        "doc", "part", F.col("at").alias("lo"),
        F.when(F.col("settled"), F.col("run")).otherwise(F.col("at") + F.col("windows") + LENGTH - 1).alias("end"))
    splits = F.ceil(F.col("runs") / BUCKET_ROWS)
    open_ = (marks.where("NOT settled AND first AND runs > 1")
             .select("doc", "part", F.struct("gram", F.pmod(F.xxhash64("doc", "part", "at"), splits).cast("int").alias("salt"),
                                             (splits > 1).alias("split"), "at", "windows").alias("w"))
             .groupBy("doc", "part").agg(F.collect_list("w").alias("wanted")))
    open_ = spill(open_, "open")
    contexts = map_batches(corpus.firsts(open_.select("doc", "part")).join(open_, ["doc", "part"]), _context_batches,
                           "gram long, salt int, split boolean, doc long, part long, at long, context binary")
    contexts = contexts.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "doc", "part", "at")
    refined = spill(map_batches(contexts, _refine_batches,
                                "settled boolean, id long, doc long, part long, lo long, end long"), "refined")
    heads = refined.where("NOT settled")
    me = F.struct("doc", "part", "lo")
    winners = heads.groupBy("id").agg(F.min(me).alias("winner"), F.count("*").alias("n")).where("n > 1")
    across = heads.join(winners, "id").where(me != F.col("winner")).select("doc", "part", "lo", "end")
    return gone.unionByName(refined.where("settled").select("doc", "part", "lo", "end")).unionByName(across)


def cut_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; with
    ``with_text`` also the spans and the bytes that stay, for the rows that
    lose some but not all."""
    corpus = Corpus(docs)
    spans = repeated_spans(corpus).groupBy("doc", "part").agg(F.collect_list(F.struct("lo", "end")).alias("spans"))
    spans = spill(spans, "spans")
    cut = map_batches(corpus.firsts(spans.select("doc", "part")).join(spans, ["doc", "part"]), _cut_batches,
                      "doc long, part long, n_removed long, n_spans long, kept_sha256 string, kept binary, "
                      "spans array<struct<lo: long, end: long>>")
    extra = ["spans", "kept"] if with_text else []
    cut = spill(cut.select("doc", "part", "n_removed", "n_spans", "kept_sha256", *extra), "cut")
    zero = F.lit(0).cast("long")
    stay = corpus.slim.join(cut, ["doc", "part"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *extra)
    whole = F.col("n_bytes") >= LENGTH
    empty = hashlib.sha256(b"").hexdigest()
    lost = corpus.copies.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(zero).alias("n_removed"),
        whole.cast("long").alias("n_spans"), F.when(whole, F.lit(empty)).otherwise(F.col("sha")).alias("kept_sha256"),
        *[F.lit(None).cast(cut.schema[c].dataType).alias(c) for c in extra])
    return stay.unionByName(lost)


@register("op6_substring_dedup")
def op6_substring_dedup(spark, sf_dir):
    return cut_repeats(documents(spark, sf_dir))
