"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by the vocabulary's pattern.  Tier one is a
minimal perfect hash over the vocabulary: a pre-token that is a token as a
whole is resolved by one probe (vectorised over a batch of distinct
pre-tokens) and a comparison with the key stored in its slot.  Tier two takes
the misses: their bytes form a linked list, a heap holds the adjacent pairs by
rank, and the lowest rank, leftmost first, is merged until none is left, which
is O(n log n) for a pre-token of n bytes.

Spark partitions the documents; a task reads Arrow batches and keeps a bounded
memo of resolved pre-tokens.  The vocabulary (about 50,000 entries, fixed by
its file and independent of the corpus) is read on the driver from the path
given and broadcast.  Nothing is shuffled.

Defined results: null text counts as empty (no tokens, digests of the empty
string); texts of any length are encoded whole, long ones in runs of matches;
unpaired surrogates cannot occur in Spark strings; rows are independent, so
repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import documents, map_batches, register, text_or_empty

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens and bytes that a worker's memo holds at most.
MEMO_WORDS, MEMO_BYTES = 300_000, 8 << 20
#: Characters of text resolved together, and matches of a longer text.
RUN_CHARS, RUN_MATCHES = 1 << 20, 200_000

#: Letters and digits of Unicode versions after 16.0, which the tokenizer
#: library does not count as such while the regex module does.
NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2"
    r"\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7"
    r"\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    r"\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    r"\U00016ff2-\U00016ff3\U00016ff4-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    r"\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    r"\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    r"\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)

_U = np.uint64
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, all at once."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = size.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    full = np.flatnonzero(size)
    if len(full):
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
        start = np.cumsum(size[full]) - size[full]
        power = np.cumprod(np.concatenate(([1], np.full(int(size.max()) - 1, 0x100000001B3))).astype(np.uint64))
        place = np.arange(len(flat)) - np.repeat(start, size[full])
        out[full] += np.add.reduceat((flat + _U(1)) * power[place], start)
    for m, s in zip(_MIX, (30, 27)):
        out = (out ^ (out >> _U(s))) * m
    return out ^ (out >> _U(31))


class PerfectHash:
    """Minimal perfect hash by displacement: as many slots as keys.

    Keys fall into buckets; the largest buckets first, each gets the first
    displacement that puts its keys into free slots.  Buckets of one key point
    at a free slot directly.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = max(1, n), max(1, n // 4)
        h = hash_words(keys)
        self.shift = np.zeros(self.buckets, np.int64)
        self.key_hash = np.zeros(self.n, np.uint64)
        self.key_at: list[bytes | None] = [None] * self.n
        bucket = (h % _U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = [g for g in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(g)]
        free = np.ones(self.n, bool)
        spare = None
        for g in sorted(groups, key=len, reverse=True):
            if len(g) == 1:
                if spare is None:
                    spare = iter(np.flatnonzero(free).tolist())
                slots, d = [next(spare)], None
                self.shift[bucket[g[0]]] = -slots[0] - 1
            else:
                d, step = 0, 64
                while True:  # try a block of displacements at a time
                    tried = self._slot(h[g][None, :], np.arange(d, d + step)[:, None])
                    good = free[tried].all(axis=1) & (np.diff(np.sort(tried, axis=1), axis=1) > 0).all(axis=1)
                    if good.any():
                        break
                    d, step = d + step, min(step * 2, 4096)
                d += int(good.argmax())
                slots = tried[good.argmax()].tolist()
                self.shift[bucket[g[0]]] = d
            free[slots] = False
            for s, k in zip(slots, g.tolist()):
                self.key_hash[s], self.key_at[s] = h[k], keys[k]

    def _slot(self, h, d):
        return (((h >> _U(20)) + np.asarray(d).astype(np.uint64) * ((h >> _U(7)) | _U(1))) % _U(self.n)).astype(np.int64)

    def find(self, words: list[bytes]) -> list[int]:
        """Slot of each word, -1 where it is no key."""
        if not words:
            return []
        h = hash_words(words)
        d = self.shift[(h % _U(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, self._slot(h, np.maximum(d, 0)))
        slot[self.key_hash[slot] != h] = -1
        return [s if s >= 0 and self.key_at[s] == w else -1 for s, w in zip(slot.tolist(), words)]


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a pre-token: a heap of pairs over linked bytes."""
    n = len(word)
    after = list(range(1, n + 1))  # start of the part behind the one that starts here
    before = list(range(-1, n - 1))
    rank = ranks.get
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(word[i:i + 2])) is not None]
    heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, i, j, k = heappop(heap)
        if gone[i] or after[i] != j or gone[j] or after[j] != k:
            continue
        gone[j] = 1
        after[i] = k
        if k < n:
            before[k] = i
            if (r := rank(word[i:after[k]])) is not None:
                heappush(heap, (r, i, k, after[k]))
        p = before[i]
        if p >= 0 and (r := rank(word[p:k])) is not None:
            heappush(heap, (r, p, i, k))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i:after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encoder and decoder of one vocabulary, with a bounded memo."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, whole: PerfectHash):
        self.ranks = ranks
        self.usual = regex.compile(pattern)
        self.newer = regex.compile(f"[{NEWER}]")
        strict = pattern
        for kind in (r"\p{L}", r"\p{N}"):
            strict = strict.replace(kind, f"[{kind}--[{NEWER}]]")
        self.strict = regex.compile("(?V1)" + strict)
        self.whole = whole
        self.slot_id = [ranks.get(k) for k in self.whole.key_at]
        self.token = {v: k for k, v in ranks.items()}
        self._forget()

    def _forget(self):
        self.memo: dict[str, tuple[str, bytes]] = {}  # ids in decimal, decoded bytes
        self.held = 0

    def runs(self, text: str):
        """The pre-tokens of a text in lists of bounded length."""
        cut = self.strict if not _latin(text) and self.newer.search(text) else self.usual
        if len(text) <= RUN_CHARS:
            yield cut.findall(text)
            return
        found = (m.group() for m in cut.finditer(text))
        while run := list(islice(found, RUN_MATCHES)):
            yield run

    def learn(self, words) -> None:
        """Resolve the words that the memo lacks."""
        if len(self.memo) > MEMO_WORDS or self.held > MEMO_BYTES:
            self._forget()
        new = list(set(words) - self.memo.keys())
        raw = [w.encode() for w in new]
        for w, b, s in zip(new, raw, self.whole.find(raw)):
            ids = [self.slot_id[s]] if s >= 0 else merge_word(b, self.ranks)
            self.memo[w] = ",".join(map(str, ids)), self.decode(ids)
            self.held += len(b)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for run in self.runs(text):
            self.learn(run)
            for w in run:
                out += map(int, self.memo[w][0].split(","))
        return out

    def digests(self, texts: list[str]):
        """``digest`` of every text; short texts are resolved together."""
        at = 0
        while at < len(texts):
            if len(texts[at]) > RUN_CHARS:
                yield self.digest(self._learned(self.runs(texts[at])))
                at += 1
                continue
            runs, chars = [], 0
            while at < len(texts) and chars + len(texts[at]) <= RUN_CHARS:
                chars += len(texts[at])
                runs.append(list(self.runs(texts[at])))
                at += 1
            self.learn(set().union(*(r for own in runs for r in own)))
            yield from map(self.digest, runs)

    def _learned(self, runs):
        for run in runs:
            self.learn(set(run))
            yield run

    def digest(self, runs) -> tuple[int, str, str]:
        """(tokens, SHA-256 of the ids in decimal joined by commas, SHA-256 of
        the bytes that the ids decode to) of a text's resolved runs."""
        n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
        for run in runs:
            if not run:
                continue
            found = list(map(self.memo.__getitem__, run))
            shown = ",".join([f[0] for f in found])
            if n:
                ids.update(b",")
            n += shown.count(",") + 1
            ids.update(shown.encode())
            back.update(b"".join([f[1] for f in found]))
        return n, ids.hexdigest(), back.hexdigest()


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _share(df: DataFrame, path: str | None):
    """The ranks and their perfect hash, broadcast: built once, on the driver."""
    ranks = load_ranks(path or public_tokenizers.path(VOCABULARY))
    return df.sparkSession.sparkContext.broadcast((ranks, PerfectHash(list(ranks))))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    shared = _share(docs, path)

    def task(batches):
        ranks, whole = shared.value
        codec = Codec(ranks, pattern, whole)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                ids = [codec.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(_rows(docs), task, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids)."""
    shared = _share(tokens, path)

    def task(batches):
        token = {v: k for k, v in shared.value[0].items()}
        for b in batches:
            raw = [b"".join(map(token.__getitem__, ids or ())) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return map_batches(tokens.select("doc_id", "ids"), task, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in
    one pass and keeps only the digests."""
    shared = _share(docs, path)

    def task(batches):
        ranks, whole = shared.value
        codec = Codec(ranks, pattern, whole)
        for b in batches:
            found = []
            for at in range(0, len(b), 512):
                found += codec.digests(b.column("text").slice(at, 512).to_pylist())
            n, ids, back = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(_rows(docs), task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@register("op10_byte_bpe")
def op10_byte_bpe(spark, sf_dir):
    return round_trip(documents(spark, sf_dir))
