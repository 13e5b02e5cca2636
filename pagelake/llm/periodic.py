"""Periodic runs of words by block convolution.

A run is a maximal stretch of words with smallest period q (words q apart are
identical) that is long enough: max(``MIN_LENGTH``, ``MIN_PERIODS`` * q) words.

For each dyadic scale B = 1, 2, 4, ... the words are cut into blocks of B.  A run
with q in [B, 2B) holds a whole block within its first B words, and the same block
again q words later.  So each block is compared with the window of the 2B words
that begin B words after it: at shift d the sum of squared differences of word
numbers is sum(x^2) + sum(y^2) - 2 sum(xy), and sum(xy) for all d at once is a
convolution, taken as a number-theoretic transform modulo ``PRIME``.  The
arithmetic is exact: a true occurrence gives zero, and a sum that is zero only
modulo the prime is refused when its distance seeds an extension, which compares
words.  Distances are extended in both directions to the maximal stretch.
A block with a word that does not come again within its window cannot occur there
and is not transformed.  Scales ascend, so a block whose occurrence lies in a run of a smaller period is
a multiple of that period and is left out.

Documents are rows: Spark deals them to tasks and nothing is shuffled.  In a
task the words of many short documents are laid end to end, with a number of its
own between two documents, and share each transform; words stay in Arrow buffers
and numbers, never Python strings.  Blocks are transformed in slabs of ``SLAB``
numbers, so the transforms of one document of any length need bounded memory beside
its words.

Defined results: null, empty and blank texts have no words and no runs; a null
doc_id is kept as null; repeated rows give repeated rows; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import documents, map_batches, register, text_or_empty
from pagelake.llm.wordcut import cut_words, word_numbers

MIN_LENGTH = 6
MIN_PERIODS = 4
#: 15 * 2^27 + 1: transforms of up to 2^27 numbers, products below 2^62.
PRIME, ROOT = 2013265921, 31
#: Numbers transformed at a time, and bytes of text laid end to end.
SLAB = 1 << 16
RUN_BYTES = 1 << 20


@lru_cache(maxsize=64)
def _roots(size: int, inverse: bool) -> np.ndarray:
    """Powers of the root of unity of order ``size``, half a turn."""
    w = pow(ROOT, (PRIME - 1) // size, PRIME)
    w = pow(w, PRIME - 2, PRIME) if inverse else w
    out = np.ones(1, np.int64)
    while len(out) < size // 2:
        out = np.concatenate([out, out * pow(w, len(out), PRIME) % PRIME])
    return out[:max(1, size // 2)]


@lru_cache(maxsize=32)
def _mirror(size: int) -> np.ndarray:
    """Where frequency -k lies if frequencies are in bit-reversed order."""
    order = np.zeros(1, np.int64)
    while len(order) < size:
        order = np.concatenate([order * 2, order * 2 + 1])
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    return place[(-order) % size]


def _forward(x: np.ndarray) -> np.ndarray:
    """Transform of the columns of ``x``; frequencies come in bit-reversed order."""
    size, cols = x.shape
    half = size // 2
    while half:
        v = x.reshape(-1, 2, half, cols)
        a, b = v[:, 0], v[:, 1]
        total = a + b
        turned = (a - b + PRIME) * _roots(2 * half, False)[:, None] % PRIME
        total -= PRIME * (total >= PRIME)
        v[:, 0], v[:, 1] = total, turned
        half //= 2
    return x


def _backward(x: np.ndarray) -> np.ndarray:
    """Inverse of ``_forward`` but for the factor 1 / size."""
    size, cols = x.shape
    half = 1
    while half < size:
        v = x.reshape(-1, 2, half, cols)
        a = v[:, 0]
        b = v[:, 1] * _roots(2 * half, True)[:, None] % PRIME
        low, high = a + b, a - b
        low -= PRIME * (low >= PRIME)
        high += PRIME * (high < 0)
        v[:, 0], v[:, 1] = low, high
        half *= 2
    return x


def occurrences(x: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of the blocks of ``x`` at ``starts`` (ascending multiples of
    the block) and their places in the windows at distances block to 2 * block - 1.
    ``x`` must go on for three blocks from each start; distances may be false where
    words differ."""
    size = 2 * block
    scale = pow(size, PRIME - 2, PRIME)
    mirror = _mirror(size)
    sign = np.where(np.arange(size) < block, 1, PRIME - 1)[:, None]  # bit-reversed: odd frequencies come last
    found = []
    step = max(1, SLAB // size)
    for lo in range(0, len(starts), step):
        own = starts[lo:lo + step]
        # The window is two blocks; each block is transformed once, padded with zeros.
        number = (own - own[0]) // block
        needed = np.zeros(number[-1] + 3, bool)
        for m in range(3):
            needed[number + m] = True
        at = own[0] + np.flatnonzero(needed) * block
        padded = np.zeros((size, len(at)), np.int64)
        padded[:block] = x[at[None, :] + np.arange(block)[:, None]]
        squares = (padded[:block] * padded[:block] % PRIME)
        freq = _forward(padded)
        place = np.cumsum(needed) - 1
        i, j, k = (place[number + m] for m in range(3))
        window = (freq[:, j] + sign * freq[:, k]) % PRIME
        corr = _backward(freq[mirror][:, i] * window % PRIME)[:block]
        corr = corr * scale % PRIME
        # Squares of the block, and of its place at each distance.
        run = np.concatenate([squares[:, j], squares[:, k]])
        run = np.concatenate([np.zeros((1, len(own)), np.int64), np.cumsum(run, axis=0)])
        here = run[block:size] - run[:block]
        diff = (here + squares[:, i].sum(axis=0) - 2 * corr) % PRIME
        d, c = np.nonzero(diff == 0)
        found.append((own[c], d + block))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _still(x: np.ndarray, end: np.ndarray, b: np.ndarray, d: np.ndarray, block: int) -> np.ndarray:
    """Which seeds (b, d) are words that repeat at distance d from b for 2 * d words
    at least, as the first block of a run does; checked in doubling steps."""
    left = np.flatnonzero(b + 3 * d <= end)
    done, width = np.zeros(len(left), np.int64), 4
    alive = []
    while len(left):
        keep = np.ones(len(left), bool)
        per = max(1, SLAB // width)
        for lo in range(0, len(left), per):
            s = slice(lo, lo + per)
            at = done[s, None] + np.arange(width)[None, :]
            at = np.minimum(at, 2 * d[left[s], None] - 1) + b[left[s], None]
            keep[s] = (x[at] == x[at + d[left[s], None]]).all(axis=1)
        left, done = left[keep], done[keep] + width
        over = done >= 2 * d[left]
        alive.append(left[over])
        left, done = left[~over], done[~over]
        width *= 2
    return np.concatenate(alive) if alive else left


def _agree(x: np.ndarray, at: int, d: int, stop: int, step: int) -> int:
    """First place from ``at`` in direction ``step`` where the words d apart differ
    (``stop`` if none)."""
    width = 32
    while at != stop:
        to = min(at + width, stop) if step > 0 else max(at - width, stop)
        lo, hi = (at, to) if step > 0 else (to + 1, at + 1)
        differ = np.flatnonzero(x[lo:hi] != x[lo + d:hi + d])
        if len(differ):
            return int(lo + (differ[0] if step > 0 else differ[-1]))
        at, width = to, min(width * 2, 1 << 20)
    return stop


def runs(x: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``x``; ``first`` and ``end`` bound the
    document of each place, and places between documents hold numbers of their own."""
    out: list[tuple[int, int, int]] = []
    longest = int((end - first).max()) if len(x) else 0
    # Distance of each word to its next occurrence, and the largest one of a block.
    order = np.argsort(x, kind="stable")
    again = np.full(len(x), len(x), np.int64)
    same = x[order[1:]] == x[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    block = 1
    while MIN_PERIODS * block <= longest:
        starts = np.arange(0, len(x) - 3 * block + 1, block)
        # A block with a word that does not come again in its window is not in the window.
        starts = starts[(starts + 3 * block <= end[starts]) & (again[:len(starts)] < 2 * block)]
        if out and len(starts):
            # Furthest end of a run known so far among those that begin at or before a place.
            known = np.array(sorted((s, s + n) for s, n, _ in out), np.int64)
            reach = np.maximum.accumulate(known[:, 1])

            def covered(b, upto):
                k = np.searchsorted(known[:, 0], b, side="right") - 1
                return (k >= 0) & (reach[np.maximum(k, 0)] >= upto)

            starts = starts[~covered(starts, starts + 3 * block)]
        else:
            covered = None
        b, d = occurrences(x, starts, block)
        if covered is not None and len(b):
            fresh = ~covered(b, b + d + block)
            b, d = b[fresh], d[fresh]
        seeds = _still(x, end[b], b, d, block) if len(b) else []
        for q in np.unique(d[seeds]).tolist() if len(seeds) else ():
            own, i = np.sort(b[seeds[d[seeds] == q]]), 0
            while i < len(own):
                at = int(own[i])
                right = _agree(x, at, q, int(end[at]) - q, 1)
                left = _agree(x, at, q, int(first[at]) - 1, -1) + 1
                if right + q - left >= max(MIN_LENGTH, MIN_PERIODS * q):
                    out.append((left, right + q - left, q))
                i = max(i + 1, int(np.searchsorted(own, right)))  # the others up to there seed the same stretch
        block *= 2
        again = np.maximum(again, np.append(again[1:], len(x)))[::2] if len(again) > 1 else again
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeats_planted(n: int, doc_id: int | None) -> np.ndarray:
    """For each of n words, the number of the original word that stands there: in a
    tenth of the documents, fixed by doc_id, a tail repeats with some period."""
    word = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        word[a:] = a + (word[a:] - a) % p
    return word


def scan(texts: list[bytes], origins=None):
    """For each text (words' numbers, runs with starts from the text's first word,
    words as Arrow array); ``origins(i, n)`` may rearrange the n words of text i."""
    words, counts = cut_words(texts)
    ids = word_numbers(words)
    start = np.concatenate([[0], np.cumsum(counts)])
    place = [(origins(i, int(n)) if origins else np.arange(n)) + start[i] for i, n in enumerate(counts)]
    # One place between documents, each with a number that no word has.
    total = int(start[-1]) + len(texts)
    base = start[:-1] + np.arange(len(texts))
    x, first, end = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
    top = int(ids.max()) + 1 if len(ids) else 0
    for i, n in enumerate(counts):
        lo, hi = base[i], base[i] + n
        x[lo:hi] = ids[place[i]]
        x[hi] = top + i
        first[lo:hi + 1], end[lo:hi + 1] = lo, hi
    found = runs(x, first, end)
    owner = np.searchsorted(base, [r[0] for r in found], side="right") - 1
    each: list[list] = [[] for _ in texts]
    for (s, n, q), i in zip(found, owner):
        each[i].append((int(s - base[i]), n, q))
    return [(place[i], each[i], words) for i in range(len(texts))]


def collapsed(n: int, found) -> np.ndarray:
    """Whether each of n words stays: a run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in found:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _hash_words(words, places: np.ndarray) -> str:
    h = hashlib.sha256()
    for lo in range(0, len(places), 1 << 16):
        part = words.take(pa.array(places[lo:lo + (1 << 16)]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), pa.scalar(b" ", pa.large_binary()))
        h.update(b" " if lo else b"")
        h.update(joined[0].as_buffer())
    return h.hexdigest()


def _row(place, found, words) -> tuple:
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *top, listed, _hash_words(words, place[collapsed(len(place), found)]))


SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def _task(plant: bool):
    def task(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            lo = 0
            while lo < batch.num_rows:
                # As many texts as fit, one at least.
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + RUN_BYTES, side="right")))
                part = batch.slice(lo, hi - lo)
                ids, texts = part.column(0).to_pylist(), [t.as_buffer().to_pybytes() for t in part.column(1)]
                rows = [_row(*s) for s in scan(texts, (lambda i, n: repeats_planted(n, ids[i])) if plant else None)]
                columns = [pa.array(c, pa.int64()) for c in zip(*[r[:5] for r in rows])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), *columns, pa.array([r[5] for r in rows]), pa.array([r[6] for r in rows])],
                    [f.split()[0] for f in SCHEMA.split(", ")])
                lo = hi
    return task


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Runs and the collapsed text of every document; ``plant`` first makes the
    tail of a tenth of them periodic (``repeats_planted``), to have known runs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return map_batches(rows, _task(plant), SCHEMA)


@register("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    return periodic_runs(documents(spark, sf_dir), plant=True)
