"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements
and one failure bit per rule.  Policies are versioned sets of rules: whether a
document is kept under any policy is a bitwise test of the ledger, and what
each rule changes (its ablation) comes from counting the distinct bit patterns,
of which there are at most 2^rules, without touching the texts again.

The measurements need the words in order, so they run in Arrow batches: words
are cut and numbered without a Python object each, windows of eight are hashed over
the numbers, and windows of one hash are compared word by word.  The pass is
narrow, a document of any length is one row, nothing is shuffled.

Defined results: null text has no words and no lines; an empty text fails
``few_words``; repeated rows give repeated rows; a null doc_id is kept as null;
an empty table gives an empty ledger; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import documents, map_batches, register, text_or_empty
from pagelake.llm.wordcut import cut_words, word_numbers

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Bytes of text measured together.
RUN_BYTES = 1 << 20

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words",
            "longest_word"]

#: Bit by bit: (rule, failure as a SQL condition over the measurements).
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("few_alphabetic", "100 * n_alpha_words < 70 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("long_word", "longest_word > 1000"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: a document is dropped when it fails a listed rule.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": ("few_words", "repeated_words", "symbols", "repeated_lines", "few_alphabetic", "word_length", "long_word"),
}
CURRENT = "v2"

_SYMBOL, _LETTER, _LEAD = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[list(SYMBOLS.encode())] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True  # any byte of a non-ASCII character counts
_LEAD[[*range(128), *range(192, 256)]] = True  # first byte of a code point
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                    0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _per(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``cuts``."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[cuts])


def repeat_words(word: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words inside a window of eight that occurs twice or more in its document, per
    document; ``word`` numbers the words of all documents one after the other."""
    n = len(word) - WINDOW + 1
    cuts = np.concatenate([[0], np.cumsum(counts)])
    cover = np.zeros(len(word) + 1, np.int32)
    if n > 0:
        owner = np.repeat(np.arange(len(counts)), counts)
        h = owner[:n].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        for j, p in enumerate(_POWERS):
            mixed = word[j:j + n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            h += (mixed ^ (mixed >> np.uint64(31))) * p
        at = np.flatnonzero(owner[:n] == owner[WINDOW - 1:])
        at = at[np.argsort(h[at], kind="stable")]
        new = np.ones(len(at), bool)
        new[1:] = h[at[1:]] != h[at[:-1]]
        group = np.cumsum(new) - 1
        first = at[np.flatnonzero(new)][group]  # first window with the same hash
        same = owner[at] == owner[first]
        for j in range(WINDOW):  # the comparison word by word
            same &= word[at + j] == word[first + j]
        twice = np.bincount(group[same], minlength=group[-1] + 1 if len(group) else 0)[group] > 1
        found = at[same & twice]
        odd = at[~same]
        if len(odd):  # different windows with one hash
            names = [(int(owner[i]), *word[i:i + WINDOW].tolist()) for i in odd]
            seen = Counter(names)
            found = np.concatenate([found, [i for i, g in zip(odd, names) if seen[g] > 1]]).astype(np.int64)
        cover[found] += 1  # each window is found once
        cover[found + WINDOW] -= 1
    return _per(np.cumsum(cover[:-1]) > 0, cuts)


def line_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word, and those equal to an earlier line."""
    parts = pc.split_pattern(pa.array(texts, pa.large_binary()), b"\n")
    lines = parts.values  # of large lists: all lines one after the other
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    full = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    ids = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False)[full].astype(np.int64)
    owner = owner[full]
    n = np.bincount(owner, minlength=len(texts))
    kinds = np.unique(owner * (int(ids.max()) + 1 if len(ids) else 1) + ids)
    distinct = np.bincount(kinds // (int(ids.max()) + 1 if len(ids) else 1), minlength=len(texts))
    return n, n - distinct


def measure(texts: list[bytes]) -> list[np.ndarray]:
    """MEASURES of every text (UTF-8), one array each."""
    words, counts = cut_words(texts)
    offsets = np.frombuffer(words.buffers()[1], np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    size = np.diff(offsets)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    ends = offsets[cuts]  # where each document's letters begin
    alphabetic = _per(_LETTER[data], offsets) > 0
    longest = np.zeros(len(texts), np.int64)
    some = counts > 0
    if some.any():
        longest[some] = np.maximum.reduceat(size, cuts[:-1][some])
    lines, repeated = line_counts(texts)
    return [counts, _per(_LEAD[data], ends), _per(_SYMBOL[data], ends), lines, repeated,
            repeat_words(word_numbers(words), counts), _per(alphabetic, cuts), longest]


def _measure_batches(batches):
    for b in batches:
        sizes = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(b):
            # As many texts as fit, one at least.
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + RUN_BYTES, side="right")))
            part = b.slice(at, to - at)
            found = measure([t.as_buffer().to_pybytes() for t in part.column("text")])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in found)], ["doc_id", *MEASURES])
            at = to


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for name, failed in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def kept_by(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, fail_bits) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").cast("binary").alias("text"))
    return (map_batches(rows, _measure_batches, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
            .withColumn("fail_bits", failure_bits()))


def ablation(book: DataFrame, policies=tuple(POLICIES)) -> DataFrame:
    """(policy, rule, n_failed, n_only, n_dropped): documents that fail the
    rule, those dropped by it alone (kept without it), and all the policy drops."""
    counts = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    parts = []
    for p in policies:
        hit = F.col("fail_bits").bitwiseAND(F.lit(mask(p)).cast("long"))
        for r in POLICIES[p]:
            parts.append(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"),
                                  F.when(hit.bitwiseAND(F.lit(BIT[r]).cast("long")) != 0, F.col("n")).otherwise(0).alias("failed"),
                                  F.when(hit == BIT[r], F.col("n")).otherwise(0).alias("only"),
                                  F.when(hit != 0, F.col("n")).otherwise(0).alias("dropped")))
    rows = counts.select("n", F.explode(F.array(*parts)).alias("x")).select("x.*")
    return rows.groupBy("policy", "rule").agg(F.sum("failed").alias("n_failed"), F.sum("only").alias("n_only"),
                                              F.sum("dropped").alias("n_dropped"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g), (SELECT unnest(range(0, 8)) AS k) WHERE n > 1 GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_alpha_words,
  coalesce(list_max(list_transform(w, lambda x: strlen(x))), 0) AS longest_word
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, CAST(""" + " + ".join(f"CASE WHEN {failed} THEN {BIT[name]} ELSE 0 END" for name, failed in RULES) + """ AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""


@register("op2_quality_rules", ORACLE)
def op2_quality_rules(spark, sf_dir):
    return ledger(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~kept_by("base")).alias("base_failed"), kept_by(CURRENT).alias("kept"), "fail_bits")
