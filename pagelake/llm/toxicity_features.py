"""Dense features of a text for the toxicity model.

Kept apart from the model so that the executors' Python workers, which only
compute features, do not load the machine-learning package.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import fresh, map_batches, text_or_empty

#: Lengths in bytes of the learned word beginnings.
BEGINNINGS = (4, 5, 6)
SEED_LEXICON = frozenset(
    "idiot idiots stupid moron morons trash clown clowns loser losers scum pathetic worthless disgusting dumb fool "
    "garbage ugly jerk freak creep filthy vermin imbecile coward disgrace useless hate".split())
SECOND_PERSON = frozenset("you your yours yourself u ur ya du dich dir dein deine ihr euch tu te toi ton ta tes vous "
                          "votre vos tú ti usted ustedes vosotros".split())
NEAR = 5

FEATURES = ["seed_rate", "seed_hits", "word_rate", "word_weight", "start_rate", "start_weight", "distinct_hits",
            "near_you", "you_rate", "capitals", "shouted", "exclaimed", "asked", "repeated_marks", "obfuscated",
            "undone_hits", "log_words"]

#: Everything but ASCII letters, digits and underscores, and all non-ASCII characters, parts words.
_PARTS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c == 95 or c >= 128 else 32 for c in range(256))
_SHOUT = re.compile(r"[A-Z]{3,}")
_MARKS = re.compile(r"[!?.*]{2,}")
_MIXED = re.compile(r"[a-z]+(?:[0-9@$*!]+[a-z]+)+")
_SIGNS = "0123456789@$*!"
_UNDO = str.maketrans("013457@$!*", "oieastasiu")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_PARTS).split()


class Lexicon:
    """Learned words and word beginnings with their log-odds."""

    def __init__(self, words: dict[bytes, float], starts: dict[bytes, float]):
        self.words, self.starts = words, starts
        self.known, self.seed = frozenset(words), frozenset(w.encode() for w in SEED_LEXICON)
        self.first = frozenset(w[:BEGINNINGS[0]] for w in starts)
        self.you = frozenset(w.encode() for w in SECOND_PERSON)

    def features(self, text: str) -> list[float]:
        """FEATURES of a text."""
        low = text.lower()
        found = low.encode().translate(_PARTS).split()
        n = len(found)
        if not n:
            return [0.0] * len(FEATURES)
        own = set(found)
        seeds, known = own & self.seed, own & self.known
        seed, word_n = sum(map(found.count, seeds)), sum(map(found.count, known))
        start_n, start_w, hits = 0, 0.0, seeds | known
        if self.first & {w[:BEGINNINGS[0]] for w in own}:
            for w in own:
                best = max(self.starts.get(w[:m], 0.0) for m in BEGINNINGS)
                if best:
                    start_n += found.count(w)
                    start_w += best
                    hits.add(w)
        present = own & self.you
        near = 0
        if present and hits:
            places = [i for i, w in enumerate(found) if w in hits]
            near = sum(not present.isdisjoint(found[max(0, i - NEAR):i + NEAR + 1]) for i in places)
        mixed = _MIXED.findall(low) if any(map(low.__contains__, _SIGNS)) else []
        undone = sum((x.translate(_UNDO).encode() in self.seed or x.translate(_UNDO).encode() in self.known) for x in mixed)
        size = len(text)
        return [seed / n, math.log1p(seed), word_n / n, sum(map(self.words.__getitem__, known)), start_n / n, start_w,
                float(len(hits)), near / n, sum(map(found.count, present)) / n,
                sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / size, len(_SHOUT.findall(text)) / n,
                text.count("!") / size, text.count("?") / size, len(_MARKS.findall(text)) / n, len(mixed) / n,
                float(undone), math.log1p(n)]


def with_features(docs: DataFrame, lexicons, name: str, part: str | None = None) -> DataFrame:
    """``docs`` and an array of FEATURES; one narrow Arrow pass.  ``part`` names
    the column of the part whose own rows the lexicon must not have seen."""
    text = fresh(docs.columns, "scored_text")

    def task(batches):
        known = {p: Lexicon(*x) for p, x in lexicons.items()}
        for b in batches:
            for at in range(0, max(1, len(b)), 1_000):
                rows = b.slice(at, 1_000)
                unseen = rows.column(part).to_pylist() if part else [0] * len(rows)
                made = [known[int(p)].features(t.as_py()) for t, p in zip(rows.column(text), unseen)]
                keep = [c for c in range(rows.num_columns) if rows.schema.names[c] != text]
                yield pa.RecordBatch.from_arrays([rows.column(c) for c in keep] + [pa.array(made, pa.list_(pa.float64()))],
                                                 [rows.schema.names[c] for c in keep] + [name])

    schema = T.StructType(docs.schema.fields + [T.StructField(name, T.ArrayType(T.DoubleType()))])
    return map_batches(docs.withColumn(text, text_or_empty("text")), task, schema)


def entries(words: list[bytes]) -> tuple[set[bytes], set[bytes]]:
    own = set(words)
    return own, {w[:m] for w in own for m in BEGINNINGS if len(w) > m}


def count_entries(rows: DataFrame, wanted=None) -> DataFrame:
    """(kind, entry, part, n): in how many of the rows (text, part) each word
    (kind 0) and word beginning (kind 1) occurs, combined per batch; with
    ``wanted`` only the entries in those two sets."""
    def task(batches):
        for b in batches:
            seen: Counter = Counter()
            for t, p in zip(b.column("text"), b.column("part").to_pylist()):
                for kind, own in enumerate(entries(words_of(t.as_py()))):
                    if wanted is not None:
                        own = wanted[kind].intersection(own)
                    seen.update((kind, e, p) for e in own)
            yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _, _ in seen], pa.int32()),
                                              "entry": pa.array([e for _, e, _ in seen], pa.binary()),
                                              "part": pa.array([p for _, _, p in seen], pa.int32()),
                                              "n": pa.array(list(seen.values()), pa.int64())})

    some = rows.select("text", F.col("part").cast("int").alias("part"))
    return map_batches(some, task, "kind int, entry binary, part int, n long")
