"""Plain-Python counterparts and awkward rows shared by these tests."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def awkward() -> list[tuple]:
    """(doc_id, text): nulls, blanks, ties, repeated rows, a very long text."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    return [(1, "a  b\tc"), (2, "a b c"), (3, None), (4, ""), (5, " \n\t"), (6, long), (7, long + " end"), (8, "x"),
            (8, "x"), (8, "y z"), (None, "a b c"), (None, None), (9, "é ü  Z"), (10, "A B C")]


def table(spark, rows, n: int = 3):
    """Rows (doc_id, text) as a documents table with all its columns."""
    full = [(d, t, "en", f"s{(d or 0) % 4}" if d != 4 else None, len(t or "")) for d, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(n)


def near_copies(seed: int, n: int = 250) -> list[tuple]:
    """Documents made from a few base texts with word edits."""
    r = random.Random(seed)
    words = lambda k: ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(k)]
    base = [words(r.choice([1, 2, 3, 9, 10, 11, 20, 21, 40, 80, 150])) for _ in range(14)] + [words(120) for _ in range(4)]
    rows = []
    for i in range(n):
        b = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            k = r.randrange(len(b) + 1)
            b[k:k + 1] = words(1) if r.random() < 0.7 else []
        rows.append((i, r.choice([" ", "\n", "  "]).join(w.upper() if r.random() < 0.1 else w for w in b)))
    return rows


def grams(text: str | None, n: int) -> set:
    w = WORD.findall(lower_ascii(text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n: int, percent: int):
    """(doc_id, set size, component, links) of rows with different ids, by comparing all pairs."""
    sets = [grams(t, n) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(sets[i]), least[top(i)], links[i]) for i, (d, _) in enumerate(rows))


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    count = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover: set = set()
    for i in range(len(w) - 7):
        if count[tuple(w[i:i + 8])] > 1:
            cover.update(range(i, i + 8))
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(cover)


def cut(rows, length: int = 100):
    """{doc_id: [(bytes, removed, spans, digest of the rest)]} by a set of all strings."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for j in range(len(data) - length + 1):
            if data[j:j + length] in seen:
                gone[j:j + length] = b"\1" * length
            seen.add(data[j:j + length])
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.setdefault(d, []).append((len(data), sum(gone), spans, sha(bytes(x for x, g in zip(data, gone) if not g))))
    return out
