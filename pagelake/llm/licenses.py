"""Licence scan with a positional rare-token index.

The licence texts (templates) are indexed by word and position.  Word weights
are inverse document frequencies over all documents, counted for the licence
vocabulary only (a few hundred rows).  Each template is entered in the index
under the rarest word of its key phrases; a file looks up its own rare licence
words there, each hit fixes where the template would start, the postings of
the template's other words are intersected at that relative position, and a
label is given only where a whole key phrase stands word for word.  As a key
phrase always contains its rarest word, every place of every phrase is found.

Both passes over the texts are narrow Arrow passes; only the document
frequencies (combined per batch) are shuffled and sent to the driver, at most
one number per licence word.

Words are runs of ASCII letters and digits and of non-ASCII characters, after
lower-casing A-Z.  Defined results: null and empty texts have no words, labels
are empty strings and the score is 0; repeated rows give repeated rows; an
empty table gives an empty result; a null doc_id stays null; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import documents, map_batches, register, text_or_empty

#: Phrases that each make a label wherever their words stand consecutively.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Public licence notices (fixed values): (label, notice, key phrases that must all
#: stand, in any order, within ``REACH`` words of each other).
TEMPLATES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ["gnu general public license version 3"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2",
     ["gnu general public license version 2"]),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published "
                "by the free software foundation either version 3 of the license or at your option any later version",
     ["gnu general public license as published by the free software foundation", "version 3 of the license"]),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published "
                "by the free software foundation either version 2 of the license or at your option any later version",
     ["gnu general public license as published by the free software foundation", "version 2 of the license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ["cc by nc sa"]),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", ["cc by nc nd"]),
    ("cc-by", "licensed under a creative commons attribution license", ["creative commons attribution"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license", ["creative commons attribution sharealike"]),
    ("cc-by-sa", "licensed under a creative commons attribution share alike license", ["creative commons attribution share alike"]),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives license", ["creative commons attribution noderivatives"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license", ["creative commons attribution noncommercial"]),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike license",
     ["creative commons attribution noncommercial sharealike"]),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives license",
     ["creative commons attribution noncommercial noderivatives"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files to deal in the software without restriction",
     ["permission is hereby granted free of charge"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided "
                     "that the following conditions are met neither the name of the copyright holder nor the names of its "
                     "contributors may be used to endorse or promote products derived from this software",
     ["redistribution and use in source and binary forms", "may be used to endorse or promote products derived from this software"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license"]),
    ("mpl-2.0", "licensed under mpl 2 0", ["mpl 2 0"]),
    ("epl-2.0", "available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("boost", "boost software license version 1 0", ["boost software license"]),
    ("zlib", "this software is provided as is without any express or implied warranty altered source versions must be "
             "plainly marked as such", ["altered source versions must be plainly marked as such"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software"]),
]
#: SPDX identifiers (fixed values), as words, and their labels.
SPDX = {"mit": "mit", "apache 2 0": "apache-2.0", "gpl 2 0": "gpl-2.0", "gpl 3 0": "gpl-3.0", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl",
        "agpl 3 0": "agpl", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd-3-clause", "isc": "isc", "mpl 2 0": "mpl-2.0",
        "epl 2 0": "epl-2.0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc", "cc0 1 0": "cc0",
        "bsl 1 0": "boost", "zlib": "zlib", "unlicense": "unlicense"}
TEMPLATES += [(label, f"spdx license identifier {name}", [f"spdx license identifier {name}"]) for name, label in SPDX.items()]
#: Words between the first and the last key phrase of a notice at most.
REACH = 250

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORD).split()


def near(words: list[bytes], at: int, phrase: list[bytes]) -> bool:
    """Whether ``phrase`` stands within ``REACH`` words of place ``at``."""
    lo, hi = max(0, at - REACH), min(len(words), at + REACH)
    return any(words[i] == phrase[0] and words[i:i + len(phrase)] == phrase for i in range(lo, hi))


class Index:
    """Templates by the rarest word of each key phrase."""

    def __init__(self, weight: dict[bytes, float]):
        self.weight = weight
        self.anchors: dict[bytes, list[tuple]] = {}
        self.templates: list[list[bytes]] = []
        entries = [(label, phrase, [phrase], True) for phrase, label in BASE.items()]
        for label, notice, keys, base in entries + [(*t, False) for t in TEMPLATES]:
            notice = notice.encode().split()
            self.templates.append(notice)
            # The key phrase with the rarest word is looked up; the others are verified.
            phrases = [key.encode().split() for key in keys]
            first = max(phrases, key=lambda p: max((weight[w], w) for w in p))
            at = next(i for i in range(len(notice)) if notice[i:i + len(first)] == first)
            rare = max(range(len(first)), key=lambda i: (weight[first[i]], first[i]))
            others = [p for p in phrases if p is not first]
            self.anchors.setdefault(first[rare], []).append(
                (len(self.templates) - 1, at, at + rare, first, others, label, base))
        self.total = [sum(weight[w] for w in t) for t in self.templates]

    def scan(self, words: list[bytes]):
        """(n_base, first, last, base labels, labels, score, spans)."""
        base, spans, score, places = set(), [], 0.0, []
        anchors = self.anchors
        for i, w in enumerate(words):
            if w not in anchors:
                continue
            for t, key_at, rare_at, key, others, label, is_base in anchors[w]:
                start = i - rare_at  # where the template would begin
                notice = self.templates[t]
                aligned = sum(self.weight[x] for j, x in enumerate(notice)
                              if 0 <= start + j < len(words) and words[start + j] == x)
                score = max(score, aligned / self.total[t])
                at = start + key_at
                if at >= 0 and words[at:at + len(key)] == key and all(near(words, at, p) for p in others):
                    if is_base:
                        base.add(label)
                        places.append(at)
                    spans.append((label, at, at + len(key)))
        # Of two phrases at the same place the longer one is more specific.
        longest: dict[int, int] = {}
        for _, at, end in spans:
            longest[at] = max(end, longest.get(at, 0))
        spans = [s for s in spans if s[0] in base or s[2] == longest[s[1]]]
        labels = {s[0] for s in spans}
        return (len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                ",".join(sorted(labels)), min(1.0, round(score, 6)), spans)


def vocabulary() -> set[bytes]:
    return {w for t in [*BASE, *(t[1] for t in TEMPLATES)] for w in t.encode().split()}


def word_weights(rows: DataFrame) -> dict[bytes, float]:
    """Inverse document frequency of each licence word over all documents."""
    known = vocabulary()

    def task(batches):
        for b in batches:
            seen: dict[bytes, int] = {}
            for t in b.column("text"):
                for w in known.intersection(words_of(t.as_py())):
                    seen[w] = seen.get(w, 0) + 1
            seen[b""] = len(b)
            yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in seen], "n": list(seen.values())})

    counted = map_batches(rows.select("text"), task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r.word.encode(): r.n for r in counted.collect()}  # a row per licence word at most
    return {w: 1.0 + math.log((1 + n.get(b"", 0)) / (1 + n.get(w, 0))) for w in known}


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans) of every row; spans are (label, first word, end word)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    index = Index(word_weights(rows))
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
             ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
             ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())])))]

    def task(batches):
        for b in batches:
            found = []
            for t in b.column("text"):
                words = words_of(t.as_py())
                *some, spans = index.scan(words)
                found.append((len(words), *some, [{"label": s[0], "first": s[1], "end": s[2]} for s in spans]))
            columns = list(zip(*found)) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, k) for c, (_, k) in zip(columns, kinds))],
                ["doc_id", *(name for name, _ in kinds)])

    return map_batches(rows, task, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                 "base_labels string, labels string, score double, "
                                 "spans array<struct<label: string, first: long, end: long>>")


@register("op1_license_scan")
def op1_license_scan(spark, sf_dir):
    return scan(documents(spark, sf_dir)).drop("spans")
