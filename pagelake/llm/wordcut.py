"""Words of many texts as one Arrow array: no Python object per word, so a text of
tens of megabytes costs a few times its size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: The white space between words.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def cut_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts one after the other, how many each text has)."""
    # A blank after each text ends its last word.
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = BLANK[data]
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    counts = np.diff(np.concatenate([[0], np.searchsorted(begins, np.cumsum(sizes))]))
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begins),
                                  [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank].tobytes())])
    return words, counts


def word_numbers(words: pa.Array) -> np.ndarray:
    """A number for each word, the same for equal words."""
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
