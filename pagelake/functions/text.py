"""Text column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
SPAM_TERMS = ["viagra", "lottery", "prize", "million dollars", "free money", "casino"]
C_SPACE = r"[ \t\n\x0B\f\r]"          # C isspace() in the "C" locale
TAG_RE = r"<[^>]*>"
ENTITY_RE = r"(?<!\w)\p{Upper}\p{Lower}+(?!\w)"  # \b as ASCII word boundary; Java runs named classes much faster than ranges
# Stop-word table for the language vote (our own short lists; ties -> code order)
STOP_WORDS = {
    "de": ["der", "die", "das", "und", "nicht", "ist", "mit", "sich", "von", "den", "zu", "des",
           "ein", "auch", "auf"],
    "en": ["the", "and", "of", "to", "in", "is", "it", "that", "was", "for", "with", "as", "on",
           "by", "this", "are"],
    "es": ["el", "la", "los", "las", "de", "y", "que", "en", "es", "por", "con", "para", "una",
           "del", "se"],
    "fr": ["le", "la", "les", "de", "et", "un", "une", "est", "que", "pour", "dans", "du", "des",
           "pas", "qui"],
}
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def preprocess(text) -> Column:
    """ASCII-lowercase, drop tags (words fuse), every char outside
    ``[a-z0-9]``/whitespace -> space, collapse whitespace runs.  Not trimmed."""
    # What is left of the second step is ASCII: ``lower`` then changes A-Z alone, and
    # without looking up each character.
    t = F.regexp_replace(_c(text), TAG_RE, "")
    return F.lower(F.regexp_replace(t, r"\P{Alnum}+", " "))


def is_spam(text) -> Column:
    """preprocessed text contains any spam term (substring)."""
    p = preprocess(text)
    return F.coalesce(p.rlike("|".join(SPAM_TERMS)), F.lit(False))


def words(processed) -> Column:
    """Whitespace tokens (``>>`` extraction: runs of non-space)."""
    return F.filter(F.split(_c(processed), C_SPACE + "+"), lambda w: w != "")


def plain_words(text) -> Column:
    """Words of the preprocessed ``text``, which one space parts."""
    return F.array_remove(F.split(preprocess(text), " "), "")


def relevance_from_hits(hits) -> Column:
    """min(1, 0.2 x number of query words found), duplicates counted."""
    return F.least(F.lit(1.0), _c(hits).cast("double") * F.lit(0.2))


def entities(text, compat: bool = False) -> Column:
    """Capitalised words.  The reference runs the pattern on lowercased
    text, so it never matches (``compat=True``); by default it runs on the
    tag-stripped original text."""
    t = F.lower(_c(text)) if compat else F.regexp_replace(_c(text), TAG_RE, "")
    return F.regexp_extract_all(t, F.lit(ENTITY_RE), 0)


def token_hash(word) -> Column:
    """T4: portable word hash in [0, 1): first 15 hex digits of md5 / 16^15."""
    return F.conv(F.substring(F.md5(_c(word)), 1, 15), 16, 10).cast("double") / F.lit(float(16 ** 15))


def tokenize(text) -> Column:
    """T4: whitespace tokens of the raw text, each hashed to [0, 1)."""
    return F.transform(words(text), token_hash)


def softmax(vec) -> Column:
    """M1: softmax with max subtraction, in double.  The max and the sum are
    bound once per row (not re-evaluated per element)."""
    from pagelake.functions.rfc import let
    v = F.transform(_c(vec), lambda x: x.cast("double"))
    e = let(F.struct(v.alias("v"), F.array_max(v).alias("m")),
            lambda s: F.transform(s["v"], lambda x: F.exp(x - s["m"])))
    return let(F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, x: a + x).alias("total")),
               lambda s: F.transform(s["e"], lambda x: x / s["total"]))


def argmax(vec) -> Column:
    """M3: 0-based index of the first maximum."""
    return (F.array_position(_c(vec), F.array_max(_c(vec))) - 1).cast("int")


def format_g(x) -> Column:
    """C++ stream formatting of a double (6 significant digits, %g)."""
    s = F.format_string("%.6g", _c(x))
    mant = F.regexp_extract(s, r"^([^e]*)", 1)
    exp = F.regexp_extract(s, r"(e.*)$", 1)
    mant = F.when(mant.contains("."), F.regexp_replace(F.regexp_replace(mant, "0+$", ""), r"\.$", "")).otherwise(mant)
    return F.concat(mant, exp)


def epoch_to_text(epoch) -> Column:
    """Epoch seconds -> ``%Y-%m-%d %H:%M:%S`` (session time zone UTC)."""
    return F.date_format(F.timestamp_seconds(_c(epoch)), "yyyy-MM-dd HH:mm:ss")


GRAM = 3


def qgrams(text, sizes=range(1, GRAM + 1)) -> Column:
    """Distinct hashes of the ``sizes``-character substrings of a text.  The text is
    cut into characters once, so the time is linear in its length."""
    from pagelake.functions.rfc import let

    def of(chars, k):
        starts = F.slice(chars, F.lit(1), F.greatest(F.size(chars) - (k - 1), F.lit(0)))
        return F.transform(starts, lambda a, i: F.xxhash64(a, *[F.get(chars, i + j) for j in range(1, k)]))

    return F.array_distinct(let(F.split(_c(text), ""), lambda chars: F.concat(*[of(chars, k) for k in sizes])))


def word_grams(word) -> Column:
    """The q-grams that a text must have to hold ``word``: those of ``GRAM``
    characters, or the word itself if it is shorter."""
    w = _c(word)
    short = F.lit(None).cast("array<long>")
    for k in range(1, GRAM):
        short = F.when(F.length(w) == k, qgrams(w, [k])).otherwise(short)
    return F.when(F.length(w) >= GRAM, qgrams(w, [GRAM])).otherwise(short)
