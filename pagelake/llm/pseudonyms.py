"""Format-preserving pseudonyms for personal data, in SQL functions only.

Candidates are found by one pattern; a candidate is personal only when its
kind validates: payment cards by Luhn, IBANs by mod 97 (in one word, or in
groups of four with the length of their country), IPv4 octets, real dates
(with slashes dd/mm, else mm/dd, which stays a date of only that reading),
telephone numbers by their digits, mail addresses and secrets by form.
Its symbols are permuted by a keyed Feistel network within their own alphabet
and the value is put back in its own layout, with check digits recomputed:
a card becomes another valid card, a date another real date, an address
another address of the same shape.  The permutation depends on the key and the
value alone, so equal values stay equal in all documents, and different values
of one kind and shape never meet.

A digit run of several groups is tested at its group borders, so a card keeps
its pseudonym beside an expiry, a check code or another number; digits of the
run that are no card stay.

The network: halves a and b, ``ROUNDS`` times (a, b) -> (b, a + F(b)), where +
adds symbol by symbol modulo the alphabet and F is SHA-512 of key, kind, round
and b.  Dates walk the cycle of a six-digit permutation until they are again a
day between the years 1000 and 2999.

Scale: one narrow pass without shuffle or Python; the text is cut at the
candidates and joined again.  Work follows the text's length and the number of
candidates.

Defined results: null text stays null with nothing found; empty text stays
empty; texts without candidates come back unchanged, as do candidates that do
not validate; repeated rows give repeated rows; all columns are carried by
``pseudonymise``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import documents, fresh, register

ROUNDS = 8
#: Only a default for tests and checks; production passes its own secret.
KEY = "pagelake-test-key"

KINDS = ("secret", "email", "iban", "date", "ip", "phone", "card")

SECRET = r'(?i:\b(?:token|password|passwd|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}"?[A-Za-z0-9+/_-]{8,})'
CLOUD_KEY = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,20}"
#: Countries by the length of their IBANs, for the printed form: groups of four
#: with single spaces, whose end only the length tells.
LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
           22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
           25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
           29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
SPACED = r"\b(?:" + "|".join(
    f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, c in LENGTHS.items()) + r")\b"
IBAN = r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b"
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\d)"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d)(?!\.\d)"
PHONE = (r"(?<![\w+])\+?\d{0,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
         r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d){9,12}(?!\d)"
         r"|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])")
#: Telephone numbers that also stand among the groups of a digit run.
BARE = (r"(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
        r"|(?<![\w+.-])(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-]|\.\d)")
#: A digit run ends where another candidate begins.
STOP = "|".join([DATE, IP, EMAIL, r"\d{1,3}\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
                 r"(?:1[ .-])?\d{3}(?:\.\d{3}[ .-]|[ -]\d{3}\.)\d{4}(?![\d-]|\.\d)|1\.\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-]|\.\d)"])
#: Digit groups with single spaces or dashes between them, 13 digits or more;
#: possessive, so that long runs need no stack.
NEXT = rf"(?:\d|[ -](?!{STOP})\d)"
RUN = rf"(?<!\d)\d{NEXT}{{12,}}+"
#: What follows a printed IBAN belongs to its candidate, in case it is none.
CANDIDATE = "|".join([SECRET, CLOUD_KEY, EMAIL, IBAN, SPACED + NEXT + "*+", DATE, IP, PHONE, RUN, BARE])
#: How cards are printed, and the first digits that issuers have.
PRINTED = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5})$"
ISSUER = r"^(?:[3-6]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720)"
#: Every candidate has one of these characters.
HINT = "[0-9@=:]"

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER, HEX = LOWER.upper(), "0123456789abcdef"


def _q(s: str) -> str:
    return "r'" + s.replace("'", "\\'") + "'" if "'" not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _stream(x: str, source: str) -> str:
    """Hex digits, four for each symbol of ``x``."""
    return (f"array_join(transform(sequence(0, (length({x}) - 1) div 32), "
            f"blk -> sha2(concat_ws(':', {source}, string(blk)), 512)), '')")


def _add(x: str, alphabet: str, stream: str) -> str:
    place = f"instr('{alphabet}', substr({x}, i, 1)) - 1 + int(conv(substr(strm, 4 * i - 3, 4), 16, 10))"
    return (f"CASE WHEN length({x}) = 0 THEN '' ELSE " + _let(stream, "strm", (
        f"array_join(transform(sequence(1, length({x})), i -> "
        f"substr('{alphabet}', ({place}) % {len(alphabet)} + 1, 1)), '')")) + " END")


def permute(s: str, alphabet: str, kind: str, key: str) -> str:
    """SQL: the string ``s`` over ``alphabet``, permuted."""
    tweak = f"{_q(key)}, '{kind}', string(length(sym))"
    one = _add("sym", alphabet, _stream("sym", tweak))
    turn = _add("h.a", alphabet, _stream("h.a", f"{tweak}, string(rnd), h.b"))
    return _let(s, "sym", f"""CASE WHEN length(sym) < 2 THEN {one} ELSE
        aggregate(sequence(1, {ROUNDS}),
                  named_struct('a', substr(sym, 1, length(sym) div 2), 'b', substr(sym, length(sym) div 2 + 1)),
                  (h, rnd) -> named_struct('a', h.b, 'b', {turn}), h -> concat(h.a, h.b)) END""")


def _only(s: str, cls: str) -> str:
    return f"regexp_replace({s}, '[^{cls}]', '')"


def _nth(s: str, cls: str, made: str) -> str:
    return f"substr({made}, length({_only(f'substr({s}, 1, p)', cls)}), 1)"


def layout(s: str, digits: str, lower: str | None = None, upper: str | None = None) -> str:
    """SQL: ``s`` with its digits (and letters) replaced in order."""
    cases = [("0-9", digits), ("a-z", lower), ("A-Z", upper)]
    when = " ".join(f"WHEN substr({s}, p, 1) RLIKE '[{c}]' THEN {_nth(s, c, made)}" for c, made in cases if made)
    return (f"CASE WHEN length({s}) = 0 THEN '' ELSE array_join(transform(sequence(1, length({s})), "
            f"p -> CASE {when} ELSE substr({s}, p, 1) END), '') END")


def by_class(s: str, kind: str, key: str) -> str:
    """SQL: digits among digits, letters among letters of the same case."""
    parts = ", ".join(f"'{n}', " + permute(_only(s, c), a, f"{kind}-{n}", key)
                      for n, c, a in (("d", "0-9", DIGITS), ("l", "a-z", LOWER), ("u", "A-Z", UPPER)))
    return _let(f"named_struct({parts})", "made", layout(s, "made.d", "made.l", "made.u"))


def mod97(s: str) -> str:
    """SQL: a string of digits and capitals (A = 10) modulo 97."""
    place = f"instr('{DIGITS + UPPER}', substr({s}, c, 1)) - 1"
    return (f"aggregate(sequence(1, length({s})), 0, (acc, c) -> "
            f"(acc * CASE WHEN {place} < 10 THEN 10 ELSE 100 END + {place}) % 97)")


def _card(m: str, key: str) -> str:
    plain = _only(m, "0-9")
    body = permute(f"substr({plain}, 1, length({plain}) - 1)", DIGITS, "card", key)
    full = _let(body, "bdy", "concat(bdy, string(element_at(filter(sequence(0, 9), "
                             "c -> luhn_check(concat(bdy, string(c)))), 1)))")
    return _let(full, "num", layout(m, "num"))


def _iban(m: str, key: str) -> str:
    return _let(by_class(f"substr({m}, 5)", "iban", key), "acct", (
        f"concat(substr({m}, 1, 2), lpad(string(98 - " + mod97(f"concat(replace(acct, ' ', ''), substr({m}, 1, 2), '00')")
        + "), 2, '0'), acct)"))


_FORMATS = [(r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}/", "dd/MM/yyyy"), (r"^\d{2}\.", "dd.MM.yyyy")]
_FIRST_DAY, _DAYS = "DATE'1000-01-01'", 730_485


def _as_date(m: str) -> str:
    """SQL: the date that ``m`` writes, null when there is none.  Built from
    its numbers, so 31 April is no date; with slashes, mm/dd is read where
    dd/mm is none."""
    made = lambda y, mo, d: (f"try_make_timestamp(int(substr({m}, {y}, 4)), int(substr({m}, {mo}, 2)), "  # noqa: E731
                             f"int(substr({m}, {d}, 2)), 0, 0, 0)")
    return (f"date(CASE WHEN {m} RLIKE {_q(_FORMATS[0][0])} THEN {made(1, 6, 9)} WHEN {m} RLIKE {_q(_FORMATS[1][0])} "
            f"THEN coalesce({made(7, 4, 1)}, {made(7, 1, 4)}) WHEN {m} RLIKE {_q(_FORMATS[2][0])} THEN {made(7, 4, 1)} END)")


def _month_first(m: str) -> str:
    """SQL: whether the date ``m`` is read as mm/dd: its day is no month."""
    return f"({m} RLIKE {_q(_FORMATS[1][0])} AND int(substr({m}, 4, 2)) > 12)"


def _date(m: str, key: str) -> str:
    step = "int(" + permute("lpad(string(x.d), 6, '0')", DIGITS, "date", key) + ")"
    walk = (f"aggregate(sequence(1, 200), named_struct('d', datediff({_as_date(m)}, {_FIRST_DAY}), 'n', 0), "
            f"(x, w) -> CASE WHEN x.n > 0 AND x.d < {_DAYS} AND (NOT mdy OR day(date_add({_FIRST_DAY}, x.d)) > 12) THEN x ELSE named_struct('d', {step}, 'n', 1) END, x -> x.d)")
    when = " ".join(f"WHEN {m} RLIKE {_q(r)} THEN date_format(date_add({_FIRST_DAY}, day), '{f}')" for r, f in _FORMATS)
    when = f"WHEN mdy THEN date_format(date_add({_FIRST_DAY}, day), 'MM/dd/yyyy') {when}"
    return _let(_month_first(m), "mdy", _let(walk, "day", f"CASE {when} END"))


def _ip(m: str, key: str) -> str:
    octets = f"array_join(transform(split({m}, '[.]'), o -> lpad(lower(hex(int(o))), 2, '0')), '')"
    return _let(permute(octets, HEX, "ip", key), "hx", (
        "array_join(transform(sequence(0, 3), o -> conv(substr(hx, 2 * o + 1, 2), 16, 10)), '.')"))


def _phone(m: str, key: str) -> str:
    """The last ten digits; a country code before them stays."""
    plain = _only(m, "0-9")
    return _let(f"concat(substr({plain}, 1, length({plain}) - 10), "
                + permute(f"right({plain}, 10)", DIGITS, "phone", key) + ")", "num", layout(m, "num"))


def _email(m: str, key: str) -> str:
    return _let(f"substring_index({m}, '@', 1)", "loc",
                "concat(" + by_class("loc", "email", key) + f", '@', substring_index({m}, '@', -1))")


_SECRET_HEAD = r'(?i)^(?:(?:AKIA|ASIA)|[a-z_-]+\s{0,3}[=:]\s{0,3}"?)'


def _secret(m: str, key: str) -> str:
    tail = f"regexp_replace({m}, {_q(_SECRET_HEAD)}, '')"
    made = (f"CASE WHEN tl RLIKE '^[0-9a-f]+$' THEN {permute('tl', HEX, 'secret-hex', key)} "
            f"ELSE {by_class('tl', 'secret', key)} END")
    return f"concat(regexp_extract({m}, {_q('(' + _SECRET_HEAD + ')')}, 1), " + _let(tail, "tl", made) + ")"


def kind_of(m: str) -> str:
    """SQL: the kind of a candidate that validates, else null."""
    full = lambda p: _q("^(?:" + p + ")$")
    return f"""CASE
      WHEN {m} LIKE '%@%' AND {m} RLIKE {full(EMAIL)} THEN 'email'
      WHEN {m} RLIKE {full(SECRET + "|" + CLOUD_KEY)} THEN 'secret'
      WHEN {m} RLIKE {full(IBAN)} THEN CASE WHEN {mod97(f"concat(substr({m}, 5), substr({m}, 1, 4))")} = 1 THEN 'iban' END
      WHEN {m} RLIKE {_q("^" + SPACED)} THEN NULL
      WHEN {m} RLIKE {full(DATE)} THEN CASE WHEN year({_as_date(m)}) BETWEEN 1000 AND 2999 THEN 'date' END
      WHEN {m} RLIKE {full(IP)} THEN CASE WHEN forall(split({m}, '[.]'), o -> int(o) <= 255) THEN 'ip' END
      WHEN {m} RLIKE {full(PHONE + "|" + BARE)} THEN 'phone' END"""


_PIECE = "named_struct('m', {}, 'kind', {})"


def _groups(i: str, j: str) -> str:
    """SQL: the digit groups ``i`` to ``j`` of the arrays grp and sep as written."""
    return (f"array_join(transform(sequence({i}, {j}), "
            f"t -> concat(get(grp, t), CASE WHEN t < {j} THEN get(sep, t) ELSE '' END)), '')")


def _valid_runs(runs: str, rank: str, more: str) -> str:
    """SQL: of the group borders ``runs`` (structs i, j), those whose digits are
    a card and that meet ``more``, with a rank: the smaller, the more like one."""
    c = _only("r.m", "0-9")
    return (f"transform(filter(transform({runs}, r -> named_struct('i', r.i, 'j', r.j, 'm', {_groups('r.i', 'r.j')})), "
            f"r -> length({c}) BETWEEN 13 AND 19 AND luhn_check({c}) AND {c} RLIKE '[1-9]' AND {more}), "
            f"r -> named_struct('i', r.i, 'j', r.j, 'm', r.m, "
            f"'rank', 2 * ({rank}) + CASE WHEN length({c}) = 16 THEN 0 ELSE 1 END))")


def _cards(run: str) -> str:
    """SQL: the cards in a digit run as structs i, j, m, in order.  First the
    sub-runs whose groups but the last have four digits or more; where there is
    none, the whole run, and what begins or ends it in groups of two or more
    unless a telephone number is among them.  Of sub-runs that overlap the
    better rank stays, then the first."""
    last = "size(grp) - 1"
    near = (f"flatten(transform(sequence(0, {last}), b -> transform(sequence(b, least(b + 4, {last})), "
            "e -> named_struct('i', b, 'j', e))))")
    printed = _valid_runs(near, f"CASE WHEN r.m RLIKE {_q(PRINTED)} THEN CASE WHEN r.m RLIKE {_q(ISSUER)} THEN 0 ELSE 1 END ELSE 2 END",
                          f"r.m RLIKE {_q(r'^(?:[0-9]{4,}[ -])*[0-9]+$')}")
    ends = (f"array_distinct(concat(transform(sequence(0, least(18, {last})), e -> named_struct('i', 0, 'j', e)), "
            f"transform(sequence(greatest(0, {last} - 18), {last}), b -> named_struct('i', b, 'j', {last}))))")
    whole = f"(r.i = 0 AND r.j = {last})"
    other = _valid_runs(ends, f"CASE WHEN {whole} THEN 0 ELSE 1 END",
                        f"({whole} OR (r.m RLIKE {_q(r'^(?:[0-9]{2,}[ -])*[0-9]+$')} AND NOT {run} RLIKE {_q(BARE)}))")
    best = ("filter(val, (x, k) -> NOT exists(slice(val, greatest(1, k - 39), 80), "
            "y -> y.rank < x.rank AND y.i <= x.j AND y.j >= x.i))")
    taken = (f"aggregate({best}, named_struct('last', -1, 'out', filter(val, x -> false)), "
             "(h, x) -> CASE WHEN x.i > h.last THEN named_struct('last', x.j, 'out', concat(h.out, array(x))) ELSE h END, h -> h.out)")
    return _let(printed, "prt", _let(f"CASE WHEN size(prt) > 0 THEN prt ELSE {other} END", "val", taken))


def _phones(text: str) -> str:
    """SQL: ``text`` as pieces, cut at its telephone numbers."""
    return (f"filter(flatten(zip_with(split({text}, {_q(BARE)}, -1), regexp_extract_all({text}, {_q(BARE)}, 0), (gap, tel) -> array("
            + _PIECE.format("gap", "string(null)") + ", " + _PIECE.format("tel", "'phone'") + "))), v -> v.m IS NOT NULL)")


def _run_pieces(run: str) -> str:
    """SQL: a digit run as pieces: its cards, and what is between them."""
    low = "CASE WHEN n = 0 THEN 0 ELSE get(crd, n - 1).j + 1 END"
    high = "CASE WHEN n = size(crd) THEN size(grp) - 1 ELSE get(crd, n).i - 1 END"
    between = (f"CASE WHEN lo <= hi THEN concat(CASE WHEN n > 0 THEN get(sep, lo - 1) ELSE '' END, {_groups('lo', 'hi')}, "
               "CASE WHEN n < size(crd) THEN get(sep, hi) ELSE '' END) "
               "WHEN n > 0 AND n < size(crd) THEN get(sep, lo - 1) ELSE '' END")
    parts = _let(low, "lo", _let(high, "hi", _let(between, "btw", _phones("btw"))))
    card = f"CASE WHEN n < size(crd) THEN array({_PIECE.format('get(crd, n).m', chr(39) + 'card' + chr(39))}) ELSE array() END"
    pieces = f"flatten(transform(sequence(0, size(crd)), n -> concat({parts}, {card})))"
    return _let(f"split({run}, '[ -]')", "grp", _let(f"regexp_extract_all({run}, '[ -]', 0)", "sep",
                                                      _let(_cards(run), "crd", pieces)))


def pieces_of(m: str) -> str:
    """SQL: a candidate as structs m, kind that make it up, kind null for what
    stays: itself if it validates, else a printed IBAN at its start if that
    does, and the cards and numbers in the digit runs of the rest."""
    runs = (f"flatten(zip_with(split(rst, {_q(RUN)}, -1), regexp_extract_all(rst, {_q(RUN)}, 0), (gap, run) -> concat("
            f"{_phones('gap')}, CASE WHEN run IS NULL THEN array() ELSE {_run_pieces('run')} END)))")
    bare = "replace(spc, ' ', '')"
    head = (_let(f"regexp_extract({m}, {_q('^' + SPACED)}, 0)", "spc",
                 f"CASE WHEN spc <> '' AND {mod97(f'concat(substr({bare}, 5), substr({bare}, 1, 4))')} = 1 THEN spc ELSE '' END"))
    iban = f"CASE WHEN hed = '' THEN array() ELSE array({_PIECE.format('hed', chr(39) + 'iban' + chr(39))}) END"
    rest = _let(head, "hed", f"concat({iban}, " + _let(f"substr({m}, length(hed) + 1)", "rst", runs) + ")")
    return _let(kind_of(m), "knd", f"CASE WHEN knd IS NOT NULL THEN array({_PIECE.format(m, 'knd')}) ELSE {rest} END")


def pseudonym(m: str, kind: str, key: str) -> str:
    make = {"secret": _secret, "email": _email, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "card": _card}
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {make[k](m, key)}" for k in KINDS) + f" ELSE {m} END"


def pseudonymise(docs: DataFrame, key: str = KEY, kinds: str = "private_kinds") -> DataFrame:
    """``docs`` with ``text`` pseudonymised, and the kinds of the values that
    were replaced, in order, as an array column."""
    text, found, known, made = (fresh([*docs.columns, kinds], c) for c in ("whole_text", "candidates", "known", "made"))
    out = docs.withColumn(text, F.col("text").cast("string"))
    out = out.withColumn(found, F.when(F.col(text).rlike(HINT), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
                         .otherwise(F.array().cast("array<string>")))
    out = out.withColumn(known, F.expr(f"transform({found}, m -> {pieces_of('m')})"))
    out = out.withColumn(made, F.expr(f"transform({known}, c -> array_join(transform(c, v -> {pseudonym('v.m', 'v.kind', key)}), ''))"))
    whole = F.when(F.expr(f"exists(flatten({known}), v -> v.kind IS NOT NULL)"), F.array_join(F.zip_with(
        F.split(text, CANDIDATE, -1), made, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")).otherwise(F.col(text))
    rest = [whole.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*rest, F.expr(f"filter(transform(flatten({known}), v -> v.kind), k -> k IS NOT NULL)").alias(kinds))


@register("op8_pseudonyms")
def op8_pseudonyms(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = pseudonymise(docs, kinds="kinds")
    return out.select("doc_id", F.size("kinds").cast("long").alias("n_private"),
                      *[F.expr(f"bigint(size(filter(kinds, k -> k = '{k}')))").alias(f"n_{k}") for k in KINDS], "text")
