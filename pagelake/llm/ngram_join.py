"""Exact n-gram Jaccard self-join over a token-group matrix.

A document's set holds its distinct word n-grams; two documents link when
100 * |A & B| >= percent * |A | B|.

1. Candidates.  Linked sets of sizes up to s differ in at most
   D = floor(2 s (100 - percent) / (100 + percent)) n-grams.  Cut the n-gram
   space by hash into D + 1 + e parts: at least 1 + e parts then hold the same
   n-grams in both sets.  The hash of a part's n-grams is a signature, so
   linked sets share a signature that is not that of an empty part, unless
   both have more than e empty parts, and such (rare) sets sign for those too.
   Sizes are cut into levels of ratio ``percent``; a set signs for its level
   and the next, so neighbours in size meet.  One row per signature is
   shuffled (about a quarter of the n-grams); sets equal within an Arrow batch
   sign once, and all equal sets count as one from there on.  Signatures of
   one set are dropped.
2. Groups.  Each signature names its least set; a set goes to the family of
   the set that most of its signatures name.  Families are cut by size level
   and hash into groups of about ``GROUP`` sets (``WIDE_GROUP`` where only
   components are wanted) and ``GROUP_TOKENS`` n-grams.
   Signatures that bring the same groups together are taken once, with their
   number, and a pair of groups stays only with as many common signatures as
   linked sets of their sizes have at least.
3. Bounds.  Parity sketches of the sets (a bit for each hash place) differ in at
   most as many bits as the sets in n-grams; pairs of groups without a pair of
   members that may link by their sketches are not opened.
4. For each group left its members' tokens and their union (the matrix row) are
   stored.  In a pair, a query of one group opens the other only if the union
   holds ``percent`` of its tokens.  Opened groups are compared as incidence
   matrices in one product, inside a task: no row per pair of documents is
   made.  A task emits a spanning forest of the links it found and each set's
   number of links.
5. Components of those links.  Nothing is sampled or capped: every linked pair
   shares a signature, hence its groups are compared.

Texts are read twice; the second time only those with a shared signature are
shuffled.  N-grams are 64-bit hashes of their words.

Defined results: null and empty texts and texts without words have size 0 and
link with nothing; with fewer words than n the whole sequence is the one
n-gram; rows are told apart by doc_id, or where that repeats or is null by
doc_id and text (rows that repeat both are one document); component_id is the
smallest doc_id of the component; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.common import bounded_broadcast, documents, free, fresh, map_batches, register, spill, text_or_empty
from pagelake.llm.graph import components

WORDS, PERCENT = 3, 90
#: Sets of a group, on average, where links are counted and where only components
#: are wanted; n-grams of a group; ids that are broadcast at most.
GROUP, WIDE_GROUP, GROUP_TOKENS, ID_LIMIT = 64, 256, 1 << 17, 1_000_000
#: Low bits of a signature that hold its size level.
LEVEL_BITS = 10
#: Bytes hashed together; texts are cut between words to fit.
BLOCK = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(BLOCK, base, np.uint64))))


_POWER, _UNPOWER = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _blocks(text: bytes):
    """Pieces of at most BLOCK bytes that end between words; a word that is
    longer stands in by its digest."""
    if len(text) > BLOCK:
        text = b" ".join(w if len(w) < BLOCK else b"\0" + hashlib.blake2b(w.translate(_FOLD)).hexdigest().encode()
                         for w in text.split())
    at = 0
    while len(text) - at > BLOCK:
        cut = text.rfind(b" ", at, at + BLOCK) + 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word."""
    hashes, owners, held, size = [], [], [], 0

    def flush():
        if not held:
            return
        data = np.frombuffer(b" ".join(p for _, p in held), np.uint8)
        space = np.concatenate(([True], _SPACE[data], [True]))
        start = np.flatnonzero(space[:-2] & ~space[1:-1])
        end = np.flatnonzero(~space[1:-1] & space[2:]) + 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _POWER[:len(data)], out=total[1:])
        hashes.append(_mix((total[end] - total[start]) * _UNPOWER[start] + (end - start).astype(np.uint64)))
        begin = np.cumsum([0] + [len(p) + 1 for _, p in held])[:-1]
        owners.append(np.array([i for i, _ in held], np.int64)[np.searchsorted(begin, start, "right") - 1])
        held.clear()

    for i, text in enumerate(texts):
        for piece in _blocks(text):
            if size + len(piece) + 1 > BLOCK:
                flush()
                size = 0
            held.append((i, piece))
            size += len(piece) + 1
    flush()
    return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int64)])


def token_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, token) of the distinct n-grams of every text, sorted."""
    word, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts))
    parts, owners = [], []
    n = len(word) - words + 1
    if n > 0:
        gram = np.zeros(n, np.uint64)
        for j in range(words):
            gram = gram * _U(0xD6E8FEB86659FD93) + word[j:j + n]
        inside = owner[:n] == owner[words - 1:]
        parts.append(_mix(gram[inside]))
        owners.append(owner[:n][inside])
    first = np.cumsum(count) - count
    for few in range(1, words):  # fewer words: the whole sequence
        some = np.flatnonzero(count == few)
        gram = np.full(len(some), few, np.uint64)
        for j in range(few):
            gram = gram * _U(0xA0761D6478BD642F) + word[first[some] + j]
        parts.append(_mix(gram))
        owners.append(some)
    token = np.concatenate(parts or [np.zeros(0, np.uint64)])
    owner = np.concatenate(owners or [np.zeros(0, np.int64)])
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], token[new]


def size_levels(percent: int, most: int) -> np.ndarray:
    """First size of each level; linked sets lie in one level or neighbours."""
    firsts = [1]
    while firsts[-1] <= most:
        firsts.append(firsts[-1] * 100 // percent + 1)
    firsts += [firsts[-1] * 100 // percent + 1]
    firsts += [firsts[-1] * 100 // percent + 1]
    return np.array(firsts, np.int64)


def parts_of(firsts: np.ndarray, tag: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the sets that sign for level ``tag``, and how many of them may
    be empty without being signed: linked sets up to that level differ in at
    most D n-grams, so D + 1 + empty parts hold one that is equal and signed."""
    differ = 2 * (firsts[tag + 1] - 1) * (100 - percent) // (100 + percent)
    empty = 1 + differ // 12
    return differ + 1 + empty, empty


def signatures(owner: np.ndarray, token: np.ndarray, size: np.ndarray, percent: int):
    """(set number, signature) of sets given as sorted (owner, token)."""
    if not len(token):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    firsts = size_levels(percent, int(size.max()))
    level = np.searchsorted(firsts, size, "right") - 1
    spread = _mix(token ^ _U(0x5851F42D4C957F2D))
    low, high = (spread & _U(0xFFFFFFFF)).astype(np.float64), (spread >> _U(32)).astype(np.float64)
    sets, signs = [], []
    for tag in (level, level + 1):
        parts, spare = parts_of(firsts, tag, percent)
        parts = np.where(size > 0, parts, 0)
        begin = np.cumsum(parts) - parts
        slot = begin[owner] + ((token >> _U(11)) % parts[owner].astype(np.uint64)).astype(np.int64)
        total = int(parts.sum())
        sums = [np.bincount(slot, w, total) for w in (low, high)]  # exact: below 2^53
        value = sums[0].astype(np.uint64) + (sums[1].astype(np.uint64) << _U(32))
        full = np.bincount(slot, minlength=total) > 0
        own = np.repeat(np.arange(len(size)), parts)
        part = np.arange(total) - begin[own]
        empties = np.bincount(own[~full], minlength=len(size))
        use = full | (empties > spare)[own]
        key = _mix(value + _U(_BASE) * (tag[own].astype(np.uint64) * _U(1 << 32) + part.astype(np.uint64)) + full.astype(np.uint64))
        key = key >> _U(LEVEL_BITS) << _U(LEVEL_BITS) | tag[own].astype(np.uint64)
        sets.append(own[use])
        signs.append(key[use])
    return np.concatenate(sets), np.concatenate(signs)


def _digests(owner, token, size) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    out = []
    for salt in (0x632BE59BD9B4E019, 0x2545F4914F6CDD1D):
        spread = _mix(token ^ _U(salt))
        low = np.bincount(owner, (spread & _U(0xFFFFFFFF)).astype(np.float64), len(size)).astype(np.uint64)
        high = np.bincount(owner, (spread >> _U(32)).astype(np.float64), len(size)).astype(np.uint64)
        out.append(_mix(low + (high << _U(32)) + size.astype(np.uint64)))
    return out[0], out[1]


def _text_runs(batches):
    """(nodes, texts) of up to a few MB, in order of the node."""
    for b in batches:
        held, size = [], 0
        for node, text in zip(b.column("node").to_pylist(), b.column("text")):
            text = text.as_py().encode()
            held.append((node, text))
            size += len(text)
            if size > 2 * BLOCK:
                yield sorted(held)
                held, size = [], 0
        if held:
            yield sorted(held)


def _sign_task(words: int, percent: int):
    """Rows (sig, more, node, n): of a document its two digests and n >= 0, of
    a signature n = -1.  Of equal sets in a batch only the first signs."""
    def task(batches):
        for run in _text_runs(batches):
            node = np.array([r[0] for r in run], np.int64)
            owner, token = token_sets([r[1] for r in run], words)
            size = np.bincount(owner, minlength=len(run))
            one, two = _digests(owner, token, size)
            seen: set[tuple] = set()
            first = np.array([(k not in seen, seen.add(k))[0] for k in zip(one.tolist(), two.tolist())], bool)
            use = first[owner]
            sets, signs = signatures(owner[use], token[use], np.where(first, size, 0), percent)
            n, m = len(run), len(sets)
            spread = _mix(node.view(np.uint64) + _U(_BASE))  # documents without words are no copies of each other
            one = np.where(size > 0, one, spread)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((one, signs)).view(np.int64)), pa.array(np.concatenate((two.view(np.int64), np.zeros(m, np.int64)))),
                 pa.array(np.concatenate((node, node[sets]))), pa.array(np.concatenate((size, np.full(m, -1))))],
                ["sig", "more", "node", "n"])
    return task


def _token_task(words: int):
    def task(batches):
        for run in _text_runs(batches):
            owner, token = token_sets([r[1] for r in run], words)
            cut = np.flatnonzero(np.diff(owner)) + 1
            nodes = [run[i][0] for i in owner[np.concatenate(([0], cut))]] if len(owner) else []
            rows = [t.tobytes() for t in np.split(token, cut)] if len(owner) else []
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(rows, pa.binary())], ["node", "tokens"])
    return task


def sketch_bits(n: int) -> int:
    """Bits of the parity sketch of a set of ``n`` tokens."""
    return max(1024, 1 << (2 * n - 1).bit_length())


def parity_sketch(token: np.ndarray) -> np.ndarray:
    """Bytes whose bits tell whether an even or odd number of tokens hash there.
    Two sets differ in at least as many tokens as their sketches do in bits."""
    bits = sketch_bits(len(token))
    place = (_mix(token ^ _U(0x3C6EF372FE94F82B)) % _U(bits)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8))


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set with fewer bits: places are taken modulo the new number."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _sketch_task(words: int):
    def task(batches):
        for run in _text_runs(batches):
            owner, token = token_sets([r[1] for r in run], words)
            cut = np.flatnonzero(np.diff(owner)) + 1
            nodes = [run[i][0] for i in owner[np.concatenate(([0], cut))]] if len(owner) else []
            rows = [parity_sketch(t).tobytes() for t in np.split(token, cut)] if len(owner) else []
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(rows, pa.binary())], ["node", "sketch"])
    return task


def _stacked(members: list[dict]) -> dict[int, tuple]:
    """Sketches by their size: (places among the members, matrix, set sizes)."""
    by: dict[int, list[int]] = {}
    for i, m in enumerate(members):
        by.setdefault(len(m["sketch"]), []).append(i)
    return {size: (np.array(at), np.frombuffer(b"".join(members[i]["sketch"] for i in at), np.uint8).reshape(len(at), size),
                   np.array([members[i]["n"] for i in at])) for size, at in by.items()}


def _folded_rows(sketches: np.ndarray, size: int) -> np.ndarray:
    while sketches.shape[1] > size:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def may_link(one: list[dict], other: list[dict], percent: int, same: bool) -> bool:
    """Whether the sketches leave room for a linked pair of two groups."""
    left, right = _stacked(one), _stacked(other)
    for size, (at, mine, n) in left.items():
        for size2, (at2, theirs, m) in right.items():
            low = min(size, size2)
            a, b = _folded_rows(mine, low), np.ascontiguousarray(_folded_rows(theirs, low))
            for i in range(len(a)):
                some = at2 > at[i] if same else slice(None)
                apart = np.bitwise_count((b[some] ^ a[i]).view(np.uint64)).sum(axis=1)
                if (apart <= (m[some] + n[i]) * (100 - percent) // (100 + percent)).any():
                    return True
    return False


_SKETCHES = "array<struct<n: long, sketch: binary>>"


def _bound_task(percent: int):
    def task(batches):
        for b in batches:
            for at in range(0, len(b), 16):
                kept = [(r["g1"], r["g2"]) for r in b.slice(at, 16).to_pylist()
                        if may_link(r["one"], r["other"], percent, r["g1"] == r["g2"])]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], ["g1", "g2"])
    return task


def _union_task(batches):
    """Matrix rows: the union of the tokens of each group's members."""
    for b in batches:
        rows = [np.unique(np.concatenate([np.frombuffer(m["tokens"], np.uint64) for m in members])).tobytes()
                for members in b.column("members").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("gid"), b.column("members"), pa.array(rows, pa.binary())],
                                         ["gid", "members", "tokens"])


_MEMBERS = "array<struct<node: long, copies: long, tokens: binary>>"


def compare_groups(one: list[dict], other: list[dict], union: np.ndarray, percent: int, same: bool):
    """Linked pairs (i, j) of members of two groups, by the matrix method."""
    sets = [np.frombuffer(m["tokens"], np.uint64) for m in one]
    queries = []
    for i, s in enumerate(sets):  # the bound: how much of the query the group can hold at all
        held = np.minimum(np.searchsorted(union, s), len(union) - 1)
        if 100 * int((union[held] == s).sum()) >= percent * len(s):
            queries.append(i)
    if not queries:
        return []
    theirs = [np.frombuffer(m["tokens"], np.uint64) for m in other]
    out = []
    if len(queries) * len(theirs) <= 4:
        for i in queries:
            for j, t in enumerate(theirs):
                if same and j <= i:
                    continue
                both = len(np.intersect1d(sets[i], t, assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(t) - both):
                    out.append((i, j))
        return out
    size_i = np.array([len(sets[i]) for i in queries])
    size_j = np.array([len(t) for t in theirs])
    both = np.zeros((len(queries), len(theirs)), np.int64)
    step = 1 << 14  # columns of the incidence matrices at a time
    for at in range(0, len(union), step):
        some = union[at:at + step]
        left, right = (_incidence(s, some) for s in ([sets[i] for i in queries], theirs))
        both += np.rint(left @ right.T).astype(np.int64)
    good = 100 * both >= percent * (size_i[:, None] + size_j[None, :] - both)
    return [(queries[i], int(j)) for i, j in zip(*np.nonzero(good)) if not same or j > queries[i]]


def _incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), np.float32)
    for i, s in enumerate(sets):
        lo, hi = np.searchsorted(s, columns[0]), np.searchsorted(s, columns[-1], "right")
        at = np.searchsorted(columns, s[lo:hi])
        out[i, at[columns[np.minimum(at, len(columns) - 1)] == s[lo:hi]]] = 1
    return out


def _compare_task(percent: int):
    """Rows (a, b, links): an edge of the spanning forest (links null), or a
    set's number of linked documents found here (b null)."""
    def task(batches):
        for b in (whole.slice(at, 8) for whole in batches for at in range(0, len(whole), 8)):
            found: list[tuple] = []
            for r in b.to_pylist():
                one, other, same = r["one"], r["other"], r["g1"] == r["g2"]
                root: dict[int, int] = {}
                links: dict[int, int] = {}

                def top(x):
                    while root.setdefault(x, x) != x:
                        x = root[x]
                    return x

                for i, j in compare_groups(one, other, np.frombuffer(r["tokens"], np.uint64), percent, same):
                    x, y = one[i], other[j]
                    links[x["node"]] = links.get(x["node"], 0) + y["copies"]
                    links[y["node"]] = links.get(y["node"], 0) + x["copies"]
                    p, q = top(x["node"]), top(y["node"])
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        found.append((x["node"], y["node"], None))
                found += [(n, None, k) for n, k in links.items()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b", "links"])
    return task


def _nodes(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(node, doc_id, text), and whether the node is the doc_id itself."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    total, there, different = rows.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    plain = total == there == different
    node = F.col("doc_id") if plain else F.xxhash64("doc_id", "text")
    return rows.select(node.alias("node"), "doc_id", "text"), plain


def _with_groups(pairs: DataFrame, groups: DataFrame, *more: str) -> DataFrame:
    """Pairs (g1, g2) with the members of both groups and ``more`` of the second."""
    return (pairs.join(groups.select(F.col("gid").alias("g1"), F.col("members").alias("one")), "g1")
            .join(groups.select(F.col("gid").alias("g2"), F.col("members").alias("other"), *more), "g2"))


def _group_pairs(shared: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """(g1, g2), g1 <= g2: groups that may hold linked sets of different components
    (``part``: the component that all sets of a group are known to lie in, or null)."""
    meets = spill(shared.join(member.select("node", "gid", "part"), "node").select("sig", "gid", "part").distinct(), "meets")
    level = F.col("sig").bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)).cast("int")
    wide = lambda *c: F.xxhash64(*c).cast("decimal(38,0)")
    company = meets.groupBy("sig").agg(F.sum(wide("gid")).alias("c1"), F.sum(wide("gid", F.lit(1))).alias("c2"), F.count("*").alias("size"))
    once = (company.where("size > 1").groupBy("c1", "c2", "size", level.alias("level"))
            .agg(F.min("sig").alias("sig"), F.count("*").alias("times")).select("sig", "level", "times"))
    one = meets.join(once, "sig").select("sig", "level", "times", F.col("gid").alias("g1"), F.col("part").alias("p1"))
    met = (one.join(meets.select("sig", F.col("gid").alias("g2"), F.col("part").alias("p2")), "sig")
           .where("g1 < g2 AND (p1 IS NULL OR p2 IS NULL OR p1 <> p2)")
           .groupBy("g1", "g2", "level").agg(F.sum("times").alias("times")))
    most = member.groupBy("gid", "part").agg(F.max("n").alias("most"), F.count("*").alias("sets"))
    largest = most.agg(F.max("most")).first()[0] or 1
    firsts = size_levels(percent, largest)
    signed = [p - e for p, e in zip(*map(np.ndarray.tolist, parts_of(firsts, np.arange(len(firsts) - 1), percent)))]
    signed = F.element_at(F.array(*map(F.lit, signed)), F.col("level") + 1)
    differ = F.floor((F.col("m1") + F.col("m2")) * (100 - percent) / (100 + percent))
    met = (met.join(most.select(F.col("gid").alias("g1"), F.col("most").alias("m1")), "g1")
           .join(most.select(F.col("gid").alias("g2"), F.col("most").alias("m2")), "g2")
           .where(F.col("times") >= signed - differ).select("g1", "g2").distinct())
    return met.unionByName(most.where("sets > 1 AND part IS NULL").select(F.col("gid").alias("g1"), F.col("gid").alias("g2")))


def _named(shared: DataFrame) -> DataFrame:
    """(node, leader, times): the centre of each signature is the set whose
    signatures are the most frequent in sum, one near to many others."""
    sizes = shared.groupBy("sig").agg(F.count("*").alias("size"))
    fame = shared.join(sizes, "sig").groupBy("node").agg(F.sum("size").alias("fame"))
    centre = (shared.join(fame, "node").groupBy("sig")
              .agg(F.max(F.struct("fame", -F.col("node"), "node"))["node"].alias("leader")))
    return shared.select("sig", "node").join(centre, "sig").groupBy("node", "leader").agg(F.count("*").alias("times"))


def _apart_task(percent: int):
    """Rows (node, leader, apart) of the pairs whose sketches leave room for a link."""
    def task(batches):
        for b in batches:
            kept = []
            for node, leader, n, m, one, two in zip(*(c.to_pylist() for c in b.columns)):
                one, two = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
                size = min(len(one), len(two))
                apart = int(np.bitwise_count(_folded(one, size) ^ _folded(two, size)).sum())
                if apart <= (n + m) * (100 - percent) // (100 + percent):
                    kept.append((node, leader, apart))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], ["node", "leader", "apart"])
    return task


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, count_links: bool = True) -> DataFrame:
    """(doc_id, node, n_shingles, component_id, n_links) of every row.

    Without ``count_links`` (n_links is null then) sets that are known to be
    connected need not be compared: first each set is compared with the centre of
    its signatures only, and the components found so far are contracted.  Signatures
    whose sets all lie in one component are done; in the others, groups are of
    one component or of sets without a link, and pairs within a component are
    left out."""
    spark = docs.sparkSession
    rows, plain = _nodes(docs)
    same = Window.partitionBy("sig", "more", "n")
    signed = (map_batches(rows.select("node", "text"), _sign_task(words, percent), "sig long, more long, node long, n long")
              .repartition("sig").withColumn("leader", F.min("node").over(same))
              .withColumn("shared", F.max("node").over(same) != F.col("leader")))
    marks = spill(signed.where("n >= 0 OR shared"), "signed")
    del signed
    free(spark)
    sets = marks.where("n >= 0").select("node", F.when(F.col("n") > 0, F.col("leader")).otherwise(F.col("node")).alias("rep"), "n").distinct()
    sets = spill(sets, "sets")
    copy = sets.where("node <> rep").select("node")
    shared = marks.where("n < 0").select("sig", "node").join(bounded_broadcast(copy, ID_LIMIT), "node", "left_anti")
    by_sig = Window.partitionBy("sig")
    shared = (shared.repartition("sig").withColumn("leader", F.min("node").over(by_sig))
              .withColumn("last", F.max("node").over(by_sig)).where("leader <> last").select("sig", "node", "leader"))
    shared = spill(shared, "shared")

    named = shared.groupBy("node", "leader").agg(F.count("*").alias("times"))
    family = named.groupBy("node").agg(F.max(F.struct("times", -F.col("leader"), "leader"))["leader"].alias("family"))
    firsts = size_levels(percent, sets.agg(F.max("n")).first()[0] or 1)
    starts = "array(" + ", ".join(map(str, firsts.tolist())) + ")"
    copies = sets.groupBy(F.col("rep").alias("node")).agg(F.count("*").alias("copies"))
    family = (family.join(copies, "node").join(sets.select("node", "n"), "node")
              .withColumn("level", F.expr(f"size(filter({starts}, x -> x <= n))")))

    def grouped(some: DataFrame, *by: str) -> DataFrame:
        """``some`` with groups of sets of equal ``by`` and size level, of about so many
        sets and n-grams."""
        most = GROUP if count_links else WIDE_GROUP
        chunks = some.groupBy(*by, "level").agg(F.ceil(F.greatest(F.count("*") / most, F.sum("n") / GROUP_TOKENS)).alias("chunks"))
        hold = [F.col(c).eqNullSafe(F.col("__" + c)) for c in (*by, "level")]
        chunks = chunks.select(*[F.col(c).alias("__" + c) for c in (*by, "level")], "chunks")
        cond = hold[0]
        for h in hold[1:]:
            cond = cond & h
        return some.join(chunks, cond).withColumn("gid", F.xxhash64(*by, "level", F.pmod(F.xxhash64("node"), F.col("chunks"))))

    def texts_of(some: DataFrame) -> DataFrame:
        texts = rows.join(bounded_broadcast(some.select("node").distinct(), ID_LIMIT), "node", "left_semi").select("node", "text")
        return texts if plain else texts.dropDuplicates(["node"])

    def compared(pairs: DataFrame, member: DataFrame, bounded: bool = False) -> DataFrame:
        """Links found in the pairs of groups: see ``_compare_task``."""
        def of_pairs(some: DataFrame) -> DataFrame:
            return spill(member.join(some.select(F.explode(F.array("g1", "g2")).alias("gid")).distinct(), "gid", "left_semi"), "compared")

        met = of_pairs(pairs)
        if not bounded:
            sketches = (map_batches(texts_of(met), _sketch_task(words), "node long, sketch binary").join(met, "node")
                        .groupBy("gid").agg(F.collect_list(F.struct("n", "sketch")).alias("members")))
            sketches = spill(sketches, "sketches")
            pairs = spill(map_batches(_with_groups(pairs, sketches), _bound_task(percent), "g1 long, g2 long"), "bounded")
            free(spark)
            met = of_pairs(pairs)
        tokens = map_batches(texts_of(met), _token_task(words), "node long, tokens binary")
        groups = (tokens.join(met, "node").groupBy("gid")
                  .agg(F.collect_list(F.struct("node", "copies", "tokens")).alias("members")))
        groups = spill(map_batches(groups, _union_task, f"gid long, members {_MEMBERS}, tokens binary"), "groups")
        found = map_batches(_with_groups(pairs, groups, "tokens"), _compare_task(percent), "a long, b long, links long")
        found = spill(found, "told")
        free(spark)
        return found

    def star_links() -> DataFrame:
        """Links of sets with the centre that most of their signatures name, or the
        next one, if the sketches of both leave room for a link."""
        order = Window.partitionBy("node").orderBy(F.desc("times"), "leader")
        asked = _named(shared).where("node <> leader").withColumn("place", F.row_number().over(order)).where("place <= 2")
        asked = spill(asked.select("node", "leader"), "asked")
        ends = asked.select(F.explode(F.array("node", "leader")).alias("node")).distinct()
        sketch = spill(map_batches(texts_of(ends), _sketch_task(words), "node long, sketch binary").join(sets.select("node", "n"), "node"), "ends")
        near = (asked.join(sketch, "node").join(sketch.select(F.col("node").alias("leader"), F.col("n").alias("m"), F.col("sketch").alias("other")), "leader")
                .select("node", "leader", "n", "m", "sketch", "other"))
        near = map_batches(near, _apart_task(percent), "node long, leader long, apart long")
        near = spill(near.groupBy("node").agg(F.min(F.struct("apart", "leader"))["leader"].alias("leader")), "near")
        chunks = near.groupBy("leader").agg(F.ceil(F.count("*") / GROUP).alias("chunks"))
        own = F.xxhash64("leader", F.lit("leader"))
        placed = spill(near.join(chunks, "leader").select(
            "node", own.alias("g1"), F.xxhash64("leader", F.pmod(F.xxhash64("node"), F.col("chunks"))).alias("g2")), "placed")
        member = placed.select("node", F.col("g2").alias("gid")).unionByName(
            near.select("leader").distinct().select(F.col("leader").alias("node"), own.alias("gid")))
        return edges(compared(placed.select("g1", "g2").distinct(), member.withColumn("copies", F.lit(1).cast("long")), bounded=True))

    equal = sets.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    edges = lambda told: told.where("b IS NOT NULL").select("a", "b")
    family = spill(family, "families")
    if count_links:
        member = grouped(family, "family").withColumn("part", F.lit(None).cast("long"))
        links = equal
    else:
        links = spill(star_links(), "star_links")
        part = spill(components(links), "parts")
        placed = shared.join(part, "node", "left").withColumn("part", F.coalesce("component", "node"))
        ends = placed.groupBy("sig").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("sig")
        shared = spill(shared.join(ends, "sig", "left_semi"), "open")
        family = (family.join(shared.select("node").distinct(), "node", "left_semi")
                  .join(part.withColumnRenamed("component", "part"), "node", "left")
                  .withColumn("family", F.when(F.col("part").isNull(), F.col("family"))))
        member = grouped(family, "family", "part")
        links = links.unionByName(equal)
    member = spill(member.select("node", "copies", "n", "gid", "part"), "members")
    pairs = spill(_group_pairs(shared, member, percent), "pairs")
    free(spark)
    told = compared(pairs, member.drop("part"))
    links = edges(told).unionByName(links)
    part = components(links)
    counted = told.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    zero = F.lit(0).cast("long")
    per = (sets.join(part, "node", "left").join(counted, "rep", "left").join(copies.withColumnRenamed("node", "rep"), "rep")
           .select("node", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"),
                   (F.coalesce("links", zero) + F.col("copies") - 1).alias("n_links")))
    if not count_links:
        per = per.withColumn("n_links", F.lit(None).cast("long"))
    if plain:
        return per.select(F.col("node").alias("doc_id"), "node", "n_shingles", "component_id", "n_links")
    per = rows.select("node", "doc_id").join(per, "node")
    least = per.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return per.join(least, "component_id").select("doc_id", "node", "n_shingles", F.col("least").alias("component_id"), "n_links")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component (that of the smallest
    doc_id); documents without links, also those without words, all stay."""
    docs_id = _nodes(docs)[1]
    found = join(docs, words, percent, count_links=False)
    no = fresh(docs.columns, "node")
    if docs_id:
        gone = found.where("doc_id <> component_id").select(F.col("node").alias(no))
        key = F.col("doc_id").cast("long")
    else:
        first = Window.partitionBy("component_id", "whole").orderBy(F.col("doc_id").asc_nulls_last(), "node")
        alone = F.when(F.col("n_shingles") == 0, F.col("node"))
        ranked = found.withColumn("whole", alone).distinct().withColumn("place", F.dense_rank().over(first))
        gone = ranked.where("place > 1").select(F.col("node").alias(no)).distinct()
        key = F.xxhash64(F.col("doc_id").cast("long"), text_or_empty("text"))
    gone = spill(gone, "gone")
    return docs.withColumn(no, key).join(bounded_broadcast(gone, ID_LIMIT), no, "left_anti").select(*[f"`{c}`" for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS sh FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 90 * (x.n + y.n - inter)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
k AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1)
SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id, coalesce(max(k.n_links), 0) AS n_links
FROM r LEFT JOIN n ON n.doc_id = r.a LEFT JOIN k ON k.a = r.a GROUP BY 1
"""


@register("op4_ngram_join", ORACLE)
def op4_ngram_join(spark, sf_dir):
    return join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")
