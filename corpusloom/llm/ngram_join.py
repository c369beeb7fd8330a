"""N-gram Jaccard self-join by parity sketches.

A document's sketch is an array of parity words: each shingle XORs a 64-bit hash into the word that
another hash picks. A shingle of one document alone changes one word, so the number of words in
which two sketches differ is at most the symmetric difference of the sets. Sets of sizes a <= b with
Jaccard similarity t have a symmetric difference of at most a * (1 - t) / t; a document with more
words in use than that must share one with every partner (pigeonhole), in the same size band.

Words in use that nobody else has count against that bound, so a first pass over word counts alone
leaves only documents that can have a partner. Of those, each is named by its rarest words alone, one
more than the bound: partners must meet in one of them, and words that many documents share, such as
a common passage makes, come last and seldom count. What meets is a candidate group, and in each
group the sets themselves are compared; a link counts when the words themselves confirm it, so no
collision of hashes links two texts. A set of which, against all likelihood, no more words are in use
than its bound is joined on its shingles.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, claim, collect_garbage, deal, flat_bytes, fresh, mix64, partitions, slices, slots, text_bytes, unpack
from .components import components

WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles (or 8-byte stretches of text, if more) of a candidate group that one task compares. A larger
#: group is dealt out by size bands, and a band that is still larger as pairs of blocks.
GROUP = 200_000
#: First shingles of unsure sets that are sent to every task (8 bytes each).
ASKED = 2_000_000
#: Width of those bands: a little above 100 / PERCENT, so partners lie in one band or in neighbours.
BAND = 1.34

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are hashed eight at a time; longer words go through BLAKE2.
_INLINE = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_MIXERS = mix64(np.arange(1000, 1000 + WIDTH, dtype=np.uint64)) | _U(1)
#: Bytes of packed rows that a task of the packed steps gets on average, at most.
PACKED = 64 << 20
SIGNATURE = np.dtype([("key", "<u4"), ("cls", "<u8")])
COUNT = np.dtype([("cls", "<u8"), ("n", "<u4")])
WORD = np.dtype([("key", "<u8"), ("cls", "<u8"), ("bound", "<u4"), ("size", "<u4")])
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word and the row it is in.

    Each eight bytes are mixed into the state by a bijection that is not linear, so words of up to
    eight bytes never collide and no algebra makes longer ones collide.
    """
    claim("ngram_join")
    n = len(offsets) - 1
    size = len(raw) + n
    data = np.full(size + 8, 0x20, np.uint8)
    inner = np.ones(size, bool)
    inner[offsets[1:] + np.arange(n)] = False
    data[:size][inner] = _LOWER[raw]
    letter = ~_SPACE[data[:size]]
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = ends - starts
    eight = np.ndarray((size + 1,), "<u8", data, 0, (1,))  # the eight bytes from each place on
    hashes = mix64((eight[starts] & _MASK[np.minimum(length, 8)]) ^ mix64(length.astype(np.uint64) + _U(0x2545F4914F6CDD1D)))
    for k in range(8, _INLINE, 8):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        hashes[more] = mix64(hashes[more] * _U(0x9E3779B97F4A7C15) ^ (eight[starts[more] + k] & _MASK[np.minimum(length[more] - k, 8)]))
    for k in np.flatnonzero(length > _INLINE).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    rows = np.searchsorted(offsets[1:] + np.arange(n), starts, side="left")
    return hashes, rows


def _chain(words: list[np.ndarray]) -> np.ndarray:
    """One hash for the words at each place, in order."""
    code = np.full(len(words[0]), len(words), np.uint64)
    for word, factor in zip(words, _MIXERS, strict=False):
        code = (code ^ word) * factor
        code ^= code >> _U(29)
    return mix64(code)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all rows, sorted in each row, and the offsets of the rows."""
    n = len(offsets) - 1
    words, rows = word_hashes(raw, offsets)
    counts = np.bincount(rows, minlength=n)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.where(counts >= WIDTH, counts - WIDTH + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(out_at[-1]), np.uint64)
    if len(words) >= WIDTH:
        last = len(words) - WIDTH + 1
        code = _chain([words[k : k + last] for k in range(WIDTH)])
        whole = rows[:last] == rows[WIDTH - 1 :]
        out[np.repeat(counts >= WIDTH, sizes)] = code[whole]
    for r in np.flatnonzero((counts > 0) & (counts < WIDTH)).tolist():
        some = words[firsts[r] : firsts[r + 1]]
        out[out_at[r]] = _chain([some[k : k + 1] for k in range(len(some))])[0]
    for r in np.flatnonzero(sizes > 1).tolist():
        out[out_at[r] : out_at[r + 1]].sort()
    row = np.repeat(np.arange(n), sizes)
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[first], np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=n))])


def word_shingles(body: bytes) -> set[tuple[bytes, ...]]:
    """The shingles of a text as the words themselves."""
    words = _WORD.findall(body.translate(_LOWER.tobytes()))
    if len(words) < WIDTH:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(WIDTH)), strict=False))


def _sums(tokens: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix64(tokens ^ _U(salt)), out=total[1:])
    return mix64((total[at[1:]] - total[at[:-1]]) + np.diff(at).astype(np.uint64) * _U(0x9FB21C651E98DF25))


def set_classes(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One name for each set, a 64-bit hash whose last bit is 0; equal sets have equal names."""
    return _sums(tokens, at, 0xA24BAED4963EE407) & ~_U(1)


def set_checks(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A second hash of each set: sets are equal where both hashes are."""
    return _sums(tokens, at, 0x5DEECE66D1234567)


def words_of_band(band: np.ndarray) -> np.ndarray:
    """Words in a sketch of band k (sizes 2**k to 2**(k+1) - 1): enough that, of the words of a set,
    more are in use than its largest symmetric difference. Small sets have a word for each shingle."""
    top = 2 << band.astype(np.int64)
    return np.select([top <= 8, top <= 16, top <= 128], [np.int64(1 << 40), 64 * top, 4 * top], top // 2)


def sketch(tokens: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words in use, and the row of each: of a row's own band, or of the next lower one
    for rows small enough to have a partner there."""
    sizes = np.diff(at)
    band = np.zeros(len(sizes), np.int64)
    band[sizes > 0] = np.floor(np.log2(sizes[sizes > 0])).astype(np.int64)
    used = sizes >= 3  # smaller sets are linked to equal sets only
    if lower:
        used &= sizes * PERCENT <= 100 * ((1 << band) - 1)
        band = band - 1
    chosen = np.flatnonzero(used)
    if not len(chosen):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    take = np.repeat(used, sizes)
    tokens = tokens[take]
    row = np.repeat(np.arange(len(sizes)), sizes)[take]
    words = words_of_band(np.maximum(band, 0))
    base = np.concatenate([[0], np.cumsum(np.where(used, words, 0))])
    place = (mix64(tokens ^ _U(0x5851F42D4C957F2D)) % words[row].astype(np.uint64)).astype(np.int64)
    order = np.argsort(base[row] + place, kind="stable")
    slot = (base[row] + place)[order]
    firsts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    parity = np.bitwise_xor.reduceat(mix64(tokens[order] ^ _U(0x14057B7EF767814F)), firsts)
    row = row[order][firsts]
    name = (band[row].astype(np.uint64) << _U(40)) | place[order][firsts].astype(np.uint64)
    return mix64(parity ^ mix64(name + _U(0x632BE59BD9B4E019))), row


def _digest(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text, n_shingles, cls, check, weight, own, lower) of every document: its set's two
    names, what comparing it weighs, and the words in use in its sketches; text is the hash of its text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body", 2 << 20):
                raw, offsets = flat_bytes(part.column("body"))
                tokens, at = shingle_sets(raw, offsets)
                used = [np.bincount(sketch(tokens, at, lower)[1], minlength=part.num_rows) for lower in (False, True)]
                names = [f(tokens, at).view(np.int64) for f in (set_classes, set_checks)]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), part.column("text"), *map(pa.array, (np.diff(at), *names, np.maximum(np.diff(at), np.diff(offsets) >> 3), *used))], names=["key", "doc_id", "text", "n_shingles", "cls", "check", "weight", "own", "lower"])

    return docs.mapInArrow(run, "key long, doc_id long, text long, n_shingles long, cls long, check long, weight long, own long, lower long")


#: Kinds of packed rows: of words that were not yet found shared, of words that were, and counts of shared words.
_OPEN, _COUNTED, _COUNTS = 0, 1, 2


def _shared_here(rows: np.ndarray, dealt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (key, cls) rows of one task: those of words that one set has here, two rows of each word that more sets have, and the
    counted words (cls, n) of the latter. So a word that very many sets share leaves a task as two rows."""
    full = (dealt.astype(_U) << _U(32)) | rows["key"].astype(_U)
    order = np.lexsort((rows["cls"], full))
    rows, full = rows[order], full[order]
    keep = np.concatenate([[True], (full[1:] != full[:-1]) | (rows["cls"][1:] != rows["cls"][:-1])])
    rows, full = rows[keep], full[keep]
    new = np.concatenate([[True], full[1:] != full[:-1]])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([starts, [len(rows)]]))
    shared = np.repeat(sizes > 1, sizes)
    nth = np.arange(len(rows)) - np.repeat(starts, sizes)
    cls, n = np.unique(rows["cls"][shared], return_counts=True)
    counts = np.empty(len(cls), COUNT)
    counts["cls"], counts["n"] = cls, n
    order = full >> _U(32)
    return (rows[~shared], order[~shared]), (rows[shared & (nth < 2)], order[shared & (nth < 2)]), counts


def _signatures(docs: DataFrame, parts: int) -> DataFrame:
    """(part, kind, blob): the word keys of all sets, packed, dealt by key; what a task can count by itself is counted there."""

    names = slots(parts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        dealt: list[np.ndarray] = []

        def flush():
            if any(map(len, held)):
                one, two, counts = _shared_here(np.concatenate(held), np.concatenate(dealt))
                for kind, rows, number in ((_OPEN, *one), (_COUNTED, *two), (_COUNTS, counts, mix64(counts["cls"]))):
                    for batch in deal(rows, number, names).to_batches():
                        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(np.full(batch.num_rows, kind, np.int32)), batch.column("blob")], names=["part", "kind", "blob"])
                held.clear()
                dealt.clear()

        for batch in batches:
            for part in slices(batch, "body", 2 << 20):
                tokens, at = shingle_sets(*flat_bytes(part.column("body")))
                classes = set_classes(tokens, at)
                for lower in (False, True):
                    keys, row = sketch(tokens, at, lower)
                    rows = np.empty(len(keys), SIGNATURE)
                    # the last bit tells the sketch of the own band from that of the lower one
                    rows["key"], rows["cls"] = keys >> _U(32), classes[row] | _U(lower)
                    held.append(rows)
                    dealt.append(keys & _U(0xFFFFFFFF))
                if sum(map(len, held)) > 1_000_000:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "part int, kind int, blob binary")


def _word_counts(signatures: DataFrame, parts: int) -> DataFrame:
    """(cls, n): how many words of each sketch other sets share, where any. The last bit
    of cls tells a set's two sketches apart. Partial counts travel packed, by set.

    A word that a task has found shared is counted there for its sets; its two rows tell other tasks so. A set that two
    tasks have read, as equal texts are one set, is counted once for each: words are then counted too often, which lets more
    sets stay and loses none."""
    names = slots(parts)

    def of(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
        some = [np.frombuffer(x, dtype) for x, k in zip(table.column("blob").to_pylist(), table.column("kind").to_pylist(), strict=True) if k == kind]
        return np.concatenate(some) if some else np.zeros(0, dtype)

    def count(table: pa.Table) -> pa.Table:
        open_ = of(table, _OPEN, SIGNATURE)
        rows = np.concatenate([open_, of(table, _COUNTED, SIGNATURE)])
        known = np.arange(len(rows)) >= len(open_)
        made = [of(table, _COUNTS, COUNT)]
        if len(rows):
            order = np.lexsort((known, rows["cls"], rows["key"]))
            key, cls, known = rows["key"][order], rows["cls"][order], known[order]
            last = np.concatenate([(key[1:] != key[:-1]) | (cls[1:] != cls[:-1]), [True]])
            key, cls, known = key[last], cls[last], known[last]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            cls, n = np.unique(cls[np.repeat(sizes > 1, sizes) & ~known], return_counts=True)
            more = np.empty(len(cls), COUNT)
            more["cls"], more["n"] = cls, n
            made.append(more)
        found = np.concatenate(made)
        return deal(found, mix64(found["cls"]), names)

    def add(table: pa.Table) -> pa.Table:
        rows = unpack(table, COUNT)
        cls, at = np.unique(rows["cls"], return_inverse=True)
        return pa.table({"cls": cls.view(np.int64), "n": np.bincount(at, rows["n"], len(cls)).astype(np.int64)})

    return signatures.groupBy("part").applyInArrow(count, "part int, blob binary").groupBy("part").applyInArrow(add, "cls long, n long")


def _bound(is_lower):
    """The largest symmetric difference with a partner, of whose sizes one at most is known: the set's
    own, or for partners in the next lower band the largest size there."""
    below = F.expr("shiftleft(1L, length(bin(n_shingles)) - 1) - 1")
    return (F.when(is_lower, below).otherwise(F.col("n_shingles")) * (100 - PERCENT) / PERCENT).cast("long")


def _bound_by(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """The sets of which, in one of their bands, at most as many words are outside the counted ones as
    the symmetric difference with a partner can have."""
    found = counts.select(F.col("cls").bitwiseAND(F.lit(-2)).alias("cls"), (F.col("cls").bitwiseAND(F.lit(1)) == 1).alias("is_lower"), "n")
    rest = F.when(F.col("is_lower"), F.col("lower")).otherwise(F.col("own")) - F.col("n")
    return sets.join(found, "cls").filter(rest <= _bound(F.col("is_lower"))).select(*sets.columns).distinct()


def _by_shingles(texts: DataFrame, one: DataFrame, unsure: DataFrame) -> DataFrame:
    """(a, b): each unsure set and the sets that share one of its first shingles, as many as one more
    than it can lack in a partner. Up to ASKED such shingles go to the tasks, and only those leave a text; more are joined
    with all shingles."""

    def shingles(frame: DataFrame, shared=None) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = None if shared is None else shared.value
            for batch in batches:
                for part in slices(batch, "body", 2 << 20):
                    tokens, at = shingle_sets(*flat_bytes(part.column("body")))
                    sizes = np.diff(at)
                    columns = [tokens.view(np.int64), np.repeat(set_classes(tokens, at).view(np.int64), sizes), np.arange(len(tokens)) - np.repeat(at[:-1], sizes), np.repeat(sizes, sizes)]
                    if asked is not None:
                        kept = asked[np.minimum(np.searchsorted(asked, columns[0]), len(asked) - 1)] == columns[0] if len(asked) else np.zeros(len(tokens), bool)
                        columns = [c[kept] for c in columns]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["token", "cls", "rank", "size"])

        return frame.select("body").mapInArrow(run, "token long, cls long, rank long, size long")

    keyed = texts.join(one.select("key").hint("merge"), "key")
    asks = shingles(texts.join(unsure.select("key").distinct(), "key")).filter(F.col("rank") <= F.col("size") * (100 - PERCENT) / PERCENT).select("token", F.col("cls").alias("a")).distinct()
    wanted = asks.select("token").distinct().limit(ASKED + 1).toArrow().column("token")
    shared = texts.sparkSession.sparkContext.broadcast(np.sort(np.asarray(wanted, np.int64))) if len(wanted) <= ASKED else None
    return shingles(keyed, shared).select("token", F.col("cls").alias("b")).join(asks, "token").filter("a <> b").select("a", "b").distinct()


def bounds(sizes: np.ndarray, lower: bool) -> np.ndarray:
    """The largest symmetric difference that a set of each size can have with a partner in its own
    band, or in the next lower one."""
    known = np.maximum(sizes, 1)
    if lower:
        known = (1 << np.floor(np.log2(known)).astype(np.int64)) - 1
    return known * (100 - PERCENT) // PERCENT


def _meetings(texts: DataFrame, parts: int) -> DataFrame:
    """(a, b): links from the smallest set of each word to the others, of words that are among the
    rarest of both: one more than the bound of the set. Rows travel packed."""
    names = slots(parts)

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, "body", 2 << 20):
                tokens, at = shingle_sets(*flat_bytes(part.column("body")))
                classes = set_classes(tokens, at)
                for lower in (False, True):
                    keys, row = sketch(tokens, at, lower)
                    rows = np.zeros(len(keys), WORD)
                    rows["key"], rows["cls"], rows["bound"] = keys, classes[row] | _U(lower), bounds(np.diff(at), lower)[row]
                    held.append(rows)
                if sum(map(len, held)) > 1_000_000:
                    rows = np.concatenate(held)
                    held.clear()
                    yield from deal(rows, rows["key"], names).to_batches()
        if held:
            rows = np.concatenate(held)
            yield from deal(rows, rows["key"], names).to_batches()

    def sized(table: pa.Table) -> pa.Table:
        rows = np.unique(unpack(table, WORD))  # sorted by key, each set once
        new = np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])
        starts = np.flatnonzero(new)
        rows["size"] = np.diff(np.concatenate([starts, [len(rows)]]))[np.cumsum(new) - 1]
        return deal(rows, mix64(rows["cls"]), names)

    def rarest(table: pa.Table) -> pa.Table:
        rows = unpack(table, WORD)
        rows = rows[np.lexsort((rows["key"], rows["size"], rows["cls"]))]
        starts = np.flatnonzero(np.concatenate([[True], rows["cls"][1:] != rows["cls"][:-1]]))
        rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(rows)]])))
        rows = rows[(rank <= rows["bound"]) & (rows["size"] > 1)]
        return deal(rows, rows["key"], names)

    def link(table: pa.Table) -> pa.Table:
        rows = unpack(table, WORD)
        rows["cls"] &= ~_U(1)
        rows = rows[np.lexsort((rows["cls"], rows["key"]))]
        new = np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])
        least = rows["cls"][np.flatnonzero(new)][np.cumsum(new) - 1]
        pairs = np.empty(len(rows), PAIR)
        pairs["a"], pairs["b"] = least, rows["cls"]
        pairs = np.unique(pairs[pairs["a"] != pairs["b"]])
        return deal(pairs, mix64(pairs["a"] ^ mix64(pairs["b"])), names)

    def once(table: pa.Table) -> pa.Table:
        rows = np.unique(unpack(table, PAIR))
        return pa.table({k: np.ascontiguousarray(rows[k]).view(np.int64) for k in ("a", "b")})

    out = texts.select("body").mapInArrow(words, "part int, blob binary")
    for step in (sized, rarest, link):
        out = out.groupBy("part").applyInArrow(step, "part int, blob binary")
    return out.groupBy("part").applyInArrow(once, "a long, b long")


def link_sets(sets: list[np.ndarray], bodies: list[bytes]) -> np.ndarray:
    """For each set the number of the first set that it is linked to, directly or through others.

    Exact: two sets with enough in common share one of their rarest shingles (prefix filter); such
    pairs are compared unless they are connected already, and what the hashes link is compared in words.
    """
    said: dict[int, set] = {}

    def words(x: int) -> set:
        if x not in said:
            said[x] = word_shingles(bodies[x])
        return said[x]

    n = len(sets)
    root = np.arange(n)
    if n < 2:
        return root
    sizes = np.array([len(s) for s in sets])

    def linked(x: int, y: int) -> bool:
        small, large = (x, y) if sizes[x] <= sizes[y] else (y, x)
        if 100 * sizes[small] < PERCENT * sizes[large]:
            return False
        at = np.searchsorted(sets[large], sets[small])
        both = int((sets[large][np.minimum(at, sizes[large] - 1)] == sets[small]).sum())
        if 100 * both < PERCENT * int(sizes[x] + sizes[y] - both):
            return False
        both = len(words(x) & words(y))
        return 100 * both >= PERCENT * (len(words(x)) + len(words(y)) - both)

    if n == 2:
        return np.array([0, 0 if linked(0, 1) else 1])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, token, df = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.lexsort((token, df[token], owner))
    owner, token = owner[order], token[order]
    rank = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    prefix = (rank <= (sizes - -(-PERCENT * sizes // 100))[owner]) & (df[token] > 1)
    owner, token = owner[prefix], token[prefix]
    by_token = np.argsort(token, kind="stable")
    posted, starts = owner[by_token], np.searchsorted(token[by_token], np.arange(len(df) + 1))
    spans = np.searchsorted(owner, np.arange(n + 1))
    for x in range(n):
        mine = token[spans[x] : spans[x + 1]]
        if not len(mine):
            continue
        near = np.concatenate([posted[starts[t] : starts[t + 1]] for t in mine.tolist()])
        near = near[(near > x) & (root[near] != root[x])]
        if not len(near):
            continue
        near, shared = np.unique(near, return_counts=True)
        for y in near[np.argsort(-shared, kind="stable")].tolist():
            if root[x] != root[y] and linked(x, y):
                low, high = sorted((root[x], root[y]))
                root[root == high] = low
    return root


def _compare(groups: DataFrame) -> DataFrame:
    """(a, b): links that connect what is linked in each group. Rows (task, body)."""

    def flush(bodies: list[bytes]) -> tuple[list[int], list[int]]:
        tokens, at = shingle_sets(*flat_bytes(pa.array(bodies, pa.large_binary())))
        names = set_classes(tokens, at).view(np.int64)
        one = np.unique(names, return_index=True)[1].tolist()
        root = link_sets([tokens[at[k] : at[k + 1]] for k in one], [bodies[k] for k in one])
        linked = [(one[k], one[int(r)]) for k, r in enumerate(root) if k != r]
        return names[[k for k, _ in linked]].tolist(), names[[r for _, r in linked]].tolist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        a: list[int] = []
        b: list[int] = []
        for batch in batches:
            for task, body in zip(batch.column("task").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if task != now and rows:
                    x, y = flush(rows)
                    a += x
                    b += y
                    rows = []
                now = task
                rows.append(body)
            if len(a) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        x, y = flush(rows) if rows else ([], [])
        yield pa.RecordBatch.from_pydict({"a": pa.array(a + x, pa.int64()), "b": pa.array(b + y, pa.int64())})

    parts = partitions(groups.sparkSession)
    return groups.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def _components_of(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, n_shingles, root, alone) of every row: rows of one component have equal (root, alone)."""
    spark = docs.sparkSession
    # a row is found again by its id, one without an id by its text
    body = text_bytes(text_col)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(body)).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("text"), body.alias("body"))
    digest = scratch.table(_digest(texts), "sets")
    one = digest.filter("n_shingles > 2").groupBy("cls").agg(F.min(F.struct("check", "key")).alias("rep"), *(F.max(c).alias(c) for c in ("n_shingles", "weight", "own", "lower"))).select("cls", "rep.check", "rep.key", "n_shingles", "weight", "own", "lower")
    words = digest.agg(F.sum(F.col("own") + F.col("lower"))).first()[0] or 0
    parts = max(partitions(spark), -(-words * SIGNATURE.itemsize // PACKED))

    counts = scratch.table(_word_counts(_signatures(texts.select("body"), parts), parts), "shared")
    collect_garbage(spark)
    alive = scratch.table(_bound_by(one, counts), "alive")
    scratch.drop(counts)
    unsure = one.filter((F.col("own") <= _bound(F.lit(False))) | ((F.col("lower") > 0) & (F.col("lower") <= _bound(F.lit(True)))))
    extra = None
    if not unsure.isEmpty():
        extra = scratch.table(_by_shingles(texts, one, unsure), "extra")
        sides = extra.select(F.col("a").alias("cls")).unionAll(extra.select(F.col("b").alias("cls"))).distinct()
        alive = scratch.table(alive.unionByName(one.join(sides, "cls").select(*alive.columns)).distinct(), "alive")
    # the list of keys grows with the corpus: it is merged at every size, never broadcast
    some = scratch.table(texts.join(alive.select("key").hint("merge"), "key").select("key", "body"), "texts")
    collect_garbage(spark)
    met = _meetings(some, parts)
    near = components(scratch, met.unionAll(extra) if extra else met, "near")
    near = scratch.table(near.join(alive, near["node"] == alive["cls"]).select("cls", "key", "root", "n_shingles", "weight"), "candidates")

    size = scratch.table(near.groupBy("root").agg(F.sum("weight").alias("total")), "sizes")
    placed = scratch.table(near.join(size, "root"), "placed")
    fits = placed.filter(F.col("total") <= GROUP).select("key", F.col("root").cast("string").alias("task"))
    # a larger group meets in overlapping size bands: band k and the next
    band = F.floor(F.log("n_shingles") / F.log(F.lit(BAND))).cast("int")
    banded = placed.filter(F.col("total") > GROUP).withColumn("b", band).withColumn("k", F.explode(F.array("b", F.col("b") - 1))).withColumn("task", F.concat_ws(":", "root", "k")).select("cls", "key", "weight", "task", (F.col("b") == F.col("k")).alias("own_band"))
    # without sets of band k itself, those of the next one meet in their own task
    total = scratch.table(banded.groupBy("task").agg(F.sum("weight").alias("total"), F.max("own_band").alias("any_own")).filter("any_own").drop("any_own"), "bands")
    banded = banded.join(total, "task")
    fits = fits.unionByName(banded.filter(F.col("total") <= GROUP).select("key", "task"))
    # a band too large for one task: every pair of its blocks is compared, by the same exact way
    blocks = F.ceil(F.col("total") / (GROUP // 2)).cast("int")
    wide = banded.filter(F.col("total") > GROUP).withColumn("k", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tasks = fits.unionByName(wide.select("key", F.concat_ws("/", "task", F.least("k", "o"), F.greatest("k", "o")).alias("task")))
    links = scratch.table(_compare(some.join(tasks.distinct(), "key").select("task", "body")), "links")
    scratch.drop(some)
    roots = components(scratch, links, "linked").withColumnRenamed("node", "cls").join(alive.select("cls", "check"), "cls")
    named = digest.join(roots, ["cls", "check"], "left").select("doc_id", "text", "n_shingles", F.coalesce("root", "cls").alias("root"), F.when(F.col("root").isNull(), F.col("check")).alias("alone"))
    return scratch.table(named, "named")


def _of_groups(named: DataFrame, value, name: str, scratch: Scratch) -> DataFrame:
    """The rows with one more column, a value of their component."""
    found = scratch.table(named.groupBy("root", "alone").agg(value.alias(name)), name).select(F.col("root").alias("r"), F.col("alone").alias("x"), name)
    return named.join(found, (named["root"] == found["r"]) & named["alone"].eqNullSafe(found["x"])).drop("r", "x")


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Two documents are linked when 100 * intersection >= 75 * union of their sets of five-word
    shingles; component_id is the smallest doc_id reachable. Null texts and texts without words are
    empty sets, linked with nothing. A row with a null doc_id is linked like any other, and its
    component is the smallest id reachable (null if none); equal texts and repeated rows are one set;
    an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    joined = _of_groups(_components_of(docs, scratch, id_col, text_col), F.min("doc_id"), "least", scratch)
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of linked documents, all columns kept: that of the smallest id (a row
    without an id stands for a group only if no row of it has one), of several texts of that id the one of
    the smallest hash, of repeated rows of it one.

    Texts without words are groups of their own; of repeated rows of such an id and text one stays too.
    An empty table stays empty. Columns of any name may be there.
    """
    scratch = Scratch(docs.sparkSession)
    nameless = F.col("doc_id").isNull()
    joined = _of_groups(_components_of(docs, scratch, id_col, text_col), F.min(F.struct(nameless.alias("nameless"), "doc_id", "text")), "chosen", scratch)
    chosen = (F.col("n_shingles") == 0) | ((F.col("text") == F.col("chosen.text")) & F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")))
    kept = scratch.table(joined.filter(chosen).select("doc_id", "text").distinct(), "kept").alias("k")
    name = fresh(docs, "name")
    known = docs.withColumn(name, F.xxhash64(text_bytes(text_col))).alias("d")
    some = known.join(kept, (F.col(f"d.{name}") == F.col("k.text")) & F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("k.doc_id")), "left_semi")
    return some.dropDuplicates([id_col, text_col]).select(docs.columns)
