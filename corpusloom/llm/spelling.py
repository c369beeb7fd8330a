"""Spelling variants by full neighbourhood generation.

Every word of the vocabulary emits all strings that one deleted, replaced or inserted code point makes
of it, over the alphabet that the vocabulary shows, each once. A string travels as its name, two
64-bit sums of one number for each (code point, place): the names of all neighbours follow from the
sums left and right of the change, so no string is built. Names are joined to the vocabulary's by an
equi-join; a match is a near word as it is, nothing is compared again.

Up to FILTER_WORDS words, a bitmap of the vocabulary's names goes to the tasks and neighbours that are
surely no words are not emitted. A larger vocabulary joins all of them, with the same result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, partitions, slices, text_bytes

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in this many loses a code point (a planted misspelling).
MISSPELT = 97
#: A word is a form of its near word if that is at least so many times as frequent.
FACTOR = 2
#: Words up to which a bitmap (BITS bits a word, 16 MB at most) is sent to every task.
FILTER_WORDS = 4_000_000
BITS = 32
#: Neighbour names that one task holds at once.
BLOCK = 1 << 21
#: Rows of a batch of neighbours.
EMITTED = 1 << 16
#: Distinct words, and their code points, that a task counts before it passes them on.
HELD, HELD_CHARS = 200_000, 8 << 20
#: Code points of a text that are searched at once.
PIECE = 1 << 20
#: The two sums of a name.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def pieces(text: str) -> Iterator[str]:
    """A text in pieces that cut no run; only a run longer than a piece makes one longer."""
    start = 0
    while len(text) - start > PIECE:
        stop = start + PIECE
        found = RUN.match(text, stop)
        stop = found.end() if found else stop
        yield text[start:stop]
        start = stop
    yield text[start:]


def misspelt(doc_id: int | None, run: str) -> str:
    """The lower-cased run, or without one code point where its checksum says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % MISSPELT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of words that are long and frequent enough; counts are summed up in each task first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        chars = 0
        for batch in batches:
            for part in slices(batch, "body", 2 << 20):
                for doc_id, body in zip(part.column("doc_id").to_pylist(), part.column("body").to_pylist(), strict=True):
                    for piece in pieces(body.translate(_LOWER).decode("utf-8", "replace")):
                        for word, n in Counter(RUN.findall(piece)).items():
                            if len(word) >= LEAST_LENGTH:
                                word = misspelt(doc_id, word)
                                if len(word) >= LEAST_LENGTH:
                                    before = len(held)
                                    held[word] += n
                                    chars += len(word) * (len(held) - before)
                        if len(held) > HELD or chars > HELD_CHARS:
                            yield _counts(held)
                            held, chars = Counter(), 0
        if held:
            yield _counts(held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    counted = rows.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _counts(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def _value(codes: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """The number of a code point at a place."""
    with np.errstate(over="ignore"):
        return mix64((codes.astype(_U) << _U(40)) + places.astype(_U) + _U(seed))


def _by_length(words: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of words of one length, at most ``most`` code points together, and their code points as a matrix."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        step = max(1, most // max(size, 1))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            yield some, np.frombuffer("".join(words[r] for r in some.tolist()).encode("utf-32-le"), np.uint32).reshape(len(some), size)


def names_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit sums of each word."""
    out = np.zeros((2, len(words)), _U)
    for rows, codes in _by_length(words, BLOCK):
        for k, seed in enumerate(SEEDS):
            out[k, rows] = _value(codes, np.arange(codes.shape[1])[None], seed).sum(1, dtype=_U)
    return out[0], out[1]


class Bitmap:
    """Which names the vocabulary surely does not hold: two bits of each of the two sums."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.width = max(10, int(BITS * max(1, len(first)) - 1).bit_length())
        marks = np.zeros(1 << self.width, bool)
        for name in (first, second):
            for turn in (0, 1):
                marks[self._place(name, turn)] = True
        self.bits = np.packbits(marks, bitorder="little")

    def _place(self, name: np.ndarray, turn: int) -> np.ndarray:
        return name >> _U(64 - self.width) if not turn else name & _U((1 << self.width) - 1)

    def may_hold(self, name: np.ndarray) -> np.ndarray:
        """Places in ``name`` (flat) whose two bits are set."""
        at = self._place(name, 0)
        kept = np.flatnonzero(self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1)
        at = self._place(name[kept], 1)
        return kept[(self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)]


def neighbours(codes: np.ndarray, alphabet: np.ndarray, bitmap: Bitmap | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words of one length (rows of code points): (row, first, second) of all their distinct neighbours.

    Of equal deletions and insertions in a run of one letter only one is made; a replacement differs
    from the letter it replaces. Neighbours of the three kinds differ in length or in one place, so none is
    made twice.
    """
    n, size = codes.shape
    places = np.arange(size)
    left, right_back, right_on, own = [], [], [], []
    with np.errstate(over="ignore"):
        zero = np.zeros((n, 1), _U)
        for seed in SEEDS:
            here, back, on = (_value(codes, places[None] + shift, seed) for shift in (0, -1, 1))
            left.append(np.concatenate([zero, np.cumsum(here, 1, dtype=_U)], 1))
            right_back.append(np.concatenate([np.cumsum(back[:, ::-1], 1, dtype=_U)[:, ::-1], zero], 1))
            right_on.append(np.concatenate([np.cumsum(on[:, ::-1], 1, dtype=_U)[:, ::-1], zero], 1))
            own.append(here)

        gone = np.ones((n, size), bool)
        gone[:, 1:] = codes[:, 1:] != codes[:, :-1]
        rows, at = np.nonzero(gone)
        yield from _kept(rows, *(left[k][rows, at] + right_back[k][rows, at + 1] for k in (0, 1)), bitmap)

        for place in range(size + 1):
            letters = [_value(alphabet, np.full(len(alphabet), place), seed) for seed in SEEDS]
            for kind in ("replace", "insert")[place == size :]:
                rest = [left[k][:, place] + (right_on[k][:, place] if kind == "insert" else left[k][:, size] - left[k][:, place + 1]) for k in (0, 1)]
                first = (rest[0][:, None] + letters[0][None]).ravel()
                keep = np.ones(len(first), bool) if place == size else (codes[:, place, None] != alphabet[None]).ravel()
                spots = np.flatnonzero(keep) if bitmap is None else bitmap.may_hold(first)
                spots = spots[keep[spots]]
                rows, letter = np.divmod(spots, len(alphabet))
                yield from _kept(rows, first[spots], rest[1][rows] + letters[1][letter], bitmap)


def _kept(rows: np.ndarray, first: np.ndarray, second: np.ndarray, bitmap: Bitmap | None):
    if bitmap is not None:
        some = bitmap.may_hold(first)
        rows, first, second = rows[some], first[some], second[some]
        some = bitmap.may_hold(second)
        rows, first, second = rows[some], first[some], second[some]
    if len(rows):
        yield rows, first, second


def _named(vocabulary: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word"):
                a, b = names_of(part.column("word").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["word", "n", "a", "b"])

    return vocabulary.mapInArrow(run, "word string, n long, a long, b long")


def _candidates(made: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], names=["a", "b", "c", "d"])


def near_pairs(named: DataFrame) -> DataFrame:
    """(a, b, near, near_n): for each word, by its name, all near words of the vocabulary."""
    spark = named.sparkSession
    total = named.count()
    alphabet = np.array(sorted(ord(r[0]) for r in named.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect()), np.uint32)
    shared = None
    if total <= FILTER_WORDS:
        names = named.select("a", "b").toArrow()
        shared = spark.sparkContext.broadcast(Bitmap(*(np.asarray(names.column(c)).view(_U) for c in ("a", "b"))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value if shared is not None else None
        for batch in batches:
            for part in slices(batch, "word"):
                words = part.column("word").to_pylist()
                own = [np.asarray(part.column(c)) for c in ("a", "b")]
                made, size = [], 0
                for rows, codes in _by_length(words, max(1, BLOCK // max(1, len(alphabet)))):
                    for at, first, second in neighbours(codes, alphabet, bitmap):
                        made.append((own[0][rows[at]], own[1][rows[at]], first.view(np.int64), second.view(np.int64)))
                        size += len(at)
                        if size > EMITTED:
                            yield _candidates(made)
                            made, size = [], 0
                if made:
                    yield _candidates(made)

    # a word costs about a thousand neighbours: small shares for all tasks
    dealt = named.select("word", "a", "b").repartition(max(partitions(spark), total // 16_384 + 1))
    made = dealt.mapInArrow(run, "a long, b long, c long, d long")
    words = named.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return made.join(words, ["c", "d"]).select("a", "b", "near", "near_n")


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form. Each round doubles how far a word looks; a form is at least
    twice as frequent as its word, so chains end and are short."""
    links = scratch.table(forms.filter("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = scratch.table(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        done = stepped.filter("moved").isEmpty()
        scratch.drop(links)
        links = stepped.select("word", "root")
        if done:
            return links
        scratch.paths[id(links)] = scratch.paths.pop(id(stepped))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus that is long and frequent enough.

    Null and empty texts have no words; a null id reads as an empty one. Rows are counted as they come,
    repeated ones each time. Forms of equal counts are taken in code-point order. An empty table, or
    one without frequent words, gives no rows. Other columns are ignored. Texts are searched piece by
    piece, so a very long one needs memory for a piece.
    """
    scratch = Scratch(docs.sparkSession)
    vocabulary = scratch.table(count_words(docs, id_col, text_col), "words")
    named = scratch.table(_named(vocabulary), "named")
    scratch.drop(vocabulary)
    best = near_pairs(named).groupBy("a", "b").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    large = -F.col("best.less") >= FACTOR * F.col("n")
    forms = scratch.table(
        named.join(best, ["a", "b"], "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(large, F.col("best.near")).alias("form"),
            F.when(large, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    scratch.drop(named)
    return forms.join(roots(scratch, forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
