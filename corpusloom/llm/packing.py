"""Packing by patterns: non-negative least squares over the length histogram, then best fit."""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, claim, globally_ranked, slices, text_bytes

END_ID = 1
#: Pattern lengths are counted in units of capacity / UNITS tokens, rounded up.
UNITS = 128
#: Documents of a pattern, at most.
PARTS = 4
#: Shares of each fitted repeat count that patterns may use; the rest leaves best fit lengths to choose
#: from. The share with the fewest sequences is taken, the largest of equals.
KEPT = (1.0, 0.6, 0.3, 0.1)
#: Entries of the cache of one Python worker.
CACHE = 1_200_000
#: A control character that is a token of its own; it parts words that are encoded in one call.
MARK = "\x01"
_ASCII_SPACE = re.compile("[^ \t\n\r\f\v]+")


# What a tokenizers file must hold for words to be encoded one by one.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def by_words(described: dict) -> bool:
    """Whether a tokenizers file encodes every word alike wherever it stands: white space becomes one
    space and is dropped, words end in a mark of their own, and special tokens take no space with them."""
    normalizer, splitter, model = described.get("normalizer") or {}, described.get("pre_tokenizer") or {}, described["model"]
    first = (splitter.get("pretokenizers") or [splitter])[0]
    return (
        normalizer.get("normalizers") == _NORMALIZER
        and (first.get("pattern") or {}).get("Regex") == _SPLIT
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and model.get("end_of_word_suffix") == "</w>"
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in described.get("added_tokens") or [])
    )


class WordTokenizer:
    """A tokenizers file applied chunk by chunk between ASCII white space, with a cache.

    The file's normaliser turns every run of white space into one space and its pre-tokenizer drops
    white space, so no token and no normalisation reaches across it: the ids of a text are the ids
    of its chunks, in order. A file of another kind is applied to whole texts. Special tokens that a
    text spells are treated as the library does by default.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.by_words = by_words(json.load(file))
        if not self.by_words:
            return
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        for one in (self.tokenizer, self.bare):  # words come once each: the library's own cache only costs
            if hasattr(one.model, "_resize_cache"):
                one.model._resize_cache(0)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.tails = {"": b"", ".": self._ids("."), ",": self._ids(",")}
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def learn(self, words: set[str]) -> None:
        """Encodes words that the cache lacks, thousands in one call.

        A word of composed letters below U+0130, with or without a final stop or comma, which the
        pre-tokenizer cuts off, has the ids of its small letters (and of the mark): those are one
        pre-token, need no normaliser, and their last token tells where they end. They are often
        known already. Other words stand apart by a mark.
        """
        cache = self.cache
        letters, derived, others = set(), [], []
        for w in words:
            if w.isalpha():
                base, tail = w, ""
            elif w[-1] in ".," and w[:-1].isalpha():
                base, tail = w[:-1], w[-1]
            else:
                others.append(w)
                continue
            if not w.isascii() and max(w) >= "\u0130":
                others.append(w)
                continue
            base = base.lower()
            if base not in cache:
                letters.add(base)
            if base != w:
                derived.append((w, base, tail))
        plain = list(letters)
        for start in range(0, len(plain), 4096):
            self._store_letters(plain[start : start + 4096])
        marked = [w for w in others if MARK not in w]
        for start in range(0, len(marked), 4096):
            some = marked[start : start + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            self._store(some, ids, [*np.flatnonzero(ids == self.mark).tolist(), len(ids)], 1)
        for w in others:
            if w not in cache:
                cache[w] = self._ids(w)
        tails = self.tails
        for w, base, tail in derived:
            cache[w] = cache[base] + tails[tail] if tail else cache[base]

    def _store_letters(self, words: list[str]) -> None:
        ids = np.array(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        if not self._store(words, ids, (np.flatnonzero(self.closes[ids]) + 1).tolist(), 0):
            self.cache.update({w: self._ids(w) for w in words})

    def _ids(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _store(self, words: list[str], ids: np.ndarray, ends: list[int], skip: int) -> bool:
        """Ids from one end to the next, without the ``skip`` ids of a mark; nothing is stored if the
        number of ends is not that of the words."""
        if len(ends) != len(words):
            return False
        raw, begin = ids.tobytes(), 0
        for w, end in zip(words, ends, strict=True):
            self.cache[w] = raw[4 * begin : 4 * end]
            begin = end + skip
        return True

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers; new words of all texts are learned at once."""
        if not self.by_words:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.cache) > CACHE:
            self.cache.clear()
        get = self.cache.get
        # str.split parts at all white space that the normaliser knows, and at four controls that it does not
        split = [_ASCII_SPACE.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split() for text in texts]
        found = [list(map(get, words)) for words in split]
        lost = [[k for k, ids in enumerate(parts) if ids is None] for parts in found]
        self.learn({words[k] for words, some in zip(split, lost, strict=True) for k in some})
        for words, parts, some in zip(split, found, lost, strict=True):
            for k in some:
                parts[k] = get(words[k])
        return [b"".join(parts) for parts in found]


@functools.lru_cache(maxsize=1)
def _word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def word_tokenizer(path: str) -> WordTokenizer:
    claim("packing", _word_tokenizer.cache_clear)
    return _word_tokenizer(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, path: str, capacity: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: its ids, then the end id; cut only where they exceed the capacity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = word_tokenizer(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "body", 2 << 20):
                rows: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
                if with_ids:
                    rows["ids"] = []
                texts = [body.decode("utf-8", "replace") for body in part.column("body").to_pylist()]
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), coder.encode(texts), strict=True):
                    ids = raw + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        rows["doc_id"].append(doc_id)
                        rows["piece"].append(piece)
                        rows["start"].append(at // 4)
                        rows["length"].append(len(cut) // 4)
                        rows["ids_crc32"].append(zlib.crc32(cut))
                        if with_ids:
                            rows["ids"].append(np.frombuffer(cut, "<u4").astype(np.int32))
                yield pa.RecordBatch.from_pydict(rows | {"piece": pa.array(rows["piece"], pa.int32())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def patterns(units: int = UNITS, parts: int = PARTS) -> np.ndarray:
    """All ways to fill ``units`` exactly with up to ``parts`` whole lengths, descending; 0 pads a row."""
    rows = []

    def grow(chosen: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            rows.append(chosen + (0,) * (parts - len(chosen)))
            return
        if len(chosen) < parts:
            for x in range(min(left, most), (left - 1) // (parts - len(chosen)), -1):
                grow((*chosen, x), left - x, x)

    grow((), units, units)
    return np.array(rows, np.int64)


def fit_counts(table: np.ndarray, histogram: np.ndarray, steps: int = 1500) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: repeats x >= 0 of the patterns
    with ``sum_p x_p * table_p`` near the histogram. Lengths of half the capacity and more weigh
    more, as only patterns find partners for them; short ones are easily placed afterwards."""
    units = len(histogram) - 1
    n, parts = table.shape
    weight = np.where(np.arange(units + 1) * parts >= units, 1.0, 0.3)
    weight[0] = 0.0
    flat = table.ravel()
    goal = histogram * weight

    def forward(x):
        return np.bincount(flat, np.repeat(x, parts), units + 1) * weight

    def back(r):
        return (r * weight)[table].sum(1)

    v = np.ones(n)
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1.0 / (1.05 * norm)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        z = np.maximum(0.0, y - step * back(forward(y) - goal))
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = z + (t - 1) / u * (z - x)
        if float(np.dot(y - z, z - x)) < 0:  # restart when momentum points uphill
            y = z
        x, t = z, u
    return x


def plan_bins(counts: dict[int, int], capacity: int, units: int = UNITS, parts: int = PARTS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packs a length histogram: (number of equal bins, [(length, copies in each bin), ...]).

    The histogram has at most ``capacity`` lengths however many documents there are, and a step
    here handles all equal bins at once, so the work does not grow with the corpus.
    """
    there = {int(k): int(v) for k, v in counts.items() if v > 0}
    if not there:
        return []
    unit = -(-capacity // units)
    by_unit = np.zeros(units + 1)
    for length, n in there.items():
        by_unit[-(-length // unit)] += n
    table = patterns(units, parts)
    fitted = fit_counts(table, by_unit)
    bound = -(-sum(k * v for k, v in there.items()) // capacity)
    best, fewest = None, 0
    for kept in KEPT:
        bins, left = fill_patterns(table, np.floor(fitted * kept + 1e-6).astype(np.int64), there, capacity, unit)
        plan = best_fit(bins, left, capacity)
        size = sum(n for n, _ in plan)
        if best is None or size < fewest:
            best, fewest = plan, size
        if fewest == bound:
            break
    return best


def fill_patterns(table: np.ndarray, repeats: np.ndarray, counts: dict[int, int], capacity: int, unit: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], dict[int, int]]:
    """The bins that patterns fill exactly, and the lengths that are left."""
    left = dict(counts)
    bins: list[tuple[int, list[tuple[int, int]]]] = []
    there = sorted(left)  # lengths that are not used up

    def longest(least: int, most: int, taken: dict[int, int]) -> int | None:
        at = bisect.bisect_right(there, most) - 1
        while at >= 0 and there[at] > least:
            if left[there[at]] > taken.get(there[at], 0):
                return there[at]
            at -= 1
        return None

    for p in [p for p in np.argsort(-repeats, kind="stable") if repeats[p]]:
        slots = [int(x) for x in table[p] if x]
        r = int(repeats[p])
        while r:
            uses: dict[int, int] = {}
            space = capacity
            for k, u in enumerate(slots):
                # units fix all but the last length; that one is the longest that still fits
                x = longest((u - 1) * unit, min(space, u * unit), uses) if k + 1 < len(slots) or len(slots) == 1 else longest(0, space, uses)
                if x is None or (k + 1 == len(slots) and x < space):
                    break  # no exact fill here: best fit may find a better use for these lengths
                uses[x] = uses.get(x, 0) + 1
                space -= x
            else:
                run = min(r, *(left[x] // k for x, k in uses.items()))
                for x, k in uses.items():
                    left[x] -= run * k
                    if not left[x]:
                        there.pop(bisect.bisect_left(there, x))
                bins.append((run, sorted(uses.items(), reverse=True)))
                r -= run
                continue
            break
    return bins, {k: v for k, v in left.items() if v}


def best_fit(bins: list[tuple[int, list[tuple[int, int]]]], left: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit decreasing of the residual lengths into the open bins, all equal bins in one step."""
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    frees: list[int] = []

    def add(n: int, held: list[tuple[int, int]]) -> None:
        if not n:
            return
        free = capacity - sum(x * k for x, k in held)
        if free not in groups:
            groups[free] = []
            bisect.insort(frees, free)
        groups[free].append((n, held))

    for n, held in bins:
        add(n, held)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(frees, length)
            if at == len(frees):
                fits = capacity // length
                add(n // fits, [(length, fits)])
                if n % fits:
                    add(1, [(length, n % fits)])
                break
            free = frees[at]
            count, held = groups[free].pop()
            if not groups[free]:
                del groups[free]
                frees.pop(at)
            fits = free // length  # after one copy the same bin is again the tightest that fits
            full = min(count, n // fits)
            add(full, [*held, (length, fits)])
            n -= full * fits
            rest = count - full
            if rest and n and n < fits:
                add(1, [*held, (length, n)])
                n, rest = 0, rest - 1
            add(rest, held)
    return [g for free in frees for g in groups[free]]


def runs_of(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Runs (length, first rank of that length, pieces, first sequence, place in it), sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, held in bins:
        offset = 0
        for length, copies in held:
            for _ in range(copies):
                first = used.get(length, 0)
                rows.append((length, first, sequence, offset))
                used[length] = first + n
                offset += length
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Only the length histogram (at most ``capacity`` numbers) comes to the driver. A piece then finds
    its place from its rank among the pieces of its length. Null text counts as empty (the end id
    alone); null ids, ties and repeated rows are pieces like any other; an empty table gives an
    empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    # written first: dealing by range samples its input, which would encode every text twice
    pieces = scratch.table(cut_documents(docs, path, capacity, id_col=id_col, text_col=text_col), "cut")
    ranked, _ = globally_ranked(scratch, pieces, ["length", "doc_id", "piece"], "pieces")
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lengths = np.array(sorted(counts), np.int64)
    starts = np.concatenate([[0], np.cumsum([counts[k] for k in lengths.tolist()])]).astype(np.int64)
    runs = runs_of(plan_bins(counts, capacity))
    # the global rank orders by length first: one sorted list of first ranks finds every run
    begin = starts[np.searchsorted(lengths, runs["length"])] + runs["first"] if len(lengths) else np.zeros(0, np.int64)
    sequence, offset = runs["sequence"], runs["offset"]

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def placed(g: pd.Series) -> pd.DataFrame:
        ranks = g.to_numpy(np.int64)
        at = np.searchsorted(begin, ranks, side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + ranks - begin[at], "offset": offset[at]})

    return ranked.withColumn("put", placed("g")).select("doc_id", "piece", "start", "length", "ids_crc32", "put.sequence_id", "put.offset")
