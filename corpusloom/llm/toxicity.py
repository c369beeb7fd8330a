"""Toxicity by class-conditional Kneser-Ney models.

One model of toxic and one of ordinary labelled texts, of the letters of a word given the five before
them. Both share all lower orders: continuation counts pooled over the classes, down to the single
letter. So an expression that neither class has seen has the same likelihood under both and says
nothing, and a rare one says little.

A toxic text is ordinary but for a few words. Its likelihood is that of a mixture: each distinct word
comes from the toxic model with probability SHARE, else from the ordinary one. The score is the
difference of the two log-likelihoods, normalised by length and calibrated by one slope and one
intercept; nothing else enters.

Letters are code points of any script, in lower case and without marks; the tables of counts have no
fixed size and grow with the labelled text. Up to BROADCAST grams are sent to all tasks, more are
joined, with the same scores.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, claim, flat_bytes, fresh, mix64, slices, text_bytes

ORDER = 6
DISCOUNT = 0.9
#: The part of a toxic text's words that come from the toxic model.
SHARE = 0.01
#: A text's log-likelihood difference is divided by this power of its number of distinct words.
LENGTH_POWER = 0.75
#: Rows of the calibration fold on which slope and intercept are fitted, at most.
CALIBRATION_ROWS = 20_000
#: Grams whose ratios are sent to every task (12 bytes each); beyond that they are joined.
BROADCAST = 4_000_000
THRESHOLD = 0.3
#: Bytes of text that are worked on at once.
SLICE = 1 << 20

_SPACE = 32
_U = np.uint64


@functools.cache
def _letters() -> np.ndarray:
    """The letter of each code point of the basic plane: base letters in lower case, 0 for any digit, a
    space for what is neither."""
    table = np.full(1 << 16, _SPACE, np.uint32)
    for code in range(1 << 16):
        c = chr(code)
        if c.isdigit():
            table[code] = ord("0")
        elif c.isalpha():
            base = unicodedata.normalize("NFKD", c.lower())[:1].lower()
            table[code] = ord(base) if base.isalpha() else _SPACE
    return table


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words end to end, the offsets of the words, their rows and 64-bit names."""
    n = len(offsets) - 1
    size = len(raw) + n
    closed = np.zeros(size, np.uint8)
    inner = np.ones(size, bool)
    inner[offsets[1:] + np.arange(n)] = False
    closed[inner] = np.where(raw == 0, _SPACE, raw)
    codes = np.frombuffer(closed.tobytes().decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    letters = np.where(codes < 1 << 16, _letters()[np.minimum(codes, (1 << 16) - 1)], codes)
    inside = letters != _SPACE
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    rows = np.searchsorted(np.flatnonzero(codes == 0), starts)
    letters = letters[inside]
    place = np.arange(len(letters)) - np.repeat(at[:-1], np.diff(at))
    mixed = mix64(mix64(letters.astype(np.uint64) + _U(1)) + place.astype(np.uint64) * _U(0xD1342543DE82EF95))
    names = np.bitwise_xor.reduceat(mixed, at[:-1]) if len(starts) else np.zeros(0, np.uint64)
    return letters, at, rows, names


def grams_of(letters: np.ndarray, at: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of some words, a row of ORDER letters each, and which word each is of. A word is
    read from its first letter to the space behind it; before it stand spaces."""
    sizes = np.diff(at)[some] + 1
    begin = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(some)), sizes)
    place = np.arange(len(word)) - begin[word]
    out = np.full((len(word), ORDER), _SPACE, np.uint32)
    for k in range(ORDER):
        where = place - k
        real = (where >= 0) & (where < sizes[word] - 1)
        out[real, ORDER - 1 - k] = letters[(at[:-1][some][word] + where)[real]]
    return out, word


def gram_keys(grams: np.ndarray) -> np.ndarray:
    key = np.zeros(len(grams), np.uint64)
    for k in range(ORDER):
        key = mix64(key * _U(0x9E3779B97F4A7C15) ^ (grams[:, k].astype(np.uint64) + _U(1)))
    return key


def _strings(grams: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(grams).view(f"<U{ORDER}").ravel())


def count_grams(texts: DataFrame) -> DataFrame:
    """(g, toxic, ordinary): how often each gram is in the words of toxic and of ordinary rows (body, toxic)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def squeeze() -> None:
            grams, counts = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            _, first, which = np.unique(gram_keys(grams), return_index=True, return_inverse=True)
            held[:] = [(grams[first], np.stack([np.bincount(which, counts[:, k], len(first)) for k in (0, 1)], 1))]

        for batch in batches:
            for part in slices(batch, "body", SLICE):
                letters, at, rows, names = words_of(*flat_bytes(part.column("body")))
                if not len(names):
                    continue
                toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(float)[rows]
                _, first, which = np.unique(names, return_index=True, return_inverse=True)
                grams, word = grams_of(letters, at, first)
                held.append((grams, np.stack([np.bincount(which, toxic), np.bincount(which, 1 - toxic)], 1)[word]))
                if sum(len(h[0]) for h in held) > 2_000_000:
                    squeeze()
        if held:
            squeeze()
            grams, counts = held[0]
            for a in range(0, len(grams), 50_000):
                yield pa.RecordBatch.from_arrays([_strings(grams[a : a + 50_000]), *(pa.array(counts[a : a + 50_000, k].astype(np.int64)) for k in (0, 1))], names=["g", "toxic", "ordinary"])

    local = texts.mapInArrow(run, "g string, toxic long, ordinary long")
    return local.groupBy("g").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _context(k: int) -> Column:
    return F.substring("g", 1, k - 1)


def _shorter(k: int) -> Column:
    return F.substring("g", 2, k - 1)


def shared_backoff(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, p): the probability of the last of ORDER - 1 letters after the others, from pooled
    continuation counts: how many different letters a gram follows."""
    levels = {ORDER: counts.select("g")}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = scratch.table(levels[k + 1].groupBy(_shorter(k + 1).alias("g")).agg(F.count("*").alias("n")), f"order-{k}")
    total, kinds = levels[1].agg(F.sum("n"), F.count("*")).first()
    rest = DISCOUNT * kinds / (total or 1) / (kinds + 1)  # one letter more than has been seen
    below = levels[1].select("g", (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / (total or 1) + rest).alias("p"))
    for k in range(2, ORDER):
        context = levels[k].groupBy(_context(k).alias("c")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        joined = levels[k].withColumn("c", _context(k)).join(context, "c").withColumn("s", _shorter(k)).join(below.withColumnRenamed("g", "s"), "s")
        p = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("p")) / F.col("total")
        below = scratch.table(joined.select("g", p.alias("p")), f"shared-{k}")
    return below


def ratios(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, ratio): log P_toxic - log P_ordinary of the last letter of every seen gram after the others."""
    classes = ("toxic", "ordinary")
    context = counts.groupBy(_context(ORDER).alias("c")).agg(*(F.sum(x).alias(f"{x}_total") for x in classes), *(F.sum((F.col(x) > 0).cast("long")).alias(f"{x}_kinds") for x in classes))
    joined = counts.withColumn("c", _context(ORDER)).join(context, "c").withColumn("s", _shorter(ORDER)).join(shared_backoff(counts, scratch).withColumnRenamed("g", "s"), "s")

    def log_of(x: str) -> Column:
        total = F.col(f"{x}_total")
        own = (F.greatest(F.col(x) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"{x}_kinds") * F.col("p")) / total
        return F.log(F.when(total > 0, own).otherwise(F.col("p")))

    return joined.select("g", (log_of("toxic") - log_of("ordinary")).cast("float").alias("ratio"))


@dataclass
class Model:
    """Ratios as arrays (keys sorted), or beyond BROADCAST as a table; slope and intercept."""

    keys: np.ndarray | None
    values: np.ndarray | None
    table: DataFrame | None
    weights: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0.0]))

    def score(self, x):
        return F.lit(1.0) / (1 + F.exp(-(F.lit(float(self.weights[0])) + F.lit(float(self.weights[1])) * x)))


def mixture(ratio):
    """What a word adds to the log-likelihood difference of a text."""
    return np.logaddexp(np.log1p(-SHARE), np.log(SHARE) + ratio)


def differences(bodies: pa.Array, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The length-normalised log-likelihood difference of each text."""
    n = len(bodies)
    letters, at, rows, names = words_of(*flat_bytes(bodies))
    if not len(names) or not len(keys):
        return np.zeros(n)
    _, first, which = np.unique(names, return_index=True, return_inverse=True)
    grams, word = grams_of(letters, at, first)
    key = gram_keys(grams)
    found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    adds = mixture(np.bincount(word, np.where(keys[found] == key, values[found], 0.0), len(first)))
    once = np.unique(rows.astype(np.int64) * len(first) + which)
    row = once // len(first)
    return np.bincount(row, adds[once % len(first)], n) / np.maximum(1, np.bincount(row, minlength=n)) ** LENGTH_POWER


def with_difference(docs: DataFrame, model: Model, name: str, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """The rows with the log-likelihood difference of their text as one more column."""
    if model.table is not None:
        return _joined_difference(docs, model.table, name, scratch, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.values))

    @F.arrow_udf("double")
    def difference(bodies: pa.Array) -> pa.Array:
        claim("toxicity")
        batch = pa.RecordBatch.from_arrays([bodies], names=["body"])
        keys, values = shared.value
        found = [differences(part.column("body"), keys, values) for part in slices(batch, "body", SLICE)]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn(name, difference(text_bytes(text_col)))


def _joined_difference(docs: DataFrame, table: DataFrame, name: str, scratch: Scratch, text_col: str) -> DataFrame:
    """The same without sending the model anywhere: distinct words of distinct texts meet their grams'
    ratios by joins. A text is named by two hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body", SLICE):
                letters, at, rows, names = words_of(*flat_bytes(part.column("body")))
                _, first, which = np.unique(names, return_index=True, return_inverse=True)
                once = np.unique(rows.astype(np.int64) * max(1, len(first)) + which)
                told = letters.astype("<u4").tobytes().decode("utf-32-le")
                words = pa.array([told[at[k] : at[k + 1]] for k in first.tolist()], pa.string())
                row = pa.array(once // max(1, len(first)))
                yield pa.RecordBatch.from_arrays([part.column("t1").take(row), part.column("t2").take(row), words.take(pa.array(once % max(1, len(first))))], names=["t1", "t2", "word"])

    t1, t2, x = (fresh(docs, c) for c in ("t1", "t2", "x"))
    body = text_bytes(text_col)
    named = docs.withColumns({t1: F.xxhash64(body), t2: F.xxhash64(F.lit("2"), body)})
    texts = named.select(F.col(t1).alias("t1"), F.col(t2).alias("t2"), body.alias("body")).dropDuplicates(["t1", "t2"])
    said = scratch.table(texts.mapInArrow(run, "t1 long, t2 long, word string"), "words")
    padded = F.concat(F.lit(" " * (ORDER - 1)), "word", F.lit(" "))
    each = said.select("word").distinct().select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))).alias("g"))
    words = each.join(table, "g").groupBy("word").agg(F.sum(F.col("ratio").cast("double")).alias("ratio"))
    adds = words.select("word", F.when(F.col("ratio") > 0, F.col("ratio") + F.log(F.lit(SHARE) + (1 - SHARE) * F.exp(-F.col("ratio")))).otherwise(F.log(F.lit(1 - SHARE) + SHARE * F.exp("ratio"))).alias("adds"))
    sums = said.join(adds, "word", "left").groupBy("t1", "t2").agg((F.sum(F.coalesce("adds", F.lit(0.0))) / F.pow(F.count("*"), F.lit(LENGTH_POWER))).alias(x))
    joined = named.join(sums.withColumnsRenamed({"t1": t1, "t2": t2}) if (t1, t2) != ("t1", "t2") else sums, [t1, t2], "left")
    return joined.select(*docs.columns, F.coalesce(F.col(x), F.lit(0.0)).alias(name))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 60) -> np.ndarray:
    """Intercept and slope by damped Newton steps; without both classes, the intercept alone."""
    if not len(y) or y.min() == y.max():
        return np.array([-30.0 if not len(y) or y.max() == 0 else 30.0, 0.0])
    center, scale = x.mean(), x.std() + 1e-9
    design = np.stack([np.ones(len(x)), (x - center) / scale], 1)
    w, penalty = np.zeros(2), np.array([0.0, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-6)[:, None]).T @ design + np.diag(penalty + 1e-9), design.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return np.array([w[0] - w[1] * center / scale, w[1] / scale])


def remainder(column: str = "doc_id"):
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Counts come from all labelled rows of remainders 0 and 1, slope and intercept from those of
    remainder 3 (the CALIBRATION_ROWS smallest hashes); remainder 2 is held out."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("toxic"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"), remainder(id_col).alias("fold"))
    # labels grow with the corpus: they are never broadcast, small tables are joined alike
    learned = rows.filter("fold in (0, 1)").join(known.hint("merge"), "doc_id").select("body", "toxic")
    counts = scratch.table(count_grams(learned), "grams")
    table = scratch.table(ratios(counts, scratch), "ratios")
    size = table.count()
    if size > BROADCAST:
        model = Model(None, None, table)
    else:

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    grams = np.array(batch.column("g").to_pylist(), f"<U{ORDER}").view(np.uint32).reshape(-1, ORDER)
                    yield pa.RecordBatch.from_arrays([pa.array(gram_keys(grams).view(np.int64)), batch.column("ratio")], names=["key", "ratio"])

        told = table.mapInArrow(run, "key long, ratio float").toArrow()
        keys = told["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        model = Model(keys[order], told["ratio"].to_numpy()[order], None)
    few = known.filter(remainder() == 3).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS)
    held = rows.filter("fold = 3").join(F.broadcast(few), "doc_id").select("body", "toxic")
    sample = with_difference(held, model, "x", scratch, "body").select("toxic", "x").toArrow()
    if size:
        model.weights = fit_logistic(sample["x"].to_numpy(), sample["toxic"].to_numpy().astype(float))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    Null and empty texts have a score as well; a null id is never held out and never labelled; of
    several labels of an id a toxic one wins; rows without a label of 0 or 1 teach nothing; without
    any labels all scores are near 0; an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    model = fit(docs, labels, scratch, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = with_difference(rows, model, "x", scratch).select("doc_id", (remainder() == 2).alias("held_out"), model.score(F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, all columns kept.

    Null and empty texts are scored like others; repeated rows stay or go alike; columns of any name may be there.
    """
    scratch = Scratch(docs.sparkSession)
    model = fit(docs, labels, scratch, id_col, text_col)
    x = fresh(docs, "x")
    return with_difference(docs, model, x, scratch, text_col).filter(model.score(F.col(x)) < THRESHOLD).drop(x)
