"""Removal of repeated 200-byte strings by merged Burrows-Wheeler transforms.

What can be equal at all is settled by content: each window of LENGTH bytes is dealt by the anchor it
contains (the GRAM bytes of least hash, so equal windows have equal anchors at equal places). Runs
of windows that no other run shares an anchor with are out. Runs that are the same string as a whole
(128 bits of hash agree: the anchor's and the run's) are repeated, as are texts that are the same
string; of those one copy is enough. Runs that share their anchor, and then their core, with others
that differ somewhere are the ones whose suffixes must be compared. Every task builds transforms of
what it holds of them, its shards, one for each bucket of cores; a bucket's shards, of all tasks, are
merged by refining their interleave: every pass orders the suffixes by one word more, as the words
before them say, and where neighbours part for the first time that pass tells the length of their
common prefix. Intervals whose neighbours never part in LENGTH bytes are the repeated strings. No
suffix is compared or sorted again in a merge.

A word has STRIDE bytes and a fragment is STRIDE strings of words, one for each phase, so LENGTH
bytes are LENGTH / STRIDE passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, claim, collect_garbage, deal, flat_bytes, fresh, mix64, partitions, slices, slots, text_bytes, unpack

LENGTH = 200
GRAM = 64
STRIDE = 8
#: Windows of a run that are judged by one core.
STEP = 8
#: Bytes of fragments in a bucket, on average; one core's fragments always stay together.
BUNDLE = 60_000
#: Bytes of fragments that a task turns into transforms at once.
SHARD = 8 << 20
#: Fragments of a core that are merged; the windows of a core with more are counted one by one.
MERGED = 4096
#: Bytes of packed rows that a task of the packed steps gets on average, at most.
PACKED = 64 << 20

_U = np.uint64
_BASE = 0xD1342543DE82EF95
_VALUE = mix64(np.arange(5001, 5257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_POWERS: dict[str, np.ndarray] = {}
ANCHOR = np.dtype([("key", "<u8"), ("whole", "<u8"), ("cls", "<i8"), ("at", "<u4"), ("low", "u1"), ("high", "u1")])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    claim("suffix_dedup", _POWERS.clear)
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 21)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Hasher:
    """64-bit hashes of any stretch of some bytes."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[raw] * up[: len(raw)], out=self.total[1:])

    def of(self, start: np.ndarray, stop: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return mix64((self.total[stop] - self.total[start]) * self.down[start] + mix64(salt.astype(np.uint64) + _U(1)))


def window_runs(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: row, place of the anchor in its row, first and last window as
    distances before the anchor (low >= high), hashes of the anchor and of the whole run."""
    n = len(raw)
    if n < LENGTH:
        return {k: np.zeros(0, np.uint64 if k in ("key", "whole") else np.int64) for k in ("row", "at", "low", "high", "key", "whole")}
    hashes, width, factor = _VALUE[raw], 1, 0x9E3779B97F4A7C15
    while width < GRAM:
        hashes = hashes[:-width] * _U(factor) + hashes[width:]
        factor = (factor * factor | 1) & 0xFFFFFFFFFFFFFFFF
        width *= 2
    gram = mix64(hashes)
    # the least hash, then the first place: ties fall alike in equal windows
    least = (gram & _U(0xFFFFFFFFFF000000)) | np.arange(len(gram), dtype=np.uint64)
    span, width = LENGTH - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    anchor = (least & _U(0xFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    inside = np.arange(len(anchor)) + LENGTH <= offsets[1:][row]
    change = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]), [True]])
    first = np.flatnonzero(inside & change[:-1])
    last = np.flatnonzero(inside & (change[1:] | ~np.concatenate([inside[1:], [False]])))
    at = anchor[first]
    low, high = at - first, at - last
    whole = Hasher(raw).of(first, last + LENGTH, low * 256 + high)
    return {"row": row[first], "at": at - offsets[row[first]], "low": low, "high": high, "key": gram[at], "whole": whole}


def _flush(held: list, names: np.ndarray, key: str) -> Iterator[pa.RecordBatch]:
    if held:
        rows = np.unique(np.concatenate(held))  # copies of a text in one task are told once
        held.clear()
        yield from deal(rows, mix64(rows[key]), names).to_batches()


def _anchors(texts: DataFrame, parts: int) -> DataFrame:
    """(part, blob) of ANCHOR rows of all texts (cls, body)."""
    names = slots(parts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for some in slices(batch, "body", 1 << 20):
                raw, offsets = flat_bytes(some.column("body"))
                for found, classes in _in_reach(raw, offsets, some.column("cls").to_numpy()):
                    rows = np.empty(len(found["row"]), ANCHOR)
                    for k in ("key", "whole", "at", "low", "high"):
                        rows[k] = found[k]
                    rows["cls"] = classes[found["row"]]
                    held.append(rows)
                if sum(map(len, held)) > 500_000:
                    yield from _flush(held, names, "key")
        yield from _flush(held, names, "key")

    return texts.mapInArrow(run, "part int, blob binary")


def _in_reach(raw: np.ndarray, offsets: np.ndarray, names: np.ndarray) -> Iterator[tuple[dict, np.ndarray]]:
    """The runs of some texts; a text of more than 8 MB is read in stretches that overlap by a window."""
    most = 8 << 20
    if len(raw) <= most:
        yield window_runs(raw, offsets), names
        return
    for r in range(len(names)):
        a, b = int(offsets[r]), int(offsets[r + 1])
        for start in range(a, max(a + 1, b - LENGTH + 1), most - LENGTH + 1):
            stretch = raw[start : min(b, start + most)]
            found = window_runs(stretch, np.array([0, len(stretch)]))
            found["at"] = found["at"] + (start - a)
            yield found, names[r : r + 1]


def _judge(rows: np.ndarray, key: str, whole: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows' verdicts: which are equal as a whole to another, and which stand for
    their kind where rows of one key differ and some is alone."""
    new_key = np.concatenate([[True], rows[key][1:] != rows[key][:-1]])
    new = new_key | np.concatenate([[True], rows[whole][1:] != rows[whole][:-1]])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([starts, [len(rows)]]))
    group = np.cumsum(new_key) - 1
    kinds = np.bincount(group[starts], minlength=group[-1] + 1)
    alone = np.bincount(group[starts], sizes == 1, group[-1] + 1)
    return np.repeat(sizes > 1, sizes), starts[(kinds[group[starts]] > 1) & (alone[group[starts]] > 0)]


FOUND = "cls long, kind int, first long, last long, at long, core long"


def _found(kind: np.ndarray, cls, first, last, at, core) -> pa.Table:
    return pa.table({"cls": np.asarray(cls, np.int64), "kind": np.asarray(kind, np.int32), "first": np.asarray(first, np.int64), "last": np.asarray(last, np.int64), "at": np.asarray(at, np.int64), "core": np.asarray(core, np.int64)})


def _match_runs(anchors: DataFrame) -> DataFrame:
    """Windows first..last of a text that are repeated (kind 0), and runs to look into (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        rows = np.unique(unpack(table, ANCHOR))
        same, ask = _judge(rows, "key", "whole")
        both = np.concatenate([rows[same], rows[ask]])
        kind = np.repeat([0, 1], [int(same.sum()), len(ask)])
        at = both["at"].astype(np.int64)
        return _found(kind, both["cls"], at - both["low"], at - both["high"], at, np.zeros(len(at)))

    return anchors.groupBy("part").applyInArrow(run, FOUND)


CORE = np.dtype([("core", "<u8"), ("whole", "<u8"), ("cls", "<i8"), ("first", "<u4"), ("n", "u1")])


def _cores(asked: DataFrame, parts: int) -> DataFrame:
    """(part, blob) of CORE rows: the asked runs (cls, body, runs of (first, last, at)) in steps of STEP windows."""
    names = slots(parts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for some in slices(batch, "body", 1 << 20):
                raw, offsets = flat_bytes(some.column("body"))
                hasher = Hasher(raw)
                runs = some.column("runs")
                counts = np.diff(runs.offsets.to_numpy())
                if not counts.sum():
                    continue
                row = np.repeat(np.arange(some.num_rows), counts)
                fields = runs.flatten()
                first, last, at = (fields.field(k).to_numpy() for k in ("first", "last", "at"))
                low, high = (at - first) // STEP, (at - last) // STEP
                steps = low - high + 1
                which = np.repeat(np.arange(len(steps)), steps)
                s = high[which] + np.arange(len(which)) - np.repeat(np.cumsum(steps) - steps, steps)
                begin = np.maximum(first[which], at[which] - STEP * s - STEP + 1)
                end = np.minimum(last[which], at[which] - STEP * s)
                base = offsets[:-1][row[which]]
                core = base + at[which] - STEP * s  # the bytes that all windows of the step contain
                rows = np.empty(len(which), CORE)
                rows["core"] = hasher.of(core, core + LENGTH - STEP + 1, s)
                rows["whole"] = hasher.of(base + begin, base + end + LENGTH, (at[which] - begin) * 256 + (end - begin))
                rows["cls"], rows["first"], rows["n"] = some.column("cls").to_numpy()[row[which]], begin, end - begin + 1
                held.append(rows)
                if sum(map(len, held)) > 500_000:
                    yield from _flush(held, names, "core")
        yield from _flush(held, names, "core")

    return asked.mapInArrow(run, "part int, blob binary")


def _match_cores(cores: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        rows = np.unique(unpack(table, CORE))
        same, ask = _judge(rows, "core", "whole")
        both = np.concatenate([rows[same], rows[ask]])
        kind = np.repeat([0, 1], [int(same.sum()), len(ask)])
        first = both["first"].astype(np.int64)
        return _found(kind, both["cls"], first, first + both["n"] - 1, first, both["core"].view(np.int64))

    return cores.groupBy("part").applyInArrow(run, FOUND)


@dataclass
class Shard:
    """The transform of some fragments: their bytes, and the places of their suffixes in order. A suffix
    is read in words of STRIDE bytes; the word before each place is the transform's symbol."""

    raw: np.ndarray
    sizes: np.ndarray
    order: np.ndarray


def _words(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place: the STRIDE bytes from there on, its distance from the fragment's begin, and the fragment."""
    data = np.concatenate([raw, np.zeros(STRIDE, np.uint8)])
    words = np.zeros(len(raw), np.uint64)
    for k in range(STRIDE):
        words = (words << _U(8)) | data[k : k + len(raw)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return words, np.arange(len(raw)) - (np.cumsum(sizes) - sizes)[owner], owner


def shard_of(fragments: list[bytes]) -> Shard:
    """Sorts one shard's suffixes, by doubling."""
    sizes = np.array([len(f) for f in fragments], np.int64)
    raw = np.frombuffer(b"".join(fragments), np.uint8)
    words, inside, owner = _words(raw, sizes)
    here = np.arange(len(raw))
    step = np.where(inside + STRIDE < sizes[owner], here + STRIDE, -1)
    # the last word of a string ends with it, whatever bytes of another fragment it covers
    _, rank = np.unique(words, return_inverse=True)
    while True:
        key = rank * (int(rank.max()) + 2) + np.where(step >= 0, rank[step] + 1, 0)
        _, new = np.unique(key, return_inverse=True)
        step = np.where(step >= 0, step[step], -1)
        done = (step < 0).all() or new.max() + 1 == len(new)
        rank = new
        if done:
            break
    return Shard(raw, sizes, np.argsort(rank, kind="stable").astype(np.uint32))


def _stable_order(symbols: np.ndarray) -> np.ndarray:
    """A stable order of small numbers by 16 bits at a time, which numpy sorts by radix."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if len(symbols) and int(symbols.max()) > 0xFFFF:
        order = order[np.argsort((symbols[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def merge(shards: list[Shard], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged transform of some shards: the places of all suffixes in order (the shards' bytes end to
    end; -1 for the empty suffixes, which come first), and how many words each has in common with the
    one before it, ``passes`` at most.

    The interleave says, rank by rank, from which shard the next suffix comes. Reading the shards'
    symbols along it and dealing the shard numbers stably by symbol orders the suffixes by one word
    more; neighbours part where their first words differ, or where those after them have parted.
    """
    sizes = np.array([len(s.raw) for s in shards])
    base = np.cumsum(sizes) - sizes
    found = [_words(s.raw, s.sizes) for s in shards]
    # one alphabet for all; 0 is the begin of a string
    _, symbol = np.unique(np.concatenate([w for w, _, _ in found]), return_inverse=True)
    symbol = symbol.astype(np.int64) + 1
    heads, rests, places, strings = [], [], [], []
    for s, b, (_, inside, owner) in zip(shards, base.tolist(), found, strict=True):
        last = np.flatnonzero(inside + STRIDE >= s.sizes[owner])  # before the empty suffix of a string stands its last word
        order = s.order.astype(np.int64)
        heads.append(symbol[b + last])
        rests.append(np.where(inside[order] >= STRIDE, symbol[b + np.maximum(order - STRIDE, 0)], 0))
        places.append(order + b)
        strings.append(len(last))
    numbers = np.arange(len(shards), dtype=np.uint16 if len(shards) < 1 << 16 else np.uint32)
    first = np.repeat(numbers, strings)
    origin = np.concatenate([first, np.repeat(numbers, sizes)])
    read = np.concatenate([x for pair in zip(heads, rests, strict=True) for x in pair])
    held = np.concatenate([x for n, p in zip(strings, places, strict=True) for x in (np.full(n, -1), p)])
    n, empty = len(origin), len(first)
    common = np.full(n, passes, np.int16)
    common[0] = 0
    parted = np.zeros(n, bool)
    symbols = np.empty(n, np.int64)
    for done in range(passes):
        symbols[np.argsort(origin, kind="stable")] = read
        order = _stable_order(symbols)
        # string begins have symbol 0: in their place stand the empty suffixes, shard by shard
        new_origin = origin[order]
        new_origin[:empty] = first
        along = symbols[order]
        interval = np.cumsum(parted)[order]
        breaks = np.zeros(n, bool)
        breaks[1:] = (along[1:] != along[:-1]) | (interval[1:] != interval[:-1])
        breaks[1:empty] = False
        common[breaks & (common == passes)] = done
        still = np.array_equal(breaks, parted) and np.array_equal(new_origin, origin) and done > 0
        origin, parted = new_origin, breaks
        if still:
            break
    where = np.empty(n, np.int64)
    where[np.argsort(origin, kind="stable")] = held
    return where, common


def repeated_in(shards: list[Shard]) -> list[list[np.ndarray]]:
    """For each fragment of each shard the begins of windows of LENGTH bytes that occur more than once in all of them."""
    places, common = merge(shards, LENGTH // STRIDE)
    interval = np.cumsum(common < LENGTH // STRIDE)
    sizes = np.concatenate([s.sizes for s in shards])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
    at = np.flatnonzero(places >= 0)
    at = at[inside[places[at]] + LENGTH <= sizes[owner[places[at]]]]  # suffixes that begin with a whole window
    often = np.bincount(interval[at], minlength=int(interval[-1]) + 1)[interval[at]] > 1
    hit = np.sort(places[at[often]])
    cuts = np.searchsorted(owner[hit], np.arange(len(sizes) + 1))
    found = iter([inside[hit[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    return [[next(found) for _ in s.sizes] for s in shards]


def repeated_windows(fragments: list[bytes], shards: int = 2) -> list[np.ndarray]:
    """The same of fragments that are cut into so many shards."""
    some = [x for x in np.array_split(np.arange(len(fragments)), max(1, min(shards, len(fragments)))) if len(x)]
    return [w for shard in repeated_in([shard_of([fragments[k] for k in x]) for x in some]) for w in shard]


SHARDS = "bucket long, raw binary, ends binary, suffixes binary, cls binary, first binary"


def _shards(asked: DataFrame, buckets: int) -> DataFrame:
    """Transforms, one for each bucket that a task has fragments of, of the asked steps of
    (cls, body, runs of (first, last, core)). A fragment's bucket is that of its core."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, bytes]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, rows in held.items():
                shard = shard_of([r[2] for r in rows])
                columns = [pa.array([bucket], pa.int64())]
                columns += [pa.array([x.tobytes()], pa.binary()) for x in (shard.raw, shard.sizes, shard.order, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "raw", "ends", "suffixes", "cls", "first"])
            held.clear()

        for batch in batches:
            for some in slices(batch, "body", 1 << 20):
                for cls, body, runs in zip(some.column("cls").to_pylist(), some.column("body").to_pylist(), some.column("runs").to_pylist(), strict=True):
                    for r in runs:
                        data = body[r["first"] : r["last"] + LENGTH]
                        held.setdefault((r["core"] & 0xFFFFFFFFFFFF) % buckets, []).append((cls, r["first"], data))
                        size += len(data)
                if size > SHARD:
                    yield from flush()
                    size = 0
        yield from flush()

    return asked.mapInArrow(run, SHARDS)


def _merged(shards: DataFrame) -> DataFrame:
    """Windows that are repeated (kind 0), of the shards of each bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            made = [Shard(np.frombuffer(r[0], np.uint8), np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.uint32)) for r in rows]
            cls, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r, found in zip(rows, repeated_in(made), strict=True):
                counts = [len(w) for w in found]
                cls.append(np.repeat(np.frombuffer(r[3], np.int64), counts))
                first.append(np.repeat(np.frombuffer(r[4], np.int64), counts) + (np.concatenate(found) if found else 0))
            rows.clear()
            names, begins = np.concatenate(cls), np.concatenate(first)
            yield from _found(np.zeros(len(names)), names, begins, begins, begins, np.zeros(len(names))).to_batches()

        for batch in batches:
            for k, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != now:
                    yield from flush()
                now = bucket
                rows.append([batch.column(c)[k].as_py() for c in ("raw", "ends", "suffixes", "cls", "first")])
        yield from flush()

    return shards.repartition(partitions(shards.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND)


def _counted(asked: DataFrame) -> DataFrame:
    """Windows that are repeated, of cores too common to be merged by one task: each window by itself,
    named by 128 bits, counted before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "body", 1 << 20):
                out: dict[str, list] = {"h1": [], "h2": [], "cls": [], "first": []}
                for cls, body, runs in zip(some.column("cls").to_pylist(), some.column("body").to_pylist(), some.column("runs").to_pylist(), strict=True):
                    for first in {w for r in runs for w in range(r["first"], r["last"] + 1)}:
                        digest = hashlib.blake2b(body[first : first + LENGTH], digest_size=16).digest()
                        out["h1"].append(int.from_bytes(digest[:8], "little", signed=True))
                        out["h2"].append(int.from_bytes(digest[8:], "little", signed=True))
                        out["cls"].append(cls)
                        out["first"].append(first)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    windows = asked.mapInArrow(run, "h1 long, h2 long, cls long, first long")
    often = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    return windows.join(often, ["h1", "h2"]).select("cls", "first", F.col("first").alias("last"))


def covered(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal stretches that runs of windows cover."""
    order = np.argsort(first, kind="stable")
    first, stop = first[order], last[order] + LENGTH
    reach = np.maximum.accumulate(stop)
    new = np.concatenate([[True], first[1:] > reach[:-1]])
    starts = np.flatnonzero(new)
    return first[starts], reach[np.concatenate([starts[1:] - 1, [len(first) - 1]])]


def text_name(salt: int, body: Column) -> Column:
    return F.xxhash64(F.lit(salt), body)


def named_texts(docs: DataFrame, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """(cls, body) of every row, (cls, n, n_bytes, sha) of every text, and the salt of the names: a name of
    64 bits for each text that no other text of the table has.

    Texts of one name are compared by length and SHA-256; should two differ, all get names by another salt.
    """
    salt = 0
    while True:
        body = text_bytes(text_col)
        named = docs.withColumn("cls", text_name(salt, body)).select("cls", body.alias("body"))
        facts = named.select("cls", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha"))
        copies = scratch.table(facts.groupBy("cls").agg(F.count("*").alias("n"), F.min("n_bytes").alias("n_bytes"), F.min("sha").alias("sha"), (F.min(F.struct("n_bytes", "sha")) != F.max(F.struct("n_bytes", "sha"))).alias("clash")), "copies")
        if copies.filter("clash").isEmpty():
            return named, copies.select("cls", "n", "n_bytes", "sha"), salt
        scratch.drop(copies)
        salt += 1


def repeated_spans(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """What is repeated where: (texts, copies, marks, salt).

    texts has (cls, body) of every distinct text that may hold a repeat, copies (cls, n, n_bytes, sha)
    of every text, marks (cls, runs of windows) of texts that occur once; equal texts are one. The
    name of a text is xxhash64(salt, bytes).
    """
    named, copies, salt = named_texts(docs, text_col, scratch)
    size = copies.agg(F.sum(F.col("n") * F.col("n_bytes"))).first()[0] or 0
    # a run of windows with one anchor for every (LENGTH - GRAM) / 2 bytes
    parts = max(partitions(docs.sparkSession), -(-size * ANCHOR.itemsize * 2 // (LENGTH - GRAM) // PACKED))
    found = scratch.table(_match_runs(_anchors(named, parts)), "runs")
    collect_garbage(docs.sparkSession)
    wanted = scratch.table(found.select("cls").distinct(), "wanted")
    # the list of names grows with the corpus: it is merged at every size, never broadcast
    texts = scratch.table(named.join(wanted.hint("merge"), "cls").dropDuplicates(["cls"]), "texts")
    collect_garbage(docs.sparkSession)
    asked = lambda frame, *fields: texts.join(frame.groupBy("cls").agg(F.collect_set(F.struct(*fields)).alias("runs")), "cls")
    deeper = scratch.table(_match_cores(_cores(asked(found.filter("kind = 1"), "first", "last", "at"), parts)), "steps")
    open_steps = deeper.filter("kind = 1").select("core", "cls", "first", "last")
    cores = scratch.table(open_steps.groupBy("core").agg(F.count("*").alias("total"), F.sum(F.col("last") - F.col("first") + LENGTH).alias("size")), "cores")
    common = cores.filter(F.col("total") > MERGED).select("core")
    buckets = max(1, (cores.agg(F.sum("size")).first()[0] or 0) // BUNDLE)
    merged = _merged(_shards(asked(open_steps.join(common, "core", "left_anti"), "first", "last", "core"), buckets)).select("cls", "first", "last")
    marks = found.filter("kind = 0").select("cls", "first", "last").unionAll(deeper.filter("kind = 0").select("cls", "first", "last")).unionAll(merged)
    if not common.isEmpty():
        marks = marks.unionAll(_counted(asked(open_steps.join(common, "core"), "first", "last", "core")))
    single = copies.filter("n = 1").select("cls")
    return texts, copies, marks.join(single, "cls").groupBy("cls").agg(F.collect_list(F.struct("first", "last")).alias("runs")), salt


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Every byte is removed that a string of 200 bytes covers which starts anywhere else as well, in
    the same text or another, as the input stands. Null text counts as empty; texts below 200
    bytes lose nothing; a text of 200 bytes and more that occurs twice loses all; null ids and
    repeated rows are documents like any other; an empty table gives an empty result; other columns
    are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    texts, copies, marks, salt = repeated_spans(docs.select(F.col(text_col)), scratch, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_name(salt, text_bytes(text_col)).alias("cls"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "body", 4 << 20):
                out: dict[str, list] = {"removed": [], "spans": [], "kept": []}
                for body, runs in zip(some.column("body").to_pylist(), some.column("runs"), strict=True):
                    starts, stops = covered(*(runs.values.field(k).to_numpy() for k in ("first", "last")))
                    kept = [body[a:b] for a, b in zip([0, *stops.tolist()], [*starts.tolist(), len(body)], strict=True)]
                    out["removed"].append(int((stops - starts).sum()))
                    out["spans"].append(len(starts))
                    out["kept"].append(hashlib.sha256(b"".join(kept)).hexdigest())
                yield pa.RecordBatch.from_pydict({"cls": some.column("cls"), "removed": pa.array(out["removed"], pa.int64()), "spans": pa.array(out["spans"], pa.int64()), "kept": pa.array(out["kept"], pa.string())})

    cut = scratch.table(texts.join(marks, "cls").mapInArrow(run, "cls long, removed long, spans long, kept string"), "cut")
    gone = (F.col("n") > 1) & (F.col("n_bytes") >= LENGTH)
    empty = hashlib.sha256(b"").hexdigest()
    return rows.join(copies, "cls").join(cut, "cls", "left").select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def trim(body: bytes, starts: np.ndarray, stops: np.ndarray) -> bytes:
    """The text without the characters that lie in the stretches as a whole."""
    out, at = [], 0
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        while a < b and body[a] & 0xC0 == 0x80:  # inside a character: it stays
            a += 1
        while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        out.append(body[at:a])
        at = max(at, b)
    return b"".join([*out, body[at:]])


def trim_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without the characters that repeated strings cover, all columns kept.

    Only whole characters go, so texts stay valid; null texts stay null, empty and short ones as they
    are; repeated rows lose all of a text of LENGTH bytes; rows without an id are rows like any other; an
    empty table stays empty. Columns of any name may be there.
    """
    scratch = Scratch(docs.sparkSession)
    _, copies, marks, salt = repeated_spans(docs.select(F.col(text_col)), scratch, text_col)
    name, n, runs = (fresh(docs, c) for c in ("_name", "_n", "_runs"))
    facts = scratch.table(copies.join(marks, "cls", "left").filter("n > 1 or runs is not null").select(F.col("cls").alias(name), F.col("n").alias(n), F.col("runs").alias(runs)), "facts")

    @F.arrow_udf("string")
    def cut(bodies: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for body, some in zip(bodies, runs, strict=True):
            text = body.as_py()
            if text is not None and some.is_valid and len(some):
                text = trim(text, *covered(*(some.values.field(k).to_numpy() for k in ("first", "last"))))
            out.append(None if text is None else text.decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    body = F.col(text_col).cast("binary")
    joined = docs.withColumn(name, text_name(salt, text_bytes(text_col))).join(facts, name, "left")
    text = F.when(F.col(text_col).isNull() | F.col(n).isNull(), F.col(text_col)).when((F.col(n) > 1) & (F.octet_length(body) >= LENGTH), F.lit("")).when(F.col(runs).isNull(), F.col(text_col)).otherwise(cut(body, F.col(runs)))
    return joined.withColumn(text_col, text).select(docs.columns)
