"""Near-duplicate vectors by collision counting over many sorted one-dimensional projections.

A group (the vectors of one label and length) is sorted along many random directions, one list for
each. Two vectors collide in a list when one's place lies in the window centred on the other's. A
pair is verified in double precision when it collides as often as a pair at the threshold does with
probability RECALL.

A window along one direction always holds a constant share of a group, so in a group of more than
FILL vectors each list is sorted within the cells of a few coarse projections of its own: their
number grows with the logarithm of the group and keeps what a window holds by chance bounded; the
number of lists grows with it so that the recall stays. Lists of more than CROWD vectors, as dense
groups and large clusters make them, write out no pairs: all their vectors are compared block by
block. Where that would be more work than the whole group, the group is compared instead, once.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, collect_garbage, mix64, partitions
from .components import components

COSINE = 0.98
RECALL = 1 - 1e-5
#: Distance of two unit vectors at the threshold. Along a random direction of a space of D dimensions
#: their places differ with standard deviation APART / sqrt(D); places are given times sqrt(D).
APART = math.sqrt(2 * (1 - COSINE))
#: Half a window, and the width of a coarse cell.
HALF_WINDOW = 2.5 * APART
CELL = 4 * APART
#: Unrelated vectors that a list holds on average, at most.
FILL = 8
#: A pair is verified from this many collisions on.
NEED = 3
#: Vectors of a list whose window collisions are written out as pairs.
CROWD = 128
#: Vectors of a block when all pairs of a group are compared.
BLOCK = 2048


def _agree(apart: float) -> float:
    """The chance that two places which differ by a normal number of this deviation share a coarse
    cell of random offset."""
    x = (np.arange(4000) + 0.5) / 4000 * CELL
    density = np.exp(-0.5 * (x / apart) ** 2) / (apart * math.sqrt(2 * math.pi))
    return float(2 * ((1 - x / CELL) * density).sum() * CELL / 4000)


def depth_of(n: int) -> int:
    """Coarse projections of each list in a group of n vectors."""
    return max(0, math.ceil(math.log(max(n, 1) / FILL) / -math.log(_agree(math.sqrt(2)))))


def collision_chance(depth: int) -> float:
    """The chance that a pair at the threshold collides in a list."""
    return _agree(APART) ** depth * math.erf(HALF_WINDOW / APART / math.sqrt(2))


@functools.lru_cache(maxsize=64)
def lists_of(depth: int) -> int:
    """The least number of lists in which a pair at the threshold collides NEED times with probability RECALL."""
    p, n = collision_chance(depth), NEED
    while sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(NEED)) > 1 - RECALL:
        n += 1
    return n


@functools.lru_cache(maxsize=16)
def directions(dim: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Random unit directions times sqrt(dim), the same in every task: (lists, depth + 1, dim), the
    last of each list is the one it is sorted by; and the offsets of the coarse cells."""
    g = np.random.default_rng([20_240_611, dim, depth])
    found = g.standard_normal((lists_of(depth), depth + 1, dim))
    return found / np.linalg.norm(found, axis=2, keepdims=True) * math.sqrt(dim), g.random((lists_of(depth), depth))


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(-1, keepdims=True)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors in double precision) by length."""
    values, ends = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    sizes = np.diff(ends)
    out = []
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        out.append((rows, units(values[ends[rows][:, None] + np.arange(dim)])))
    return out


def _lists(classes: DataFrame) -> DataFrame:
    """(list, place, grp, cls): the list of each direction that a vector is in, and its place there.
    Rows (grp, size, cls, e); size is that of the group."""

    def told(part: pa.RecordBatch, depth: int) -> Iterator[pa.RecordBatch]:
        grp, cls = part.column("grp").to_numpy(), part.column("cls").to_numpy()
        for rows, unit in _matrix(part.column("e")):
            ways, offsets = directions(unit.shape[1], depth)
            seed = mix64(grp[rows].view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
            for t in range(len(ways)):
                place = unit @ ways[t].T
                key = mix64(seed + np.uint64(t))
                for cell in np.floor(place[:, :depth] / CELL + offsets[t]).astype(np.int64).view(np.uint64).T:
                    key = mix64(key ^ (cell * np.uint64(0xD1342543DE82EF95)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(place[:, depth]), pa.array(grp[rows]), pa.array(cls[rows])], names=["list", "place", "grp", "cls"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                depth = np.array([depth_of(n) for n in part.column("size").to_pylist()])
                for d in np.unique(depth).tolist():
                    yield from told(part.filter(pa.array(depth == d)), d)

    return classes.select("grp", "size", "cls", "e").mapInArrow(run, "list long, place double, grp long, cls long")


def window_pairs(lists: np.ndarray, place: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that collide, the smaller class first. Rows are sorted by list and place: each looks
    along the order until its window or its list ends."""
    a, b = [], []
    at, step = np.arange(len(lists)), 0
    while len(at):
        step += 1
        at = at[at + step < len(lists)]
        at = at[(lists[at] == lists[at + step]) & (place[at + step] - place[at] <= HALF_WINDOW)]
        a.append(np.minimum(cls[at], cls[at + step]))
        b.append(np.maximum(cls[at], cls[at + step]))
    return np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])


def _collisions(sparse: DataFrame) -> DataFrame:
    """(a, b), once for each list in which the two collide. Rows (list, place, cls)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, ("list", "place", "cls"), strict=True)]
            done = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
            if done:  # the last list may go on in the next batch
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in window_pairs(*(x[:done] for x in held))], names=["a", "b"])
                held = [x[done:] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in window_pairs(*held)], names=["a", "b"])

    parts = partitions(sparse.sparkSession)
    return sparse.select("list", "place", "cls").repartition(parts, "list").sortWithinPartitions("list", "place").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame) -> DataFrame:
    """The linked pairs (a, b) of rows (a, b, x, y)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                keep = np.zeros(part.num_rows, bool)
                # both vectors of a pair are of one group, so of one length
                for (rows, x), (_, y) in zip(_matrix(part.column("x")), _matrix(part.column("y")), strict=True):
                    keep[rows] = (x * y).sum(1) >= COSINE
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def _dealt(members: DataFrame, group: str) -> DataFrame:
    """(task, side, cls, n, e): the members (group, total, cls, n, e) dealt so that all pairs of a group
    meet; one of many blocks is dealt out as pairs of blocks. Side 0 asks, side 1 is asked; a block
    that meets itself has side 2."""
    blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    placed = members.withColumn("k", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    task = lambda i, j: F.concat_ws("/", group, i, j)
    asks = placed.select(task(F.col("k"), F.col("o")).alias("task"), F.when(F.col("k") == F.col("o"), 2).otherwise(0).alias("side"), "cls", "n", "e")
    told = placed.filter("k <> o").select(task(F.col("o"), F.col("k")).alias("task"), F.lit(1).alias("side"), "cls", "n", "e")
    return asks.unionAll(told)


def _by_task(dealt: DataFrame, flush, schema: str) -> DataFrame:
    """What ``flush`` gives, as two columns, for the rows (side, cls, n, e) of each task."""
    names = [part.split()[0] for part in schema.split(", ")]

    def told(rows: list) -> pa.RecordBatch:
        side = np.array([r[0] for r in rows])
        cls = np.array([r[1] for r in rows], np.int64)
        weight = np.array([r[2] for r in rows], np.float64)
        unit = units(np.array([r[3] for r in rows], np.float64))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flush(side, cls, weight, unit)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("task", "side", "cls", "n")]
            for task, side, cls, n, e in zip(*columns, batch.column("e").to_numpy(zero_copy_only=False), strict=True):
                if task != now and rows:
                    yield told(rows)
                    rows = []
                now = task
                rows.append((side, cls, n, e))
        if rows:
            yield told(rows)

    parts = partitions(dealt.sparkSession)
    return dealt.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(run, schema)


def _count_links(members: DataFrame) -> DataFrame:
    """(cls, links): linked vectors of other classes in the same component."""

    def flush(side: np.ndarray, cls: np.ndarray, weight: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        asks, told = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        total = np.zeros(len(asks))
        for start in range(0, len(asks), 512):
            some = asks[start : start + 512]
            near = (unit[some] @ unit[told].T >= COSINE) & (cls[some][:, None] != cls[told][None, :])
            total[start : start + 512] = near @ weight[told]
        return cls[asks], total.astype(np.int64)

    return _by_task(_dealt(members, "root"), flush, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("links"))


def connected(side: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """For each vector of a task the number of the first one it is connected with by links between the sides."""
    near = np.zeros((len(side), len(side)), bool)
    asks, told = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    near[np.ix_(asks, told)] = unit[asks] @ unit[told].T >= COSINE
    near |= near.T
    root = np.full(len(side), -1)
    for first in range(len(side)):
        if root[first] < 0:
            reached = np.array([first])
            while len(reached):
                root[reached] = first
                reached = np.flatnonzero(near[reached].any(0) & (root < 0))
    return root


def _linked_in_blocks(members: DataFrame) -> DataFrame:
    """(a, b): what connects the linked vectors of each crowd. Rows (crowd, total, cls, n, e)."""

    def flush(side: np.ndarray, cls: np.ndarray, weight: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root = connected(side, unit)
        other = np.flatnonzero(root != np.arange(len(root)))
        return cls[root[other]], cls[other]

    # both orders of two blocks give the same pairs: the second is left out
    one = _dealt(members, "crowd").filter("side = 2 or split(task, '/')[1] < split(task, '/')[2]")
    return _by_task(one, flush, "a long, b long").distinct()


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors are linked when their labels are equal and not null and their cosine is 0.98 or more.
    Equal vectors of a label are one class whose rows link with each other; n_links counts rows.
    Vectors that are null, empty, zero, or hold null or non-finite components, and vectors without a
    label, link with nothing; vectors of different lengths do not link. A null vec_id takes part, and
    its component is the smallest id linked with it (itself, null, if none); repeated rows are
    vectors like any other; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    e = F.col("e")
    fit = (F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(e, lambda c: c != 0) & F.col("label").isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("e")).withColumn("fit", F.coalesce(fit, F.lit(False)))
    rows = rows.withColumn("cls", F.xxhash64("label", "e"))
    named = scratch.table(rows.select("vec_id", "fit", "cls"), "named")
    group = F.xxhash64("label", F.size("e"))
    classes = scratch.table(rows.filter("fit").groupBy("cls").agg(F.count("*").alias("n"), F.min("label").alias("label"), F.first("e").alias("e")).select("cls", "n", "e", group.alias("grp")), "classes")

    sizes = scratch.table(classes.groupBy("grp").agg(F.count("*").alias("size")), "groups")
    lists = scratch.table(_lists(classes.join(sizes, "grp")), "lists")
    crowds = scratch.table(lists.groupBy("list").agg(F.count("*").alias("total"), F.min("grp").alias("grp")).filter(F.col("total") > CROWD), "crowds")
    dense = scratch.table(crowds.groupBy("grp").agg(F.sum(F.col("total") * F.col("total")).alias("work")).join(sizes, "grp").filter(F.col("work") >= F.col("size") * F.col("size")).select("grp", "size"), "dense")
    sparse = lists.join(crowds.select("list"), "list", "left_anti").join(dense.select("grp"), "grp", "left_anti")
    counted = scratch.table(_collisions(sparse).groupBy("a", "b").agg(F.count("*").alias("met")).filter(F.col("met") >= NEED).select("a", "b"), "counted")
    collect_garbage(spark)
    sides = counted.join(classes.select(F.col("cls").alias("a"), F.col("e").alias("x")), "a").join(classes.select(F.col("cls").alias("b"), F.col("e").alias("y")), "b")
    some = lists.join(crowds.select("list", "total"), "list").join(dense.select("grp"), "grp", "left_anti").select(F.col("list").alias("crowd"), "total", "cls").join(classes.select("cls", "n", "e"), "cls")
    whole = dense.join(classes, "grp").select(F.col("grp").alias("crowd"), F.col("size").alias("total"), "cls", "n", "e")
    found = scratch.table(_verified(sides).unionAll(_linked_in_blocks(some.unionByName(whole))), "found")
    scratch.drop(lists)
    roots = scratch.table(components(scratch, found, "near"), "roots")

    # all pairs of a component are compared
    sizes = scratch.table(roots.groupBy("root").agg(F.count("*").alias("total")), "sizes")
    members = roots.join(sizes, "root").withColumnRenamed("node", "cls").join(classes, "cls")
    links = _count_links(members)

    facts = classes.select("cls", "n").join(links, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    facts = scratch.table(facts.select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root")), "facts")
    linked = named.filter("fit").join(facts, "cls")
    least = scratch.table(linked.groupBy("root").agg(F.min("vec_id").alias("component_id")), "least")
    out = linked.join(least, "root").select("vec_id", "n_links", "component_id").unionAll(named.filter("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
