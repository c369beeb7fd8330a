"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, globally_ranked

#: Points of each shard on the ring.
VNODES = 64


def ring(n_shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """The (position, shard) points in clockwise order. A shard's points depend on its number alone."""
    points = []
    for shard in range(n_shards):
        for v in range(vnodes):
            digest = hashlib.sha256(f"{shard}/{v}".encode()).digest()
            points.append((int.from_bytes(digest[:8], "big", signed=True), shard))
    return sorted(points)


def quotas(total: int, n_shards: int) -> list[int]:
    """Room of each shard: counts at most one apart."""
    return [total // n_shards + (shard < total % n_shards) for shard in range(n_shards)]


def place_arcs(points: list[tuple[int, int]], arc_counts: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Runs (first global rank, shard, first slot, length) that fill the shards up to their room.

    ``arc_counts[i]`` keys lie on the arc that ends at point i. Each arc first fills the shard of
    its own point; then, still arc by arc, what overflowed continues clockwise to the next point
    whose shard has room. Both passes see arcs only, so the work depends on the ring, not on the rows.
    """
    left = list(room)
    used = [0] * len(room)
    starts = np.concatenate([[0], np.cumsum(arc_counts)]).astype(int).tolist()
    runs, over = [], []

    def put(first: int, shard: int, want: int) -> int:
        n = min(want, left[shard])
        if n:
            runs.append((first, shard, used[shard], n))
            left[shard] -= n
            used[shard] += n
        return n

    for arc, count in enumerate(arc_counts):
        n = put(starts[arc], points[arc][1], count)
        if n < count:
            over.append((arc, starts[arc] + n, count - n))
    for arc, first, count in over:
        at = arc
        while count:
            at = (at + 1) % len(points)
            n = put(first, points[at][1], count)
            first, count = first + n, count - n
    return sorted(runs)


def shard_documents(docs: DataFrame, n_shards: int = 16, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals all rows into ``n_shards`` shards whose counts are at most one apart (law ``rows``).

    A row's key on the ring is the hash of its text, so copies stand together and share a shard as
    far as room allows; ties are ordered by id. Shard capacity is the exact quota of rows; keys
    that find a full shard continue clockwise.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard (null under
    this law). Null text counts as empty; null ids and repeated rows are rows like any other; an
    empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("pos"),
    )
    rows = scratch.table(rows, "rows")  # dealing by range samples its input: texts are read once
    # copies of a text are one place of the ring; the id splits them over the range partitions
    ranked, _ = globally_ranked(scratch, rows, ["pos", "doc_id"], "ring")
    points = ring(n_shards, vnodes)
    bounds = np.array([p for p, _ in points], np.int64)
    counted = {r["arc"]: r["n"] for r in ranked.select(_arc_of(bounds)("pos").alias("arc")).groupBy("arc").agg(F.count("*").alias("n")).collect()}
    counts = [counted.get(k, 0) for k in range(len(points) + 1)]
    # keys beyond the last point wrap to the first: their ranks come last, so they are an arc of their own
    runs = place_arcs([*points, points[0]], counts, quotas(sum(counts), n_shards))
    first = np.array([r[0] for r in runs] or [0], np.int64)
    shard = np.array([r[1] for r in runs] or [0], np.int32)
    slot = np.array([r[2] for r in runs] or [0], np.int64)

    @F.pandas_udf(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))
    def placed(g: pd.Series) -> pd.DataFrame:
        ranks = g.to_numpy(np.int64)
        at = np.searchsorted(first, ranks, side="right") - 1
        return pd.DataFrame({"shard": shard[at], "slot": slot[at] + ranks - first[at]})

    return ranked.withColumn("put", placed("g")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "put.shard", "put.slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _arc_of(bounds: np.ndarray):
    @F.pandas_udf("int")
    def arc(pos: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, pos.to_numpy(np.int64), side="left").astype(np.int32))

    return arc


def moved_share(n_shards: int, arcs: int = 20_000, vnodes: int = VNODES) -> tuple[float, float]:
    """The share of evenly spread keys that change their shard when one shard is added, and the share
    that moves between old shards, both under the quotas."""
    keys = np.linspace(-(2**63), 2**63 - 2**11, arcs).astype(np.int64)
    owners = []
    for n in (n_shards, n_shards + 1):
        points = ring(n, vnodes)
        counts = np.bincount(np.searchsorted(np.array([p for p, _ in points], np.int64), keys), minlength=len(points) + 1).tolist()
        owner = np.zeros(arcs, np.int64)
        for first, shard, _, length in place_arcs([*points, points[0]], counts, quotas(arcs, n)):
            owner[first : first + length] = shard
        owners.append(owner)
    moved = owners[0] != owners[1]
    return float(moved.mean()), float((moved & (owners[1] < n_shards)).mean())
