"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _step(scratch: Scratch, edges: DataFrame, both: bool, name: str) -> DataFrame:
    """Links the neighbours of each node to the smallest of them (``both``: larger neighbours of all
    nodes; else smaller neighbours, and the node itself).

    The minima are pre-aggregated and written, so that Spark can split the partition of a node that
    a third of all edges touch.
    """
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        around = around.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = scratch.table(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name + "-least")
    joined = around.join(least, "u")
    if both:
        made = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        made = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = scratch.table(made.filter("a <> b").distinct(), name)
    scratch.drop(least)
    return out


def components(scratch: Scratch, edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    ``edges`` has two long columns; direction, repeats, self-links and nulls do not matter. Each
    step is a written table, so lineage stays short and a lost executor costs one step.
    """
    a, b = edges.columns[:2]
    now = scratch.table(
        edges.select(F.greatest(F.col(a).cast("long"), F.col(b).cast("long")).alias("a"), F.least(F.col(a).cast("long"), F.col(b).cast("long")).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct(),
        name,
    )
    mark = None
    while True:
        large = _step(scratch, now, True, name)
        small = _step(scratch, large, False, name)
        scratch.drop(now)
        scratch.drop(large)
        now = small
        # stars are a fixed point: the same edges twice in a row
        found = tuple(now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.bit_xor(F.xxhash64("a", "b"))).first())
        if found == mark or not found[0]:
            break
        mark = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
