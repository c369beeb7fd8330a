"""Exact top-k search over binary codes by incremental multi-index hashing, as joins.

A code is cut into segments; a table of buckets holds each code under each of its segments. In round s all
queries that are not done probe each segment with the keys that differ from theirs in exactly s bits: an
equi-join on (segment, key), whose pairs are verified by their whole distance. After it every code within m * (s + 1) - 1
bits has been met, m being the number of segments: a code that is farther than s in each has at least
m * (s + 1) differing bits. A query is done when its k-th best distance is covered so; the others go to the next round.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD = 64
#: Least and most bits of a segment; in between about log2 of the number of codes, so that a bucket holds about one.
NARROW, WIDE = 8, 32


def sign_code(words: int, column: str = "embedding") -> Column:
    """The code of a vector as an array of longs: bit i of word w is set where component 64 * w + i is above 0 (missing: not)."""
    return F.expr(f"transform(sequence(0, {words - 1}), w -> aggregate(sequence(0, {WORD - 1}), 0L, (t, i) -> t | if(coalesce(get({column}, w * {WORD} + i) > 0, false), shiftleft(1L, i), 0L)))")


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def segments(code: str, words: int, width: int) -> Column:
    """The values of a code's segments; a word has 64 / width of them."""
    low = (1 << width) - 1
    return F.array(*[F.shiftrightunsigned(F.element_at(code, w + 1), at).bitwiseAND(F.lit(low).cast("long")) for w in range(words) for at in range(0, WORD, width)])


def probes(asked: DataFrame, width: int, radius: int) -> DataFrame:
    """(query, segment, key): for each segment of each query all keys that differ in exactly ``radius`` bits."""
    rows = asked.select(F.col("code").alias("query"), F.posexplode("parts").alias("segment", "key")).withColumn("last", F.lit(-1))
    for done in range(radius):  # bits in ascending order, so that no key comes twice
        spot = F.explode(F.sequence(F.col("last") + 1, F.lit(width - radius + done)))
        rows = rows.select("query", "segment", "key", spot.alias("last")).withColumn("key", F.expr("key ^ shiftleft(1L, last)"))
    return rows.select("query", "segment", "key")


def search_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", width: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, distance: for every query row the k nearest other rows by Hamming
    distance of sign codes, ties by the smaller vec_id.

    Exact, for vectors of any length: a code has a bit for each component of the longest one. Rows with a null id are
    neither found nor asked; a null or empty vector has code 0, as a missing component has bit 0; repeated rows
    count once an id; fewer than k rows give fewer; other columns are ignored. Rows of one code form a group of which only the
    k + 1 smallest ids can ever be returned, so a code that a third of all rows share is one short entry,
    pre-aggregated before the shuffle, and queries of one code are answered once.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter("vec_id is not null")
    wanted = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("v")).filter("query_id is not null")
    longest = [x.agg(F.max(F.size("v"))).first()[0] or 0 for x in (rows, wanted)]
    words = max(1, -(-max(longest) // WORD))
    # two steps keep a hot code from meeting in one task: k + 1 ids of each salt, then of the code
    coded = rows.select("vec_id", sign_code(words, "v").alias("code")).distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = _smallest(_smallest(coded, ["code", "salt"], k + 1), ["code"], k + 1).groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = scratch.table(few, "codes")
    n = index.count()
    if width is None:
        width = min((w for w in (8, 16, 32) if NARROW <= w <= WIDE), key=lambda w: abs(w - np.log2(n + 1)))
    m = words * (WORD // width)
    parts = segments("code", words, width)
    buckets = scratch.table(index.select("code", F.size("ids").alias("held"), parts.alias("parts"), F.posexplode(parts).alias("segment", "key")), "buckets")
    asked = scratch.table(wanted.select("query_id", sign_code(words, "v").alias("code")).distinct(), "asked")
    active = scratch.table(asked.select("code").distinct().withColumn("parts", parts), "active")

    found: list[DataFrame] = []
    for radius in range(width + 1):
        if active.isEmpty():
            break
        # Spark's estimate does not see how probes multiply: they are merged at every size, never broadcast
        met = probes(active, width, radius).hint("merge").join(buckets, ["segment", "key"])
        mine = segments("query", words, width)
        apart = F.zip_with(mine, "parts", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
        # a pair counts where its nearest segment, the first of equals, meets: once in all rounds
        nearest = F.array_position(apart, F.array_min(apart)) - 1
        pairs = met.filter((nearest == F.col("segment")) & (F.array_min(apart) == radius)).select("query", "code", "held", _distance("query", "code").alias("distance"))
        # of one round no more can be wanted than the k + 1 nearest, with ties of distance
        order = Window.partitionBy("query").orderBy("distance")
        found.append(scratch.table(pairs.withColumn("nth", F.rank().over(order)).filter(F.col("nth") <= k + 1).drop("nth"), f"found-{radius}"))
        covered = m * (radius + 1) - 1
        every = reduce(DataFrame.unionByName, found)
        done = every.filter(F.col("distance") <= covered).groupBy("query").agg(F.sum("held").alias("held")).filter(F.col("held") > k).select(F.col("query").alias("code"))
        left = scratch.table(active.join(done, "code", "left_anti"), "active")
        scratch.drop(active)
        active = left
    if not found:  # nothing was asked
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0).alias("distance")).limit(0)
    nearest = Window.partitionBy("query").orderBy("distance", "vec_id")
    ids = every.drop("held").join(index, "code").select("query", "distance", F.explode("ids").alias("vec_id"))
    # the query's own id may be among them, so one more than k
    best = scratch.table(ids.withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= k + 1).select(F.col("query").alias("code"), "vec_id", "distance"), "best")
    each = asked.join(best, "code").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def _smallest(frame: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("vec_id")
    return frame.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= n).drop("at")
