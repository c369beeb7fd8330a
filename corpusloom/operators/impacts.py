"""BM25 over impact blocks: lists of documents that can be skipped as a whole.

A stored list is cut into blocks of documents of like length. A block row holds its documents with all that a score needs,
and three small numbers: how many they are, the largest weighted frequency and the smallest length in it. These bound what any of
its documents can add to a score, whatever the corpus statistics are when a query comes.

A search reads the small numbers first. A block that some term of the query does not reach is out. The
blocks with the highest bounds are scored, which gives each query the score of its k-th best so far; then
only blocks whose bound reaches that score are read. Results equal ``retrieve.search``; queries with phrases, whose
frequencies no block knows, are answered there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import index as ix
from . import retrieve
from .retrieve import BODY_WEIGHT, K1, LEAST_IDF, TITLE_WEIGHT, B

#: Documents of a block, about.
BLOCK = 256
#: Blocks of a query that are scored first, at least; and documents of them for each one wanted.
FIRST, DOCUMENTS = 2, 4
#: Scores are rounded to six digits: a bound may be short by this.
SLACK = 1e-6
FIELDS = {None: "both", ix.BODY: "body", ix.TITLE: "title"}


@dataclass
class Impacts:
    """(term, block, docs, and for each searched field: n, most, least) beside the index it is made of."""

    blocks: DataFrame
    index: ix.Index


def _weighted(title: Column, body: Column) -> Column:
    return TITLE_WEIGHT * title + BODY_WEIGHT * body


def build(index: ix.Index, n_docs: int | None = None, block: int = BLOCK) -> Impacts:
    """Blocks of documents of like length (within a factor of 2 to the power 1/4), dealt by a hash so that each holds about ``block``."""
    n_docs = index.corpus.first()["n_docs"] if n_docs is None else n_docs
    size = F.col("title_len") + F.col("body_len")
    level = F.round(F.log2(size + 1) * 4).cast("int")
    levels = index.stats.groupBy(level.alias("level")).agg(F.count("*").alias("n"))
    # one number a level, some hundred at most
    parts = {r["level"]: max(1, round(r["n"] / block)) for r in levels.collect()}
    share = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), level) if parts else F.lit(1)
    placed = index.stats.select("doc_id", size.alias("size"), (level.cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("doc_id"), share)).alias("block"))
    of = lambda field: F.sum(F.when(F.col("field") == field, F.col("tf")).otherwise(0)).alias(field)
    rows = index.postings.groupBy("term", "doc_id").agg(of(ix.TITLE), of(ix.BODY)).join(placed, "doc_id")
    aggregates = [F.collect_list(F.struct("doc_id", "title", "body", "size")).alias("docs")]
    for name, title, body in (("both", F.col("title"), F.col("body")), ("body", F.lit(0), F.col("body")), ("title", F.col("title"), F.lit(0))):
        f = _weighted(title, body)
        aggregates += [F.sum((f > 0).cast("long")).alias(f"n_{name}"), F.max(f).alias(f"most_{name}"), F.min(F.when(f > 0, F.col("size"))).alias(f"least_{name}")]
    return Impacts(rows.groupBy("term", "block").agg(*aggregates), index)


def write(impacts: Impacts, folder: str) -> DataFrame:
    """Stores the blocks by term bucket, sorted so that files and pages can be skipped by term and block."""
    spark = impacts.blocks.sparkSession
    dealt = impacts.blocks.withColumn("bucket", ix.bucket_of(F.col("term"))).repartition(ix.BUCKETS, "bucket").sortWithinPartitions("bucket", "term", "block")
    dealt.write.partitionBy("bucket").parquet(folder)
    return spark.read.schema(dealt.schema).parquet(folder)


def load(spark: SparkSession, folder: str, index: ix.Index) -> Impacts:
    return Impacts(spark.read.parquet(folder), index)


def _part(idf: Column, f: Column, size: Column) -> Column:
    """What a term adds to a score: grows with f, falls with the length."""
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * size / F.col("avgdl")))


def bounds(impacts: Impacts, queries: DataFrame, field: str | None = None) -> DataFrame:
    """(query_id, n_terms, block, n, bound, terms): the blocks that every term of a query reaches, with the most that a
    document of theirs can score; ``terms`` are (term, idf)."""
    name = FIELDS[field]
    wanted = retrieve.parsed(queries).select("query_id", "n_terms", "t", F.col("token").alias("term"))
    small = impacts.blocks.select("term", "block", F.col(f"n_{name}").alias("n"), F.col(f"most_{name}").alias("most"), F.col(f"least_{name}").alias("least")).filter("n > 0")
    small = small.join(wanted.select("term").distinct(), "term", "left_semi")
    counts = small.groupBy("term").agg(F.sum("n").alias("n_t"))
    idf = F.log((F.col("n_docs") - F.col("n_t") + 0.5) / (F.col("n_t") + 0.5))
    weighed = wanted.join(counts, "term").crossJoin(F.broadcast(impacts.index.corpus)).withColumn("idf", F.when(idf <= 0, LEAST_IDF).otherwise(idf))
    each = small.join(weighed, "term").select("query_id", "n_terms", "block", "n", F.struct("t", "term", "idf").alias("of"), _part(F.col("idf"), F.col("most"), F.col("least")).alias("part"))
    reached = each.groupBy("query_id", "n_terms", "block").agg(F.count("*").alias("reached"), F.min("n").alias("n"), F.sum("part").alias("bound"), F.collect_list("of").alias("terms"))
    return reached.filter("reached = n_terms").drop("reached")


def score(impacts: Impacts, chosen: DataFrame, field: str | None = None) -> DataFrame:
    """(query_id, doc_id, score) of matching documents in the chosen blocks (rows of ``bounds``)."""
    title = F.lit(0) if field == ix.BODY else F.col("doc.title")
    body = F.lit(0) if field == ix.TITLE else F.col("doc.body")
    wanted = chosen.select("query_id", "n_terms", "block", F.explode("terms").alias("of")).select("query_id", "n_terms", "block", "of.term", "of.idf")
    rows = impacts.blocks.select("term", "block", "docs").join(wanted, ["term", "block"]).select("query_id", "n_terms", "idf", F.explode("docs").alias("doc")).crossJoin(F.broadcast(impacts.index.corpus))
    f = _weighted(title, body)
    scored = rows.filter(f > 0).groupBy("query_id", "n_terms", F.col("doc.doc_id").alias("doc_id")).agg(F.round(F.sum(_part(F.col("idf"), f, F.col("doc.size"))), 6).alias("score"), F.count("*").alias("n"))
    return scored.filter("n = n_terms").select("query_id", "doc_id", "score")


def first_blocks(reached: DataFrame, k: int) -> DataFrame:
    """The blocks that are scored first: those of the highest bounds, until they may hold enough documents."""
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = reached.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= 64 * max(FIRST, k)).withColumn("before", before)
    return placed.filter((F.col("nth") <= FIRST) | (F.col("before") < DOCUMENTS * k)).drop("nth", "before")


def needed_blocks(reached: DataFrame, first: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """Blocks besides the first ones that can hold one of the k best: their bound reaches the k-th score so far."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    least = scored.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") == k).select("query_id", F.col("score").alias("least"))
    rest = reached.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(least, "query_id", "left")
    return rest.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).drop("least")


def search(impacts: Impacts, queries: DataFrame, limit: int = 10, offset: int = 0, field: str | None = None) -> DataFrame:
    """The page of each query, as ``retrieve.search`` gives it without filters."""
    shape = retrieve.parsed(queries).groupBy("query_id").agg(F.max("n_tokens").alias("longest"))
    plain, phrases = (queries.join(shape.filter(c).select("query_id"), "query_id", "left_semi") for c in ("longest = 1", "longest > 1"))
    k = limit + offset
    reached = bounds(impacts, plain, field)
    first = first_blocks(reached, k)
    early = score(impacts, first, field)
    late = score(impacts, needed_blocks(reached, first, early, k), field)
    page = retrieve.top(early.unionByName(late), impacts.index.documents, limit, offset)
    return page.unionByName(retrieve.search(impacts.index, phrases, limit, offset, field))
