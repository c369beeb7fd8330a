"""The inverted index: postings with positions, document and corpus statistics, versioned snapshots."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .commits import Decisions

TITLE, BODY = "title", "body"
#: Of stored snapshots; 1 has no number in its marker.
SCHEMA_VERSION = 2
BUCKETS = 64
#: Tokens whose postings are made at once.
TOKENS = 1 << 18
#: Given terms that go to the tasks; more are joined.
TERMS = 200_000
#: Tokens of a stored part of a bucket, about.
PART = 1 << 19


def latest(rows: DataFrame, key: str = "path_key", by: str = "indexed_at") -> DataFrame:
    """One row per key, the newest: a batch upsert."""
    newest = Window.partitionBy(key).orderBy(F.col(by).desc(), F.col("doc_id").desc())
    return rows.withColumn("_at", F.row_number().over(newest)).filter("_at = 1").drop("_at")


def tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, field, terms): index tokens of name and text. Rows leave as they are read; no shuffle."""
    both = documents.select("doc_id", F.explode(F.array(
        F.struct(F.lit(TITLE).alias("field"), tx.index_terms(F.col("name")).alias("terms")),
        F.struct(F.lit(BODY).alias("field"), tx.index_terms(F.coalesce("text", F.lit(""))).alias("terms")),
    )).alias("f"))
    return both.select("doc_id", "f.field", "f.terms")


def _cut(batch: pa.RecordBatch, ends: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of a weight, or of one row that has more; ``ends`` are the rows' weights summed up."""
    begin = 0
    while begin < len(ends):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _parts(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts of TOKENS tokens, or of one row that has more."""
    for batch in batches:
        yield from _cut(batch, np.cumsum(sum(np.asarray(batch.column(c).value_lengths().fill_null(0), np.int64) for c in columns or ("terms",))), TOKENS)


def _grouped(batches: Iterable[pa.RecordBatch], terms: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    """Postings of the rows of each batch: a row's tokens by term, with their places; of the given terms only if
    there are any. What is held beside a batch does not grow with it."""
    for batch in _parts(batches):
        lists = batch.column("terms")
        sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        flat = lists.flatten()
        rows = np.repeat(np.arange(len(sizes)), sizes)
        places = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if terms is not None:
            asked = pc.is_in(flat, value_set=terms)
            flat, asked = flat.filter(asked), np.asarray(asked)
            rows, places = rows[asked], places[asked]
        coded = flat.dictionary_encode()
        codes = np.asarray(coded.indices, np.int64)
        n = len(codes)
        if not n:
            continue
        order = np.lexsort((codes, rows))  # stable: places of a term stay in order
        first = np.flatnonzero(np.concatenate([[True], (np.diff(rows[order]) != 0) | (np.diff(codes[order]) != 0)]))
        ends = np.append(first, n)
        where = pa.array(rows[order][first])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(where),
                batch.column("field").take(where),
                coded.dictionary.take(pa.array(codes[order][first])),
                pa.array(np.diff(ends)),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places[order].astype(np.int32))),
            ],
            names=["doc_id", "field", "term", "tf", "positions"],
        )


def document_postings(documents: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, field, term, tf, positions), of the given terms only if there are any.

    A row holds all tokens of its document, so its postings are made where it is read, and nothing is shuffled. Given
    terms go to the tasks; beyond TERMS of them tokens are joined with them, and their grouping key holds the
    document, so no task sees one term's whole list."""
    rows = tokens(documents)
    kind = dict(documents.dtypes)["doc_id"]
    told = f"doc_id {kind}, field string, term string, tf long, positions array<int>"
    if terms is None:
        return rows.mapInArrow(_grouped, told)
    few = pa.array([r["term"] for r in terms.limit(TERMS + 1).collect()], pa.string())
    if len(few) <= TERMS:
        return rows.mapInArrow(lambda batches: _grouped(batches, few), told)
    each = rows.select("doc_id", "field", F.posexplode("terms").alias("pos", "term")).join(terms.select("term"), "term", "left_semi")
    return each.groupBy("doc_id", "field", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def doc_stats(documents: DataFrame) -> DataFrame:
    """(doc_id, title_len, body_len), straight from each row."""
    return documents.select("doc_id", tx.count_terms(F.col("name")).cast("long").alias("title_len"), tx.count_terms(F.coalesce("text", F.lit(""))).cast("long").alias("body_len"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl."""
    return stats.agg(F.count("*").alias("n_docs"), F.avg(F.col("title_len") + F.col("body_len")).alias("avgdl"))


@dataclass
class Index:
    """Stored tables of one snapshot."""

    postings: DataFrame
    stats: DataFrame
    corpus: DataFrame
    documents: DataFrame


class Unstored(Index):
    """An index of documents that are read when it is searched; of the given terms only if there are any."""

    def __init__(self, documents: DataFrame, terms: DataFrame | None = None):
        self.documents, self.terms = documents, terms

    @cached_property
    def postings(self) -> DataFrame:
        return document_postings(self.documents, self.terms)

    @cached_property
    def stats(self) -> DataFrame:
        return doc_stats(self.documents)

    @cached_property
    def corpus(self) -> DataFrame:
        return corpus_stats(self.stats)


def bucket_of(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(documents: DataFrame, terms: DataFrame | None = None) -> Index:
    """An index that is not stored; with terms, the part of it that a batch of queries reads."""
    return Unstored(documents, terms)


def merged(index: Index, changed: DataFrame, gone: DataFrame | None = None) -> Index:
    """The index after documents came or changed (rows like ``index.documents``) and paths went (path_key).

    Only changed texts are tokenised; what is stored of all other documents is taken as it is. A path
    keeps the doc_id it has. Of several rows of a path in ``changed`` the newest counts if they have
    an ``indexed_at``, else the one of the largest doc_id.
    """
    order = [F.col(c).desc() for c in ("indexed_at", "doc_id") if c in changed.columns]
    one = changed.withColumn("nth", F.row_number().over(Window.partitionBy("path_key").orderBy(*order))).filter("nth = 1").drop("nth")
    old = index.documents.select("path_key", F.col("doc_id").alias("old_id"))
    fresh = one.join(old, "path_key", "left").withColumn("doc_id", F.coalesce("old_id", "doc_id")).select(*index.documents.columns)
    paths = changed.select("path_key") if gone is None else changed.select("path_key").unionByName(gone.select("path_key"))
    touched = old.join(paths, "path_key", "left_semi").select(F.col("old_id").alias("doc_id"))
    stays = lambda stored: stored.join(touched, "doc_id", "left_anti")
    new = build(fresh)
    stats = stays(index.stats).unionByName(new.stats)
    postings = stays(index.postings.select(new.postings.columns)).unionByName(new.postings)
    return Index(postings, stats, corpus_stats(stats), stays(index.documents).unionByName(fresh))


def parts_of(stats: DataFrame) -> int:
    """In how many parts a bucket of these documents is stored: as many as their tokens need, so that a task's share stays as it is."""
    tokens = stats.agg(F.sum(F.col("title_len") + F.col("body_len"))).first()[0] or 0
    return max(4, -(-tokens // (BUCKETS * PART)))


def write_postings(postings: DataFrame, folder: str, mode: str = "error", parts: int = 4) -> None:
    """Postings by term bucket, so that a query reads the buckets of its terms only; ``parts`` of a bucket, by document."""
    dealt = postings.withColumn("bucket", bucket_of(F.col("term"))).repartition(BUCKETS * parts, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    dealt.write.partitionBy("bucket").mode(mode).parquet(folder)


def of_terms(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Stored postings of the given terms; the scan is pruned to their buckets."""
    buckets = [r[0] for r in postings.sparkSession.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"))).distinct().collect()]
    return postings.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def write(index: Index, path: str, version: int) -> str:
    """Writes one immutable snapshot. The marker is written last: readers take complete versions."""
    root = f"{path}/v={version}"
    for name in ("stats", "corpus", "documents"):
        getattr(index, name).write.mode("overwrite").parquet(f"{root}/{name}")
    write_postings(index.postings, f"{root}/postings", "overwrite", parts_of(index.documents.sparkSession.read.parquet(f"{root}/stats")))
    index.corpus.select(F.lit(version).alias("version"), F.lit(SCHEMA_VERSION).alias("schema")).coalesce(1).write.mode("overwrite").parquet(f"{root}/committed")
    return root


def load(spark: SparkSession, root: str, terms: list[str] | None = None) -> Index:
    """A committed snapshot; with terms, the scan is pruned to their buckets. One of another schema is not read (``opened`` brings it up to date)."""
    if schema_of(spark, root) != SCHEMA_VERSION:
        raise ValueError("INDEX_SCHEMA")
    postings = spark.read.parquet(f"{root}/postings")
    if terms is not None:
        postings = of_terms(postings, terms)
    return Index(postings, *(spark.read.parquet(f"{root}/{n}") for n in ("stats", "corpus", "documents")))


def schema_of(spark: SparkSession, root: str) -> int:
    """The schema of a snapshot; an uncommitted version raises."""
    return spark.read.parquet(f"{root}/committed").first().asDict().get("schema", 1)


def opened(spark: SparkSession, root: str, terms: list[str] | None = None) -> Index:
    """A committed snapshot of any schema. One of another schema is moved aside as ``<root>.legacy-<schema>`` and built
    again from the documents that it holds; if that was interrupted, it is taken up from the copy."""
    files = Decisions(spark, root)
    path, _, name = root.rstrip("/").rpartition("/")
    version = int(name.split("=")[1])
    copies = [n for n in files.children(path) if n.startswith(f"{name}.legacy-")]
    complete = "committed" in files.children(root)
    if complete and schema_of(spark, root) != SCHEMA_VERSION:
        copies = [f"{name}.legacy-{schema_of(spark, root)}"]
        files.move(root, f"{path}/{copies[0]}")
        complete = False
    if not complete and copies:
        write(build(spark.read.parquet(f"{path}/{copies[-1]}/documents")), path, version)
    return load(spark, root, terms)
