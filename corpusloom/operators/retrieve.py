"""Conjunctive retrieval and BM25 over the inverted index, for a batch of queries.

A batch is a frame (query_id, query). All plans are relational: query terms meet postings by an
equi-join, a document matches when all terms do, and the best of each query are a window with a
limit that Spark turns into a per-partition top-k before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import batch as bt
from .index import BODY, TITLE, Index, Unstored

K1, B = 1.2, 0.75
TITLE_WEIGHT, BODY_WEIGHT = 8.0, 1.0
#: Rows of a page, and characters of their queries, that go to the tasks.
SENT, SENT_CHARACTERS = 1 << 15, 1 << 24
#: Inverse document frequencies that are not above 0 become this.
LEAST_IDF = 1e-6


def parsed(queries: DataFrame) -> DataFrame:
    """(query_id, t, k, token, n_tokens, n_terms): the stage-2 tokens of each distinct stage-1 term."""
    terms = queries.select("query_id", tx.query_terms(F.col("query")).alias("terms")).filter("terms is not null")
    each = terms.select("query_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("t", "term"))
    split = each.withColumn("tokens", tx.tokenize_fts(F.col("term")))
    return split.select("query_id", "n_terms", "t", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("k", "token"))


def wanted_terms(queries: DataFrame) -> DataFrame:
    """(term): the index tokens that a batch reads."""
    return parsed(queries).select(F.col("token").alias("term")).distinct()


def phrase_hits(index: Index, queries: DataFrame, field: str | None = None) -> DataFrame:
    """(query_id, n_terms, t, doc_id, tf_title, tf_body): how often each term occurs, phrases included.

    A term of several tokens occurs where they stand side by side in one field: the start places
    that all its tokens agree on.
    """
    postings = index.postings if field is None else index.postings.filter(F.col("field") == field)
    wanted = parsed(queries)
    rows = postings.join(wanted, postings["term"] == wanted["token"])
    single = rows.filter("n_tokens = 1").select("query_id", "n_terms", "t", "doc_id", "field", "tf")
    starts = rows.filter("n_tokens > 1").select("query_id", "n_terms", "t", "doc_id", "field", "n_tokens", F.explode("positions").alias("pos"), "k")
    phrases = starts.groupBy("query_id", "n_terms", "t", "doc_id", "field", "n_tokens", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("n")).filter("n = n_tokens")
    counted = phrases.groupBy("query_id", "n_terms", "t", "doc_id", "field").agg(F.count("*").alias("tf"))
    both = single.unionByName(counted)
    tf = lambda name: F.sum(F.when(F.col("field") == name, F.col("tf")).otherwise(0)).alias(f"tf_{name}")
    return both.groupBy("query_id", "n_terms", "t", "doc_id").agg(tf(TITLE), tf(BODY))


def matches(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id) of documents in which every term of the query occurs."""
    found = hits.groupBy("query_id", "n_terms", "doc_id").agg(F.count("*").alias("n"))
    return found.filter("n = n_terms").select("query_id", "doc_id")


def _kinds(index: Index, queries: DataFrame) -> dict[str, str]:
    return {"query_id": queries.schema["query_id"].dataType.simpleString(), "doc_id": index.documents.schema["doc_id"].dataType.simpleString()}


def matching(index: Index, queries: DataFrame, field: str | None = None) -> DataFrame:
    """(query_id, doc_id) of documents in which every term of the query occurs. Documents that are not indexed
    yet are matched where they are read."""
    batch = bt.gathered(parsed(queries)) if isinstance(index, Unstored) else None
    if batch is None:
        return matches(phrase_hits(index, queries, field))
    return bt.matches(index.documents, batch, field, _kinds(index, queries))


def _idf(n_t):
    idf = F.log((F.col("n_docs") - n_t + 0.5) / (n_t + 0.5))
    return F.when(idf <= 0, LEAST_IDF).otherwise(idf)


def _part(idf, tf_title, tf_body):
    """What a term adds to a score."""
    f = TITLE_WEIGHT * tf_title + BODY_WEIGHT * tf_body
    size = F.col("title_len") + F.col("body_len")
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * size / F.col("avgdl")))


def best(index: Index, queries: DataFrame, most: int, field: str | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of at least the best documents of each query among the allowed ones, ties included; with
    name and path_key where documents are read anyway."""
    batch = bt.gathered(parsed(queries)) if isinstance(index, Unstored) else None
    if batch is None:
        scored = bm25(index, phrase_hits(index, queries, field))
        return scored if allowed is None else scored.join(allowed.select("doc_id"), "doc_id", "left_semi")
    kinds = _kinds(index, queries)
    # one row a document; both reads take all its columns, so Spark makes the shuffle, and what is below, once
    rows = bt.hits(index.documents, batch, field, kinds).repartition("doc_id")
    idfs = F.map_from_entries(F.transform(F.map_entries("counts"), lambda e: F.struct(e["key"], _idf(e["value"]))))
    weights = bt.totals(rows).select("avgdl", idfs.alias("idfs"))
    if allowed is not None:
        rows = rows.join(allowed.select("doc_id"), "doc_id", "left_semi")
    parts = F.transform("hits", lambda h: F.struct(h["u"].alias("u"), _part(F.element_at("idfs", h["u"]), h["tf_title"], h["tf_body"]).alias("part")))
    scored = bt.summed(rows.crossJoin(F.broadcast(weights)).select("doc_id", "name", "path_key", parts.alias("parts")), batch, most, 1e-6, kinds)
    return scored.filter("doc_id is not null").withColumn("score", F.round("score", 6))


def bm25(index: Index, hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of matching documents; more is better.

    n_t counts documents that hold the term in the searched fields: a count that is summed up before
    the shuffle, so a stop-word's hits never meet in one task. It reads the hits' own shuffle again.
    Statistics are one row, and the counts one row for each query term.
    """
    # both reads of the hits have the same filters and columns (the count reads tf), so Spark makes their shuffle once
    hits = hits.filter("query_id is not null and t is not null and doc_id is not null")
    per_term = hits.groupBy("query_id", "t").agg(F.sum((F.col("tf_title") + F.col("tf_body") > 0).cast("long")).alias("n_t"))
    counted = hits.join(per_term, ["query_id", "t"]).crossJoin(F.broadcast(index.corpus))
    part = _part(_idf(F.col("n_t")), F.col("tf_title"), F.col("tf_body"))
    scored = counted.join(index.stats, "doc_id").groupBy("query_id", "n_terms", "doc_id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("n"))
    return scored.filter("n = n_terms").select("query_id", "doc_id", "score")


def top(scored: DataFrame, documents: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of each query by score, name and path; names that the rows do not have are joined before, texts never."""
    named = scored if "path_key" in scored.columns else scored.join(documents.select("doc_id", "name", "path_key"), "doc_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.lower("name"), "path_key")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= offset + limit)
    return ranked.filter(F.col("rank") > offset).select("query_id", "rank", "doc_id", "name", "path_key", "score")


def filtered(documents: DataFrame, root_path: str | None = None, extensions: list[str] | None = None, after=None, before=None) -> DataFrame:
    """Documents a content query may return; applied before the limit."""
    out = documents
    if root_path:
        key = root_path.lower().rstrip("\\")
        out = out.filter((F.col("path_key") == key) | F.startswith(F.col("path_key"), F.lit(key + "\\")))
    if extensions:
        out = out.filter(F.lower("extension").isin([e.strip().lstrip(".").lower() for e in extensions]))
    if after is not None:
        out = out.filter(F.col("modified_at") >= after)
    if before is not None:
        out = out.filter(F.col("modified_at") <= before)
    return out


def search(index: Index, queries: DataFrame, limit: int = 10, offset: int = 0, field: str | None = None, allowed: DataFrame | None = None, alive: DataFrame | None = None) -> DataFrame:
    """The page of each query. ``allowed``: documents that pass its filters; ``alive``: current paths."""
    page = top(best(index, queries, offset + limit, field, allowed), index.documents, limit, offset)
    # documents whose file is gone are dropped after the limit, without others in their place
    return page if alive is None else page.join(alive.select("path_key"), "path_key", "left_semi")


def with_texts(page: DataFrame, documents: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Rows of a page of ``limit`` documents a query, joined with columns of their documents by doc_id. A page that is surely small
    goes to where documents are read, so no other text is shuffled; Spark chooses the join of a larger one."""
    if queries.isStreaming:
        return page.join(documents, "doc_id")
    n, characters = queries.agg(F.count("*"), F.coalesce(F.sum(F.length("query")), F.lit(0))).first()
    small = n * limit <= SENT and characters * limit <= SENT_CHARACTERS
    return (F.broadcast(page) if small else page).join(documents, "doc_id")


def title_matched(terms, name):
    return F.exists(terms, lambda t: F.contains(F.lower(name), F.lower(t)))
