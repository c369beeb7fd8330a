"""The engine: what tools, command line and desktop call, over stored snapshots.

Each call takes a batch of queries and gives a DataFrame; errors are values (``error_code``), so one
bad query does not stop the others.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fuse, locate, mail, names, policy, queue, retrieve
from ..operators import index as ix

# Error codes of results.
QUERY_TOO_BROAD, INVALID_QUERY, CATALOG_OFFLINE, INDEX_OFFLINE = "QUERY_TOO_BROAD", "INVALID_QUERY", "CATALOG_OFFLINE", "INDEX_OFFLINE"


@dataclass
class Engine:
    """``catalog`` and ``index`` may be missing: then the other source answers alone."""

    spark: SparkSession
    catalog: DataFrame | None = None
    index: ix.Index | None = None
    messages: DataFrame | None = None
    failures: DataFrame | None = None
    queue: DataFrame | None = None

    def search_local_files(self, query: names.NameQuery) -> DataFrame:
        """File names; without a catalog, titles of the index."""
        if self.catalog is not None:
            return names.search(self.catalog, query)
        return self.search_local_content(self._one(query.text), query.limit, query.offset, field=ix.TITLE)

    def search_catalog_query(self, text: str, limit: int = 50, offset: int = 0, sort_by: str = "name", descending: bool = False) -> DataFrame:
        """A query in the catalog's own dialect."""
        if self.catalog is None:
            raise RuntimeError(CATALOG_OFFLINE)
        if not 1 <= limit <= names.MAX_LIMIT or offset < 0:
            raise ValueError(INVALID_QUERY)
        return self.catalog.filter(names.parse_raw(text)).orderBy(*names.order(sort_by, descending)).offset(offset).limit(limit)

    def search_local_content(self, queries: DataFrame, limit: int = 20, offset: int = 0, field: str | None = None, **filters) -> DataFrame:
        """Ranked documents with up to three line locations each; blank or too broad queries give an
        error row."""
        if not 1 <= limit <= names.MAX_LIMIT or offset < 0:
            raise ValueError(INVALID_QUERY)
        if self.index is None:
            raise RuntimeError(INDEX_OFFLINE)
        allowed = retrieve.filtered(self.index.documents, **filters) if filters else None
        alive = self.catalog.select("path_key") if self.catalog is not None else None
        found = retrieve.search(self.index, queries, limit, offset, field, allowed, alive)
        terms = queries.select("query_id", tx.query_terms(F.col("query")).alias("terms"))
        located = self.locations(found.join(terms, "query_id"), queries, limit, field)
        bad = terms.filter("terms is null").select("query_id", F.lit(QUERY_TOO_BROAD).alias("error_code"))
        return located.withColumn("error_code", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)

    def locations(self, found: DataFrame, queries: DataFrame, limit: int, field: str | None = None) -> DataFrame:
        """Where the hits alone hold their terms: texts are joined after the page is cut, and each kind of
        file is read in its own way (``locate.resolve``). A title hit is at line 1 without a snippet, a
        document whose raw text holds no term at line 1 with the fallback snippet."""
        columns = ["query_id", "rank", "doc_id", "name", "path_key", "score"]
        place = ["start_line", "end_line", "snippet", "heading_path", "json_path", "label"]
        if field == ix.TITLE:
            one = {"start_line": F.lit(1), "end_line": F.lit(1), "snippet": F.lit(""), **{c: F.lit(None).cast("string") for c in place[3:]}}
            return found.select(*columns).withColumns(one).withColumn("line", F.lit(1))
        texts = self.index.documents.select("doc_id", "text", "extension", *(c for c in ["blocks"] if c in self.index.documents.columns))
        rows = locate.locate(retrieve.with_texts(found, texts, queries, limit))
        hits = rows.select(*columns, "text", "terms", F.explode_outer("hits").alias("hit"))
        nowhere = F.col("hit").isNull()
        first = {"start_line": F.lit(1), "end_line": F.lit(1), "snippet": tx.snippet_fallback(F.col("text"), F.col("terms"))}
        out = hits.select(*columns, *(F.when(nowhere, first[c]).otherwise(F.col(f"hit.{c}")).alias(c) if c in first else F.col(f"hit.{c}").alias(c) for c in place))
        return out.withColumn("line", F.col("start_line"))

    def search_local_hybrid(self, queries: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
        """Names and content fused; a source that is missing leaves the answer to the other."""
        if self.catalog is None and self.index is None:
            raise RuntimeError(INDEX_OFFLINE)
        empty_names = self.spark.createDataFrame([], "query_id int, query string, path_key string, name string, rank int, noise int")
        empty_content = self.spark.createDataFrame([], "query_id int, query string, path_key string, name string, rank int, start_line int, title_matched boolean")
        by_name, by_content = empty_names, empty_content
        if self.catalog is not None:
            by_name = self._names(queries, fuse.name_limit(limit, offset))
        if self.index is not None:
            hits = self.search_local_content(queries, fuse.CONTENT_LIMIT).filter("error_code is null").join(queries, "query_id")
            place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "line")) - 1
            by_content = hits.select("query_id", "query", "path_key", "name", place.alias("rank"), F.col("line").alias("start_line"), retrieve.title_matched(tx.query_terms(F.col("query")), F.col("name")).alias("title_matched"))
        ranked = fuse.ordered(fuse.boosted(fuse.fuse(by_name, by_content)), limit, offset)
        return ranked.withColumn("tier", fuse.tier(F.col("query"), F.col("name"), F.col("match_source"), F.col("noise")))

    def _names(self, queries: DataFrame, limit: int) -> DataFrame:
        """Normal and soft names of each query by tier, match, length and name."""
        joined = names.containing(self.catalog.filter("kind = 'file'"), queries)
        level = policy.noise(F.col("query"), F.col("name"), F.col("path_key"), F.col("extension"), F.col("attributes"))
        order = Window.partitionBy("query_id").orderBy("noise", policy.name_match_rank(F.col("query"), F.col("name")), F.length("name"), F.lower("name"), "path_key")
        ranked = joined.withColumn("noise", level).filter("noise < 2").withColumn("rank", F.row_number().over(order) - 1)
        return ranked.filter(F.col("rank") < limit).select("query_id", "query", "path_key", "name", "rank", "noise")

    def search_hybrid_with_mail(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        """Collapsed files and mails in one list."""
        files = fuse.collapse(self.search_local_hybrid(queries, names.MAX_LIMIT)).select("query_id", F.col("path_key").alias("item"), F.col("baseline_index").alias("rank"))
        return fuse.merge_mail(files, self.search_mail(queries, limit).select("query_id", F.col("path_key").alias("item"), (F.col("rank") - 1).alias("rank")), limit)

    def search_content_mode(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        """Bodies of files, one row a file with how many places were found, merged with mails."""
        hits = self.search_local_content(queries, limit, field=ix.BODY).filter("error_code is null").join(queries, "query_id")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "start_line"))
        rows = hits.select("query_id", "path_key", "name", place.alias("position"), F.lit("content").alias("match_source"), F.lit(fuse.ELIGIBLE).alias("tier"), "score", "start_line")
        files = fuse.collapse(rows)
        told = files.select("query_id", F.col("path_key").alias("item"), F.col("baseline_index").alias("rank"))
        if self.messages is None:
            merged = fuse.merge_mail(told, told.limit(0), limit)
        else:
            merged = fuse.merge_mail(told, self.search_mail(queries, limit).select("query_id", F.col("path_key").alias("item"), (F.col("rank") - 1).alias("rank")), limit)
        facts = files.select("query_id", F.col("path_key").alias("item"), F.lit(0).alias("kind"), "hits", "label")
        return merged.join(facts, ["query_id", "item", "kind"], "left")

    def search_mail(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        return retrieve.search(mail.searchable(mail.deduped(self.messages), retrieve.wanted_terms(queries)), queries, limit, field=ix.BODY)

    def status(self) -> DataFrame:
        """(measure, n) of documents, queue and failures."""
        nothing = self.spark.createDataFrame([], "state string, error_code string")
        return queue.status_counts(self.index.documents, self.queue if self.queue is not None else nothing, self.failures if self.failures is not None else nothing)

    def failures_list(self, limit: int | None = None) -> DataFrame:
        """The newest failures, 200 of them unless a limit says otherwise."""
        return self.failures.orderBy(F.col("failed_at").desc(), "path_key").limit(limit or queue.LISTED)

    def retry_failures(self, paths: DataFrame | None, as_of) -> Engine:
        """The engine after failed paths (all, or those given) are queued afresh."""
        again, left = queue.retry_failures(self.queue, self.failures, paths, as_of)
        return replace(self, queue=again, failures=left)

    def _one(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(1, text)], "query_id int, query string")
