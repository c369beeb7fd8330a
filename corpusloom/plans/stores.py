"""Registered queries of the stored forms: decided scans, index segments, impact blocks, page files."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import impacts, mail, models, names, retrieve, settings
from ..operators import index as ix
from ..operators.commits import Conflict
from ..operators.segments import SegmentedIndex
from ..operators.snapshots import SnapshotStore
from ..shared import new_folder
from ..sources import adapters as ad
from ..sources import extract, make_office, pages
from ..streaming.loop import Loop
from . import sql
from .catalogue import _scans, benchmark_queries, corpus_index, iso, query

_BOTH = "'body', 'title'"


@query(f"WITH {sql.TOKENS}, {sql.bm25(_BOTH)}, {sql.TOP} SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10")
def bm25_topk_blocks(spark, sf_dir):
    """BM25 over stored impact blocks: the rows of the plain search, from fewer blocks."""
    asked = benchmark_queries(spark, sf_dir)
    index = corpus_index(spark, sf_dir, asked)
    folder = new_folder(spark, "stats")
    index.stats.write.parquet(folder)  # read several times, tokenised once
    stats = spark.read.parquet(folder)
    made = impacts.build(ix.Index(index.postings, stats, ix.corpus_stats(stats), index.documents))
    stored = impacts.Impacts(impacts.write(made, new_folder(spark, "blocks")), made.index)
    return impacts.search(stored, asked, 10).select("query_id", "rank", "doc_id", "score")


@query(f"WITH {sql.TOKENS}, {sql.bm25(_BOTH)}, {sql.TOP} SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10")
def index_migrated(spark, sf_dir):
    """A snapshot of the first schema, with postings that can no longer be read, is moved aside and built again."""
    documents = ad.documents(spark, sf_dir)
    folder = new_folder(spark, "old")
    root = ix.write(ix.Index(ix.document_postings(documents.limit(1)), ix.doc_stats(documents.limit(1)), ix.corpus_stats(ix.doc_stats(documents.limit(1))), documents), folder, 1)
    spark.range(1).select(F.lit(1).alias("version")).write.mode("overwrite").parquet(f"{root}/committed")
    return retrieve.search(ix.opened(spark, root), benchmark_queries(spark, sf_dir), 10).select("query_id", "rank", "doc_id", "score")


#: The documents after the rounds below.
_NOW = sql.TOKENS.replace("FROM documents)", "FROM docs_now)")
_ROUNDS = f"""WITH docs_now AS (SELECT doc_id, source, n_chars, CASE WHEN doc_id % 4 <> 3 AND doc_id % 10 = 1 THEN text || ' again ' || text ELSE text END AS text
  FROM documents WHERE doc_id % 4 = 3 OR doc_id % 7 <> 2), {_NOW}"""


def _rounds(spark: SparkSession, sf_dir: str) -> SegmentedIndex:
    """Three quarters of the documents; a tenth of all comes or changes; a seventh goes; the last quarter comes."""
    store = SegmentedIndex(spark, new_folder(spark, "segments"))
    docs = ad.documents(spark, sf_dir)
    store.apply(docs.filter("doc_id % 4 <> 3"))
    store.apply(docs.filter("doc_id % 10 = 1").withColumn("text", F.concat("text", F.lit(" again "), "text")))
    store.apply(gone=docs.filter("doc_id % 7 = 2"))
    store.apply(docs.filter("doc_id % 4 = 3"))
    return store


def _found(store: SegmentedIndex, spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.search(store.index(), benchmark_queries(spark, sf_dir), 10).select("query_id", "rank", "doc_id", "score")


@query(f"{_ROUNDS}, {sql.bm25(_BOTH)}, {sql.TOP} SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10")
def index_segments(spark, sf_dir):
    """A search over the segments that rounds of upserts and deletions left."""
    return _found(_rounds(spark, sf_dir), spark, sf_dir)


@query(f"{_ROUNDS}, {sql.bm25(_BOTH)}, {sql.TOP} SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10")
def index_segments_compacted(spark, sf_dir):
    """The same after the segments were merged."""
    store = _rounds(spark, sf_dir)
    store.compact()
    return _found(store, spark, sf_dir)


@query(f"{_ROUNDS} SELECT doc_id, term, field, count(*) AS tf FROM toks GROUP BY ALL")
def index_segments_postings(spark, sf_dir):
    """All postings that count after the rounds."""
    return _rounds(spark, sf_dir).index().postings.select("doc_id", "term", "field", "tf")


@query(f"""WITH {sql.SNAPSHOTS} SELECT COALESCE(a.path_key, b.path_key) AS path_key, CASE WHEN a.path_key IS NULL THEN 'new' WHEN b.path_key IS NULL THEN 'removed' WHEN a.fingerprint = b.fingerprint THEN 'unchanged' ELSE 'changed' END AS change
FROM a FULL OUTER JOIN b ON a.path_key = b.path_key
UNION ALL VALUES ('scan 1', 'committed'), ('scan 2', 'committed'), ('scan 3', 'aborted'), ('scan 4', 'staging')""")
def scan_commits(spark, sf_dir):
    """Two writers stage the second scan and the first to commit wins; one scan is aborted, one left staged."""
    a, b = (x.select("path_key", "fingerprint") for x in _scans(spark, sf_dir))
    store = SnapshotStore(spark, new_folder(spark, "scans"))
    store.commit(1, a)
    late, early = store.stage(2, a), store.stage(2, b)
    store.commit(2, attempt=early)
    try:
        store.commit(2, attempt=late)
        raise AssertionError("two writers won")
    except Conflict:
        pass
    store.stage(3, a)
    store.abort(3, "not ready")
    store.stage(4, b)
    states = store.states().select(F.concat(F.lit("scan "), F.col("scan_id").cast("string")).alias("path_key"), F.col("state").alias("change"))
    return store.diff(1, 2).unionByName(states)


_PAGED = "name, full_path, parent_path, extension, kind, size, attributes, strftime(modified_at, '%Y-%m-%d %H:%M:%S') AS modified"


def _catalog_pages(spark: SparkSession, sf_dir: str, push: bool) -> DataFrame:
    folder = new_folder(spark, "pages")
    pages.export(ad.catalog(spark, sf_dir).drop("path_key"), folder, "full_path")
    return pages.read(spark, folder, "catalog", push)


@query(f"WITH {sql.CATALOG} SELECT {_PAGED} FROM catalog")
def catalog_source(spark, sf_dir):
    """The catalog read from its page files by the engine's own data source."""
    return _catalog_pages(spark, sf_dir, False).select("name", "full_path", "parent_path", "extension", "kind", "size", "attributes", iso("modified_at").alias("modified"))


@query(f"WITH {sql.CATALOG} SELECT {_PAGED} FROM catalog WHERE kind = 'file' AND extension IN ('md', 'txt') AND size > 200 AND starts_with(full_path, 'D:\\s') AND modified_at >= TIMESTAMP '2024-01-03'")
def catalog_source_filtered(spark, sf_dir):
    """The same with filters that the data source takes over."""
    rows = _catalog_pages(spark, sf_dir, True).filter((F.col("kind") == "file") & F.col("extension").isin("md", "txt") & (F.col("size") > 200) & F.startswith("full_path", F.lit("D:\\s")) & (F.col("modified_at") >= F.lit("2024-01-03").cast("timestamp")))
    return rows.select("name", "full_path", "parent_path", "extension", "kind", "size", "attributes", iso("modified_at").alias("modified"))


_TEXTS = "('txt', 'md', 'log', 'json')"


@query(f"""WITH {sql.FILES}, f AS (SELECT *, extension IN {_TEXTS} AND (doc_id % 9 <> 4 OR doc_id % 10 = 7) AS good FROM files WHERE doc_id % 10 <> 3 AND doc_id % 11 <> 5)
SELECT 'document' AS kind, path_key, CAST(length(text) AS VARCHAR) AS detail FROM f WHERE good
UNION ALL SELECT 'failure', path_key, CASE WHEN extension IN {_TEXTS} THEN 'UNSUPPORTED_ENCODING 1' WHEN extension = 'docx' THEN 'CORRUPT_DOCUMENT 1' WHEN extension = 'pdf' THEN 'OCR_REQUIRED 3' ELSE 'UNSUPPORTED_FILE_TYPE 1' END FROM f WHERE NOT good""")
def reconcile_stream(spark, sf_dir):
    """What the running stream leaves after two scans: all files come, some that cannot be read; then a tenth goes and a
    tenth comes in a new version, mended. Between them the stream stops, and goes on from its checkpoint."""
    texts = ad.read(spark, sf_dir, "documents").select("doc_id", "text")
    files = ad.files(spark, sf_dir).withColumns({"priority": F.lit(1), "fingerprint": F.lit("1"), "change": F.lit("new")})
    bytes_of = lambda bad: files.join(texts, "doc_id").filter("doc_id % 11 <> 5").select(F.col("full_path").alias("path"), F.when(bad, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("C328")))).otherwise(F.col("text").cast("binary")).alias("content"))
    bodies = {"now": bytes_of(F.col("doc_id") % 9 == 4)}
    loop = Loop(spark, new_folder(spark, "loop"), lambda leased: bodies["now"], delays=[0.0])
    loop.submit(files)
    running = loop.start(processingTime="2 seconds")
    try:
        loop.drained(running, files, 600)
    finally:
        loop.stop(running)
    changed = files.filter("doc_id % 10 in (3, 7)").withColumn("change", F.when(F.col("doc_id") % 10 == 3, "removed").otherwise("changed")).withColumn("fingerprint", F.lit("2"))
    bodies["now"] = bytes_of((F.col("doc_id") % 9 == 4) & (F.col("doc_id") % 10 != 7))
    loop.submit(changed)
    running = loop.start(processingTime="2 seconds")
    try:
        loop.drained(running, changed, 600)
    finally:
        loop.stop(running)
    found = loop.documents().select(F.lit("document").alias("kind"), "path_key", F.length("text").cast("string").alias("detail"))
    failed = loop.failures().select(F.lit("failure").alias("kind"), "path_key", F.concat_ws(" ", "error_code", "attempts").alias("detail"))
    waiting = loop.queue().select(F.lit("queue").alias("kind"), "path_key", F.lit("").alias("detail"))
    return found.unionByName(failed).unionByName(waiting)


#: Queries of the dialect and what each asks in SQL.
PATTERNS = {
    "*.md": "name LIKE '%.md'",
    "doc?.txt": "name LIKE 'doc_.txt'",
    "!*.md !folder: 1": "NOT name LIKE '%.md' AND kind <> 'folder' AND contains(lower(name), '1')",
    "size:>1kb !ext:md;txt": "size > 1024 AND extension NOT IN ('md', 'txt')",
    "size:1kb..2kb | size:<100b": "size BETWEEN 1024 AND 2048 OR size < 100",
    "dm:2024-01-03..2024-01-05": "modified_at >= TIMESTAMP '2024-01-03' AND modified_at <= TIMESTAMP '2024-01-05'",
    "<*c1*.md|doc2*.txt> !doc11*": "(name LIKE '%c1%.md' OR name LIKE 'doc2%.txt') AND NOT name LIKE 'doc11%'",
    '"c1" *7.docx': "contains(lower(name), 'c1') AND name LIKE '%7.docx'",
    "d:\\*\\docs\\*.log": "path_key LIKE 'd:\\%\\docs\\%.log'",
}
_PATTERNS_SQL = f"WITH {sql.CATALOG} " + " UNION ALL ".join(f"SELECT {k} AS pattern, full_path FROM catalog WHERE {where}" for k, where in enumerate(PATTERNS.values()))


def _patterns(catalog: DataFrame, grams: DataFrame | None) -> DataFrame:
    found = [names.search_raw(catalog, text, grams).select(F.lit(k).alias("pattern"), "full_path") for k, text in enumerate(PATTERNS)]
    return reduce(DataFrame.unionByName, found)


@query(_PATTERNS_SQL)
def raw_query_patterns(spark, sf_dir):
    """Patterns, negation, units and ranges of the catalog's dialect."""
    return _patterns(ad.catalog(spark, sf_dir), None)


@query(_PATTERNS_SQL)
def raw_query_grams(spark, sf_dir):
    """The same through the stored table of name grams."""
    catalog = ad.catalog(spark, sf_dir)
    return _patterns(catalog, names.write_grams(catalog, new_folder(spark, "grams")))


@query("""SELECT 'item' || item_id || '.txt' AS asset, CASE WHEN item_id % 7 <> 3 THEN CAST(octet_length(encode(text)) AS BIGINT) END AS bytes,
  CASE WHEN item_id % 7 = 3 THEN 'missing_assets' WHEN item_id % 5 = 1 THEN 'hash_mismatch' ELSE 'ready' END AS status FROM benchmark""")
def model_integrity(spark, sf_dir):
    """Files of a model against their manifest: some are not there, some are not what it says."""
    items = ad.read(spark, sf_dir, "benchmark").withColumn("asset", F.concat(F.lit("item"), F.col("item_id").cast("string"), F.lit(".txt")))
    root = new_folder(spark, "assets")

    def put(batches):
        files, where = pa.fs.FileSystem.from_uri(root)
        files.create_dir(where)
        for batch in batches:
            for asset, text in zip(batch["asset"], batch["text"], strict=True):
                with files.open_output_stream(f"{where}/{asset}") as out:
                    out.write(text.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    if not items.filter("item_id % 7 <> 3").select("asset", "text").mapInPandas(put, "n long").agg(F.sum("n")).first()[0]:
        raise ValueError("no assets")
    manifest = items.select("asset", F.sha2(F.when(F.col("item_id") % 5 == 1, "other").otherwise(F.col("text")), 256).alias("sha256"))
    return models.integrity(manifest, root)


def ranking_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, better_text, worse_text): two words of each benchmark text are asked; of the documents found, one that holds
    more of the text (its first five words in a row) was acted on, those above it were not."""
    asked = benchmark_queries(spark, sf_dir)
    found = retrieve.search(corpus_index(spark, sf_dir, asked), asked, 50, field=ix.BODY)
    five = ad.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split(F.lower("text"), r"\s+"), 1, 5), " ").alias("opening"))
    texts = ad.documents(spark, sf_dir).select("doc_id", "text")
    shown = retrieve.with_texts(found, texts, asked, 50).join(five, "query_id").select("query_id", F.col("doc_id").alias("cand_id"), (F.col("rank") - 1).alias("idx"), "text", F.contains(F.regexp_replace(F.lower("text"), r"\s+", " "), F.col("opening")).alias("acted"))
    folder = new_folder(spark, "shown")
    shown.write.parquet(folder)
    shown = spark.read.parquet(folder)
    pairs = models.preferences(shown.filter("acted"), shown)
    text_of = lambda c: shown.select("query_id", F.col("cand_id").alias(c), F.col("text").alias(f"{c}_text"))
    return pairs.join(text_of("better"), ["query_id", "better"]).join(text_of("worse"), ["query_id", "worse"]).join(asked, "query_id").select("query_id", "query", "better_text", "worse_text")


def fitted_scorer(spark: SparkSession, pairs: DataFrame):
    folder = new_folder(spark, "differences")
    models.differences(pairs).write.parquet(folder)
    return models.scorer(models.fit(spark.read.parquet(folder)))


def overlap_scorer():
    """The share of query words in the text: what a fitted scorer has to beat."""

    def share(queries, texts):
        for a, b in zip(queries, texts, strict=True):
            words = set(a.lower().split())
            yield len(words & set(b.lower().split())) / max(1, len(words))

    return lambda queries, texts: list(share(queries, texts))


@query()
def semantic_fitted(spark, sf_dir):
    """How many held-out preferences (every other query) each scorer puts in their order: the fitted one, and word overlap."""
    pairs = ranking_feedback(spark, sf_dir)
    learned = fitted_scorer(spark, pairs.filter("query_id % 2 = 0"))
    held = pairs.filter("query_id % 2 = 1")
    rows = [models.right_of(held, load).select(F.lit(name).alias("scorer"), "n", "right") for name, load in (("fitted", learned), ("overlap", overlap_scorer))]
    return rows[0].unionByName(rows[1])


@query(r"""WITH f AS (SELECT doc_id, ['docx', 'xlsx', 'pptx'][doc_id % 3 + 1] AS extension, CASE WHEN doc_id % 10 = 7 THEN 'CORRUPT_DOCUMENT' WHEN doc_id % 10 = 8 THEN 'UNSUPPORTED_OR_ENCRYPTED_DOCUMENT' END AS error_code,
  array_to_string(list_filter(string_split_regex(text, '\r\n|\r|\n'), lambda x: regexp_matches(x, '\S')), chr(10)) AS text FROM documents)
SELECT 'd' || doc_id || '.' || extension AS path, CASE WHEN error_code IS NULL THEN text END AS text, error_code FROM f""")
def office_files(spark, sf_dir):
    """Every document as a file of an office format, some damaged, some with a password, read back."""
    docs = ad.read(spark, sf_dir, "documents")
    how = F.when(F.col("doc_id") % 10 == 7, "damaged").when(F.col("doc_id") % 10 == 8, "locked")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("."), ad.pick(["docx", "xlsx", "pptx"], F.col("doc_id")))
    made = make_office.files(docs.select(path.alias("path"), tx.lines(F.col("text")).alias("lines"), how.alias("how")))
    return extract.extract(made).select("path", "text", "error_code")


@query(f"""WITH {sql.MESSAGES}, i AS (SELECT store_id, CASE WHEN CAST(entry_id AS INTEGER) % 7 = 3 THEN ' ' ELSE entry_id END AS entry_id, CASE WHEN CAST(store_id AS INTEGER) % 4 = 1 THEN 26 ELSE 43 END AS item_class, folder, ts FROM messages),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY ts DESC, store_id, entry_id) AS k FROM i) WHERE k <= 100 AND item_class = 43)
SELECT store_id, entry_id FROM (SELECT * FROM n WHERE entry_id <> ' ' ORDER BY ts DESC, store_id, entry_id LIMIT 100)
UNION ALL SELECT 'skipped', CAST(count(*) AS VARCHAR) FROM n WHERE entry_id = ' '""")
def mailbox_source(spark, sf_dir):
    """A mailbox read from its page files: items of another class, and mails without an identity, which are counted."""
    items = ad.messages(spark, sf_dir).withColumns({
        "item_class": F.when(F.col("store_id").cast("int") % 4 == 1, 26).otherwise(43), "entry_id": F.when(F.col("entry_id").cast("int") % 7 == 3, " ").otherwise(F.col("entry_id")),
        "recipients": F.lit(""), "attachment_names": F.lit(""),
    })
    folder = new_folder(spark, "mailbox")
    pages.export(items, folder, "ts")
    kept, skipped = mail.source(pages.read(spark, folder, "mailbox"))
    return kept.select("store_id", "entry_id").unionByName(skipped.select(F.lit("skipped").alias("store_id"), F.col("skipped").cast("string").alias("entry_id")))


#: Settings texts, by doc_id modulo 8.
_SETTINGS = [
    "'{\"Width\": ' || n_chars || ', \"Height\": ' || (n_chars - 200) || ', \"Maximized\": true}'", "'{\"Width\": \"wide\", \"Maximized\": true}'", "'{'",
    "'{\"Ranking\": {\"BehaviorEnabled\": false, \"LocalModelEnabled\": \"no\"}, \"BehaviorDisclosureAcknowledged\": true}'", "'[]'", "'{\"Maximized\": null}'",
    "'{\"Width\": 1e9, \"Height\": 700.5, \"Ranking\": [], \"Maximized\": true}'", "NULL",
]


@query("""WITH m AS (SELECT doc_id, n_chars, doc_id % 8 AS k FROM documents)
SELECT doc_id, CASE WHEN k = 0 AND n_chars >= 820 THEN CAST(least(n_chars, 10000) AS DOUBLE) WHEN k = 6 THEN 10000.0::DOUBLE ELSE 900.0::DOUBLE END AS width,
  CASE WHEN k = 0 AND n_chars - 200 >= 520 THEN CAST(least(n_chars - 200, 10000) AS DOUBLE) WHEN k = 6 THEN 700.5::DOUBLE ELSE 560.0::DOUBLE END AS height,
  k IN (0, 6) AS maximized, k <> 3 AS behavior_enabled, TRUE AS local_model_enabled, TRUE AS cloud_enabled, k = 3 AS behavior_disclosure FROM m""")
def json_settings_source(spark, sf_dir):
    """Settings of every user, as they wrote them."""
    texts = F.expr("CASE " + " ".join(f"WHEN doc_id % 8 = {k} THEN {text}" for k, text in enumerate(_SETTINGS)) + " END")
    return settings.read(ad.read(spark, sf_dir, "documents").select("doc_id", texts.alias("json"))).drop("json")


@query("SELECT doc_id, 'corpusloom-content-' || left(sha256(source || '/' || doc_id), 32) AS channel FROM documents")
def pipe_name_hash(spark, sf_dir):
    return ad.read(spark, sf_dir, "documents").select("doc_id", tx.channel_name(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), "corpusloom-content").alias("channel"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN '{"code":"' || CASE doc_id % 3 WHEN 1 THEN 'INVALID_ARGUMENTS' ELSE 'FILE_TOO_LARGE' END || '","message":"' || lang || '","correctiveAction":"none"}' END AS error,
  CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS exit_code FROM documents""")
def json_error_sink(spark, sf_dir):
    code = F.when(F.col("doc_id") % 3 == 1, "INVALID_ARGUMENTS").when(F.col("doc_id") % 3 == 2, "FILE_TOO_LARGE")
    docs = ad.read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.when(code.isNotNull(), settings.error_object(code, F.col("lang"), F.lit("none"))).alias("error"), settings.exit_code(code).alias("exit_code"))
