"""The registered queries of the engine's operators and their SQL.

Every query runs over its whole tables. ``_SQL`` holds DuckDB SQL with the same rows; queries
without an entry have no SQL form and are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as tx
from ..operators import behavior, fuse, locate, mail, names, policy, queue, rerank, retrieve
from ..operators import index as ix
from ..sources import adapters as ad
from ..streaming import state
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

AS_OF = "2024-02-10"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle is not None:
            _SQL[f.__name__] = oracle
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def iso(column: str) -> Column:
    """A timestamp as text, alike in both engines."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# Catalog and crawl policy


@query(f"WITH {sql.CATALOG} SELECT name, full_path, parent_path, extension, kind, size, attributes, strftime(modified_at, '%Y-%m-%d %H:%M:%S') AS modified FROM catalog")
def catalog_query(spark, sf_dir):
    return ad.catalog(spark, sf_dir).select("name", "full_path", "parent_path", "extension", "kind", "size", "attributes", iso("modified_at").alias("modified"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'folder' ELSE 'file' END AS kind, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END AS size, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * doc_id, '%Y-%m-%d %H:%M:%S') END AS modified FROM documents")
def catalog_decode(spark, sf_dir):
    ticks = F.lit(116444736000000000) + (F.lit(1704067200) + F.col("doc_id") * 3600) * 10_000_000
    rows = ad.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), (F.col("doc_id") % 5 == 0).alias("is_folder"), F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("n_chars")).alias("size"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(ticks).alias("filetime"))
    return names.decode(rows).select(F.col("name").cast("long").alias("doc_id"), "kind", "size", iso("modified_at").alias("modified"))


@query(f"WITH {sql.CATALOG} SELECT full_path, COALESCE(size, 0) AS size, strftime(COALESCE(modified_at, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS modified FROM catalog")
def catalog_scan_paged(spark, sf_dir):
    rows = ad.catalog(spark, sf_dir).withColumns({"size": F.coalesce("size", F.lit(0)), "modified_at": F.coalesce("modified_at", F.timestamp_seconds(F.lit(0)))})
    return rows.select("full_path", "size", iso("modified_at").alias("modified"))


@query(f"WITH {sql.CATALOG} SELECT full_path FROM catalog WHERE lower(name) IN {sql.listed(policy.REPOSITORY_MARKERS + policy.EXCLUDED_DIRECTORIES)}")
def scan_markers(spark, sf_dir):
    return policy.scan_markers(ad.catalog(spark, sf_dir)).select("full_path")


@query(f"WITH {sql.CATALOG} SELECT full_path, strftime(modified_at, '%Y-%m-%d %H:%M:%S') AS modified FROM catalog WHERE kind = 'file' AND extension IN ('txt', 'md', 'markdown', 'docx')")
def scan_candidates(spark, sf_dir):
    found = ad.catalog(spark, sf_dir).filter((F.col("kind") == "file") & F.col("extension").isin(*(e[1:] for e in policy.FORMAT_LIMITS)))
    return found.orderBy(F.col("modified_at").desc(), "path_key").select("full_path", iso("modified_at").alias("modified"))


@query("SELECT DISTINCT chr(65 + CAST(doc_id % 26 AS INTEGER)) || ':\\' AS root_path FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 26 % 3 <> 1 AND doc_id % 26 % 4 <> 2")
def eligible_drives(spark, sf_dir):
    """Every document tells of a drive, in capitals or not: which are ready, fixed and keep a journal."""
    letter = F.col("doc_id") % 26
    root = F.concat(F.char(F.lit(65) + letter), F.lit(":\\"))
    drives = ad.read(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 2 == 0, root).otherwise(F.lower(root)).alias("root_path"), (F.col("doc_id") % 5 != 0).alias("is_ready"),
        ad.pick(["Fixed", "Removable", "fixed"], letter).alias("drive_type"), ad.pick(["NTFS", "ReFS", "FAT32", "ntfs"], letter).alias("drive_format"),
    )
    return policy.eligible_drives(drives).select(F.upper("root_path").alias("root_path"))


@query(f"WITH {sql.CATALOG}, {sql.EXCLUSIONS} SELECT prefix FROM exclusions")
def dynamic_exclusions(spark, sf_dir):
    return policy.dynamic_exclusions(policy.scan_markers(ad.catalog(spark, sf_dir)))


@query(sql.POLICY)
def policy_evaluate(spark, sf_dir):
    exclusions = policy.dynamic_exclusions(policy.scan_markers(ad.catalog(spark, sf_dir)))
    return policy.evaluate(ad.files(spark, sf_dir), exclusions, stamp(AS_OF))


@query(f"WITH {sql.CATALOG}, {sql.EXCLUSIONS} SELECT DISTINCT f.doc_id FROM files f JOIN exclusions e ON f.path_key = e.prefix OR starts_with(f.path_key, e.prefix || '\\')")
def prefix_subtree_match(spark, sf_dir):
    exclusions = policy.dynamic_exclusions(policy.scan_markers(ad.catalog(spark, sf_dir)))
    above = ad.files(spark, sf_dir).select("doc_id", F.explode(paths.ancestors(F.col("path_key"))).alias("prefix"))
    return above.join(exclusions, "prefix", "left_semi").select("doc_id").distinct()


@query(f"WITH {sql.CATALOG} SELECT doc_id, list_has_any(string_split(lower(parent_path), '\\')[2:], {sql.array(policy.EXCLUDED_DIRECTORIES)}) AS excluded FROM files")
def excluded_segment(spark, sf_dir):
    return ad.files(spark, sf_dir).select("doc_id", policy._any_of(paths.directories(F.col("path_key")), policy.EXCLUDED_DIRECTORIES).alias("excluded"))


@query(f"WITH {sql.CATALOG} SELECT doc_id, {sql.PRIORITY} AS priority FROM files")
def crawl_priority(spark, sf_dir):
    return ad.files(spark, sf_dir).select("doc_id", policy.crawl_priority(F.col("path_key"), F.col("modified_at"), stamp(AS_OF)).alias("priority"))


@query(f"WITH {sql.CATALOG} SELECT doc_id, upper(sha256(upper(full_path) || '|' || size || '|' || (epoch_us(modified_at) * 10 + 621355968000000000) || '|1')) AS fingerprint FROM files")
def fingerprint(spark, sf_dir):
    return ad.files(spark, sf_dir).select("doc_id", policy.fingerprint(F.col("full_path"), F.col("size"), F.col("modified_at")).alias("fingerprint"))


# Names


@query(f"WITH {sql.CATALOG} SELECT full_path, {sql.noise('doc1')} AS noise FROM catalog")
def noise_classify(spark, sf_dir):
    return ad.catalog(spark, sf_dir).select("full_path", policy.noise(F.lit("doc1"), F.col("name"), F.col("path_key"), F.col("extension"), F.col("attributes")).alias("noise"))


@query(f"WITH {sql.CATALOG} SELECT full_path, CASE WHEN path_key = 'd:\\src6' OR starts_with(path_key, 'd:\\src6\\') THEN TRUE ELSE FALSE END AS is_system FROM catalog")
def system_path(spark, sf_dir):
    return ad.catalog(spark, sf_dir).select("full_path", paths.within_any(F.col("path_key"), policy.SYSTEM_ROOTS).alias("is_system"))


@query(f"WITH {sql.CATALOG} SELECT full_path, CASE WHEN lower(name) = 'doc1' THEN 0 WHEN starts_with(lower(name), 'doc1') THEN 1 WHEN contains(lower(name), 'doc1') THEN 2 ELSE 3 END AS match_rank FROM catalog")
def name_match_rank(spark, sf_dir):
    return ad.catalog(spark, sf_dir).select("full_path", policy.name_match_rank(F.lit(" doc1 "), F.col("name")).alias("match_rank"))


@query(f"WITH {sql.CATALOG} SELECT full_path FROM catalog WHERE lower(name) = 'doc8.txt'")
def exact_query(spark, sf_dir):
    return ad.catalog(spark, sf_dir).filter(policy.exact_query(F.lit('"DOC8.txt"'), F.col("name"), F.col("path_key"))).select("full_path")


@query(f"WITH {sql.CATALOG} SELECT full_path, list_filter(string_split(path_key[3:], '\\'), lambda p: p <> '') AS components, CASE WHEN extension = '' THEN lower(regexp_extract(name, '(\\.[^.]*)$', 1)) ELSE '.' || extension END AS dotted FROM catalog")
def path_components(spark, sf_dir):
    return names.name_components(ad.catalog(spark, sf_dir))


@query(f"WITH {sql.CATALOG} SELECT full_path FROM catalog WHERE contains(lower(name), 'doc') AND starts_with(path_key, 'd:\\src3\\') AND extension IN ('md', 'pdf') AND kind = 'file' AND modified_at >= TIMESTAMP '2024-01-02' AND modified_at <= TIMESTAMP '2024-03-01'")
def name_query_filters(spark, sf_dir):
    found = names.NameQuery("doc", path="D:\\src3", extensions=[".MD", "pdf"], kind="file", modified_after="2024-01-02", modified_before="2024-03-01")
    return ad.catalog(spark, sf_dir).filter(names.predicate(found)).select("full_path")


def _name_sort(sort_by: str, descending: bool) -> None:
    key = {"name": "lower(name)", "path": "path_key", "size": "size", "modified": "modified_at"}[sort_by]
    order = f"{key} {'DESC NULLS LAST' if descending else 'ASC NULLS FIRST'}, path_key"
    oracle = f"WITH {sql.CATALOG} SELECT full_path, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS position FROM (SELECT * FROM catalog WHERE contains(lower(name), 'doc') ORDER BY {order} LIMIT 50)"

    def run(spark, sf_dir):
        page = names.search(ad.catalog(spark, sf_dir), names.NameQuery("doc", sort_by=sort_by, descending=descending))
        return page.select("full_path", F.row_number().over(Window.orderBy(*names.order(sort_by, descending))).alias("position"))

    run.__name__ = f"name_sort_{sort_by}" + "_descending" * descending
    query(oracle)(run)


for _by in ("name", "path", "size", "modified"):
    for _down in (False, True):
        _name_sort(_by, _down)


@query(f"WITH {sql.CATALOG} SELECT full_path FROM catalog WHERE (extension IN ('md') OR extension IN ('txt')) AND kind = 'file' AND contains(lower(name), '1') AND size > 1000 AND modified_at >= TIMESTAMP '2024-01-01'")
def raw_query(spark, sf_dir):
    return ad.catalog(spark, sf_dir).filter(names.parse_raw('<ext:md|ext:txt> file: "1" size:>1000 dm:>=2024-01-01')).select("full_path")


@query(f"WITH {sql.CATALOG} SELECT full_path FROM catalog WHERE modified_at >= TIMESTAMP '2024-02-05' AND modified_at < TIMESTAMP '2024-02-12' OR modified_at < TIMESTAMP '2024-01-01' OR size < 100 AND modified_at >= TIMESTAMP '2024-02-09' AND modified_at < TIMESTAMP '2024-02-10' OR size > 1000 AND modified_at >= TIMESTAMP '2024-01-01' AND modified_at < TIMESTAMP '2024-02-01'")
def raw_query_relative_dates(spark, sf_dir):
    return ad.catalog(spark, sf_dir).filter(names.parse_raw("dm:thisweek | dm:<lastmonth | size:<100 dm:yesterday | dm:lastmonth size:>1000", stamp(AS_OF))).select("full_path")


@query(f"WITH {sql.CATALOG} SELECT b.item_id AS query_id, f.doc_id FROM benchmark b JOIN files f ON contains(lower(f.name), 'c' || (b.item_id % 97) || '.') OR contains(lower(f.name), 'doc' || b.item_id)")
def names_of_a_batch(spark, sf_dir):
    """More queries than are scanned: names are found by their rarest gram."""
    items = ad.read(spark, sf_dir, "benchmark")
    asked = items.select(F.col("item_id").alias("query_id"), F.explode(F.array(F.concat(F.lit("C"), (F.col("item_id") % 97).cast("string"), F.lit(".")), F.concat(F.lit(" doc"), F.col("item_id").cast("string")))).alias("query"))
    keyed = asked.withColumnRenamed("query_id", "item").withColumn("query_id", F.xxhash64("item", "query"))
    return names.containing(ad.files(spark, sf_dir), keyed, names.SCANNED + 1).select(F.col("item").alias("query_id"), "doc_id").distinct()


@query(sql.NOISE_AWARE)
def noise_aware_search(spark, sf_dir):
    return names.noise_aware(ad.catalog(spark, sf_dir), "doc1", 50)


@query(f"""WITH {sql.CATALOG}, n AS ({sql.NOISE_AWARE})
SELECT CAST(n.position - 1 AS INTEGER) AS baseline_index, n.full_path, c.kind, CASE WHEN c.kind <> 'folder' THEN c.size END AS size, CASE WHEN lower(c.name) = 'doc1' THEN 0 WHEN n.noise = 1 THEN 2 ELSE 1 END AS tier FROM n JOIN catalog c USING (full_path)""")
def projection_to_item(spark, sf_dir):
    """A page of names as items: place, tier, and no size for folders."""
    return names.items(ad.catalog(spark, sf_dir), "doc1", 50).select("baseline_index", "full_path", "kind", "size", "tier")


@query(f"WITH {sql.CATALOG} SELECT full_path, CAST(row_number() OVER (ORDER BY path_key) - 1 AS INTEGER) AS baseline_index FROM (SELECT * FROM catalog WHERE contains(lower(name), 'doc1') ORDER BY path_key LIMIT 20 OFFSET 10)")
def offset_limit(spark, sf_dir):
    page = names.search(ad.catalog(spark, sf_dir), names.NameQuery("doc1", sort_by="path", limit=20, offset=10))
    return page.select("full_path", (F.row_number().over(Window.orderBy("path_key")) - 1).alias("baseline_index"))


@query("""SELECT '{"doc_id":' || doc_id || ',"lang":"' || lang || '","nChars":' || n_chars || '}' AS json FROM documents""")
def json_result_sink(spark, sf_dir):
    return ad.read(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "lang", F.col("n_chars").alias("nChars"))).alias("json"))


# Text


@query("SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{Mn}\\p{Mc}_.+#-]+'), lambda t: regexp_replace(t, '^[._-]+|[._-]+$', '', 'g')), lambda t: regexp_matches(t, '[\\p{L}\\p{Nd}]')) AS tokens FROM documents")
def tokenize_app_ascii(spark, sf_dir):
    return ad.read(spark, sf_dir, "documents").select("doc_id", tx.tokenize_app(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, regexp_extract_all({sql.fold('lower(text)')}, '[\\p{{L}}\\p{{N}}]+') AS tokens FROM documents")
def tokenize_fts(spark, sf_dir):
    return ad.read(spark, sf_dir, "documents").select("doc_id", tx.tokenize_fts(F.col("text")).alias("tokens"))


#: Letters and the characters that stand for them in a corpus of CJK text.
_LATIN, _HAN = "abcdefghijklmnopqrstuvwxyz", "一丁七万丈三上下不与丐丑专且世丘丙业丛东丝丢两严丧中"


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(lower(text), '{_LATIN}', '{_HAN}'), '[一-龥]+|[0-9À-ɏ_.+#-]+') AS runs FROM documents)
SELECT doc_id, flatten(list_transform(runs, lambda r: CASE WHEN NOT regexp_matches(r, '^[一-龥]') THEN list_filter([regexp_replace(r, '^[._-]+|[._-]+$', '', 'g')], lambda t: regexp_matches(t, '[\\p{{L}}\\p{{Nd}}]'))
  WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)) AS tokens FROM d""")
def cjk_bigrams(spark, sf_dir):
    """Whole texts with CJK characters for their plain letters: pairs of those, and what stands between them."""
    return ad.read(spark, sf_dir, "documents").select("doc_id", tx.tokenize_mixed(F.translate(F.lower("text"), _LATIN, _HAN)).alias("tokens"))


@query("""WITH w AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{Mn}\\p{Mc}_.+#-]+'), lambda t: regexp_replace(t, '^[._-]+|[._-]+$', '', 'g')), lambda t: regexp_matches(t, '[\\p{L}\\p{Nd}]')) AS w FROM benchmark),
t AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS terms FROM w)
SELECT item_id, CASE WHEN item_id % 5 > 0 THEN terms END AS terms, CASE WHEN item_id % 5 > 0 THEN array_to_string(list_transform(terms, lambda x: '"' || x || '"'), ' AND ') END AS expression FROM t""")
def query_terms(spark, sf_dir):
    """Every benchmark text as a query; a fifth of them blank or of one character, which ask for nothing."""
    terms = tx.query_terms(F.col("q"))
    asked = ad.read(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 10 == 0, "  ").when(F.col("item_id") % 10 == 5, " 人").otherwise(F.col("text")).alias("q"))
    return asked.select("item_id", terms.alias("terms"), tx.match_expression(terms).alias("expression"))


@query("SELECT doc_id, CAST(len(string_split_regex(text, '\\r\\n|\\r|\\n')) AS INTEGER) AS n_lines FROM documents")
def split_lines(spark, sf_dir):
    return ad.read(spark, sf_dir, "documents").select("doc_id", F.size(tx.lines(F.col("text"))).alias("n_lines"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
def contains_ci(spark, sf_dir):
    return ad.read(spark, sf_dir, "documents").filter(F.contains(F.lower("text"), F.lower(F.lit("THE")))).select("doc_id")


@query("WITH p AS (SELECT doc_id, text, least(CASE WHEN strpos(lower(text), 'the') > 0 THEN strpos(lower(text), 'the') END, CASE WHEN strpos(lower(text), 'der') > 0 THEN strpos(lower(text), 'der') END) AS spot FROM documents) SELECT doc_id, trim(substr(text, greatest(COALESCE(spot, 1) - 81, 0) + 1, 240), ' ') AS snippet FROM p")
def snippet_fallback(spark, sf_dir):
    return ad.read(spark, sf_dir, "documents").select("doc_id", tx.snippet_fallback(F.col("text"), F.array(F.lit("the"), F.lit("der"))).alias("snippet"))


@query(sql.SNIPPET_MAIL)
def snippet_mail(spark, sf_dir):
    return ad.read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.snippet_mail(F.col("text"), F.lit("the")).alias("snippet"))


@query("SELECT doc_id, left(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), 200) AS snippet FROM documents")
def snippet_200(spark, sf_dir):
    return ad.read(spark, sf_dir, "documents").select("doc_id", tx.snippet_200(F.col("text")).alias("snippet"))


@query("SELECT doc_id, left(text, 1000) AS text, length(text) > 1000 AS truncated FROM documents")
def truncate_chars(spark, sf_dir):
    return ad.read(spark, sf_dir, "documents").select("doc_id", tx.truncate_chars(F.col("text"), 1000).alias("t")).select("doc_id", "t.*")


@query("SELECT doc_id, left(text, 500) AS message, left(text, 300) AS mail_message FROM documents")
def truncate_message(spark, sf_dir):
    return ad.read(spark, sf_dir, "documents").select("doc_id", tx.truncate_message(F.col("text")).alias("message"), tx.truncate_message(F.col("text"), 300).alias("mail_message"))


#: Queries that users might type, made of each document's facts, by doc_id modulo 9.
_TYPED = [
    "'doc' || doc_id || '.txt'", "'\"' || lang || ' ' || source || '\"'", "'C:' || chr(92) || source", "source || '/' || lang", "'.' || lang", "lang", "'where is ' || source",
    "lang || ' ' || source || ' x ' || doc_id", "source || '?'",
]
_TYPED_QUERY = "CASE " + " ".join(f"WHEN doc_id % {len(_TYPED)} = {k} THEN {q}" for k, q in enumerate(_TYPED)) + " END"


@query(f"""WITH t AS (SELECT doc_id, {_TYPED_QUERY} AS q FROM documents)
SELECT doc_id, q, starts_with(q, '"') AND ends_with(q, '"') OR regexp_matches(q, '^[A-Za-z]:|[\\\\/]') OR length(q) > 1 AND regexp_matches(q, '\\.[^.]+$|^\\.') AS explicit,
  contains(q, '?') OR len(string_split(q, ' ')) >= 4 OR contains(q, 'where is') AS natural_language FROM t""")
def query_shape(spark, sf_dir):
    typed = ad.read(spark, sf_dir, "documents").select("doc_id", F.expr(_TYPED_QUERY.replace("chr(92)", "char(92)")).alias("q"))
    return typed.select("doc_id", "q", tx.explicit_file_query(F.col("q")).alias("explicit"), tx.natural_language_query(F.col("q")).alias("natural_language"))


@query("SELECT conv_id, turn, 'outlook://mail/' || left(sha256(conv_id || chr(10) || turn), 24) AS path FROM conversations")
def mail_identity_path(spark, sf_dir):
    return ad.read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.mail_identity_path(F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"))


@query("SELECT doc_id, CASE WHEN doc_id = 0 THEN 3 ELSE doc_id + 1 END AS mapped FROM documents")
def sp_id_map(spark, sf_dir):
    return ad.read(spark, sf_dir, "documents").select("doc_id", tx.sentence_piece_id(F.col("doc_id")).alias("mapped"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_values(spark, sf_dir):
    return ad.read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query()
def normalize_nfkc(spark, sf_dir):
    return ad.read(spark, sf_dir, "documents").select("doc_id", tx.normalize_nfkc(F.col("text")).alias("text"))


@query()
def hmac_key(spark, sf_dir):
    return ad.files(spark, sf_dir).select("doc_id", F.hex(tx.hmac_key(b"salt", "file", F.col("full_path"))).alias("file_key"))


@query("SELECT doc_id, CASE WHEN ext IN ('txt', 'md', 'log', 'json') THEN 'text' WHEN ext IN ('docx', 'pdf') THEN ext ELSE 'UNSUPPORTED_FILE_TYPE' END AS route FROM (SELECT doc_id, ['txt', 'md', 'docx', 'pdf', 'tmp', 'log', 'dll', 'json'][doc_id % 8 + 1] AS ext FROM documents)")
def extract_route(spark, sf_dir):
    from ..sources import extract

    rows = ad.files(spark, sf_dir).select(F.col("doc_id"), F.col("full_path").alias("path"), F.col("size").alias("length"))
    return rows.join(extract.routed(rows, 10 * 1024 * 1024), "path").select("doc_id", "route")


@query("SELECT doc_id, text, CAST(length(text) AS BIGINT) AS characters, CAST(NULL AS VARCHAR) AS error_code FROM documents")
def extract_text(spark, sf_dir):
    """Every text encoded, then read back as a file would be."""
    from ..sources import extract

    rows = ad.read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    return extract.extract(rows).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), "text", "characters", "error_code")


# Index and retrieval


def benchmark_queries(spark: SparkSession, sf_dir: str, joint: str = " ") -> DataFrame:
    """A batch of two-word queries: the first words of each benchmark text."""
    terms = F.slice(tx.tokenize_fts(F.col("text")), 1, 2)
    return ad.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(terms, joint).alias("query"))


def corpus_index(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> ix.Index:
    """The index of all documents, or the part of it that a batch of queries reads."""
    return ix.build(ad.documents(spark, sf_dir), terms=None if asked is None else retrieve.wanted_terms(asked))


@query(f"WITH {sql.TOKENS} SELECT doc_id, field, term, count(*) AS tf, list_sort(list(CAST(pos AS INTEGER))) AS positions FROM toks GROUP BY ALL")
def index_postings(spark, sf_dir):
    return ix.document_postings(ad.documents(spark, sf_dir)).select("doc_id", "field", "term", "tf", "positions")


@query(f"WITH {sql.TOKENS} SELECT doc_id, CAST(title_len AS BIGINT) AS title_len, CAST(body_len AS BIGINT) AS body_len FROM stats")
def doc_stats(spark, sf_dir):
    return ix.doc_stats(ad.documents(spark, sf_dir))


@query(f"WITH {sql.TOKENS} SELECT n_docs, round(avgdl, 6) AS avgdl FROM corpus")
def corpus_stats(spark, sf_dir):
    return ix.corpus_stats(ix.doc_stats(ad.documents(spark, sf_dir))).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS size, lang FROM documents")
def index_upsert(spark, sf_dir):
    """Every document twice, the older version with another text: the newer one wins."""
    docs = ad.read(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.col("doc_id").cast("string").alias("path_key"))
    both = docs.withColumn("indexed_at", F.lit(2)).unionByName(docs.withColumn("text", F.lit("old")).withColumn("indexed_at", F.lit(1)))
    return ix.latest(both).select("doc_id", F.length("text").cast("long").alias("size"), "lang")


@query(f"WITH {sql.TOKENS}, m AS (SELECT query_id, doc_id, n_terms, count(DISTINCT qt.term) AS n FROM qt JOIN toks ON qt.term = toks.term GROUP BY ALL) SELECT query_id, doc_id FROM m WHERE n = n_terms")
def fts_match_and(spark, sf_dir):
    return retrieve.matching(corpus_index(spark, sf_dir, benchmark_queries(spark, sf_dir)), benchmark_queries(spark, sf_dir))


def title_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of title queries: the name that each benchmark item would have as a document."""
    return ad.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("Doc"), F.col("item_id").cast("string")).alias("query"))


@query(f"WITH {sql.TOKENS} SELECT b.item_id AS query_id, t.doc_id FROM benchmark b JOIN toks t ON t.field = 'title' AND t.term = 'doc' || b.item_id")
def fts_match_title(spark, sf_dir):
    asked = title_queries(spark, sf_dir)
    return retrieve.matching(corpus_index(spark, sf_dir, asked), asked, ix.TITLE)


_HAN_PAIRS = "list_distinct(flatten(list_transform(regexp_extract_all({0}, '[一-龥]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)))"


@query(f"""WITH d AS (SELECT doc_id, {_HAN_PAIRS.format(f"translate(lower(text), '{_LATIN}', '{_HAN}')")} AS pairs FROM documents),
q AS (SELECT item_id AS query_id, translate(regexp_extract(lower(text), '[a-z][a-z]+'), '{_LATIN}', '{_HAN}') AS query FROM benchmark),
w AS (SELECT query_id, {_HAN_PAIRS.format('query')} AS pairs FROM q WHERE length(query) > 1)
SELECT query_id, doc_id FROM w JOIN d ON list_has_all(d.pairs, w.pairs)""")
def fts_match_cjk(spark, sf_dir):
    """Words of CJK characters against texts of them, by overlapping pairs."""
    han = lambda text: F.translate(F.lower(text), _LATIN, _HAN)
    texts = ad.read(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("name"), F.col("doc_id").cast("string").alias("path_key"), han(F.col("text")).alias("text"))
    asked = ad.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), han(F.regexp_extract(F.lower("text"), "[a-z][a-z]+", 0)).alias("query"))
    return retrieve.matching(ix.build(texts, retrieve.wanted_terms(asked)), asked)


@query(f"WITH {sql.TOKENS}, p AS (SELECT item_id AS query_id, regexp_extract_all({sql.fold('lower(text)')}, {sql.WORD})[1:2] AS w FROM benchmark) SELECT DISTINCT query_id, a.doc_id FROM p JOIN toks a ON a.term = w[1] JOIN toks b ON b.term = w[2] AND b.doc_id = a.doc_id AND b.field = a.field AND b.pos = a.pos + 1")
def fts_phrase(spark, sf_dir):
    return retrieve.matching(corpus_index(spark, sf_dir, benchmark_queries(spark, sf_dir, "-")), benchmark_queries(spark, sf_dir, "-"))


@query(f"WITH {sql.TOKENS}, {sql.bm25(chr(39) + 'body' + chr(39))}, {sql.TOP} SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return retrieve.search(corpus_index(spark, sf_dir, benchmark_queries(spark, sf_dir)), benchmark_queries(spark, sf_dir), 10, field=ix.BODY).select("query_id", "rank", "doc_id", "score")


@query(f"WITH {sql.TOKENS}, {sql.bm25(chr(39) + 'body' + chr(39) + ', ' + chr(39) + 'title' + chr(39))}, {sql.TOP} SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10")
def bm25_two_field(spark, sf_dir):
    return retrieve.search(corpus_index(spark, sf_dir, benchmark_queries(spark, sf_dir)), benchmark_queries(spark, sf_dir), 10).select("query_id", "rank", "doc_id", "score")


@query(f"WITH {sql.TOKENS}, {sql.bm25(chr(39) + 'body' + chr(39))}, {sql.TOP} SELECT query_id, rank, doc_id FROM ranked WHERE rank > 5 AND rank <= 15")
def fts_order_page(spark, sf_dir):
    return retrieve.search(corpus_index(spark, sf_dir, benchmark_queries(spark, sf_dir)), benchmark_queries(spark, sf_dir), 10, 5, field=ix.BODY).select("query_id", "rank", "doc_id")


@query(f"WITH {sql.TOKENS}, {sql.bm25(chr(39) + 'body' + chr(39))} SELECT query_id, count(*) AS n FROM scored GROUP BY query_id")
def fts_count(spark, sf_dir):
    found = retrieve.matching(corpus_index(spark, sf_dir, benchmark_queries(spark, sf_dir)), benchmark_queries(spark, sf_dir), ix.BODY)
    return found.groupBy("query_id").agg(F.count("*").alias("n"))


@query(f"WITH {sql.FILES} SELECT doc_id FROM files WHERE starts_with(path_key, 'd:\\src3\\') AND extension IN ('pdf', 'json') AND modified_at >= TIMESTAMP '2024-01-02' AND modified_at <= TIMESTAMP '2024-02-05'")
def filters_path_ext_date(spark, sf_dir):
    return retrieve.filtered(ad.files(spark, sf_dir), "D:\\src3", [".pdf", "json"], stamp("2024-01-02"), stamp("2024-02-05")).select("doc_id")


@query(f"WITH {sql.TOKENS}, {sql.bm25(chr(39) + 'body' + chr(39))}, {sql.TOP} SELECT query_id, rank, doc_id FROM ranked WHERE rank <= 10 AND doc_id % 3 <> 0")
def liveness_anti_join(spark, sf_dir):
    alive = ad.documents(spark, sf_dir).filter("doc_id % 3 <> 0")
    return retrieve.search(corpus_index(spark, sf_dir, benchmark_queries(spark, sf_dir)), benchmark_queries(spark, sf_dir), 10, field=ix.BODY, alive=alive).select("query_id", "rank", "doc_id")


@query(f"WITH {sql.FILES} SELECT doc_id, contains(lower(name), 'doc1') OR contains(lower(name), '.md') AS title_matched FROM files")
def title_matched(spark, sf_dir):
    return ad.documents(spark, sf_dir).select("doc_id", retrieve.title_matched(F.array(F.lit("doc1"), F.lit(".MD")), F.col("name")).alias("title_matched"))


# Locations


@query(sql.LOCATE)
def locate_lines(spark, sf_dir):
    return locate.locate_lines(ad.documents(spark, sf_dir), F.array(F.lit("the"), F.lit("der ")))


@query(sql.WINDOW)
def locate_compact_window(spark, sf_dir):
    return locate.compact_window(ad.documents(spark, sf_dir), ["and", "with"])


@query(sql.HEADINGS)
def heading_paths(spark, sf_dir):
    return locate.heading_paths(ad.markdown(spark, sf_dir))


@query("SELECT event_id AS doc_id, 1 AS line, '$.k' AS json_path FROM events WHERE props IS NOT NULL")
def locate_json(spark, sf_dir):
    docs = ad.read(spark, sf_dir, "events").filter("props is not null").select(F.col("event_id").alias("doc_id"), F.col("props").alias("text"))
    return locate.locate_json(docs, ["k"]).select("doc_id", "line", "json_path")


@query("SELECT doc_id, 2 AS line, '$.doc.tags[0]' AS json_path FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 3, '$.doc.tags[1].source' FROM documents")
def locate_json_nested(spark, sf_dir):
    """Nested JSON of several lines: a value within a list, and the name of a property within it."""
    docs = ad.read(spark, sf_dir, "documents")
    text = F.concat(F.lit('{"doc": {"id": '), F.col("doc_id").cast("string"), F.lit(',\n"tags": ["'), "lang", F.lit('",\n{"source": "'), "source", F.lit('"}]}}'))
    return locate.locate_json(docs.select("doc_id", text.alias("text")), ["en", "source"]).select("doc_id", "line", "json_path")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ad.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("i", "text"))
    return lines.select("doc_id", (F.col("i") + 1).alias("ordinal"), "text", F.concat(F.lit("第 "), (F.col("i") + 1).cast("string"), F.lit(" 段")).alias("label"), F.lit(None).cast("string").alias("heading_path"))


@query(sql.WINDOW.replace("SELECT doc_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM s WHERE k = 1", """, w AS (SELECT doc_id, end_line AS ordinal FROM s WHERE k = 1),
o AS (SELECT doc_id, line AS ordinal, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM c WHERE (a IS NOT NULL OR b IS NOT NULL) AND doc_id NOT IN (SELECT doc_id FROM w))
SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, '第 ' || ordinal || ' 段' AS label FROM (SELECT * FROM w UNION ALL SELECT doc_id, ordinal FROM o WHERE k <= 3)""").replace("WHERE a IS NOT NULL AND b IS NOT NULL)\n,", "WHERE a IS NOT NULL AND b IS NOT NULL),"))
def locate_blocks(spark, sf_dir):
    return locate.locate_blocks(_blocks(spark, sf_dir), ["and", "with"]).select("doc_id", "ordinal", "label")


@query("WITH b AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS ls FROM documents), o AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM b) SELECT doc_id, CAST(i AS INTEGER) AS ordinal, CAST(COALESCE(list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)), 0) AS INTEGER) AS start, CAST(length(ls[i]) AS INTEGER) AS length FROM o")
def location_map(spark, sf_dir):
    return locate.location_map(_blocks(spark, sf_dir)).select("doc_id", "ordinal", "start", "length")


@query("SELECT doc_id, CAST(1 AS INTEGER) AS ordinal, CAST(0 AS INTEGER) AS start, CAST(length(text) // 2 AS INTEGER) AS length FROM documents WHERE doc_id % 3 = 0 AND length(text) > 0 UNION ALL SELECT doc_id, 2, 5, CAST(length(text) - 5 AS INTEGER) FROM documents WHERE length(text) >= 5")
def location_map_validated(spark, sf_dir):
    """Stored entries of which some lie outside their text."""
    docs = ad.read(spark, sf_dir, "documents")
    n = F.length("text")
    entry = lambda ordinal, start, length: F.struct(F.lit(ordinal).alias("ordinal"), F.lit(start).alias("start"), length.cast("int").alias("length"), F.lit(" ").alias("label"), F.lit("h").alias("heading_path"))
    first = F.when((F.col("doc_id") % 3 == 0) & (n > 0), F.floor(n / 2)).otherwise(n + 1)
    stored = docs.select("doc_id", F.explode(F.array(entry(1, 0, first), entry(2, 5, n - 5), entry(0, 0, n), entry(3, -1, n))).alias("m")).select("doc_id", "m.*")
    return locate.valid_map(stored, docs).filter("label is null and heading_path = 'h'").select("doc_id", "ordinal", "start", "length")


# Fusion


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = literals(spark, [(1, "doc1"), (2, "doc2.md"), (3, "doc3")], "query_id int, query string")
    files = ad.files(spark, sf_dir)
    by_name = Window.partitionBy("query_id").orderBy(F.length("name"), F.lower("name"), "path_key")
    found = files.join(F.broadcast(asked), F.contains(F.lower(files["name"]), asked["query"]))
    found = found.select("query_id", "query", "path_key", "name", (F.col("attributes").bitwiseAND(256) != 0).cast("int").alias("noise"), (F.row_number().over(by_name) - 1).alias("rank")).filter("rank < 50")
    by_size = Window.partitionBy("query_id").orderBy((F.col("size") * F.col("query_id") * 37 % 1009).desc(), "path_key")
    best = files.crossJoin(F.broadcast(asked)).select("query_id", "query", "doc_id", "path_key", "name", F.row_number().over(by_size).alias("d")).filter("d <= 50")
    hits = locate.locate_lines(ad.documents(spark, sf_dir).join(best.select("doc_id").distinct(), "doc_id", "left_semi"), F.array(F.lit("an")))
    by_hit = Window.partitionBy("query_id").orderBy("d", "line")
    content = best.join(hits, "doc_id").select("query_id", "query", "path_key", "name", F.col("line").alias("start_line"), F.contains(F.lower("name"), F.lower("query")).alias("title_matched"), (F.row_number().over(by_hit) - 1).alias("rank"))
    return fuse.fuse(found, content)


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fuse.boosted(fused(spark, sf_dir))
    return fuse.ordered(scored, 10_000).withColumn("tier", fuse.tier(F.col("query"), F.col("name"), F.col("match_source"), F.col("noise")))


@query(f"{sql.FUSED} SELECT query_id, path_key, CAST(hit_no AS INTEGER) AS hit_no, round(rrf, 9) AS rrf FROM fused")
def rrf_fuse(spark, sf_dir):
    return fused(spark, sf_dir).select("query_id", "path_key", "hit_no", F.round("rrf", 9).alias("rrf"))


@query(f"{sql.FUSED} SELECT query_id, path_key, CAST(hit_no AS INTEGER) AS hit_no, score FROM boosted")
def boosts(spark, sf_dir):
    return fuse.boosted(fused(spark, sf_dir)).select("query_id", "path_key", "hit_no", "score")


@query(f"{sql.FUSED} SELECT query_id, path_key, CAST(position AS INTEGER) AS position FROM ordered")
def fusion_order(spark, sf_dir):
    return ordered(spark, sf_dir).select("query_id", "path_key", "position")


@query(f"{sql.FUSED} SELECT query_id, match_source, count(*) AS n FROM fused GROUP BY ALL")
def match_source(spark, sf_dir):
    return fused(spark, sf_dir).groupBy("query_id", "match_source").agg(F.count("*").alias("n"))


@query(f"{sql.FUSED} SELECT query_id, path_key, CAST(position AS INTEGER) AS position, tier FROM ordered")
def tier_assign(spark, sf_dir):
    return ordered(spark, sf_dir).select("query_id", "path_key", "position", "tier")


@query(f"{sql.FUSED}, g AS (SELECT query_id, path_key, min(position) AS first, count(*) AS hits, bool_or(match_source <> 'content') AS n, bool_or(match_source <> 'name') AS c, min(tier) AS tier, max(score) AS score, arg_min(start_line, position) AS line FROM ordered GROUP BY ALL) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) - 1 AS INTEGER) AS baseline_index, path_key, hits, CASE WHEN n AND c THEN 'both' WHEN n THEN 'name' ELSE 'content' END AS match_source, tier, score, CASE WHEN hits > 1 THEN hits || ' 处命中 · ' ELSE '' END || 'lines ' || line || '-' || line AS label FROM g")
def collapse_by_file(spark, sf_dir):
    return fuse.collapse(ordered(spark, sf_dir)).drop("name")


@query("WITH f AS (SELECT doc_id % 5 AS query_id, CAST(doc_id AS VARCHAR) AS item, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id) - 1 AS rank, 0 AS kind FROM documents), m AS (SELECT conv_id % 5 AS query_id, conv_id || '/' || turn AS item, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id, turn) - 1 AS rank, 1 AS kind FROM conversations), u AS (SELECT * FROM f UNION ALL SELECT * FROM m), p AS (SELECT *, round(1.0::DOUBLE / (61 + rank), 9) AS score FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, rank) - 1 AS position FROM p) SELECT query_id, CAST(position AS INTEGER) AS position, item, kind, score FROM r WHERE position < 20")
def rrf_merge_mail(spark, sf_dir):
    rank = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1
    files = ad.read(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("query_id"), "doc_id").select("query_id", F.col("doc_id").cast("string").alias("item"), rank("doc_id").alias("rank"))
    mails = ad.read(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).alias("query_id"), "conv_id", "turn").select("query_id", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item"), rank("conv_id", "turn").alias("rank"))
    return fuse.merge_mail(files, mails, 20)


# Mail


@query(f"WITH {sql.MESSAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY ts DESC, store_id, entry_id) AS k FROM messages) SELECT store_id, entry_id, folder FROM (SELECT * FROM n WHERE k <= 100 ORDER BY ts DESC, store_id, entry_id LIMIT 100)")
def mail_source(spark, sf_dir):
    return mail.recent(ad.messages(spark, sf_dir)).select("store_id", "entry_id", "folder")


@query(f"WITH {sql.MESSAGES} SELECT store_id, entry_id, subject FROM messages")
def mail_dedupe(spark, sf_dir):
    rows = ad.messages(spark, sf_dir)
    older = rows.withColumns({"subject": F.lit("old"), "ts": F.col("ts") - F.expr("INTERVAL 1 DAY")})
    return mail.deduped(rows.unionByName(older).unionByName(rows.withColumn("entry_id", F.lit(" ")))).select("store_id", "entry_id", "subject")


@query(f"WITH {sql.MESSAGES} SELECT store_id, entry_id, subject FROM messages WHERE CAST(store_id AS BIGINT) % 3 <> 0")
def mail_snapshot_sync(spark, sf_dir):
    rows = ad.messages(spark, sf_dir)
    stored = rows.withColumn("first_seen", F.col("ts"))
    return mail.merge_snapshot(stored, rows.filter("cast(store_id as bigint) % 3 <> 0")).select("store_id", "entry_id", "subject")


@query(f"WITH {sql.MESSAGES} SELECT 2 * count(*) AS total, count(*) AS stored, count(*) AS skipped, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_message FROM messages")
def mail_status(spark, sf_dir):
    rows = ad.messages(spark, sf_dir)
    return mail.status(rows.unionByName(rows), mail.deduped(rows)).withColumn("last_message", iso("last_message"))


@query(f"""WITH {sql.MESSAGES},
toks AS (SELECT store_id, entry_id, unnest(regexp_extract_all({sql.fold("lower(subject || chr(10) || sender || chr(10) || folder || chr(10) || body)")}, {sql.WORD})) AS term FROM messages),
d AS (SELECT store_id, entry_id, count(*) AS d FROM toks GROUP BY ALL), c AS (SELECT (SELECT count(*) FROM messages) AS n, (SELECT count(*) FROM toks) / (SELECT count(*) FROM messages)::DOUBLE AS avgdl),
h AS (SELECT store_id, entry_id, term, count(*) AS f FROM toks WHERE term IN ('the', 'user') GROUP BY ALL), nt AS (SELECT term, count(*) AS n_t FROM h GROUP BY term),
s AS (SELECT store_id, entry_id, round(sum(CASE WHEN ln((n - n_t + 0.5) / (n_t + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n_t + 0.5) / (n_t + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avgdl))), 6) AS score FROM h JOIN nt USING (term) JOIN d USING (store_id, entry_id), c GROUP BY ALL HAVING count(*) = 2)
SELECT CAST(row_number() OVER (ORDER BY score DESC, path) AS INTEGER) AS rank, path, score FROM (SELECT 'outlook://mail/' || left(sha256(store_id || chr(10) || entry_id), 24) AS path, score FROM s ORDER BY score DESC, path LIMIT 20)""")
def mail_search(spark, sf_dir):
    asked = literals(spark, [(1, "the user")], "query_id int, query string")
    found = retrieve.search(mail.searchable(ad.messages(spark, sf_dir), retrieve.wanted_terms(asked)), asked, 20, field=ix.BODY)
    return found.select("rank", F.col("path_key").alias("path"), "score")


# Behavior and ranking


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = ad.files(spark, sf_dir).select("doc_id", "path_key", F.lower("parent_path").alias("directory_key"), "extension")
    n = ad.read(spark, sf_dir, "documents").count()
    return ad.feedback(ad.read(spark, sf_dir, "events"), n).join(files, "doc_id")


@query(f"WITH {sql.FEEDBACK} SELECT strftime(day, '%Y-%m-%d') AS day, path_key, extension, CAST(weight_sum AS DOUBLE) AS weight_sum, event_count FROM daily")
def behavior_daily(spark, sf_dir):
    return behavior.daily(_feedback(spark, sf_dir)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "path_key", "extension", "weight_sum", "event_count")


@query(f"WITH {sql.FEEDBACK} SELECT event_id, CAST(weight AS DOUBLE) AS weight FROM fb")
def action_weight(spark, sf_dir):
    return _feedback(spark, sf_dir).filter("mode <> 'Content'").select("event_id", behavior.action_weight(F.coalesce("action", F.lit("")), F.col("previewed")).alias("weight"))


@query(f"""WITH {sql.FEEDBACK}, k AS (SELECT *, weight_sum * pow(2.0, -date_diff('day', day, DATE '2024-02-10') / 30.0::DOUBLE) AS w FROM daily WHERE day >= DATE '2024-02-10' - 29),
p AS (SELECT path_key, sum(w) AS s FROM k GROUP BY ALL), d AS (SELECT directory_key, sum(w) AS s FROM k GROUP BY ALL), x AS (SELECT extension, sum(w) AS s FROM k GROUP BY ALL),
r AS (SELECT f.path_key, round(COALESCE(p.s, 0) + 0.3 * COALESCE(d.s, 0) + 0.1 * COALESCE(x.s, 0), 6) AS affinity FROM files f LEFT JOIN p USING (path_key) LEFT JOIN d ON d.directory_key = lower(f.parent_path) LEFT JOIN x ON x.extension = f.extension)
SELECT path_key, CAST(affinity AS DOUBLE) AS affinity, CAST(greatest(1, least(10, ceil(affinity))) AS INTEGER) AS promotion FROM r WHERE affinity > 0""")
def decayed_affinity(spark, sf_dir):
    candidates = ad.files(spark, sf_dir).select("path_key", F.lower("parent_path").alias("directory_key"), "extension")
    found = behavior.affinity(candidates, behavior.daily(_feedback(spark, sf_dir)), F.to_date(F.lit(AS_OF)))
    return found.select("path_key", "affinity", behavior.promotion(F.col("affinity")).alias("promotion"))


@query(f"WITH {sql.FEEDBACK} SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM daily WHERE day >= DATE '2024-02-10' - 29 GROUP BY day")
def retention_prune(spark, sf_dir):
    kept = behavior.retained(behavior.daily(_feedback(spark, sf_dir)), F.to_date(F.lit(AS_OF)))
    return kept.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN value <= 0 THEN 0 ELSE CAST(greatest(1, least(10, ceil(value))) AS INTEGER) END AS promotion FROM events")
def promotion(spark, sf_dir):
    return ad.read(spark, sf_dir, "events").select("event_id", behavior.promotion(F.col("value")).alias("promotion"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ad.read(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 12").alias("query_id"))
    docs = docs.withColumn("idx", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")) - 1)
    vectors = ad.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    n = vectors.count()
    zero = vectors.filter("vec_id = 0").select(F.col("e").alias("e0"))
    dot = F.aggregate(F.zip_with("e", "e0", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = docs.join(vectors, docs["doc_id"] % n == vectors["vec_id"]).crossJoin(F.broadcast(zero))
    return rows.select(
        "query_id", F.col("doc_id").cast("string").alias("cand_id"), "idx", ((F.col("idx") / 5).cast("int") % 3).alias("tier"), (F.col("doc_id") % 4).alias("promotion"), F.concat(F.lit("name"), (F.col("doc_id") % 1200).cast("string")).alias("name"),
        ad.pick(["name", "content", "both"], F.col("doc_id")).alias("match_source"), F.round(dot, 6).alias("semantic_score"), F.lit(False).alias("is_mail"),
    )


@query(f"{sql.BEHAVED} SELECT query_id, cand_id, CAST(behavior_index AS INTEGER) AS behavior_index FROM b")
def behavior_rerank(spark, sf_dir):
    return rerank.behavior(candidates(spark, sf_dir)).select("query_id", "cand_id", "behavior_index")


@query(f"{sql.CANDIDATES} SELECT query_id, NOT bool_or(tier = 0) AS semantic FROM c GROUP BY query_id HAVING count(*) >= 2")
def rerank_gate(spark, sf_dir):
    return rerank.gate(candidates(spark, sf_dir))


def _head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.behavior(candidates(spark, sf_dir)).filter("idx < 10")


@query(f"{sql.BEHAVED} SELECT query_id, cand_id, CAST(semantic_rank AS INTEGER) AS semantic_rank FROM s")
def semantic_rank(spark, sf_dir):
    return rerank.semantic_rank(_head(spark, sf_dir)).select("query_id", "cand_id", "semantic_rank")


@query(f"{sql.BEHAVED} SELECT query_id, cand_id, round(CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE (n - semantic_rank)::DOUBLE / (n - 1) END, 9) AS rank_value FROM s")
def rank_value(spark, sf_dir):
    rows = rerank.semantic_rank(_head(spark, sf_dir)).withColumn("n", F.count("*").over(Window.partitionBy("query_id", "tier")))
    return rows.select("query_id", "cand_id", F.round(rerank.rank_value(F.col("n"), F.col("semantic_rank")), 9).alias("rank_value"))


@query(f"{sql.BEHAVED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 0 THEN -behavior_index::DOUBLE ELSE blended END DESC, behavior_index) AS position FROM bl) SELECT query_id, CAST(position AS INTEGER) AS position, cand_id, blended FROM o WHERE position <= 5")
def blend_local(spark, sf_dir):
    return rerank.blend(_head(spark, sf_dir)).select("query_id", "position", "cand_id", "blended")


@query(f"{sql.CANDIDATES}, w AS (SELECT query_id, cand_id, row_number() OVER (PARTITION BY query_id ORDER BY cand_id DESC) AS wanted FROM c WHERE idx % 3 = 0) SELECT query_id, cand_id, CAST(CASE WHEN idx < 10 THEN row_number() OVER (PARTITION BY query_id, idx < 10 ORDER BY tier, COALESCE(wanted, 2147483647), idx) - 1 ELSE idx END AS INTEGER) AS new_index FROM c LEFT JOIN w USING (query_id, cand_id)")
def protected_reorder(spark, sf_dir):
    rows = candidates(spark, sf_dir)
    wanted = rows.filter("idx % 3 = 0").select("query_id", "cand_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cand_id").desc())).alias("wanted"))
    return rerank.protected(rows, wanted).select("query_id", "cand_id", "new_index")


@query(f"{sql.CANDIDATES}, {sql.LOW} SELECT * FROM low")
def low_confidence(spark, sf_dir):
    return rerank.low_confidence(candidates(spark, sf_dir))


@query(f"{sql.CANDIDATES} SELECT query_id, max(k) > 1 AS duplicate_names FROM (SELECT query_id, lower(trim(name, ' ')) AS n, count(*) AS k FROM c GROUP BY ALL) GROUP BY query_id")
def duplicate_names(spark, sf_dir):
    return rerank.duplicate_names(candidates(spark, sf_dir))


@query(f"{sql.CANDIDATES} SELECT query_id, bool_or(match_source IN ('name', 'both')) AND bool_or(match_source IN ('content', 'both')) AS mixed_evidence FROM c GROUP BY query_id")
def mixed_evidence(spark, sf_dir):
    return rerank.mixed_evidence(candidates(spark, sf_dir))


@query(f"{sql.CANDIDATES}, {sql.LOW}, g AS (SELECT query_id, bool_or(tier = 0 AND idx > 0) AS ex, sum(CASE WHEN tier = 1 THEN 1 ELSE 0 END) AS el, bool_or(match_source IN ('name', 'both')) AND bool_or(match_source IN ('content', 'both')) AS mixed FROM (SELECT query_id, idx, match_source, CASE WHEN query_id % 2 = 0 AND tier = 0 THEN 1 ELSE tier END AS tier FROM c WHERE TRUE) GROUP BY query_id) SELECT query_id, NOT ex AND el >= 3 AND NOT (query_id % 4 = 0) AND (low_confidence OR mixed OR query_id % 3 = 0) AS ambiguous FROM g JOIN low USING (query_id)")
def ambiguity_gate(spark, sf_dir):
    rows = candidates(spark, sf_dir).withColumn("tier", F.when((F.col("query_id") % 2 == 0) & (F.col("tier") == 0), 1).otherwise(F.col("tier")))
    questions = rows.select("query_id").distinct().select("query_id", (F.col("query_id") % 4 == 0).alias("explicit"), (F.col("query_id") % 3 == 0).alias("natural"))
    return rerank.ambiguity(rows, questions)


@query("SELECT doc_id, len(ids) BETWEEN 1 AND 5 AND len(list_distinct(ids)) = len(ids) AND len(list_filter(ids, lambda x: NOT list_contains([0, 1, 2, 3, 4, 5, 6], x))) = 0 AS valid FROM (SELECT doc_id, [doc_id % 9, doc_id % 7, doc_id % 5] AS ids FROM documents)")
def validate_external_order(spark, sf_dir):
    ids = F.array(F.col("doc_id") % 9, F.col("doc_id") % 7, F.col("doc_id") % 5)
    return ad.read(spark, sf_dir, "documents").select("doc_id", rerank.valid_order(ids, F.array(*(F.lit(k).cast("long") for k in range(7)))).alias("valid"))


@query(f"{sql.BEHAVED} SELECT query_id, bool_and(idx = behavior_index) AS equal FROM b GROUP BY query_id")
def orders_equal(spark, sf_dir):
    return rerank.orders_equal(rerank.behavior(candidates(spark, sf_dir)), "idx", "behavior_index")


@query()
def semantic_score(spark, sf_dir):
    """Any scorer of (query, text): here the share of query words in the text."""

    def load():
        def overlap(queries, texts):
            for a, b in zip(queries, texts, strict=True):
                words = set(a.lower().split())
                yield len(words & set(b.lower().split())) / max(1, len(words))

        return lambda queries, texts: list(overlap(queries, texts))

    asked = benchmark_queries(spark, sf_dir)
    found = asked.join(retrieve.search(corpus_index(spark, sf_dir, asked), asked, 10, field=ix.BODY), "query_id")
    rows = retrieve.with_texts(found, ad.documents(spark, sf_dir).select("doc_id", "text"), asked, 10)
    return rerank.scored(rows, load).select("query_id", "doc_id", F.round("semantic_score", 6).alias("semantic_score"))


# Snapshots and queue


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = ad.files(spark, sf_dir)
    mark = lambda size: policy.fingerprint(F.col("full_path"), size, F.col("modified_at")).alias("fingerprint")
    later = F.col("size") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    return files.filter("doc_id % 10 <> 1").select("path_key", mark(F.col("size")), "doc_id"), files.filter("doc_id % 10 <> 2").select("path_key", mark(later), "doc_id")


@query(f"WITH {sql.SNAPSHOTS} SELECT COALESCE(a.path_key, b.path_key) AS path_key, CASE WHEN a.path_key IS NULL THEN 'new' WHEN b.path_key IS NULL THEN 'removed' WHEN a.fingerprint = b.fingerprint THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b ON a.path_key = b.path_key")
def snapshot_diff(spark, sf_dir):
    return queue.snapshot_diff(*_scans(spark, sf_dir))


@query(f"WITH {sql.SNAPSHOTS} SELECT path_key FROM a WHERE path_key NOT IN (SELECT path_key FROM b)")
def except_snapshot(spark, sf_dir):
    a, b = _scans(spark, sf_dir)
    return queue.removed(a, b).select("path_key")


@query(f"WITH {sql.SNAPSHOTS} SELECT path_key FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.path_key = b.path_key AND a.fingerprint = b.fingerprint) AND NOT EXISTS (SELECT 1 FROM b f WHERE f.path_key = b.path_key AND f.doc_id % 13 = 0)")
def enqueue_anti_join(spark, sf_dir):
    a, b = _scans(spark, sf_dir)
    return queue.to_enqueue(b, a, b.filter("doc_id % 13 = 0")).select("path_key")


@query(f"WITH {sql.SNAPSHOTS} SELECT count(*) AS n FROM a JOIN b USING (path_key)")
def queue_scan_join(spark, sf_dir):
    a, b = _scans(spark, sf_dir)
    return a.join(b, "path_key").agg(F.count("*").alias("n"))


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = ["ACCESS_DENIED", "CORRUPT_DOCUMENT", "FILE_TOO_LARGE", "UNSUPPORTED_ENCODING", "EXTRACTION_TIMEOUT", "OCR_REQUIRED"]
    return ad.files(spark, sf_dir).select(
        F.col("doc_id").alias("id"), "path_key", F.col("doc_id").cast("string").alias("fingerprint"), (F.col("doc_id") % 3).alias("priority"), (F.col("doc_id") % 4).cast("int").alias("attempts"),
        F.when(F.col("doc_id") % 7 == 0, "processing").otherwise("pending").alias("state"), F.col("modified_at").alias("next_attempt_at"), ad.pick(codes, F.col("doc_id")).alias("error_code"),
    )


@query(f"WITH {sql.QUEUE} SELECT id, state FROM (SELECT id, priority, 'processing' AS state FROM queue WHERE state = 'pending' AND next_attempt_at <= TIMESTAMP '2024-01-20' ORDER BY priority, id LIMIT 50)")
def queue_lease(spark, sf_dir):
    return queue.lease(_queue(spark, sf_dir), stamp("2024-01-20"), 50).select("id", "state")


@query(f"WITH {sql.QUEUE}, n AS (SELECT path_key, CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE 'v2' END AS fingerprint, id FROM queue WHERE id % 5 <> 0) SELECT q.path_key, COALESCE(n.fingerprint, CAST(q.id AS VARCHAR)) AS fingerprint, CAST(CASE WHEN n.path_key IS NOT NULL AND n.fingerprint <> CAST(q.id AS VARCHAR) THEN 0 ELSE q.attempts END AS INTEGER) AS attempts, CASE WHEN n.path_key IS NOT NULL THEN 'pending' ELSE q.state END AS state, strftime(CASE WHEN n.path_key IS NOT NULL AND n.fingerprint <> CAST(q.id AS VARCHAR) THEN TIMESTAMP '2024-02-10' ELSE q.next_attempt_at END, '%Y-%m-%d %H:%M:%S') AS due FROM queue q LEFT JOIN n USING (path_key)")
def queue_upsert(spark, sf_dir):
    rows = _queue(spark, sf_dir)
    incoming = rows.filter("id % 5 <> 0").select("path_key", F.when(F.col("id") % 2 == 0, F.col("fingerprint")).otherwise("v2").alias("fingerprint"), "priority")
    return queue.upsert(rows, incoming, stamp(AS_OF)).select("path_key", "fingerprint", "attempts", "state", iso("next_attempt_at").alias("due"))


@query(f"WITH {sql.QUEUE}, t AS (SELECT *, attempts + 1 >= 3 OR error_code IN ('CORRUPT_DOCUMENT', 'UNSUPPORTED_OR_ENCRYPTED_DOCUMENT', 'UNSUPPORTED_FILE_TYPE', 'UNSUPPORTED_ENCODING', 'FILE_TOO_LARGE', 'EXTRACTION_TIMEOUT', 'ACCESS_DENIED') AS terminal FROM queue WHERE state = 'processing') SELECT path_key, CAST(attempts + 1 AS INTEGER) AS attempts, terminal, CASE WHEN NOT terminal THEN strftime(TIMESTAMP '2024-02-10' + INTERVAL 1 MINUTE * [1, 10, 60][least(attempts + 1, 3)], '%Y-%m-%d %H:%M:%S') END AS due FROM t")
def queue_fail_retry(spark, sf_dir):
    failed = queue.after_failure(_queue(spark, sf_dir).filter("state = 'processing'"), stamp(AS_OF))
    return failed.select("path_key", "attempts", "terminal", iso("next_attempt_at").alias("due"))


@query(f"WITH {sql.QUEUE} SELECT id, 'pending' AS state FROM queue")
def queue_recover(spark, sf_dir):
    return queue.recover(_queue(spark, sf_dir)).select("id", "state")


@query(f"WITH {sql.QUEUE} SELECT 'failed:' || CASE WHEN error_code IN ('UNSUPPORTED_FILE_TYPE', 'UNSUPPORTED_ENCODING', 'OCR_REQUIRED') THEN 'unsupported' WHEN error_code = 'FILE_TOO_LARGE' THEN 'too_large' WHEN error_code = 'ACCESS_DENIED' THEN 'access_denied' WHEN error_code = 'CORRUPT_DOCUMENT' THEN 'corrupt' ELSE 'other' END AS measure, count(*) AS n FROM queue WHERE attempts = 3 GROUP BY ALL UNION ALL SELECT 'queue:' || state, count(*) FROM queue GROUP BY ALL UNION ALL SELECT 'documents', count(*) FROM documents")
def status_counts(spark, sf_dir):
    rows = _queue(spark, sf_dir)
    return queue.status_counts(ad.read(spark, sf_dir, "documents"), rows, rows.filter("attempts = 3"))


@query(f"WITH {sql.QUEUE} SELECT path_key FROM (SELECT path_key, next_attempt_at FROM queue ORDER BY next_attempt_at DESC, path_key LIMIT 200)")
def failures_list(spark, sf_dir):
    return queue.failures_list(_queue(spark, sf_dir).withColumn("failed_at", F.col("next_attempt_at"))).select("path_key")


@query("SELECT min(value) AS min_ms, median(value) AS median_ms, quantile_disc(value, 0.95) AS p95_ms, max(value) AS max_ms FROM events")
def latency_stats(spark, sf_dir):
    return queue.latency(ad.read(spark, sf_dir, "events").select(F.col("value").alias("duration_ms")))


# Rates, bursts, state machines


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_window(spark, sf_dir):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = ad.read(spark, sf_dir, "events").withColumn("s", seconds)
    return rows.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-60, 0)).alias("in_window"))


@query("WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id AS session, count(*) AS keys, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM s GROUP BY user_id, k")
def session_debounce(spark, sf_dir):
    """The batch form, with a gap that fits the events' spacing."""
    events = ad.read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"))
    return state.debounced(events, gap="1 hour").select("session", "keys", iso("ts").alias("last_at"))


@query("SELECT user_id AS session, max(event_id) AS version FROM events GROUP BY user_id")
def latest_pending(spark, sf_dir):
    rows = ad.read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("version"), F.col("event_type").alias("query"))
    return state.latest_pending(rows).select("session", "version")


@query("SELECT event_id, CASE WHEN event_id < max(event_id) OVER (PARTITION BY user_id) THEN 'superseded' WHEN event_id % 800 > 400 THEN 'expired' ELSE 'run' END AS outcome FROM events")
def pending_outcomes(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    rows = ad.read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("version"), ts.alias("requested_at"), F.timestamp_micros(F.unix_micros(ts) + F.col("event_id") % 800 * 1000).alias("free_at"))
    return state.pending_outcomes(rows).select(F.col("version").alias("event_id"), "outcome")


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = ad.pick([200, 500, 429, 0, 200, 404, 503], F.col("event_id"))
    return ad.read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 16).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("payload"))


@query()
def rate_limiter(spark, sf_dir):
    return state.admitted(_status(spark, sf_dir))


@query()
def circuit_breaker(spark, sf_dir):
    return state.circuit(_status(spark, sf_dir))


@query()
def ttl_cache(spark, sf_dir):
    return state.cache_hits(_status(spark, sf_dir))


# The flagship: a batch of hybrid searches, end to end


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top ten of every benchmark query, with line locations late-materialised for those only."""
    asked = benchmark_queries(spark, sf_dir)
    found = retrieve.search(corpus_index(spark, sf_dir, asked), asked, 10)
    terms = asked.select("query_id", tx.query_terms(F.col("query")).alias("terms"))
    texts = ad.documents(spark, sf_dir).select("doc_id", "text")
    rows = retrieve.with_texts(found.join(terms, "query_id"), texts, asked, 10).select("query_id", "rank", "doc_id", "score", "terms", tx.lines(tx.fold_marks(F.lower("text"))).alias("ls"))
    first = F.element_at(F.filter(F.transform("ls", lambda c, i: F.when(F.exists("terms", lambda t: F.contains(c, t)), i + 1)), lambda n: n.isNotNull()), 1)
    return rows.select("query_id", "rank", "doc_id", "score", F.coalesce(first, F.lit(1)).alias("line"))


@query(f"""WITH {sql.TOKENS}, {sql.bm25(chr(39) + 'body' + chr(39) + ', ' + chr(39) + 'title' + chr(39))}, {sql.TOP}, t AS (SELECT r.query_id, r.rank, r.doc_id, r.score, string_split_regex(f.text, '\\r\\n|\\r|\\n') AS ls, q.terms FROM ranked r JOIN files f USING (doc_id) JOIN q USING (query_id) WHERE r.rank <= 10)
SELECT query_id, rank, doc_id, score, CAST(COALESCE(list_filter(range(1, len(ls) + 1), lambda i: len(list_filter(terms, lambda t: contains({sql.fold('lower(ls[i])')}, t))) > 0)[1], 1) AS INTEGER) AS line FROM t""")
def hybrid_batch(spark, sf_dir):
    return flagship(spark, sf_dir)


# The rest of the inventory


@query("SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{Mn}\\p{Mc}_.+#-]+'), lambda t: regexp_replace(t, '^[._-]+|[._-]+$', '', 'g')), lambda t: regexp_matches(t, '[\\p{L}\\p{Nd}]')), ' ') AS body_tokens FROM documents")
def index_tokens(spark, sf_dir):
    return ad.read(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.tokenize_app(F.col("text")), " ").alias("body_tokens"))


_MAIL_TIME = "strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (conv_id * 7 + turn), '%Y-%m-%d %H:%M')"


@query(f"SELECT conv_id, turn, role || CASE WHEN turn % 2 = 0 THEN ' → team' ELSE '' END || ' · ' || {_MAIL_TIME} AS detail, '邮件：' || CASE WHEN trim(substr(text, 1, 40)) = '' THEN '(无主题)' ELSE substr(text, 1, 40) END || chr(10) || '发件人：' || role || chr(10) || '收件人：' || CASE WHEN turn % 2 = 0 THEN 'team' ELSE ' ' END || chr(10) || '时间：' || {_MAIL_TIME} || chr(10) || '文件夹：' || CASE WHEN role = 'user' THEN 'Inbox' ELSE 'Sent' END || chr(10) || CASE WHEN turn % 3 = 0 THEN '附件：a.txt' || chr(10) ELSE '' END || '正文片段：' || substr(text, 1, 20) AS reference FROM conversations")
def mail_detail(spark, sf_dir):
    rows = ad.messages(spark, sf_dir).withColumns({"turn": F.col("entry_id").cast("long"), "conv_id": F.col("store_id").cast("long")})
    recipients = F.when(F.col("turn") % 2 == 0, "team").otherwise(" ")
    attachments = F.when(F.col("turn") % 3 == 0, "a.txt")
    reference = tx.mail_reference(F.col("subject"), F.col("sender"), recipients, F.col("ts"), F.col("folder"), attachments, F.substring("body", 1, 20))
    return rows.select("conv_id", "turn", tx.mail_detail(F.col("sender"), recipients, F.col("ts")).alias("detail"), reference.alias("reference"))


@query("SELECT item_id, list_transform(list_sort(list_transform(terms, lambda t, i: {'n': -length(t), 'i': i, 't': t})), lambda x: x.t) AS terms FROM (SELECT item_id, list_distinct_ordered AS terms FROM (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark)))")
def preview_terms(spark, sf_dir):
    words = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), " ")
    return ad.read(spark, sf_dir, "benchmark").select("item_id", tx.preview_terms(words).alias("terms"))


@query("WITH b AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS ls FROM documents), j AS (SELECT doc_id, left(array_to_string(ls, chr(10)), 500) AS t FROM b) SELECT doc_id, regexp_replace(t, '\\n$', '') AS text FROM j")
def truncate_blocks(spark, sf_dir):
    """Lines as blocks, cut at 500 characters: the joined text, less a line end that nothing follows."""
    docs = ad.read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.regexp_replace(F.array_join(tx.truncated_blocks(tx.lines(F.col("text")), 500), "\n"), "\n$", "").alias("text"))


@query("SELECT item_id, CAST(len(q) AS INTEGER) AS n_query, list_concat([0], q, [2, 2], t[1:192 - 4 - len(q)], [2], list_transform(range(0, greatest(0, 192 - 4 - len(q) - len(t))), lambda x: 1)) AS ids FROM (SELECT item_id, list_transform(regexp_extract_all(text, '[a-z]+'), lambda w: length(w))[1:48] AS q, list_transform(regexp_extract_all(text, '[a-z]+'), lambda w: length(w)) AS t FROM benchmark)")
def pair_encode(spark, sf_dir):
    """Pairs of a text with itself, word lengths standing for ids."""
    ids = F.transform(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)), F.length)
    rows = ad.read(spark, sf_dir, "benchmark").select("item_id", ids.alias("t"))
    return rows.select("item_id", F.size(F.slice("t", 1, 48)).alias("n_query"), tx.pair_ids(F.col("t"), F.col("t")).alias("ids"))


@query("SELECT DISTINCT lower(extension) AS name FROM (SELECT ['txt', 'md', 'docx', 'pdf', 'tmp', 'log', 'dll', 'json'][doc_id % 8 + 1] AS extension FROM documents) UNION SELECT DISTINCT lower(lang) FROM documents")
def union_distinct_names(spark, sf_dir):
    files = ad.files(spark, sf_dir).select(F.lower("extension").alias("name"))
    return files.union(ad.read(spark, sf_dir, "documents").select(F.lower("lang"))).distinct()


@query(f"WITH {sql.FEEDBACK} SELECT strftime(day, '%Y-%m-%d') AS day, path_key, event_count FROM daily WHERE path_key LIKE '%doc1.%' OR directory_key LIKE '%\\notes' OR extension = 'md'")
def behavior_or_lookup(spark, sf_dir):
    days = behavior.daily(_feedback(spark, sf_dir))
    files = ad.files(spark, sf_dir)
    wanted = behavior.lookup(days, files.filter(F.col("path_key").like("%doc1.%")).select("path_key"), files.select(F.lower("parent_path").alias("directory_key")).filter(F.endswith(F.col("directory_key"), F.lit("\\notes"))).distinct(), files.filter("extension = 'md'").select("extension").distinct())
    return wanted.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "path_key", "event_count")


@query(f"{sql.CANDIDATES} SELECT a.query_id, a.cand_id, CASE WHEN a.idx < 6 THEN a.idx + 1 ELSE 99 END AS baseline_rank, 99 AS presented_rank FROM c a WHERE a.idx % 2 = 0")
def feedback_build(spark, sf_dir):
    rows = candidates(spark, sf_dir)
    acted = rows.filter("idx % 2 = 0").select("query_id", "cand_id", F.lit("Open").alias("action"), F.lit(99).alias("presented"))
    found = rerank.feedback_rows(acted, rows.filter("idx < 6"))
    return found.select("query_id", "cand_id", F.col("baseline_rank").cast("long").alias("baseline_rank"), "presented_rank")


@query(f"{sql.FUSED}, o AS (SELECT query_id, path_key, round(1.0::DOUBLE / (61 + rank), 9) AS rrf FROM names) SELECT query_id, path_key, rrf FROM o")
def partial_failure(spark, sf_dir):
    """Content is down: names answer alone."""
    asked = literals(spark, [(1, "doc1"), (2, "doc2.md"), (3, "doc3")], "query_id int, query string")
    files = ad.files(spark, sf_dir)
    by_name = Window.partitionBy("query_id").orderBy(F.length("name"), F.lower("name"), "path_key")
    found = files.join(asked, F.contains(F.lower(files["name"]), asked["query"])).select("query_id", "query", "path_key", "name", F.lit(0).alias("noise"), (F.row_number().over(by_name) - 1).alias("rank")).filter("rank < 50")
    nothing = literals(spark, [], "query_id int, query string, path_key string, name string, rank int, start_line int, title_matched boolean")
    return fuse.fuse(found, nothing).select("query_id", "path_key", F.round("rrf", 9).alias("rrf"))


def _engine(spark: SparkSession, sf_dir: str):
    from .engine import Engine

    return Engine(spark, ad.catalog(spark, sf_dir), corpus_index(spark, sf_dir), ad.messages(spark, sf_dir))


@query()
def content_mode(spark, sf_dir):
    """Content search of every benchmark text's first words, collapsed to files and merged with mails."""
    return _engine(spark, sf_dir).search_content_mode(benchmark_queries(spark, sf_dir), 10)


@query()
def hybrid_with_mail(spark, sf_dir):
    return _engine(spark, sf_dir).search_hybrid_with_mail(literals(spark, [(1, "doc1"), (2, "the"), (3, "user the")], "query_id int, query string"), 20)


@query(f"WITH {sql.TOKENS} SELECT b.item_id AS query_id, t.doc_id FROM benchmark b JOIN toks t ON t.field = 'title' AND t.term = 'doc' || b.item_id")
def filename_fallback(spark, sf_dir):
    """Without a catalog, file names are found as titles of the index."""
    from .engine import Engine

    asked = title_queries(spark, sf_dir)
    found = Engine(spark, None, corpus_index(spark, sf_dir, asked)).search_local_content(asked, 10, field=ix.TITLE)
    return found.filter("error_code is null").select("query_id", "doc_id")


@query("SELECT 'documents' AS measure, count(*) AS n FROM documents")
def index_status(spark, sf_dir):
    return _engine(spark, sf_dir).status()


from . import stores  # noqa: E402, F401  its queries are registered here
