"""The thin registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import bpe_codec, embedding_dedup, lexical, main_text, ngram_join, packing, secrets, sharding, spelling, suffix_dedup, topk, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_projection_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_read(spark, sf_dir, "documents"))


def op4_suffix_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op6_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(_read(spark, sf_dir, "documents"))


def op7_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), 16)


def op8_multi_index_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.search_top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 10)


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096)


def op10_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_read(spark, sf_dir, "pages"))


def op11_max_score_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 10)


def op12_tree_scored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_pages(_read(spark, sf_dir, "pages"))


def op13_spelling_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_read(spark, sf_dir, "documents"))


def queries():
    return {
        "pipeline": corpus_pipeline.run,
        "op1_kneser_ney_toxicity": op1_kneser_ney_toxicity,
        "op2_projection_near_dedup": op2_projection_near_dedup,
        "op3_grammar_secrets": op3_grammar_secrets,
        "op4_suffix_merge_dedup": op4_suffix_merge_dedup,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_parity_sketch_join": op6_parity_sketch_join,
        "op7_bounded_ring": op7_bounded_ring,
        "op8_multi_index_top_k": op8_multi_index_top_k,
        "op9_pattern_packing": op9_pattern_packing,
        "op10_warc_chunks": op10_warc_chunks,
        "op11_max_score_search": op11_max_score_search,
        "op12_tree_scored_text": op12_tree_scored_text,
        "op13_spelling_neighbourhood": op13_spelling_neighbourhood,
    }


OP8_SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
d AS (
  SELECT q.query_id, v.vec_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (COALESCE(q.e[i], 0) > 0) <> (COALESCE(v.embedding[i], 0) > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM q JOIN embeddings v ON v.vec_id <> q.query_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""

OP10_SQL = """
WITH p AS (SELECT page_id, encode(COALESCE(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
b AS (
  SELECT page_id, n, hex,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST(('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS INTEGER), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER) + 1, 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex) AS first_id
  FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM b
"""


OP11_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(ts)) AS BIGINT) AS ll FROM d WHERE len(ts) > 0),
p AS MATERIALIZED (SELECT doc_id, len(ts) AS n, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM d) GROUP BY doc_id, ts, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p CROSS JOIN c GROUP BY term, nn),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
      FROM p JOIN i USING (term) JOIN w USING (term) CROSS JOIN c GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""

#: The article of the tables' one page layout: its heading and paragraphs.
OP12_SQL = r"""
WITH a AS (SELECT page_id, url, split_part(split_part(COALESCE(html, ''), '<article>', 2), '</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, array_to_string(list_filter(list_transform(regexp_split_to_array(body, '</?p>|</?h1>'),
        lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))),
        lambda x: x <> ''), chr(10) || chr(10)) AS text FROM a)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM b
"""


def oracle_sql():
    return {"op8_multi_index_top_k": OP8_SQL, "op10_warc_chunks": OP10_SQL, "op11_max_score_search": OP11_SQL, "op12_tree_scored_text": OP12_SQL}
