"""Fusion of name and content results, collapse by file, and mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF = 60
EXACT_BOOST, TITLE_BOOST = 1.5, 1.2
CONTENT_LIMIT, MAX_LIMIT = 50, 100
EXACT, ELIGIBLE, SOFT = 0, 1, 2


def contribution(rank: Column) -> Column:
    """Of a 0-based rank."""
    return F.lit(1.0) / (RRF + rank + 1)


def name_limit(limit: int, offset: int) -> int:
    return min(MAX_LIMIT, offset + limit)


def fuse(names: DataFrame, content: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of names (query_id, query, path_key, name, rank, noise) and content hits
    (query_id, query, path_key, name, rank, start_line, title_matched), ranks from 0.

    A name meets the first content hit of its path; later hits of the file stay content. One full
    outer join on (query, path, first hit).
    """
    first = Window.partitionBy("query_id", "path_key").orderBy("rank")
    hits = content.withColumn("hit_no", F.row_number().over(first))
    n = names.select("query_id", "path_key", F.lit(1).alias("hit_no"), F.col("query").alias("n_query"), F.col("name").alias("n_name"), F.col("rank").alias("n_rank"), "noise")
    both = n.join(hits, ["query_id", "path_key", "hit_no"], "full_outer")
    by_name, by_content = F.col("n_rank").isNotNull(), F.col("rank").isNotNull()
    name, query = F.coalesce("name", "n_name"), F.coalesce("query", "n_query")
    score = F.coalesce(contribution(F.col("n_rank")), F.lit(0.0)) + F.coalesce(contribution(F.col("rank")), F.lit(0.0))
    return both.select(
        "query_id", "path_key", "hit_no", name.alias("name"), query.alias("query"), F.coalesce("start_line", F.lit(0)).alias("start_line"),
        F.when(by_name & by_content, "both").when(by_name, "name").otherwise("content").alias("match_source"), F.coalesce("noise", F.lit(0)).alias("noise"),
        F.coalesce("title_matched", F.lit(False)).alias("title_matched"), score.alias("rrf"),
    )


def boosted(fused: DataFrame) -> DataFrame:
    """An exact name counts half as much again, a matched title a fifth; both can apply."""
    exact = F.when(F.lower("name") == F.lower(F.trim("query")), EXACT_BOOST).otherwise(1.0)
    title = F.when(F.col("title_matched"), TITLE_BOOST).otherwise(1.0)
    return fused.withColumn("score", F.round(F.col("rrf") * exact * title, 9))


def fusion_group(match_source: Column, noise: Column) -> Column:
    """Content first, then normal names, then soft ones."""
    return F.when(match_source != "name", 0).when(noise == 0, 1).otherwise(2)


def ordered(scored: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    rank = Window.partitionBy("query_id").orderBy(fusion_group(F.col("match_source"), F.col("noise")), F.col("score").desc(), "path_key", "hit_no")
    return scored.withColumn("position", F.row_number().over(rank)).filter((F.col("position") > offset) & (F.col("position") <= offset + limit))


def tier(query: Column, name: Column, match_source: Column, noise: Column) -> Column:
    return F.when(F.lower(name) == F.lower(F.trim(query)), EXACT).when((match_source == "name") & (noise > 0), SOFT).otherwise(ELIGIBLE)


def collapse(ranked: DataFrame) -> DataFrame:
    """One row for each file at its first place: hits, sources in union, best tier, best score."""
    rows = ranked.groupBy("query_id", "path_key").agg(
        F.min_by("name", "position").alias("name"), F.min("position").alias("first"), F.min_by("start_line", "position").alias("start_line"), F.count("*").alias("hits"),
        F.bool_or(F.col("match_source") != "content").alias("_n"), F.bool_or(F.col("match_source") != "name").alias("_c"), F.min("tier").alias("tier"), F.max("score").alias("score"),
    )
    source = F.when(F.col("_n") & F.col("_c"), "both").when(F.col("_n"), "name").otherwise("content")
    line = F.concat(F.lit("lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("start_line").cast("string"))
    label = F.when(F.col("hits") > 1, F.concat(F.col("hits").cast("string"), F.lit(" 处命中 · "), line)).otherwise(line)
    order = Window.partitionBy("query_id").orderBy("first")
    return rows.select("query_id", (F.row_number().over(order) - 1).alias("baseline_index"), "path_key", "name", "hits", source.alias("match_source"), "tier", "score", label.alias("label"))


def merge_mail(files: DataFrame, mails: DataFrame, limit: int) -> DataFrame:
    """Files and mails (query_id, item, rank from 0) by reciprocal rank; files first among equals."""
    # a rank beyond the limit cannot be among the first of the merged list: it is cut before the shuffle
    best = lambda rows, kind: rows.filter(F.col("rank") < limit).select("query_id", "item", "rank", F.lit(kind).alias("kind"))
    both = best(files, 0).unionByName(best(mails, 1))
    scored = both.withColumn("score", F.round(contribution(F.col("rank")), 9))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "kind", "rank")
    return scored.withColumn("position", F.row_number().over(order) - 1).filter(F.col("position") < limit).select("query_id", "position", "item", "kind", "score")
