"""Feedback to daily aggregates to decayed affinity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_LIFE_DAYS, KEEP_DAYS = 30, 29
DIRECTORY_SHARE, EXTENSION_SHARE = 0.30, 0.10


def action_weight(action: Column, previewed: Column) -> Column:
    extra = F.when(previewed, 0.25).otherwise(0.0)
    return F.when(action.isin("Open", "CopyReference"), 1.0 + extra).when(action == "Locate", 0.5).otherwise(0.0)


def daily(feedback: DataFrame) -> DataFrame:
    """(day, path_key, directory_key, extension) -> weight_sum, event_count; content mode and actions
    without weight are not written. Sums are partial before the shuffle."""
    weight = action_weight(F.col("action"), F.col("previewed"))
    rows = feedback.filter("mode <> 'Content'").withColumn("weight", weight).filter("weight > 0")
    return rows.groupBy(F.to_date("ts").alias("day"), "path_key", "directory_key", "extension").agg(F.sum("weight").alias("weight_sum"), F.count("*").alias("event_count"))


def retained(days: DataFrame, today: Column) -> DataFrame:
    return days.filter(F.col("day") >= F.date_sub(today, KEEP_DAYS))


def _decayed(days: DataFrame, key: str, today: Column) -> DataFrame:
    age = F.datediff(today, F.col("day"))
    return days.groupBy(key).agg(F.sum(F.col("weight_sum") * F.pow(F.lit(2.0), -age / HALF_LIFE_DAYS)).alias(f"{key}_sum"))


def affinity(candidates: DataFrame, days: DataFrame, today: Column) -> DataFrame:
    """Candidates (path_key, directory_key, extension) with a score above 0: three equi-joins on sums
    of three keys, instead of one join on either of them."""
    kept = retained(days, today)
    out = candidates
    for key in ("path_key", "directory_key", "extension"):
        out = out.join(_decayed(kept, key, today), key, "left")
    score = F.coalesce("path_key_sum", F.lit(0.0)) + DIRECTORY_SHARE * F.coalesce("directory_key_sum", F.lit(0.0)) + EXTENSION_SHARE * F.coalesce("extension_sum", F.lit(0.0))
    return out.withColumn("affinity", F.round(score, 6)).drop("path_key_sum", "directory_key_sum", "extension_sum").filter("affinity > 0")


def promotion(score: Column) -> Column:
    return F.when(score <= 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(score).cast("int"))))


def lookup(days: DataFrame, path_keys: DataFrame, directory_keys: DataFrame, extensions: DataFrame) -> DataFrame:
    """Aggregates whose file, directory or extension is asked for: three semi-joins in union, as an OR
    over three columns has no join key."""
    hits = [days.join(keys, key, "left_semi") for key, keys in (("path_key", path_keys), ("directory_key", directory_keys), ("extension", extensions))]
    return hits[0].unionByName(hits[1]).unionByName(hits[2]).distinct()
