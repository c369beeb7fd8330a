"""The mailbox: snapshot, dedupe, search, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import index as ix

MOST = 100


def recent(messages: DataFrame, limit: int = MOST) -> DataFrame:
    """The newest of each folder, then the newest of all."""
    newest = Window.partitionBy("folder").orderBy(F.col("ts").desc(), "store_id", "entry_id")
    few = messages.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limit).drop("_n")
    return few.orderBy(F.col("ts").desc(), "store_id", "entry_id").limit(limit)


#: The class of a mail among a mailbox's items.
MAIL_CLASS = 43


def source(items: DataFrame, limit: int = MOST) -> tuple[DataFrame, DataFrame]:
    """What is read of a mailbox, and one row with ``skipped``.

    The newest items of each folder are looked at, whatever their class; mails among them are taken, the newest of all
    folders up to the limit. A mail without an identity or a time is skipped and counted, an item of another
    class is passed over."""
    newest = Window.partitionBy("folder").orderBy(F.col("ts").desc_nulls_last(), "store_id", "entry_id")
    seen = items.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limit).drop("_n").filter(F.col("item_class") == MAIL_CLASS)
    whole = F.coalesce((F.trim("store_id") != "") & (F.trim("entry_id") != "") & F.col("ts").isNotNull(), F.lit(False))
    skipped = seen.agg(F.coalesce(F.count_if(~whole), F.lit(0)).alias("skipped"))
    return seen.filter(whole).orderBy(F.col("ts").desc(), "store_id", "entry_id").limit(limit), skipped


def deduped(messages: DataFrame) -> DataFrame:
    """The newest row of each identity; rows without one are dropped."""
    newest = Window.partitionBy("store_id", "entry_id").orderBy(F.col("ts").desc(), "subject")
    good = messages.filter((F.trim("store_id") != "") & (F.trim("entry_id") != ""))
    return good.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def merge_snapshot(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Upserts the current messages and prunes those that are gone: the current snapshot, with the
    time at which each identity was first stored."""
    keys = ["store_id", "entry_id"]
    known = stored.select(*keys, F.col("first_seen").alias("_seen"))
    return deduped(current).join(known, keys, "left").withColumn("first_seen", F.coalesce("_seen", "ts")).drop("_seen")


def documents(messages: DataFrame) -> DataFrame:
    """Messages as documents of one field, for the index."""
    return messages.select(
        F.xxhash64("store_id", "entry_id").alias("doc_id"), F.lit("").alias("name"), F.lit("mail").alias("extension"), tx.mail_identity_path(F.col("store_id"), F.col("entry_id")).alias("path_key"),
        F.concat_ws("\n", "subject", "sender", "folder", "body").alias("text"), "ts",
    )


def searchable(messages: DataFrame, terms: DataFrame | None = None) -> ix.Index:
    """The index of messages; with terms, the part that a batch of queries reads."""
    return ix.build(documents(messages), terms)


def status(messages: DataFrame, valid: DataFrame) -> DataFrame:
    return messages.agg(F.count("*").alias("total")).crossJoin(valid.agg(F.count("*").alias("stored"), F.max("ts").alias("last_message"))).withColumn("skipped", F.col("total") - F.col("stored"))
