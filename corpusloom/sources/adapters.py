"""Deterministic adapters from the stored tables to the engine's schemas.

A file catalog, a mailbox and a feedback log do not exist as tables; they are projections of
``documents``, ``conversations`` and ``events``, so every engine operator can run at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

SEPARATOR = "\\"
EXTENSIONS = ["txt", "md", "docx", "pdf", "tmp", "log", "dll", "json"]
DIRECTORIES = ["notes", "node_modules", "Temp", "build", "Templates", "AppData", ".git", "docs", "$Recycle.Bin", "archive", "Downloads"]
ATTRIBUTES = [32, 2, 4, 256, 1024, 32, 32]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(values: list, number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (number % len(values)).cast("int") + 1)


def _named(docs: DataFrame) -> DataFrame:
    extension = pick(EXTENSIONS, F.col("doc_id"))
    parent = F.concat(F.lit("D:" + SEPARATOR), F.col("source"), F.lit(SEPARATOR), pick(DIRECTORIES, F.col("doc_id")))
    return docs.withColumns({
        "extension": extension,
        "name": F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), extension),
        "parent_path": parent,
    })


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document as a file of the catalog."""
    docs = _named(read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))
    path = F.concat(F.col("parent_path"), F.lit(SEPARATOR), F.col("name"))
    return docs.select(
        "doc_id", "name", path.alias("full_path"), "parent_path", "extension", F.lit("file").alias("kind"), F.col("n_chars").alias("size"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("doc_id").cast("int"))).alias("modified_at"),
        pick(ATTRIBUTES, F.col("doc_id")).alias("attributes"), F.lower(path).alias("path_key"),
    )


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct parents of all files."""
    parents = files(spark, sf_dir).select("parent_path").distinct()
    return parents.select(
        F.element_at(F.split("parent_path", r"\\"), -1).alias("name"), F.col("parent_path").alias("full_path"),
        F.regexp_extract("parent_path", r"^(.*)\\[^\\]*$", 1).alias("parent_path"), F.lit("").alias("extension"), F.lit("folder").alias("kind"),
        F.lit(None).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified_at"), F.lit(16).alias("attributes"), F.lower("parent_path").alias("path_key"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).drop("doc_id").unionByName(folders(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indexed corpus: doc_id, name, extension, path_key, text."""
    docs = _named(read(spark, sf_dir, "documents"))
    return docs.select("doc_id", "name", "extension", F.lower(F.concat("parent_path", F.lit(SEPARATOR), "name")).alias("path_key"), "text")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return rows.select(
        F.col("conv_id").cast("string").alias("store_id"), F.col("turn").cast("string").alias("entry_id"), F.substring("text", 1, 40).alias("subject"), F.col("role").alias("sender"),
        F.when(F.col("role") == "user", "Inbox").otherwise("Sent").alias("folder"), F.col("text").alias("body"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=(F.col("conv_id") * 7 + F.col("turn")).cast("int"))).alias("ts"),
    )


#: Which action an event type stands for; ``error`` is feedback of the content mode, which is ignored.
ACTIONS = {"purchase": "Open", "signup": "CopyReference", "click": "Locate", "view": "PreviewConfirmed"}


def feedback(events: DataFrame, n_docs: Column | int) -> DataFrame:
    """Feedback rows of an events table, batch or stream."""
    action = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    return events.select(
        "event_id", (F.col("event_id") % n_docs).alias("doc_id"), action[F.col("event_type")].alias("action"),
        F.when(F.col("event_type") == "error", "Content").otherwise("Hybrid").alias("mode"), (F.col("event_id") % 2 == 0).alias("previewed"), F.col("ts").cast("timestamp").alias("ts"),
    )


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line (1-based), text: every seventh line is a first-level heading, every third a second-level one."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\r\n|\r|\n", -1)).alias("i", "raw"))
    text = F.when(F.col("i") % 7 == 0, F.concat(F.lit("# "), "raw")).when(F.col("i") % 3 == 0, F.concat(F.lit("## "), "raw")).otherwise(F.col("raw"))
    return lines.select("doc_id", (F.col("i") + 1).alias("line"), text.alias("text"))
