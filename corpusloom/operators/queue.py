"""Snapshots and the work queue, as joins of immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import at_ranks

MAX_ATTEMPTS = 3
#: Minutes before the next attempt, by attempts made.
DELAYS = [1, 10, 60]
PERMANENT = ["CORRUPT_DOCUMENT", "UNSUPPORTED_OR_ENCRYPTED_DOCUMENT", "UNSUPPORTED_FILE_TYPE", "UNSUPPORTED_ENCODING", "FILE_TOO_LARGE", "EXTRACTION_TIMEOUT", "ACCESS_DENIED"]
LISTED = 200


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path_key, change) between two scans (path_key, fingerprint)."""
    a, b = before.select("path_key", F.col("fingerprint").alias("old")), after.select("path_key", F.col("fingerprint").alias("new"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return a.join(b, "path_key", "full_outer").select("path_key", change.alias("change"))


def removed(stored: DataFrame, scan: DataFrame) -> DataFrame:
    return stored.join(scan, "path_key", "left_anti")


def kept(stored: DataFrame, scan: DataFrame) -> DataFrame:
    return stored.join(scan, "path_key", "left_semi")


def to_enqueue(candidates: DataFrame, documents: DataFrame, failures: DataFrame) -> DataFrame:
    """Candidates whose version is neither indexed nor failed for good."""
    keys = ["path_key", "fingerprint"]
    return candidates.join(documents.select(keys), keys, "left_anti").join(failures.select(keys), keys, "left_anti")


def upsert(queue: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """Incoming rows (path_key, fingerprint, priority) over the queue: attempts and due time stay for
    the same version; every row is pending."""
    old = queue.select("path_key", F.col("fingerprint").alias("o_f"), F.col("priority").alias("o_p"), F.col("attempts").alias("o_a"), F.col("next_attempt_at").alias("o_n"), F.col("state").alias("o_s"))
    new = incoming.select("path_key", "fingerprint", "priority")
    both = new.withColumn("fresh", F.lit(True)).join(old, "path_key", "full_outer")
    same = F.col("fingerprint") == F.col("o_f")
    fresh = F.col("fresh").isNotNull()
    return both.select(
        "path_key", F.coalesce("fingerprint", "o_f").alias("fingerprint"), F.coalesce("priority", "o_p").alias("priority"),
        F.when(fresh & ~F.coalesce(same, F.lit(False)), 0).otherwise(F.col("o_a")).alias("attempts"),
        F.when(fresh & ~F.coalesce(same, F.lit(False)), as_of).otherwise(F.col("o_n")).alias("next_attempt_at"),
        F.when(fresh, "pending").otherwise(F.col("o_s")).alias("state"),
    )


def lease(queue: DataFrame, as_of: Column, n: int) -> DataFrame:
    """The first n that are due, by priority and id."""
    due = queue.filter((F.col("state") == "pending") & (F.col("next_attempt_at") <= as_of))
    return due.orderBy("priority", "id").limit(n).withColumn("state", F.lit("processing"))


def retry_failures(queue: DataFrame, failures: DataFrame, paths: DataFrame | None, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Queue and failures after failed paths (all, or the given path_key rows) are to be tried afresh."""
    again = failures if paths is None else failures.join(paths, "path_key", "left_semi")
    fresh = again.select("path_key", "fingerprint", F.lit(1).alias("priority"))
    return upsert(queue.join(again.select("path_key"), "path_key", "left_anti"), fresh, as_of), failures.join(again.select("path_key"), "path_key", "left_anti")


def recover(queue: DataFrame) -> DataFrame:
    return queue.withColumn("state", F.lit("pending"))


def after_failure(leased: DataFrame, as_of: Column) -> DataFrame:
    """Leased rows with an error_code: terminal after the third attempt or a permanent error, else due
    again after the delay of the attempts made."""
    made = F.col("attempts") + 1
    terminal = (made >= MAX_ATTEMPTS) | F.col("error_code").isin(PERMANENT)
    minutes = F.element_at(F.array(*(F.lit(d) for d in DELAYS)), F.least(made, F.lit(len(DELAYS))))
    kept = [c for c in ("path_key", "fingerprint", "priority", "error_code") if c in leased.columns]
    return leased.select(*kept, made.alias("attempts"), terminal.alias("terminal"), F.when(~terminal, as_of + F.make_interval(mins=minutes)).alias("next_attempt_at"))


def status_counts(documents: DataFrame, queue: DataFrame, failures: DataFrame) -> DataFrame:
    """(measure, n): five groups of failures, the queue by state, the documents."""
    group = (
        F.when(F.col("error_code").isin("UNSUPPORTED_FILE_TYPE", "UNSUPPORTED_ENCODING", "OCR_REQUIRED"), "unsupported")
        .when(F.col("error_code") == "FILE_TOO_LARGE", "too_large")
        .when(F.col("error_code") == "ACCESS_DENIED", "access_denied")
        .when(F.col("error_code") == "CORRUPT_DOCUMENT", "corrupt")
        .otherwise("other")
    )
    rows = failures.select(F.concat(F.lit("failed:"), group).alias("measure")).unionAll(queue.select(F.concat(F.lit("queue:"), "state").alias("measure"))).unionAll(documents.select(F.lit("documents").alias("measure")))
    return rows.groupBy("measure").agg(F.count("*").alias("n"))


def failures_list(failures: DataFrame) -> DataFrame:
    return failures.orderBy(F.col("failed_at").desc(), "path_key").limit(LISTED)


def latency(samples: DataFrame) -> DataFrame:
    """min, median (mean of the middle two), nearest-rank p95 and max of duration_ms, found by counting."""
    wanted = lambda n: (0, (n - 1) // 2, n // 2, -(-n * 95 // 100) - 1, n - 1)
    _, found = at_ranks(samples, "duration_ms", wanted)
    least, lower, upper, p95, most = found or [None] * 5
    row = (least, None if lower is None else (lower + upper) / 2, p95, most)
    return samples.sparkSession.createDataFrame([row], "min_ms double, median_ms double, p95_ms double, max_ms double")
