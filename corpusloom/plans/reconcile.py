"""Keeping an index up to date: one round of scan, queue, extraction and index, as tables in and out.

A round reads the last committed state and gives the next one; nothing is changed in place, so a
round that fails half way leaves the state as it was, and the same round can run again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import index as ix
from ..operators import policy, queue
from ..shared import new_folder
from ..sources import extract

DOCUMENTS = "doc_id long, name string, extension string, path_key string, full_path string, fingerprint string, text string, blocks array<struct<ordinal:int,text:string,label:string,heading_path:string>>"
QUEUE = "path_key string, fingerprint string, priority int, attempts int, next_attempt_at timestamp, state string"
FAILURES = "path_key string, fingerprint string, error_code string, message string, failed_at timestamp"


@dataclass
class State:
    index: ix.Index
    queue: DataFrame
    failures: DataFrame
    paused: bool = False


def empty(spark: SparkSession) -> State:
    return State(ix.build(spark.createDataFrame([], DOCUMENTS)), spark.createDataFrame([], QUEUE), spark.createDataFrame([], FAILURES))


def scanned(state: State, files: DataFrame, exclusions: DataFrame, as_of: Column) -> State:
    """The state after a whole scan: files (as in the catalog) that the policy admits and whose version is
    neither indexed nor failed for good are queued; what the scan no longer admits leaves index, queue
    and failures. An empty scan says that the source is not ready, and changes nothing."""
    if files.isEmpty():
        return state
    judged = policy.evaluate(files, exclusions, as_of, "path_key").filter("accepted").select("path_key", F.col("priority").cast("int").alias("priority"))
    admitted = files.join(judged, "path_key").select("path_key", policy.fingerprint(F.col("full_path"), F.col("size"), F.col("modified_at")).alias("fingerprint"), "priority")
    gone = queue.removed(state.index.documents.select("path_key"), admitted)
    # a failure counts against its version while it is not queued for another attempt
    final = queue.removed(state.failures, state.queue.select("path_key", "fingerprint"))
    fresh = queue.to_enqueue(queue.removed(admitted, state.queue.select("path_key")).unionByName(admitted.join(state.queue.select("path_key", F.col("fingerprint").alias("queued")), "path_key").filter("fingerprint <> queued").drop("queued")), state.index.documents, final)
    waiting = queue.upsert(queue.kept(state.queue, admitted), fresh, as_of)
    index = ix.merged(state.index, state.index.documents.limit(0), gone)
    return replace(state, index=index, queue=waiting, failures=queue.kept(state.failures, admitted))


def processed(state: State, files: DataFrame, contents: DataFrame, as_of: Column, n: int, readers: dict | None = None) -> State:
    """The state after the first n due files were read and indexed. ``contents`` is (path, content); a
    queued file that has none is gone and leaves the index.

    A failure is kept with its code; after the third attempt, or one that no further attempt can mend,
    the file leaves the queue, else it is due again later. A paused state stays as it is.
    """
    if state.paused:
        return state
    facts = files.select("path_key", "full_path", "name", "extension")
    due = queue.lease(state.queue.withColumn("id", F.xxhash64("path_key")), as_of, n).drop("id", "state")
    leased = due.join(facts, "path_key", "left")
    read = extract.extract(contents.join(leased.select(F.col("full_path").alias("path")), "path"), readers=readers)
    done = _once(leased.join(read, leased["full_path"] == read["path"], "left"))
    missing = done.filter("path is null").select("path_key")
    good = done.filter("path is not null and error_code is null")
    bad = done.filter("error_code is not null")
    documents = good.select(F.xxhash64("path_key").alias("doc_id"), "name", "extension", "path_key", "full_path", "fingerprint", "text", "blocks")
    judged = queue.after_failure(bad, as_of)
    again = judged.filter("not terminal").select("path_key", "fingerprint", "priority", "attempts", "next_attempt_at", F.lit("pending").alias("state"))
    waiting = queue.removed(state.queue, due.select("path_key")).select("path_key", "fingerprint", "priority", "attempts", "next_attempt_at", "state")
    failed = bad.select("path_key", "fingerprint", "error_code", tx.truncate_message(F.col("error_code")).alias("message"), as_of.alias("failed_at"))
    settled = queue.removed(state.failures, due.select("path_key")).unionByName(failed)
    return replace(state, index=ix.merged(state.index, documents, missing), queue=waiting.unionByName(again), failures=settled)


def _once(rows: DataFrame) -> DataFrame:
    """What a round has read, written and read back: index, queue and failures see one extraction, which is made once."""
    folder = new_folder(rows.sparkSession, "round")
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def paused(state: State) -> State:
    return replace(state, paused=True)


def resumed(state: State) -> State:
    return replace(state, paused=False)


def round_of(state: State, files: DataFrame, exclusions: DataFrame, contents: DataFrame, as_of: Column, n: int, readers: dict | None = None) -> State:
    """One scan and one batch of work: what a trigger of a stream, or a call to synchronise, does."""
    return processed(scanned(state, files, exclusions, as_of), files, contents, as_of, n, readers)


def saved(state: State, path: str, version: int) -> str:
    """Writes a state; the index's marker comes last, so readers see whole versions only."""
    root = f"{path}/v={version}"
    state.queue.write.mode("overwrite").parquet(f"{root}/queue")
    state.failures.write.mode("overwrite").parquet(f"{root}/failures")
    return ix.write(state.index, path, version)


def loaded(spark: SparkSession, root: str) -> State:
    index = ix.load(spark, root)
    return State(index, spark.read.parquet(f"{root}/queue"), spark.read.parquet(f"{root}/failures"))
