"""The index kept up to date by a running stream.

Changes of scanned files come in as a stream of rows. The files' queue entries are keyed state (``applyInPandasWithState``): a new
version is leased at once, a failed one again when its timer says so, a removed one not at all. Leases of a
micro-batch are read, indexed as one segment and answered by outcomes, which are a second source of the
same stream. Everything a micro-batch does can be done again: outcomes that do not fit the state are
ignored, documents are upserts, and what the batch read is written once and read back.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import queue
from ..operators.segments import SegmentedIndex
from ..shipping import ship
from ..sources import extract

#: ``change``: new, changed or removed, as ``queue.snapshot_diff`` tells.
CHANGES = "path_key string, full_path string, name string, extension string, fingerprint string, priority int, change string"
OUTCOMES = "path_key string, fingerprint string, attempts int, error_code string, terminal boolean, failed_at timestamp, next_attempt_at timestamp, batch long"
ACTIONS = "path_key string, full_path string, name string, extension string, fingerprint string, priority int, attempts int, action string"
_STATE = "path_key array<string>, full_path array<string>, name array<string>, extension array<string>, fingerprint array<string>, priority array<int>, attempts array<int>, leased array<boolean>, due array<long>"
_INPUT = "path_key string, full_path string, name string, extension string, fingerprint string, priority int, change string, attempts int, terminal boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_EVENT = ["path_key", "full_path", "name", "extension", "fingerprint", "priority", "change", "attempts", "terminal"]
#: Parts of the queue. One call works on all rows of its part, as a call for each file costs milliseconds.
PARTS = 4096


def file_queue(delays: list[float]) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The step of one part of the queue. Its entries tell of each file what version waits, how often it was tried and when it
    is due again; a file that is done has none."""

    def step(key: tuple, tables: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries = {e[0]: e[1:] for e in zip(*state.get, strict=True)} if state.exists else {}
        now = state.getCurrentProcessingTimeMs()
        events = [] if state.hasTimedOut else [e for table in tables for e in zip(*(table[c].tolist() for c in _EVENT), strict=True)]
        # outcomes of earlier leases first: a change that comes with them is newer
        events.sort(key=lambda e: e[6] != "outcome")
        out = []
        for path, full_path, name, extension, fingerprint, priority, change, attempts, terminal in events:
            held = entries.get(path)
            if change == "outcome":
                if held is not None and held[6] and held[3] == fingerprint and held[5] == attempts - 1:
                    if terminal:
                        del entries[path]
                    else:
                        wait = delays[min(int(attempts), len(delays)) - 1]
                        entries[path] = (*held[:5], int(attempts), False, int(now + 1000 * wait))
            elif change == "removed":
                entries.pop(path, None)
                out.append((path, full_path, name, extension, fingerprint, None, 0, "remove"))
            elif held is None or held[3] != fingerprint:
                entries[path] = (full_path, name, extension, fingerprint, int(priority), 0, True, None)
                out.append((path, *entries[path][:6], "lease"))
        for path, held in entries.items():
            if not held[6] and held[7] <= now:
                entries[path] = (*held[:6], True, None)
                out.append((path, *held[:6], "lease"))
        if entries:
            state.update(tuple(map(list, zip(*((path, *held) for path, held in entries.items()), strict=True))))
            if due := [held[7] for held in entries.values() if not held[6]]:  # a call ends the timer that was set before
                state.setTimeoutDuration(max(1, min(due) - now))
        elif state.exists:
            state.remove()
        if out:
            yield _actions(out)

    return step


def _actions(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ACTIONS.split(", ")]).astype({"priority": "Int32"})


class Loop:
    """The running job below ``root``: its index, its outcomes and its checkpoint. ``contents`` gives (path, content) of the
    leased files (path_key, full_path); a file without content is gone. ``delays`` are the seconds before
    a next attempt, by attempts made."""

    def __init__(self, spark: SparkSession, root: str, contents: Callable[[DataFrame], DataFrame], delays: list[float] | None = None, readers: dict | None = None):
        self.spark, self.root, self.contents, self.readers = spark, root.rstrip("/"), contents, readers
        self.delays = delays or [60.0 * m for m in queue.DELAYS]
        self.index = SegmentedIndex(spark, f"{self.root}/index")
        for table, schema in (("changes", CHANGES), ("outcomes", OUTCOMES)):  # sources must be there before the stream is
            if not self.index.versions.decisions.children(f"{self.root}/{table}"):
                spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.root}/{table}")

    def submit(self, changes: DataFrame) -> None:
        """Adds the changes of one scan (rows of CHANGES) to the stream's source."""
        changes.select(*(c.split()[0] for c in CHANGES.split(", "))).write.mode("append").parquet(f"{self.root}/changes")

    def start(self, **trigger) -> StreamingQuery:
        """Starts or, from its checkpoint, restarts the stream; every 60 seconds unless a trigger is given."""
        ship(self.spark)
        read = lambda table, schema: self.spark.readStream.schema(schema).parquet(f"{self.root}/{table}")
        columns = [c.split()[0] for c in _INPUT.split(", ")]
        missing = lambda frame: frame.select(*[c if c in frame.columns else F.lit(None).cast(dict(x.split() for x in _INPUT.split(", "))[c]).alias(c) for c in columns])
        events = missing(read("changes", CHANGES)).unionByName(missing(read("outcomes", OUTCOMES).withColumn("change", F.lit("outcome"))))
        actions = events.withColumn("part", F.pmod(F.xxhash64("path_key"), F.lit(PARTS))).groupBy("part").applyInPandasWithState(file_queue(self.delays), ACTIONS, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
        stream = actions.writeStream.foreachBatch(self._work).option("checkpointLocation", f"{self.root}/checkpoint").trigger(**(trigger or {"processingTime": "60 seconds"}))
        # entries may be more than memory holds; a stream keeps the settings it was started with, others keep theirs
        before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKSDB)
        try:
            return stream.start()
        finally:
            self.spark.conf.unset(PROVIDER) if before is None else self.spark.conf.set(PROVIDER, before)

    def _work(self, actions: DataFrame, batch: int) -> None:
        """Reads, indexes and answers the leases of one micro-batch."""
        spark = self.spark
        mine = f"{self.root}/work/batch={batch}"
        actions.write.mode("overwrite").parquet(f"{mine}/actions")
        actions = spark.read.schema(ACTIONS).parquet(f"{mine}/actions")
        if actions.isEmpty():
            return
        leased = actions.filter("action = 'lease'")
        wanted = leased.select("path_key", "full_path")
        texts = extract.extract(self.contents(wanted).join(wanted.select(F.col("full_path").alias("path")), "path", "left_semi"), readers=self.readers)
        # read once: index, failures and outcomes must not see different extractions
        leased.join(texts, leased["full_path"] == texts["path"], "left").write.mode("overwrite").parquet(f"{mine}/done")
        done = spark.read.parquet(f"{mine}/done")
        good = done.filter("path is not null and error_code is null")
        documents = good.select(F.xxhash64("path_key").alias("doc_id"), "name", "extension", "path_key", "full_path", "fingerprint", "text", "blocks")
        gone = actions.filter("action = 'remove'").select("path_key").unionByName(done.filter("path is null").select("path_key"))
        self.index.apply(None if good.isEmpty() else documents, gone)
        now = F.current_timestamp()
        made = F.col("attempts") + 1
        failed = F.col("error_code").isNotNull()
        terminal = ~failed | (made >= queue.MAX_ATTEMPTS) | F.col("error_code").isin(queue.PERMANENT)
        wait = F.element_at(F.array(*(F.lit(float(d)) for d in self.delays)), F.least(made, F.lit(len(self.delays))))
        due = F.when(failed & ~terminal, F.timestamp_micros((F.unix_micros(now) + wait * 1_000_000).cast("long")))
        outcomes = done.select("path_key", "fingerprint", made.alias("attempts"), "error_code", terminal.alias("terminal"), F.when(failed, now).alias("failed_at"), due.alias("next_attempt_at"), F.lit(batch).cast("long").alias("batch"))
        removed = actions.filter("action = 'remove'").select("path_key", "fingerprint", F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error_code"), F.lit(True).alias("terminal"), *(F.lit(None).cast("timestamp").alias(c) for c in ("failed_at", "next_attempt_at")), F.lit(batch).cast("long").alias("batch"))
        outcomes.unionByName(removed).write.mode("append").parquet(f"{self.root}/outcomes")

    def drained(self, query: StreamingQuery, files: DataFrame, seconds: float) -> None:
        """Waits until each of the files (path_key, fingerprint) has an outcome of its version and none waits for another attempt."""
        end = time.monotonic() + seconds
        while self.queue().count() or not files.join(self._last(), ["path_key", "fingerprint"], "left_anti").isEmpty():
            if query.exception() is not None:
                raise query.exception()
            if time.monotonic() > end:
                raise TimeoutError("the stream is not done")
            time.sleep(0.5)

    @staticmethod
    def stop(query: StreamingQuery, seconds: float = 60) -> None:
        """Stops once the micro-batch that runs now is over, if that is within the given time. There need not be a pause: timers are
        looked after in micro-batches of their own, which follow each other where they take longer than the trigger."""
        end = time.monotonic() + seconds
        last = lambda: (query.lastProgress or {}).get("batchId")
        before = last()
        while query.isActive and query.status["isTriggerActive"] and last() == before and time.monotonic() < end:
            time.sleep(0.02)
        query.stop()

    # state, as it can be read at any time

    def _last(self) -> DataFrame:
        """The last outcome of each file."""
        newest = Window.partitionBy("path_key").orderBy(F.col("batch").desc(), F.col("attempts").desc())
        rows = self.spark.read.schema(OUTCOMES).parquet(f"{self.root}/outcomes")
        return rows.withColumn("nth", F.row_number().over(newest)).filter("nth = 1").drop("nth")

    def failures(self) -> DataFrame:
        """Files whose last attempt failed: (path_key, fingerprint, error_code, attempts, failed_at)."""
        return self._last().filter("error_code is not null").select("path_key", "fingerprint", "error_code", "attempts", "failed_at")

    def queue(self) -> DataFrame:
        """Files that will be tried again: (path_key, fingerprint, attempts, next_attempt_at)."""
        return self._last().filter("not terminal").select("path_key", "fingerprint", "attempts", "next_attempt_at")

    def documents(self) -> DataFrame:
        return self.index.index().documents
