"""The running stream against the batch rounds, and its restart from a checkpoint."""

import time

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.plans import reconcile
from corpusloom.streaming.loop import CHANGES, Loop, file_queue


def changes(spark, *rows):
    return spark.createDataFrame([(f"d:\\{n}", f"D:\\{n}", n, n.rsplit(".", 1)[-1], f, 1, c) for n, f, c in rows], CHANGES)


def until(query, done, seconds=120):
    end = time.time() + seconds
    while not done() and time.time() < end:
        assert query.isActive, query.exception()
        time.sleep(0.3)
    assert done()


def test_stream_reaches_the_state_of_the_rounds(spark, tmp_path):
    table = f"file://{tmp_path}/contents"
    bodies = {"a.txt": b"alpha", "b.md": b"# beta", "bad.txt": b"\xff\xfe\x00\xd8\x80", "p.pdf": b"page", "old.docx": b"no"}

    def put():
        spark.createDataFrame([(f"D:\\{n}", bytearray(c)) for n, c in bodies.items()], "path string, content binary").write.mode("overwrite").parquet(table)

    put()
    loop = Loop(spark, f"file://{tmp_path}/loop", lambda leased: spark.read.parquet(table), delays=[0.5, 0.5, 0.5])
    loop.submit(changes(spark, ("a.txt", "1", "new"), ("b.md", "1", "new"), ("bad.txt", "1", "new"), ("p.pdf", "1", "new"), ("gone.txt", "1", "new")))
    query = loop.start(processingTime="1 second")
    failed = lambda: {(r.path_key[3:], r.error_code, r.attempts) for r in loop.failures().collect()}
    until(query, lambda: failed() == {("bad.txt", "UNSUPPORTED_ENCODING", 1), ("p.pdf", "OCR_REQUIRED", 3)})
    loop.stop(query)
    assert loop.queue().count() == 0 and {r.path_key[3:] for r in loop.documents().collect()} == {"a.txt", "b.md"}
    first = loop.index.version().number

    # while it is down: a changes, b goes, bad is mended, one comes; the same version again changes nothing
    bodies |= {"a.txt": b"omega", "bad.txt": b"mended", "c.txt": b"new"}
    put()
    loop.submit(changes(spark, ("a.txt", "2", "changed"), ("b.md", "1", "removed"), ("bad.txt", "2", "changed"), ("c.txt", "1", "new"), ("old.docx", "1", "new")))
    again = Loop(spark, f"file://{tmp_path}/loop", lambda leased: spark.read.parquet(table), delays=[0.5, 0.5, 0.5])
    query = again.start(processingTime="1 second")
    until(query, lambda: {r.path_key[3:]: r.text for r in again.documents().collect()} == {"a.txt": "omega", "bad.txt": "mended", "c.txt": "new"} and ("old.docx", "CORRUPT_DOCUMENT", 1) in failed())
    loop.stop(query)
    assert failed() == {("p.pdf", "OCR_REQUIRED", 3), ("old.docx", "CORRUPT_DOCUMENT", 1)} and again.queue().count() == 0
    assert again.index.version().number > first

    # the batch rounds end with the same files
    at = lambda text: F.lit(text).cast("timestamp")
    state = reconcile.empty(spark)
    files = spark.createDataFrame([(f"d:\\{n}", f"D:\\{n}", n, n.rsplit(".", 1)[-1]) for n in ("a.txt", "bad.txt", "c.txt", "p.pdf", "old.docx")], "path_key string, full_path string, name string, extension string")
    state.queue = files.select("path_key", F.lit("2").alias("fingerprint"), F.lit(1).alias("priority"), F.lit(2).alias("attempts"), at("2024-01-01").alias("next_attempt_at"), F.lit("pending").alias("state"))
    end = reconcile.processed(state, files, spark.read.parquet(table), at("2024-01-02"), 10)
    assert {(r.path_key, r.text) for r in end.index.documents.collect()} == {(r.path_key, r.text) for r in again.documents().collect()}
    assert {(r.path_key[3:], r.error_code) for r in end.failures.collect()} == {x[:2] for x in failed()} and end.queue.count() == 0


def test_a_file_in_its_queue(spark, tmp_path):
    """A file without success waits for its next attempt, and a new version takes its place."""
    table = f"file://{tmp_path}/contents"
    spark.createDataFrame([("D:\\p.pdf", bytearray(b"x"))], "path string, content binary").write.parquet(table)
    loop = Loop(spark, f"file://{tmp_path}/loop", lambda leased: spark.read.parquet(table), delays=[3600.0])
    loop.submit(changes(spark, ("p.pdf", "1", "new")))
    query = loop.start(processingTime="1 second")
    until(query, lambda: [(r.fingerprint, r.attempts) for r in loop.queue().collect()] == [("1", 1)])
    loop.submit(changes(spark, ("p.pdf", "1", "changed"), ("p.pdf", "2", "changed")))
    until(query, lambda: [(r.fingerprint, r.attempts) for r in loop.queue().collect()] == [("2", 1)])
    loop.submit(changes(spark, ("p.pdf", "2", "removed")))
    until(query, lambda: loop.queue().count() == 0 and loop.failures().count() == 0)
    loop.stop(query)


class Held:
    """A part's state without a stream."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.now, self.wait = None, False, False, 1000, None

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.get, self.exists, self.wait = value, True, None

    def remove(self):
        self.get, self.exists, self.wait = None, False, None

    def setTimeoutDuration(self, wait):
        self.wait = wait


def test_one_call_works_on_many_files():
    """The files of a part share a call and a timer: calls do not grow with the files."""
    columns = ["path_key", "full_path", "name", "extension", "fingerprint", "priority", "change", "attempts", "terminal"]
    state, step = Held(), file_queue([2.0, 5.0])

    def call(*rows):
        made = list(step((0,), iter([pd.DataFrame(rows, columns=columns)]), state))
        return [tuple(r) for f in made for r in f[["path_key", "fingerprint", "attempts", "action"]].itertuples(index=False)]

    new = lambda k, f, change="new": (f"p{k}", f"P{k}", f"n{k}", "txt", f, 1, change, None, None)
    outcome = lambda k, f, attempts, terminal: (f"p{k}", None, None, None, f, None, "outcome", attempts, terminal)
    assert call(*(new(k, "1") for k in range(1000))) == [(f"p{k}", "1", 0, "lease") for k in range(1000)]
    assert state.wait is None and len(state.get[0]) == 1000
    # most are done, two wait, one outcome is of an older version, one file goes
    assert call(new(3, "2", "changed"), *(outcome(k, "1", 1, k > 2) for k in range(1000) if k != 4), new(4, "1", "removed"), outcome(4, "1", 1, False)) == [("p3", "2", 0, "lease"), ("p4", "1", 0, "remove")]
    assert sorted(state.get[0]) == ["p0", "p1", "p2", "p3"] and state.wait == 2000
    state.now = 2000
    assert call(outcome(3, "1", 1, True)) == [] and state.wait == 1000  # the timer goes on
    state.now, state.hasTimedOut = 3000, True
    assert call() == [(f"p{k}", "1", 1, "lease") for k in range(3)] and state.wait is None
    state.hasTimedOut = False
    assert call(*(outcome(k, "1", 2, k > 0) for k in range(3)), outcome(3, "2", 1, True)) == [] and state.get[0] == ["p0"] and state.wait == 5000
    assert call(outcome(0, "1", 2, True), new(0, "1", "removed")) == [("p0", "1", 0, "remove")] and not state.exists


def test_stop_does_not_wait_for_a_pause():
    """Micro-batches of timers may follow each other without a pause; the end of the one that runs is enough."""

    class Busy:
        isActive, status, batch, stopped = True, {"isTriggerActive": True}, 0, False

        @property
        def lastProgress(self):
            self.batch += 1
            return {"batchId": self.batch // 20}

        def stop(self):
            self.stopped = True

    busy, began = Busy(), time.monotonic()
    Loop.stop(busy, 30)
    assert busy.stopped and time.monotonic() - began < 10
