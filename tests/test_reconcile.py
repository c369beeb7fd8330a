"""Rounds of scan, queue, extraction and index against what they must leave."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import queue, retrieve
from corpusloom.plans import reconcile

FILES = "path_key string, full_path string, name string, extension string, kind string, size long, modified_at timestamp, attributes int"


def at(text):
    return F.lit(text).cast("timestamp")


def scan(spark, *rows):
    """Files (name, size) below a folder that the policy admits."""
    made = [(f"d:\\notes\\{n}".lower(), f"D:\\notes\\{n}", n, n.rsplit(".", 1)[-1], "file", size, None, 0) for n, size in rows]
    return spark.createDataFrame(made, FILES).withColumn("modified_at", at("2024-01-01"))


def contents(spark, **texts):
    return spark.createDataFrame([(f"D:\\notes\\{n.replace('_', '.')}", bytearray(t)) for n, t in texts.items()], "path string, content binary")


def names(frame):
    return {r.path_key.rsplit("\\", 1)[-1] for r in frame.collect()}


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "prefix string")


def matches(spark, state, word):
    found = retrieve.matches(retrieve.phrase_hits(state.index, spark.createDataFrame([(1, word)], "query_id int, query string")))
    return names(found.join(state.index.documents, "doc_id"))


def test_rounds(spark, none, tmp_path):
    files = scan(spark, ("a.txt", 5), ("b.md", 6), ("bad.txt", 3), ("gone.txt", 1), ("x.exe", 9))
    texts = contents(spark, a_txt=b"alpha one", b_md="# beta".encode(), bad_txt=b"\xff\xfe\x00\xd8\x80", x_exe=b"alpha")
    start = reconcile.empty(spark)
    queued = reconcile.scanned(start, files, none, at("2024-02-01"))
    assert names(queued.queue) == {"a.txt", "b.md", "bad.txt", "gone.txt"}
    assert reconcile.scanned(queued, files.limit(0), none, at("2024-02-01")) is queued
    assert reconcile.processed(reconcile.paused(queued), files, texts, at("2024-02-01"), 10).index is queued.index
    one = reconcile.processed(reconcile.resumed(queued), files, texts, at("2024-02-01"), 10)
    root = reconcile.saved(one, str(tmp_path), 1)
    one = reconcile.loaded(spark, root)
    assert names(one.index.documents) == {"a.txt", "b.md"} and names(one.queue) == set()
    assert {r.error_code for r in one.failures.collect()} == {"UNSUPPORTED_ENCODING"}
    assert matches(spark, one, "alpha") == {"a.txt"} and matches(spark, one, "beta") == {"b.md"}
    # the same scan again queues only what is still unread: the file that had no content
    assert names(reconcile.scanned(one, files, none, at("2024-02-02")).queue) == {"gone.txt"}
    # a changes, b goes, c comes, bad is mended
    files = scan(spark, ("a.txt", 7), ("bad.txt", 4), ("c.json", 2), ("c.txt", 2))
    texts = contents(spark, a_txt=b"omega", bad_txt=b"mended", c_txt=b"alpha new")
    two = reconcile.round_of(one, files, none, texts, at("2024-02-03"), 10)
    assert names(two.index.documents) == {"a.txt", "bad.txt", "c.txt"} and two.failures.count() == 0
    assert matches(spark, two, "alpha") == {"c.txt"} and matches(spark, two, "omega") == {"a.txt"} and matches(spark, two, "beta") == set()
    ids = lambda s: {r.path_key: r.doc_id for r in s.index.documents.collect()}
    assert ids(one)["d:\\notes\\a.txt"] == ids(two)["d:\\notes\\a.txt"]
    assert two.index.corpus.first().n_docs == 3


def test_failures_come_back_three_times(spark, none):
    files = scan(spark, ("a.docx", 5))
    broken = spark.createDataFrame([("D:\\notes\\a.docx", bytearray(b"x"))], "path string, content binary")
    state = reconcile.scanned(reconcile.empty(spark), files, none, at("2024-02-01"))
    permanent = reconcile.processed(state, files, broken, at("2024-02-01"), 10)
    assert permanent.queue.count() == 0 and permanent.failures.first().error_code == "CORRUPT_DOCUMENT"
    assert names(reconcile.scanned(permanent, files, none, at("2024-02-02")).queue) == set()
    again, left = queue.retry_failures(permanent.queue, permanent.failures, None, at("2024-02-02"))
    assert names(again) == {"a.docx"} and left.count() == 0


def test_temporary_failures_wait(spark, none):
    files = scan(spark, ("a.pdf", 5))
    state = reconcile.empty(spark)
    waiting = spark.createDataFrame([("d:\\notes\\a.pdf", "f", 1, 0, None, "pending")], reconcile.QUEUE).withColumn("next_attempt_at", at("2024-02-01 00:00:00"))
    state.queue = waiting
    body = spark.createDataFrame([("D:\\notes\\a.pdf", bytearray(b"text"))], "path string, content binary")
    for attempt, later in enumerate(("2024-02-01 00:00:00", "2024-02-01 00:01:00", "2024-02-01 00:11:00"), 1):
        assert reconcile.processed(state, files, body, at("2024-01-31"), 10).failures.count() == attempt - 1 > -1 if attempt == 1 else True
        state = reconcile.processed(state, files, body, at(later), 10)
        assert state.failures.count() == 1 and state.failures.first().error_code == "OCR_REQUIRED"
        assert state.queue.count() == (0 if attempt == queue.MAX_ATTEMPTS else 1)
    read = reconcile.processed(reconcile.State(reconcile.empty(spark).index, waiting, state.failures), files, body, at("2024-02-02"), 10, {"pdf": lambda content: content.decode()})
    assert matches(spark, read, "text") == {"a.pdf"} and read.failures.count() == 0
