"""Batches that are answered where documents are read: same rows as by joins, and no shuffle of tokens."""

import pytest

from corpusloom.functions import text as tx
from corpusloom.operators import batch as bt
from corpusloom.operators import index as ix
from corpusloom.operators import retrieve

DOCS = "doc_id long, name string, extension string, path_key string, text string"
TEXTS = ["alpha beta gamma", "beta alpha beta-gamma", None, "", "alpha " * 40 + "beta", "日本語 alpha", "本日 語 beta gamma delta", "gamma gamma alpha beta", "Éa beta ea", "alpha-beta alpha-beta"]
ASKED = [(1, "alpha beta"), (2, "beta-gamma"), (3, "日本語"), (4, "gamma"), (5, "missing alpha"), (6, " "), (7, "ea ÉA."), (8, "alpha-beta alpha"), (9, "d3.txt"), (10, "a-a-a"), (11, "beta beta-gamma-delta")]


@pytest.fixture
def built(spark):
    return ix.build(spark.createDataFrame([(i, f"d{i}.txt", "txt", f"c:\\d{i}.txt", t) for i, t in enumerate([*TEXTS, "a a a a b a a a"])], DOCS))


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(ASKED, "query_id int, query string")


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("field", [None, ix.TITLE, ix.BODY])
def test_same_rows_as_by_joins(built, asked, field):
    by_joins = ix.Index(built.postings, built.stats, built.corpus, built.documents)
    want = rows(retrieve.matching(by_joins, asked, field))
    assert want and rows(retrieve.matching(built, asked, field)) == want
    allowed = built.documents.filter("doc_id % 3 <> 1")
    for limit, offset, some in ((1, 1, None), (2, 0, allowed)):
        want = rows(retrieve.search(by_joins, asked, limit, offset, field, some))
        assert rows(retrieve.search(built, asked, limit, offset, field, some)) == want


@pytest.mark.parametrize("most", [1, 7])
def test_small_parts_and_ties(built, asked, monkeypatch, most):
    """Rows of several parts, each with ties: none is lost at the cut."""
    by_joins = ix.Index(built.postings, built.stats, built.corpus, built.documents)
    want = rows(retrieve.search(by_joins, asked, 2))
    monkeypatch.setattr(ix, "TOKENS", most)
    monkeypatch.setattr(bt, "PAIRS", most)
    assert rows(retrieve.search(built, asked, 2)) == want


def test_no_shuffle(built, asked):
    """Matches leave the task where a document is read; tokens and hits of a term never meet in one."""
    assert "Exchange" not in plan(retrieve.matching(built, asked))
    page = plan(retrieve.search(built, asked, 3))
    assert "posexplode" not in page and "collect_list(pos" not in page


def test_names_come_with_the_hits(spark, built, asked):
    """The names of all documents are not joined with scores: no task sorts them. Rows without an id are left out, as by joins."""
    page = retrieve.search(built, asked, 3)
    assert "Join" not in plan(page).replace("BroadcastNestedLoopJoin", "", 1)  # one: the row of weights
    more = ix.build(built.documents.unionByName(spark.createDataFrame([(None, "none", "txt", "c:\\none", "alpha beta")], DOCS)))
    found = retrieve.search(more, asked, 20).collect()
    assert found and all(r.doc_id is not None and r.name == f"d{r.doc_id}.txt" and r.path_key == "c:\\" + r.name for r in found)


def test_texts_stay_where_they_are_read(built, asked, monkeypatch):
    """A small page goes to the texts, whatever their size; of a page that may be large Spark chooses."""
    page = retrieve.search(built, asked, 3).select("query_id", "rank", "doc_id")
    texts = built.documents.select("doc_id", "text")
    want = rows(page.join(texts, "doc_id"))
    found = retrieve.with_texts(page, texts, asked, 3)
    sent = lambda frame: frame._jdf.queryExecution().analyzed().toString().count("ResolvedHint (strategy=broadcast)")
    assert sent(found) == sent(page) + 1 and "BroadcastHashJoin" in plan(found)
    assert want and rows(found) == want
    for name, most in (("SENT", 3 * len(ASKED) - 1), ("SENT_CHARACTERS", 100)):
        with monkeypatch.context() as m:
            m.setattr(retrieve, name, most)
            large = retrieve.with_texts(page, texts, asked, 3)
            assert sent(large) == sent(page)
            assert rows(large) == want
    assert rows(retrieve.with_texts(page.limit(0), texts, asked.limit(0), 3)) == []


def test_large_batch_goes_by_joins(built, asked, monkeypatch):
    want = rows(retrieve.search(built, asked, 3))
    monkeypatch.setattr(bt, "MOST", 3)
    assert bt.gathered(retrieve.parsed(asked)) is None
    assert rows(retrieve.search(built, asked, 3)) == want


def test_empty_batch_and_corpus(spark, built, asked):
    assert rows(retrieve.search(built, asked.filter("query_id = 6"), 3)) == rows(retrieve.matching(built, asked.limit(0))) == []
    empty = ix.build(built.documents.limit(0))
    assert rows(retrieve.search(empty, asked, 3)) == rows(retrieve.matching(empty, asked)) == []


def test_folding_looks_at_distinct_characters():
    """A text of ideographs is given back as it is, not mapped character by character."""
    text = "日本語" * 1000
    assert tx.folded(text) is text and tx.folded(text + "é") == text + "e"


def test_postings_of_terms_are_made_where_a_row_is_read(spark, built, monkeypatch):
    terms = spark.createDataFrame([("alpha",), ("a",), ("missing",)], "term string")
    made = ix.document_postings(built.documents, terms)
    assert "Exchange" not in plan(made)
    monkeypatch.setattr(ix, "TERMS", 2)
    assert rows(made.withColumn("positions", made["positions"].cast("string"))) == rows((by_join := ix.document_postings(built.documents, terms)).withColumn("positions", by_join["positions"].cast("string")))


def test_parts_of_a_bucket_grow_with_the_tokens(spark):
    stats = spark.createDataFrame([(1, 1, 0), (2, 4, ix.BUCKETS * ix.PART * 9)], "doc_id long, title_len long, body_len long")
    assert ix.parts_of(stats) == 10 and ix.parts_of(stats.limit(1)) == 4


def test_rows_pass_by_the_ids_taken_out(spark, tmp_path, built, monkeypatch):
    """Beyond GONE ids no sort of all stored rows."""
    from corpusloom.operators import segments

    store = segments.SegmentedIndex(spark, f"file://{tmp_path}/i")
    store.apply(built.documents)
    store.apply(gone=built.documents.filter("doc_id % 2 = 0"))
    want = rows(store.index().postings.select("doc_id", "term", "field", "tf"))
    monkeypatch.setattr(segments, "GONE", 1)
    frame = store.index().postings.select("doc_id", "term", "field", "tf")
    assert want and rows(frame) == want and "ShuffledHashJoin" in plan(frame)
