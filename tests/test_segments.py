"""Decisions, scans, index segments and impact blocks against what a fresh index gives."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import impacts, retrieve
from corpusloom.operators import index as ix
from corpusloom.operators.commits import Conflict, Decisions
from corpusloom.operators.segments import FANOUT, SegmentedIndex
from corpusloom.operators.snapshots import SnapshotStore

DOCUMENTS = "doc_id long, name string, extension string, path_key string, text string"
WORDS = [f"w{k}" for k in range(40)]


def documents(spark, rows):
    return spark.createDataFrame([(i, f"doc{i}.txt", "txt", f"d:\\doc{i}.txt", t) for i, t in rows], DOCUMENTS)


def text(seed, n=None):
    r = random.Random(seed)
    return " ".join(WORDS[min(int(r.expovariate(0.15)), 39)] for _ in range(n or r.choice([3, 10, 40, 200])))


def asked(spark):
    return spark.createDataFrame([(1, "w0 w1"), (2, "w30"), (3, "w2 w2 w9"), (4, "w0"), (5, "none w0"), (6, "doc7"), (7, ""), (8, "w3-w4")], "query_id int, query string")


def page(frame):
    return sorted((r.query_id, r["rank"], r.path_key, r.score) for r in frame.collect())


def test_one_decision_each(spark, tmp_path):
    decisions = Decisions(spark, f"file://{tmp_path}/d")
    won = []
    writers = [threading.Thread(target=lambda k=k: won.append(k) if decisions.decide("one", writer=k) else None) for k in range(8)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(won) == 1 and decisions.read("one") == {"writer": won[0]} and decisions.names() == ["one"]
    assert decisions.read("two") is None and not decisions.decide("one", writer=9)


def test_scans_are_decided_once(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/scans")
    rows = lambda *pairs: spark.createDataFrame(pairs, "path_key string, fingerprint string")
    with pytest.raises(ValueError):
        store.commit(1)
    mine, other = store.stage(1, rows(("a", "1"), ("a", "2"))), store.stage(1, rows(("b", "1")))
    assert store.state(1) == "staging" and store.state(2) is None
    with pytest.raises(ValueError):
        store.commit(1)  # which of the two?
    store.commit(1, attempt=other)
    with pytest.raises(Conflict):
        store.commit(1, attempt=mine)
    with pytest.raises(Conflict):
        store.abort(1)
    with pytest.raises(ValueError):
        store.stage(1, rows(("c", "1")))
    assert [tuple(r) for r in store.read(1).collect()] == [("b", "1")]
    store.stage(2, rows(("a", "1")))
    store.abort(2, "x" * 600)
    store.abort(2)
    with pytest.raises(ValueError):
        store.commit(2, rows(("a", "1")))
    with pytest.raises(ValueError):
        store.read(2)
    store.commit(3, rows())
    assert {(r.scan_id, r.state, len(r.reason or "")) for r in store.states().collect()} == {(1, "committed", 0), (2, "aborted", 500), (3, "committed", 0)}
    assert store.committed() == [1, 3] and store.read(3).count() == 0 and [tuple(r) for r in store.diff(1, 3).collect()] == [("b", "removed")]


def test_segments_equal_a_fresh_index(spark, tmp_path):
    store = SegmentedIndex(spark, f"file://{tmp_path}/i")
    now = {k: text(k) for k in range(60)}
    assert store.apply(gone=documents(spark, [(1, "")])) == 0
    store.apply(documents(spark, now.items()))
    sizes = []
    for k in range(1, 6):
        changed = {i: text(1000 * k + i) for i in (k, 2 * k, 60 + k)}
        gone = [10 + k, 60 + k - 1, 500]
        for i in gone:
            now.pop(i, None)
        now |= changed
        number = store.apply(documents(spark, changed.items()), documents(spark, [(i, "") for i in gone]))
        sizes.append(store._stored("postings", [store.version().segments[-1]["name"]]).count())
        if k == 4:
            number = store.compact()
        assert store.version().number == number
        fresh, stored = ix.build(documents(spark, now.items())), store.index()
        assert stored.corpus.first() == fresh.corpus.first() and stored.stats.count() == len(now)
        if k in (2, 5):
            assert page(retrieve.search(stored, asked(spark))) == page(retrieve.search(fresh, asked(spark)))
            terms = ["w0", "w1", "w30"]
            assert page(retrieve.search(store.index(terms=terms), asked(spark).filter("query_id < 3"))) == page(retrieve.search(fresh, asked(spark).filter("query_id < 3")))
    assert max(sizes) < 0.2 * store.index().postings.count()  # a round writes what changed
    assert len(store.version().segments) < 6
    old = store.version(1)
    assert len(store.vacuum()) >= len(old.segments)
    assert page(retrieve.search(store.index(), asked(spark))) == page(retrieve.search(ix.build(documents(spark, now.items())), asked(spark)))


def test_a_path_keeps_its_id(spark, tmp_path):
    store = SegmentedIndex(spark, f"file://{tmp_path}/i")
    one = documents(spark, [(1, "alpha"), (2, "beta")])
    store.apply(one)
    moved = spark.createDataFrame([(77, "doc1.txt", "txt", "d:\\doc1.txt", "gamma", 1), (78, "doc1.txt", "txt", "d:\\doc1.txt", "delta", 2)], DOCUMENTS + ", indexed_at int")
    store.apply(moved.drop("indexed_at"))
    assert {r.path_key: (r.doc_id, r.text) for r in store.index().documents.collect()} == {"d:\\doc1.txt": (1, "delta"), "d:\\doc2.txt": (2, "beta")}
    store.apply(one.limit(0))
    store.apply(gone=one)
    assert store.index().documents.count() == 0 and store.index().postings.count() == 0 and store.index().corpus.first().n_docs == 0


def test_overtaken_round_is_made_again(spark, tmp_path, monkeypatch):
    mine, other = (SegmentedIndex(spark, f"file://{tmp_path}/i") for _ in range(2))
    mine.apply(documents(spark, [(1, "alpha")]))
    propose, first = mine.versions.propose, []

    def late(number, **content):
        if not first:
            first.append(other.apply(documents(spark, [(2, "beta")])))
        propose(number, **content)

    monkeypatch.setattr(mine.versions, "propose", late)
    assert mine.apply(documents(spark, [(1, "gamma")])) == 3
    assert {r.text for r in other.index().documents.collect()} == {"beta", "gamma"}


def test_compaction_is_by_size():
    from corpusloom.operators.segments import Version

    some = lambda *sizes: Version(1, [{"docs": n} for n in sizes], sum(sizes), 0)
    assert SegmentedIndex._mergeable(some(1000, 1, 1)) == []
    assert len(SegmentedIndex._mergeable(some(1000, *[1] * FANOUT))) == FANOUT
    assert len(SegmentedIndex._mergeable(Version(1, [{"docs": 10}, {"docs": 9}], 5, 0))) == 2


@pytest.mark.parametrize("field", [None, ix.BODY, ix.TITLE])
def test_blocks_equal_plain_search(spark, field, tmp_path):
    index = ix.build(documents(spark, [(i, text(i)) for i in range(400)] + [(900, None), (901, "")]))
    made = impacts.build(index, block=8)
    stored = impacts.Impacts(impacts.write(made, f"file://{tmp_path}/b"), index)
    for limit, offset in ((3, 1), (500, 0)):
        assert page(impacts.search(stored, asked(spark), limit, offset, field)) == page(retrieve.search(index, asked(spark), limit, offset, field))


def test_blocks_are_skipped(spark):
    index = ix.build(documents(spark, [(i, text(i)) for i in range(2000)]))
    made = impacts.build(index, block=16)
    one = spark.createDataFrame([(1, "w16 w20"), (2, "w25")], "query_id int, query string")
    reached = impacts.bounds(made, one)
    first = impacts.first_blocks(reached, 10)
    early = impacts.score(made, first)
    late = impacts.needed_blocks(reached, first, early, 10)
    every, read = reached.count(), first.count() + late.count()
    assert every > 50 and read < 0.7 * every
    assert late.filter("query_id = 2").isEmpty() and first.filter("query_id = 2").count() < 0.5 * reached.filter("query_id = 2").count()
    # no document of a block scores above its bound
    for r in reached.orderBy("block").limit(6).collect():
        some = impacts.score(made, reached.filter((F.col("block") == r.block) & (F.col("query_id") == r.query_id)))
        assert (some.agg(F.max("score")).first()[0] or 0) <= r.bound + impacts.SLACK


def test_older_snapshots_are_moved_aside_and_built_again(spark, tmp_path):
    docs = documents(spark, [(i, text(i)) for i in range(30)])
    root = ix.write(ix.build(docs), f"file://{tmp_path}/x", 3)
    assert ix.schema_of(spark, root) == ix.SCHEMA_VERSION
    want = page(retrieve.search(ix.load(spark, root), asked(spark)))
    spark.range(1).select(F.lit(3).alias("version")).write.mode("overwrite").parquet(f"{root}/committed")
    spark.range(1).write.mode("overwrite").parquet(f"{root}/postings")
    with pytest.raises(ValueError, match="INDEX_SCHEMA"):
        ix.load(spark, root)
    assert page(retrieve.search(ix.opened(spark, root), asked(spark))) == want
    assert (tmp_path / "x" / "v=3.legacy-1" / "documents").is_dir()
    # interrupted after the move: what was begun is made again from the copy
    Decisions(spark, root).delete(root)
    assert page(retrieve.search(ix.opened(spark, root), asked(spark))) == want
    assert page(retrieve.search(ix.opened(spark, root), asked(spark))) == want


def test_postings_are_made_of_bounded_parts(monkeypatch):
    """However many rows a batch has, a part of it has TOKENS tokens at most, or one row."""
    import pyarrow as pa

    from corpusloom.operators import index as ix

    monkeypatch.setattr(ix, "TOKENS", 5)
    terms = [["a", "b", "a"], [], ["c"] * 4, None, ["a"] * 12, ["b", "c"], ["c"]]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "field": ["body"] * 7, "terms": pa.array(terms, pa.list_(pa.string()))})
    made = list(ix._grouped([batch]))
    assert [sum(b.column("tf").to_pylist()) for b in made] == [3, 4, 12, 3]
    rows = [tuple(r.values()) for b in made for r in b.to_pylist()]
    want = [(i, "body", t, ts.count(t), [k for k, x in enumerate(ts) if x == t]) for i, ts in enumerate(terms) if ts for t in dict.fromkeys(ts)]
    assert sorted(rows) == sorted(want)
