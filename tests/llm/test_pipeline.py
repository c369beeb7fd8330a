"""The corpus pipeline: what each stage keeps, on the test tables and on odd ones."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ngram_join, packing, secrets, suffix_dedup, toxicity

from .test_operators import joined_by_hand, odd_documents, removed_by_hand

#: Names that operators use inside, and the columns of the table.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "_cls", "_n", "_runs", "_kept", "_name", "cls", "key", "body", "x", "t1", "score", "tie", "part", "hits"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in COLUMNS[5:])


def ids(frame):
    return sorted((r.doc_id for r in frame.select("doc_id").collect()), key=lambda x: (x is None, x))


def table(spark, rows):
    """Rows (doc_id, text) with all columns."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *(c for c in COLUMNS[5:])) for i, t in rows], SCHEMA)


@pytest.fixture
def labelled(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "secret_scan", "best_fit_packing"]
    inputs = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, inputs[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        inputs.append(spark.read.parquet(f"{tmp_path}/{k}"))
    for frame in inputs[1:5]:
        assert frame.columns == columns and frame.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert ids(inputs[1]) == ids(toxicity.score_documents(docs, labels).filter("predicted = 0"))
    assert ids(inputs[2]) == ids(ngram_join.join_documents(inputs[1]).filter("doc_id = component_id"))
    assert ids(inputs[3]) == ids(inputs[2]) and ids(inputs[4]) == ids(inputs[3])
    gone = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(inputs[2]).collect()}
    size = lambda f: {r[0]: r[1] for r in f.select("doc_id", F.octet_length("text")).collect()}
    before, after = size(inputs[2]), size(inputs[3])
    assert all(0 <= after[i] - (before[i] - gone[i]) <= 6 * (gone[i] > 0) * (1 + gone[i] // 200) for i in before)
    assert secrets.scan_secrets(inputs[4]).agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))).first()[0] == 0
    assert inputs[5].select("doc_id").distinct().count() == inputs[4].count()


def test_each_stage_on_odd_rows(spark, labelled):
    """Nulls, empty and long texts, repeated rows, ids that are null, columns whose names operators use."""
    sf = labelled([(k, 1, int(k % 5 == 0)) for k in range(40)] + [(None, None, 1), (3, 0, None)])
    rows = [(i, t) for i, t, *_ in odd_documents(21)] + [(None, None), (None, "a b c d e f g"), (None, "a b c d e f g"), (None, "")]
    docs = table(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = docs.collect(), stage(spark, docs, sf).cache()
        assert out.columns == docs.columns
        after = out.collect()
        assert all(tuple(r)[5:] == tuple(COLUMNS[5:]) for r in after)
        key = lambda r: (r.doc_id, r.text)
        if name == "toxicity":
            assert {key(r) for r in after} <= {key(r) for r in before}
        elif name == "ngram_jaccard_join":
            numbered = dict(enumerate(sorted({key(r) for r in before}, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))))
            groups = joined_by_hand([(n, t) for n, (_, t) in numbered.items()])
            per = {}
            for n, _, c in groups:
                per.setdefault(c, []).append(numbered[n])
            got = [key(r) for r in after]
            assert len(got) == len(set(got)) == len(per)
            for members in per.values():
                (one,) = [m for m in members if m in set(got)]
                assert one[0] == min((m[0] for m in members if m[0] is not None), default=None)
        else:
            assert ids(out) == ids(docs)
            assert sum(r.text is None for r in after) == sum(r.text is None for r in before)
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(pieces) >= docs.count() and all(0 < p.length <= 4096 and p.offset + p.length <= 4096 for p in pieces)


def test_each_stage_on_an_empty_table(spark, labelled):
    sf = labelled([(1, 1, 1)])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, []), sf).count() == 0
    sf = labelled([])
    assert ids(corpus_pipeline.STAGES[0][1](spark, table(spark, [(1, "x"), (2, None)]), sf)) == [1, 2]


def test_trimming_equals_brute_force_on_ascii(spark):
    r = random.Random(4)
    passage = "".join(r.choice("abcdefgh ") for _ in range(260))
    rows = [(k, "".join(r.choice("ijklmnop ") for _ in range(r.randint(0, 200))) + (passage[r.randint(0, 20) :] if k % 3 == 0 else "") + "end") for k in range(60)]
    rows += [(100, rows[1][1] * 3), (101, rows[1][1] * 3), (102, None)]
    got = {x.doc_id: x.text for x in corpus_pipeline.cut_repeated_strings(spark, table(spark, rows), "").collect()}
    removed = {i: n - cut for i, n, cut, _, _ in removed_by_hand(rows)}
    assert {i: len(t or "") for i, t in got.items()} == removed and got[102] is None


def test_redaction_takes_effect_and_packing_reads_its_result(spark, labelled):
    docs = table(spark, [(1, 'say password = "hunter22x" now'), (2, "plain words"), (3, None)])
    out = {x.doc_id: (x.text, x.n_chars) for x in corpus_pipeline.redact_secrets(spark, docs, "").collect()}
    assert "hunter22x" not in out[1][0] and out[1][1] == len(out[1][0]) and out[2][0] == "plain words" and out[3] == (None, None)
    assert packing.pack_documents(docs, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"), 4096).count() == 3
