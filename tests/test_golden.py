"""Golden cases of single operators, and checks without an SQL form."""

import io
import sqlite3
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import behavior, fuse, index, locate, names, policy, queue, rerank, retrieve
from corpusloom.operators.snapshots import SnapshotStore
from corpusloom.plans import catalogue
from corpusloom.sources import adapters as ad
from corpusloom.sources import extract
from corpusloom.streaming import state


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values))
    return frame.select(column).first()[0]


def test_name_query_text():
    q = names.NameQuery('report "final"', path="C:\\docs", extensions=[".PDF", "pdf", " DocX "], kind="file", modified_after="2026-07-01 00:00:00")
    assert names.compiled_text(q) == '"report quot:finalquot:" "C:\\docs\\" <ext:pdf|ext:docx> file: dm:>=20260701T000000'


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": 101}, {"offset": -1}, {"path": "x"}, {"extensions": ["a*"]}, {"modified_after": "2026", "modified_before": "2025"}, {"sort_by": "age"}])
def test_name_query_validation(bad):
    with pytest.raises(ValueError):
        names.validate(names.NameQuery("x", **bad))


@pytest.mark.parametrize("bad", ["<a", "a >", "foo:bar", '"open', "|"])
def test_raw_query_errors(bad, spark):
    with pytest.raises(ValueError):
        names.parse_raw(bad)


@pytest.mark.parametrize(
    "query, path, attributes, level",
    [
        ("x", "c:\\$recycle.bin\\a.txt", 0, 2), ("x", "c:\\a\\b.tmp", 0, 2), ("x", "c:\\a\\~$b.docx", 0, 2), ("x", "c:\\a\\.~lock.b#", 0, 2), ("x", "c:\\a\\thumbs.db", 0, 2), ("x", "c:\\a\\b.md", 256, 2),
        ("b.tmp", "c:\\a\\b.tmp", 0, 2), ("attempt", "d:\\templates\\attempt.md", 0, 0), ("kernel", "c:\\node_modules\\kernel32.dll", 0, 1), ("kernel32.dll", "c:\\node_modules\\kernel32.dll", 0, 0),
        ("c:\\node_modules\\kernel32.dll", "c:\\node_modules\\kernel32.dll", 0, 0), ("x", "c:\\a\\b.min.js", 0, 1), ("x", "c:\\a\\b.txt", 2, 1),
    ],
)
def test_noise(spark, query, path, attributes, level):
    name = path.rsplit("\\", 1)[1]
    assert one(spark, policy.noise(F.col("q"), F.col("n"), F.col("p"), F.lit(""), F.col("a").cast("int")), q=query, n=name, p=path, a=attributes) == level


def test_tokens_of_marks_and_nfkc(spark):
    assert one(spark, tx.normalize_nfkc(F.col("t")), t="ﬁﬂ Å①") == unicodedata.normalize("NFKC", "ﬁﬂ Å①")
    assert one(spark, tx.tokenize_fts(F.col("t")), t="Ça va, Straße? qwen3-vl") == ["ca", "va", "straße", "qwen3", "vl"]
    assert one(spark, tx.snippet_mail(F.col("t"), F.lit("needle")), t="a " * 200 + "needle" + " b" * 200).startswith("…")


def test_bm25_equals_fts5(spark, sf_dir):
    docs = ad.documents(spark, sf_dir)
    rows = docs.select("doc_id", "name", "text").collect()
    base = sqlite3.connect(":memory:")
    base.execute("CREATE VIRTUAL TABLE t USING fts5(title, body, tokenize=\"unicode61 remove_diacritics 2\")")
    base.executemany("INSERT INTO t(rowid, title, body) VALUES (?, ?, ?)", [(r.doc_id + 1, r.name, r.text) for r in rows])
    built = index.build(docs)
    asked = catalogue.benchmark_queries(spark, sf_dir).limit(12)
    got = {}
    for r in retrieve.bm25(built, retrieve.phrase_hits(built, asked)).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = r.score
    for q in asked.collect():
        match = " AND ".join(f'"{t}"' for t in dict.fromkeys(q.query.split()))
        want = {i - 1: -s for i, s in base.execute("SELECT rowid, bm25(t, 8.0, 1.0) FROM t WHERE t MATCH ?", (match,))}
        assert got.get(q.query_id, {}).keys() == want.keys()
        for doc, score in want.items():
            assert got[q.query_id][doc] == pytest.approx(score, abs=2e-6)


def test_stored_index_prunes_buckets(spark, sf_dir, tmp_path):
    built = index.build(ad.documents(spark, sf_dir))
    root = index.write(built, f"file://{tmp_path}/index", 1)
    asked = catalogue.benchmark_queries(spark, sf_dir).limit(2)
    terms = sorted({t for r in asked.collect() for t in r.query.split()})
    stored = index.load(spark, root, terms)
    plan = stored.postings._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan
    key = lambda f: sorted(map(tuple, f.collect()))
    assert key(retrieve.search(stored, asked, 5)) == key(retrieve.search(built, asked, 5))


def test_top_k_plan_limits_before_the_shuffle(spark, sf_dir):
    page = retrieve.search(index.build(ad.documents(spark, sf_dir)), catalogue.benchmark_queries(spark, sf_dir), 5)
    assert "WindowGroupLimit" in page._jdf.queryExecution().toString()


def docx(*paragraphs: str) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(paragraphs)}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="My"><w:name w:val="mine"/><w:basedOn w:val="Heading1"/></w:style></w:styles>')
    return out.getvalue()


def p(text: str, style: str = "") -> str:
    style = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{style}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_extraction(spark):
    table = f"<w:tbl><w:tr><w:tc>{p('')}</w:tc><w:tc>{p('cell')}</w:tc></w:tr></w:tbl>"
    files = [
        ("a.docx", docx(p("Plan", "My"), p("first"), p(" "), table)), ("b.txt", "é".encode("utf-16")), ("c.txt", b"\xef\xbb\xbfok"), ("d.txt", b"\xc3\x28\xff"), ("e.txt", b"1" * 50), ("f.exe", b""), ("g.docx", b"no"), ("h.pdf", b""), ("i.txt", "1234567890".encode()),
    ]
    got = {r.path: r for r in extract.extract(spark.createDataFrame([(n, bytearray(c)) for n, c in files], "path string, content binary"), 2000, 5).collect()}
    assert [b.label for b in got["a.docx"].blocks] == ["Plan · 标题 1"] and got["a.docx"].truncated
    whole = extract.docx_blocks(files[0][1])
    assert [b[1] for b in whole] == ["Plan · 标题 1", "Plan · 第 1 段", "Plan · 表格 1 · 第 1 行 · 第 2 列"]
    assert got["b.txt"].text == "é" and got["c.txt"].text == "ok"
    assert {k: got[k].error_code for k in ("d.txt", "f.exe", "g.docx", "h.pdf")} == {"d.txt": "UNSUPPORTED_ENCODING", "f.exe": "UNSUPPORTED_FILE_TYPE", "g.docx": "CORRUPT_DOCUMENT", "h.pdf": "OCR_REQUIRED"}
    assert got["i.txt"].text == "12345" and got["i.txt"].truncated
    assert extract.extract_one("x.txt", b"12345", 4, 10)["error_code"] == "FILE_TOO_LARGE"
    assert extract.space_camel_case("oneTwo") == "one Two"


def test_json_locations(spark):
    assert locate.json_hits('{"users":[{"name":"first"},\n{"name":"needle"}]}', ["needle"]) == [(2, "$.users[1].name", None)]
    frame = spark.createDataFrame([(1, '{\n"name": "needle"'), (2, '{"a b": 1}')], "doc_id long, text string")
    got = {r.doc_id: (r.line, r.json_path, r.label) for r in locate.locate_json(frame, ["needle", "a b"]).collect()}
    assert got == {1: (2, None, "Invalid JSON · text fallback"), 2: (1, "$['a b']", None)}


def test_markdown_and_window(spark):
    lines = "# Project\nintro\n## Decision\nuse needle here".split("\n")
    frame = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines, 1)], "doc_id long, line int, text string")
    assert {r.line: r.heading_path for r in locate.heading_paths(frame).collect()} == {1: "Project", 2: "Project", 3: "Project > Decision", 4: "Project > Decision"}
    docs = spark.createDataFrame([(1, "before\nalpha starts\nbridge\nbeta ends\nafter")], "doc_id long, text string")
    assert tuple(locate.compact_window(docs, ["alpha", "beta"]).first()) == (1, 2, 4)


def test_affinity_golden(spark):
    days = spark.createDataFrame([("2024-01-26", "p", "d", "e", 1.0)], "day string, path_key string, directory_key string, extension string, weight_sum double").withColumn("day", F.to_date("day"))
    asked = spark.createDataFrame([("p", "d", "e"), ("q", "d", "e"), ("q", "x", "e"), ("q", "x", "y")], "path_key string, directory_key string, extension string")
    got = sorted(r.affinity for r in behavior.affinity(asked, days, F.to_date(F.lit("2024-02-10"))).collect())
    assert got == [round(x * 2**-0.5, 6) for x in (0.1, 0.4, 1.4)]


def test_rerank_golden(spark):
    rows = spark.createDataFrame([(1, f"c{k}", k, 1, 10 if k in (9, 11) else 0, float(k)) for k in range(12)], "query_id int, cand_id string, idx int, tier int, promotion int, semantic_score double")
    moved = {r.cand_id: r.behavior_index for r in rerank.behavior(rows).collect()}
    assert moved["c9"] == 0 and moved["c10"] == 10 and moved["c11"] == 11
    head = rows.withColumn("behavior_index", F.col("idx")).filter("idx < 10")
    assert [r.cand_id for r in rerank.blend(head).orderBy("position").collect()][:2] == ["c9", "c8"]


def test_fusion_first_is_both(spark):
    n = spark.createDataFrame([(1, "q", "alpha", "alpha", 0, 0), (1, "q", "both", "both", 1, 0)], "query_id int, query string, path_key string, name string, rank int, noise int")
    c = spark.createDataFrame([(1, "q", "both", "both", 0, 3, False), (1, "q", "content", "content", 1, 4, False)], "query_id int, query string, path_key string, name string, rank int, start_line int, title_matched boolean")
    rows = fuse.ordered(fuse.boosted(fuse.fuse(n, c)), 10).orderBy("position").collect()
    assert [r.path_key for r in rows] == ["both", "content", "alpha"] and rows[0].match_source == "both"


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/scans")
    frame = lambda rows: spark.createDataFrame(rows, "path_key string, fingerprint string")
    store.commit(1, frame([("first", "1"), ("second", "1")]))
    store.stage(2, frame([("second", "9")]))
    store.abort(2)
    store.commit(3, frame([("second", "2")]))
    assert store.committed() == [1, 3]
    assert {r.path_key: r.change for r in store.diff(1, 3).collect()} == {"first": "removed", "second": "changed"}
    with pytest.raises(ValueError):
        store.read(2)


def test_latency_golden(spark):
    got = queue.latency(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "duration_ms double")).first()
    assert tuple(got) == (1.0, 3.0, 100.0, 100.0)


def test_state_machines():
    verdict, held = state.admit([float(k) for k in range(11)])
    assert verdict == [True] * 10 + [False] and len(held) == 10
    assert state.break_circuit([(0, 429), (1, 200), (31, 200)])[0] == ["sent", "open", "sent"]
    assert state.break_circuit([(0, 500), (1, 503), (2, 200), (32, 200)])[0] == ["sent", "sent", "open", "sent"]
    assert state.break_circuit([(0, 401), (99, 200)])[0] == ["sent", "disabled"]
    assert state.cached([(0, "a"), (599, "a"), (601, "a")])[0] == [False, True, False]


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = ad.read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    run = state.admitted_stream(stream).writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("admitted").collect())) == sorted(map(tuple, state.admitted(events).collect()))
    rows = stream.select("ts", F.col("event_id").alias("doc_id"), F.lit(1.0).alias("weight"))
    run = state.daily_feedback(rows).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    run.awaitTermination(120)
    assert spark.table("daily").agg(F.sum("event_count")).first()[0] == events.count()


def test_limiter_never_exceeds(spark, sf_dir):
    rows = catalogue.queries()["rate_limiter"](spark, sf_dir).filter("admitted").join(catalogue._status(spark, sf_dir), "event_id").collect()
    per = {}
    for r in rows:
        per.setdefault(r.user_id, []).append(r.ts.timestamp())
    for times in per.values():
        times.sort()
        assert all(times[k] - times[k - 10] >= 60 for k in range(10, len(times)))
