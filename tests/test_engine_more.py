"""The engine's calls against plain Python: scripts, places by kind, content mode, batches of names, updates."""

import hashlib
import hmac
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import index as ix
from corpusloom.operators import locate, names, policy, queue, rerank, retrieve
from corpusloom.plans import catalogue
from corpusloom.plans.engine import Engine
from corpusloom.sources import adapters as ad
from corpusloom.streaming import state

DOCS = "doc_id long, name string, extension string, path_key string, text string"


def documents(spark, texts, extension="txt"):
    return spark.createDataFrame([(k, f"d{k}.{extension}", extension, f"c:\\d{k}.{extension}", t) for k, t in enumerate(texts)], DOCS)


def found(spark, docs, *queries):
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    out = defaultdict(set)
    for r in retrieve.matches(retrieve.phrase_hits(ix.build(docs), asked)).collect():
        out[queries[r.query_id]].add(r.doc_id)
    return out


def test_search_in_all_scripts(spark):
    texts = ["这是人工智能报告", "Ｈｅｌｌｏ world", "ﬁle name", "Việt Nam", "café au lait", "plain words", "がぎ カタカナ", "한국어 문서", "Ёлка ΆΝΘΡΩΠΟΣ", "x\u0301y"]
    got = found(spark, documents(spark, texts), "人工智能", "hello", "file", "viet", "cafe", "CAFÉ", "plain", "ｐｌａｉｎ", "がぎ", "かき", "한국", "елка", "ανθρωπος", "智能报", "能人", "xy")
    want = {"人工智能": {0}, "hello": {1}, "file": {2}, "viet": {3}, "cafe": {4}, "CAFÉ": {4}, "plain": {5}, "ｐｌａｉｎ": {5}, "がぎ": {6}, "한국": {7}, "елка": {8}, "ανθρωπος": {8}, "智能报": {0}, "xy": {9}}
    assert dict(got) == want


def test_stored_tokens_are_those_of_both_stages(spark):
    row = spark.createDataFrame([("Alpha_1 人工智能x Ünï ½ --",), ("Plain-ASCII v2.1",), (None,), ("",)], "t string").select(tx.index_terms(F.col("t")).alias("t"), tx.count_terms(F.col("t")).alias("n")).collect()
    assert [r.n for r in row] == [9, 4, None, 0]
    assert [r.t for r in row] == [["alpha", "1", "人工", "工智", "智能", "x", "uni", "1", "2"], ["plain", "ascii", "v2", "1"], None, []]


def test_plain_texts_fold_alike_in_both_ways(spark):
    import re

    characters = [chr(k) for k in [*range(0x20, 0x250), *range(0x2000, 0x20D0), 0x3042, 0x4E00]]
    rows = spark.createDataFrame([(c, f"a{c}b") for c in characters], "c string, t string")
    simple = 0
    for r in rows.select("c", tx.is_plain(F.col("t")).alias("plain"), tx.index_terms(F.col("t")).alias("terms"), tx.count_terms(F.col("t")).alias("n"), tx.is_plain(F.lower("t")).alias("small"), tx.fold_marks(F.lower("t")).alias("folded")).collect():
        simple += r.plain
        assert r.n == len(r.terms)
        if r.plain or r.c < "\u3000":
            assert r.terms == re.findall(r"[^\W_]+", tx.searchable(f"a{r.c}b")), r
        if r.small:
            assert "".join(x for x in r.folded if x.isalnum()) == "".join(x for x in tx.searchable(f"a{r.c}b".lower()) if x.isalnum()), r
    assert 350 < simple < len(characters)


def test_ascii_texts_stay_in_the_jvm(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(texts):
        seen.add(int(texts.notna().sum()))
        return texts

    rows = spark.createDataFrame([("a",), ("é",), ("b",)], "t string")
    rows.select(tx._beyond(tx.is_ascii(F.col("t")), counted, F.col("t"), F.col("t"))).collect()
    assert seen.value == 1


def test_scores_need_no_window_over_a_terms_hits(spark):
    index = ix.build(documents(spark, ["a b", "a c", "a"]))
    asked = spark.createDataFrame([(1, "a b"), (2, "a")], "query_id int, query string")
    scored = retrieve.bm25(index, retrieve.phrase_hits(index, asked))
    assert len(scored.collect()) == 4
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "ReusedExchange" in plan


MARKDOWN = "# A\nintro\n## B ##x\nalpha here\n\nbeta there\n# C\nalpha beta\n#nospace\n"
JSON = '{"alpha": [1, {"b c": "has beta"}],\n "gamma": true}'


@pytest.mark.parametrize(
    ("text", "extension", "terms", "want"),
    [
        ("one\nalpha\nthree\nalpha\nalpha\nALPHA", "txt", ["alpha"], [(2, 2, "one\nalpha\nthree", None, None, "lines 2-2"), (4, 4, "three\nalpha\nalpha", None, None, "lines 4-4"), (5, 5, "alpha\nalpha\nALPHA", None, None, "lines 5-5")]),
        ("a\r\nb\rx\nb\nq\na", "txt", ["a", "b"], [(1, 2, "a\nb\nx", None, None, "lines 1-2")]),
        (MARKDOWN, "md", ["alpha", "beta"], [(8, 8, "# C\nalpha beta\n#nospace", "C", None, "C · lines 8-8")]),
        (MARKDOWN, "MD", ["there"], [(6, 6, "beta there\n# C", "A > B ##x", None, "A > B ##x · lines 6-6")]),
        (JSON, "json", ["alpha"], [(1, 1, '{"alpha": [1, {"b c": "has beta"}],\n "gamma": true}', None, "$.alpha", "$.alpha")]),
        (JSON, "json", ["beta"], [(1, 1, '{"alpha": [1, {"b c": "has beta"}],\n "gamma": true}', None, "$.alpha[1]['b c']", "$.alpha[1]['b c']")]),
        ("{bad alpha", "json", ["alpha"], [(1, 1, "{bad alpha", None, None, locate.INVALID_JSON)]),
        ("x", "txt", ["alpha"], []),
        ("x", "txt", [], []),
    ],
)
def test_places_by_kind(text, extension, terms, want):
    assert locate.resolve(text, extension, terms) == want


def test_places_in_blocks():
    blocks = [{"ordinal": k + 1, "text": t, "label": f"p{k + 1}", "heading_path": h} for k, (t, h) in enumerate([("alpha", None), ("x", "H"), ("beta", "H"), ("alpha y", "H > I"), ("z beta", None)])]
    assert locate.resolve("", "docx", ["alpha", "BETA"], blocks) == [(4, 4, "beta\nalpha y", "H > I", None, "p4")]
    assert [h[0] for h in locate.resolve("", "docx", ["beta"], blocks)] == [3, 5]
    assert locate.resolve("beta", "docx", ["beta"], None)[0][5] == "lines 1-1"


def test_smallest_span_equals_brute_force():
    r = random.Random(4)
    for _ in range(300):
        terms = ["a", "b", "c"][: r.randint(2, 3)]
        parts = ["".join(r.choices("abcx", k=r.randint(0, 2))) for _ in range(r.randint(0, 9))]
        best = None
        for s in range(len(parts)):
            e = next((e for e in range(s, len(parts)) if all(any(t in p for p in parts[s : e + 1]) for t in terms)), None)
            if e is not None and (best is None or e - s < best[1] - best[0]):
                best = (s, e)
        assert locate.smallest_span(parts, terms) == best


def test_engine_places_hits_by_kind(spark):
    rows = [(1, "a.md", "md", "c:\\a.md", MARKDOWN), (2, "b.json", "json", "c:\\b.json", '{"k": "alpha"}'), (3, "c.txt", "txt", "c:\\c.txt", "ＡＬＰＨＡ only in full width")]
    engine = Engine(spark, None, ix.build(spark.createDataFrame(rows, DOCS)))
    asked = spark.createDataFrame([(1, "alpha"), (2, " ")], "query_id int, query string")
    got = {(r.doc_id, r.start_line): r for r in engine.search_local_content(asked, 10).collect()}
    assert set(got) == {(1, 4), (1, 8), (2, 1), (3, 1), (None, None)}
    assert got[1, 4].heading_path == "A > B ##x" and got[2, 1].json_path == "$.k" and got[3, 1].label is None and got[3, 1].snippet.startswith("ＡＬＰＨＡ")
    assert got[None, None].error_code == "QUERY_TOO_BROAD"
    titles = engine.search_local_content(spark.createDataFrame([(1, "b.json")], "query_id int, query string"), 10, field=ix.TITLE).collect()
    assert [(r.doc_id, r.start_line, r.snippet) for r in titles] == [(2, 1, "")]


def test_content_mode_equals_plain_python(spark, sf_dir):
    engine = catalogue._engine(spark, sf_dir)
    asked = catalogue.benchmark_queries(spark, sf_dir)
    got = catalogue.content_mode(spark, sf_dir).collect()
    hits, mails = defaultdict(list), defaultdict(list)
    for r in sorted(engine.search_local_content(asked, 10, field=ix.BODY).filter("error_code is null").collect(), key=lambda r: (r.query_id, r.rank, r.start_line)):
        hits[r.query_id].append((r.path_key, r.start_line))
    for r in sorted(engine.search_mail(asked, 10).collect(), key=lambda r: (r.query_id, r.rank)):
        mails[r.query_id].append(r.path_key)
    want = set()
    for q in hits.keys() | mails.keys():
        files = list(dict.fromkeys(p for p, _ in hits[q]))
        both = [(-round(1 / (61 + k), 9), 0, k, p) for k, p in enumerate(files)] + [(-round(1 / (61 + k), 9), 1, k, p) for k, p in enumerate(mails[q])]
        for position, (score, kind, _, item) in enumerate(sorted(both)[:10]):
            n = sum(p == item for p, _ in hits[q]) if kind == 0 else None
            want.add((q, position, item, kind, -score, n))
    assert {(r.query_id, r.position, r.item, r.kind, r.score, r.hits) for r in got} == want
    assert any(k for _, _, _, k, _, _ in want) and len(want) > 20


def test_names_of_a_batch_equal_a_scan(spark):
    r = random.Random(3)
    files = spark.createDataFrame([(k, "".join(r.choices("abAB.é", k=r.randint(1, 8)))) for k in range(150)] + [(999, None)], "id int, name string")
    asked = spark.createDataFrame([(k, "".join(r.choices("abA.é ", k=r.randint(0, 4)))) for k in range(60)] + [(99, None)], "query_id int, query string")
    rows = lambda few: sorted(map(tuple, names.containing(files, asked, few).select("id", "query_id").collect()))
    assert rows(1) == rows(names.SCANNED + 1) and len(rows(1)) > 100
    plan = names.containing(files, asked, names.SCANNED + 1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("bad", ["dm:thisdecade", "dm:2024-13-01", "size:big", "dm:"])
def test_dialect_refuses_what_it_does_not_know(bad, spark):
    with pytest.raises(ValueError, match="INVALID_QUERY"):
        names.parse_raw(bad)


def test_invalid_paths_are_refused_first(spark):
    rows = [(1, None, "a.txt"), (2, "  ", "a.txt"), (3, "c:\\a\0b.txt", "b.txt"), (4, "c:\\x\\a.exe", "a.exe")]
    entries = spark.createDataFrame([(i, n, p, (p or "").lower(), n[-3:], 1, None, 0) for i, p, n in rows], "doc_id int, name string, full_path string, path_key string, extension string, size long, modified_at timestamp, attributes int")
    got = {r.doc_id: r.reason for r in policy.evaluate(entries, spark.createDataFrame([], "prefix string"), F.current_timestamp()).collect()}
    assert got == {1: "invalid path", 2: "invalid path", 3: "invalid path", 4: "unsupported format"}


def test_failed_paths_are_tried_afresh(spark):
    work = spark.createDataFrame([("a", "1", 0, 2, "2024-01-01", "pending")], "path_key string, fingerprint string, priority int, attempts int, next_attempt_at string, state string").withColumn("next_attempt_at", F.col("next_attempt_at").cast("timestamp"))
    failures = spark.createDataFrame([("a", "1", "2024-01-03"), ("b", "2", "2024-01-02")], "path_key string, fingerprint string, failed_at string")
    engine = Engine(spark, failures=failures, queue=work)
    assert [r.path_key for r in engine.failures_list(1).collect()] == ["a"]
    after = engine.retry_failures(spark.createDataFrame([("b",)], "path_key string"), F.lit("2024-02-01").cast("timestamp"))
    assert {(r.path_key, r.attempts, r.state) for r in after.queue.collect()} == {("a", 2, "pending"), ("b", 0, "pending")}
    assert [r.path_key for r in after.failures.collect()] == ["a"]
    everything = queue.retry_failures(work, failures, None, F.lit("2024-02-01").cast("timestamp"))
    assert {(r.path_key, r.attempts) for r in everything[0].collect()} == {("a", 0), ("b", 0)} and everything[1].count() == 0


def test_merged_index_equals_a_new_one(spark, tmp_path):
    old = documents(spark, ["alpha beta", "gamma", "delta", "alpha"])
    root = ix.write(ix.build(old), str(tmp_path), 1)
    changed = spark.createDataFrame([(70, "d1.txt", "txt", "c:\\d1.txt", "gamma alpha"), (71, "new.md", "md", "c:\\new.md", "beta"), (69, "d1.txt", "txt", "c:\\d1.txt", "older")], DOCS)
    after = ix.merged(ix.load(spark, root), changed, spark.createDataFrame([("c:\\d2.txt",)], "path_key string"))
    want = ix.build(spark.createDataFrame([(0, "d0.txt", "txt", "c:\\d0.txt", "alpha beta"), (1, "d1.txt", "txt", "c:\\d1.txt", "gamma alpha"), (71, "new.md", "md", "c:\\new.md", "beta"), (3, "d3.txt", "txt", "c:\\d3.txt", "alpha")], DOCS))
    rows = lambda frame: sorted(map(str, frame.select(*sorted(frame.columns)).collect()))
    for part in ("postings", "stats", "corpus", "documents"):
        assert rows(getattr(after, part)) == rows(getattr(want, part))
    stored = ix.load(spark, ix.write(after, str(tmp_path), 2))
    assert rows(stored.stats) == rows(want.stats)


def test_models_load_once_a_task_and_see_batches(spark):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda queries, texts: [float("inf") if q == "x" else float(len(t)) for q, t in zip(queries, texts, strict=True)]

    rows = spark.createDataFrame([("q", "ab"), ("x", "c"), ("q", "")] * 50, "query string, text string").coalesce(1)
    got = rerank.scored(rows, load).collect()
    assert [r.semantic_score for r in got[:3]] == [2.0, None, 0.0] and loads.value == 1


def test_external_order_keeps_to_its_limits(spark):
    rows = spark.createDataFrame([(q, f"query {q}", f"c{k}", k, f"n{k}", "s" * (4000 if q == 4 else 5)) for q in (1, 2, 3, 4) for k in range(12)], "query_id int, query string, cand_id string, idx int, name string, snippet string")

    def ask(query, shown):
        assert len(shown) == 10 and all(len(r["snippet"]) <= 200 for r in shown)
        if query.endswith("2"):
            raise TimeoutError
        return ["c3", "c1"] if query.endswith("1") else ["c11"] if query.endswith("3") else ["c0"]

    got = sorted(map(tuple, rerank.external_order(rows, ask).collect()))
    assert got == [(1, "c1", 2), (1, "c3", 1), (4, "c0", 1)]
    assert [r[0] for r in rerank.external_order(rows, ask, most_bytes=100).collect()] == []


def test_keys_equal_the_standard_library(spark, sf_dir):
    path = {r.doc_id: r.full_path for r in ad.files(spark, sf_dir).collect()}
    for r in catalogue.hmac_key(spark, sf_dir).collect():
        assert r.file_key.lower() == hmac.new(b"salt", b"file\0" + path[r.doc_id].upper().encode(), hashlib.sha256).hexdigest()


def test_semantic_scores_equal_plain_python(spark, sf_dir):
    asked = {r.query_id: r.query for r in catalogue.benchmark_queries(spark, sf_dir).collect()}
    text = {r.doc_id: r.text for r in ad.documents(spark, sf_dir).collect()}
    got = catalogue.semantic_score(spark, sf_dir).collect()
    for r in got:
        words = set(asked[r.query_id].lower().split())
        assert r.semantic_score == pytest.approx(len(words & set(text[r.doc_id].lower().split())) / len(words), abs=1e-6)
    assert len(got) > 10


def test_cache_and_breaker_replay_equal_plain_python(spark):
    r = random.Random(9)
    rows = [(k, r.choice("ab"), float(k * 7 % 31) + k / 100, r.choice(["p", "q"])) for k in range(80)]
    events = spark.createDataFrame(rows, "event_id long, user_id string, at double, payload string").withColumn("ts", F.timestamp_micros((F.col("at") * 60e6).cast("long")))
    got = {x.event_id: x.hit for x in state.cache_hits(events).collect()}
    kept = {}
    for k, user, at, payload in sorted(rows, key=lambda x: (x[2], x[0])):
        hit = (user, payload) in kept and at * 60 < kept[user, payload] + state.CACHE_SECONDS
        assert got[k] == hit
        if not hit:
            kept[user, payload] = at * 60
    assert 0 < sum(got.values()) < len(rows)
    calls = [(k, r.choice("ab"), k * 7.0, r.choice([200, 200, 500, 0, 429, 503])) for k in range(120)]
    events = spark.createDataFrame(calls, "event_id long, user_id string, at double, status int").withColumn("ts", F.timestamp_seconds("at"))
    got = {x.event_id: x.outcome for x in state.circuit(events).collect()}
    open_until, failures = defaultdict(float), defaultdict(int)
    for k, user, at, status in calls:
        if at < open_until[user]:
            assert got[k] != "sent"
            continue
        assert got[k] == "sent"
        bad = status == 0 or status >= 500
        failures[user] = failures[user] + 1 if bad else 0
        if status == 429 or failures[user] >= state.FAILURES:
            open_until[user], failures[user] = at + state.OPEN_SECONDS, 0
    assert len(set(got.values())) > 1


def test_only_the_newest_results_are_shown(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 1), ("b", 3, 4), ("c", 5, 5)], "session string, version int, shown_version int")
    assert sorted((r.session, r.version) for r in state.presented(rows).collect()) == [("a", 2), ("c", 5)]


def test_stored_behavior(spark, tmp_path, monkeypatch):
    from corpusloom.operators import behavior, behavior_store

    rows = lambda day, n: spark.createDataFrame([("Open", False, "Hybrid", f"{day} 10:00:00", "a", "d", "md")] * n + [("Open", True, "Content", f"{day} 10:00:00", "a", "d", "md")], "action string, previewed boolean, mode string, ts string, path_key string, directory_key string, extension string").withColumn("ts", F.col("ts").cast("timestamp"))
    store = behavior_store.BehaviorStore(spark, f"file://{tmp_path}/behavior")
    salt = store.salt()
    store.add(rows("2024-02-01", 2))
    store.add(rows("2024-02-01", 3))
    store.add(rows("2024-03-20", 1))
    told = lambda: sorted((str(r.day), r.weight_sum, r.event_count) for r in store.read().collect())
    assert told() == [("2024-02-01", 5.0, 5), ("2024-03-20", 1.0, 1)]
    assert behavior_store.BehaviorStore(spark, store.root).read().count() == 2 and store.salt() == salt
    store.prune(F.lit("2024-03-21").cast("date"))
    assert told() == [("2024-03-20", 1.0, 1)] and store.salt() == salt
    store.clear()
    assert told() == [] and store.salt() != salt
    store.add(rows("2024-03-20", 1))
    monkeypatch.setattr(behavior_store, "SCHEMA_VERSION", 3)
    assert behavior_store.BehaviorStore(spark, store.root).read().count() == 0
    assert (tmp_path / "behavior.legacy-2").is_dir()
    assert behavior.daily(rows("2024-02-01", 1)).count() == 1
