"""Ranked lexical search, main text of pages and spelling variants against brute force and planted truth."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import lexical, main_text, queries, spelling

from ..conftest import canonical

DOCS = "doc_id long, text string, lang string, score string, term string, body string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# ranked search


def some_documents(seed=3, n=120):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "é", "日本", "a.b", "X1", "x1", " "]
    texts = [None, "", " \t.,;", "w1", "W1 w1", "w1 " * 5000, "x" * 200_000 + " w2", "日本 日本,w1"]
    texts += [" ".join(words[min(int(r.expovariate(0.08)), 66)] for _ in range(r.choice([1, 5, 30, 150]))) for _ in range(n)]
    rows = [(k, t, "en", "s", "t", "b") for k, t in enumerate(texts)]
    return rows + [rows[20], rows[20], rows[3], (None, texts[9], None, None, None, None), (None, "w1", None, None, None, None)]


ITEMS = [(1, "w1 w2, W1 w40"), (2, "É 日本 none"), (3, None), (4, " ."), (5, "a.b x1"), (6, "none"), (7, "w0"), (7, "w50 w0"), (None, "w3 w4 w5 w6 w7 w8 w9"), (8, " ".join(f"w{k}" for k in range(60)))]


def brute_rank(docs, items, k):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(find(t))) for i, t, *_ in docs]
    total, length = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(find(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            n = c.total()
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * total // length))) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "first", "shard"), [(10, 256, 4_000_000), (3, 4, 300), (1000, 16, 4_000_000)])
def test_max_score_equals_brute_force(spark, monkeypatch, k, first, shard):
    monkeypatch.setattr(lexical, "FIRST_BLOCK", first)
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", shard)
    docs = some_documents()
    got = lexical.rank_documents(frame(spark, docs), frame(spark, ITEMS, "item_id long, text string"), k)
    assert sorted(map(tuple, got.collect()), key=str) == brute_rank(docs, ITEMS, k)


def test_items_in_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 200)
    monkeypatch.setattr(lexical, "PIECE", 1000)
    docs = some_documents(4, 40)
    got = lexical.rank_documents(frame(spark, docs), frame(spark, ITEMS, "item_id long, text string"), 5)
    assert sorted(map(tuple, got.collect()), key=str) == brute_rank(docs, ITEMS, 5)


def test_max_score_probes_few():
    """Common terms are looked up for few documents once rare ones have set the threshold."""
    r = np.random.default_rng(1)
    n = 20_000
    held = [np.unique(np.concatenate([[0], r.choice(200, 20), [300 + int(r.integers(50))]])) for _ in range(n)]
    sizes, terms = np.array([len(h) for h in held]), np.concatenate(held)
    df = np.bincount(terms, minlength=400)
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    shard = lexical.Shard(np.arange(n), np.zeros(n, bool), r.integers(10, 200, n), sizes, terms, np.ones(len(terms), np.int64), weight, n, n * 100)
    wanted = np.array([0, 1, 2, 300, 301])
    at, scores = shard.best(wanted, 10)
    every = np.zeros(n, np.int64)
    for t in wanted:
        spots = shard.terms == t
        every[shard.doc[spots]] += shard.add[spots]
    best = np.lexsort((np.arange(n), -every))[:10]
    assert at.tolist() == best.tolist() and scores.tolist() == every[best].tolist()
    assert shard.scored + shard.probed < 0.3 * df[wanted].sum()


def test_search_query_equals_sql(spark, sf_dir, duck):
    got, want = queries.op11_max_score_search(spark, sf_dir), duck.sql(queries.OP11_SQL)
    assert canonical(got.columns, got.collect()) == canonical(want.columns, want.fetchall())


# main text


def prose(k):
    return f"Paragraph {k} has a few words, some commas, and goes on for a good while so that it counts as prose."


PAGES = {
    "soup": (f'<html><body class="comments-open has-sidebar"><div id=wrapper><div id=header><h2>Site</h2><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></div><div class="sidebar-left"><p>{prose(0)}</p></div><div id=content><h1>Title</h1><p>{prose(1)}<p>{prose(2)} <b>bold</b><em>x</em></p><div class="comments"><p>{prose(8)}</p><p>{prose(9)}</p></div></div><div id=footer>2020, all rights, reserved</div></div>', ["Title", prose(1), prose(2) + " boldx"]),
    "sections": ("<main><h1>T</h1><section><h2>A</h2>" + "".join(f"<p>{prose(k)}</p>" for k in range(8)) + f"</section><section><h2>B</h2><p>Short.</p></section></main><aside><p>{prose(9)}</p></aside>", ["T", "A", *map(prose, range(8)), "B", "Short."]),
    "form": (f'<body><form action=x><input type=hidden value="a>b"><div class=nav><a href=1>1</a></div><article class="post comment-closed"><header class="entry-header"><h1>T</h1></header><p>{prose(1)}</p><footer>posted, in, cats</footer></article><button>Go</button></form>', ["T", prose(1)]),
    "notices": (f'<body><div class="cookie-notice"><p>{prose(7) * 3}</p></div><div><h1>T</h1><div><p>{prose(1)}</p></div></div><section id="comments"><article class="comment"><p>{prose(8) * 9}</p></article></section></body>', ["T", prose(1)]),
    "related": (f"<article><p>{prose(1)}</p><div><ul><li><a href=1>One thing</a></li><li><a href=2>Two things</a></li></ul></div><p>{prose(2)}</p><ul><li>plain item</li><li>second <a href=x>x</a></li></ul></article>", [prose(1), prose(2), "plain item", "second x"]),
    "table": (f"<table><tr><td><a href=1>Home</a><br><a href=2>News</a><td><p>{prose(1)}<p>{prose(2)}</table>", [prose(1), prose(2)]),
    "breaks": (f"<div class=story>{prose(1)}<br><br>{prose(2)}<br>line two<br />\n<br/>{prose(3)}</div>", [prose(1), prose(2) + " line two", prose(3)]),
    "references": ('<article><p>a &lt;b&gt; &amp &copy; &#x41;&nbsp;z<script>if (a</b>) "<p>x</p>"</script><p>next <!-- c > <p>no</p> --> here<style>p{}</style></p></article>', ["a <b> & © A z", "next here"]),
    "bare": ("<p>only text < 5 and > 3 <b>x", ["only text < 5 and > 3 x"]),
    "hidden": (f'<body><div style="display:none"><p>{prose(8)}</p></div><div hidden>{prose(8)}</div><p>{prose(1)}</p><noscript>{prose(9)}</noscript></body>', [prose(1)]),
    "columns": (f'<div class=page><h1>T</h1><div class=row><div class=col><p>{prose(1)}</p><p>{prose(2)}</p></div><div class="col widget-area"><p>{prose(9)}</p></div></div></div>', ["T", prose(1), prose(2)]),
    "lead": ("<div class=post><div class=lead><p>Lead text.</p></div><div class=text>" + "".join(f"<p>{prose(k)}</p>" for k in range(9)) + "</div></div>", ["Lead text.", *map(prose, range(9))]),
    "empty": ("", []),
    "menu only": ("<html><head><title>x</title></head><body><nav><a href=1>x</a></nav></body></html>", []),
    "cut off": (f'<article><p>{prose(1)}</p><p class="a', [prose(1)]),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_main_text_of_layouts(name):
    page, blocks = PAGES[name]
    assert main_text.main_text(page) == "\n\n".join(blocks)


def test_main_text_is_linear():
    hard = ["<div>" * 100_000 + "x y, z", "<p>" + "<span>" * 100_000 + "<li>" * 50_000, "<" * 200_000, '<a b="' * 100_000, "<!--" * 100_000, "<ul>" + "<span>" * 1000 + "<li></li>" * 50_000, "<a href=x>" * 100_000, "</x>" * 100_000, "<h1>" * 50_000, "<script>" * 100_000]
    start = time.time()
    for page in hard:
        main_text.main_text(page)
    assert time.time() - start < 40


def test_pages_keep_their_rows(spark):
    rows = [(1, "u", PAGES["soup"][0], "x", 1), (1, "u", PAGES["soup"][0], "x", 1), (None, None, None, None, None), (2, None, "", "y", 2), (3, "v", "<p>" + "word, " * 200_000, None, 3)]
    got = main_text.extract_pages(frame(spark, rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    want = "\n\n".join(PAGES["soup"][1])
    assert sorted((str(r.page_id), r.url, r.n_chars) for r in got if r.page_id != 3) == [("1", "u", len(want)), ("1", "u", len(want)), ("2", None, 0), ("None", None, 0)]
    assert [r.text for r in got if r.page_id == 1] == [want] * 2 and [r.text for r in got if r.page_id == 3] == [" ".join(["word,"] * 200_000)]


def test_pages_query_equals_sql(spark, sf_dir, duck):
    got, want = queries.op12_tree_scored_text(spark, sf_dir), duck.sql(queries.OP12_SQL)
    assert canonical(got.columns, got.collect()) == canonical(want.columns, want.fetchall())


# spelling variants


def brute_variants(docs):
    counts = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    shapes = defaultdict(set)
    for w in words:  # equal but for one place, or one place longer
        for k in range(len(w)):
            shapes[w[:k] + "*" + w[k + 1 :]].add(w)
        for k in range(len(w) + 1):
            shapes[w[:k] + "*" + w[k:]].add(w)
    near = defaultdict(set)
    for same in shapes.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def variant_rows(frame):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in frame.collect()), key=str)


def spelled_documents():
    r = random.Random(9)
    base = ["abcde", "abcdef", "abbbbde", "Éclair", "éclair", "ÀÿÀÿÀ", "kitten", "z" * 70, "aaaaa", "aaaaaa", "abcdx"]
    out = []
    for k in range(300):
        words = []
        for _ in range(r.randint(0, 30)):
            w = base[min(int(r.expovariate(0.4)), 10)]
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abdeÉx") + w[at:], w[:at] + r.choice("abdeÉx") + w[at + 1 :]])
            words.append(w.upper() if r.random() < 0.1 and w.isascii() else w)
        out.append((k, r.choice([" ", ", ", "1"]).join(words), "en", "n", "root", "b"))
    return [*out, out[5], out[5], (None, out[7][1], None, None, None, None), (400, None, None, None, None, None), (401, "", None, None, None, None), (402, "kitten " * 2000, None, None, None, None)]


@pytest.mark.parametrize("words", [spelling.FILTER_WORDS, 0])
def test_variants_equal_brute_force(spark, monkeypatch, words):
    """With the bitmap, and with all neighbours joined."""
    monkeypatch.setattr(spelling, "FILTER_WORDS", words)
    monkeypatch.setattr(spelling, "PIECE", 1000)
    monkeypatch.setattr(spelling, "HELD", 50)
    docs = spelled_documents()
    assert variant_rows(spelling.group_variants(frame(spark, docs))) == brute_variants(docs)


def test_variants_of_the_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert variant_rows(queries.op13_spelling_neighbourhood(spark, sf_dir)) == brute_variants(docs)


def test_neighbours_are_all_and_distinct():
    alphabet = np.array([ord(c) for c in "abcé"], np.uint32)
    for word in ("abcab", "aaaaa", "aabbc", "éééaa"):
        want = {word[:k] + word[k + 1 :] for k in range(5)} | {word[:k] + c + word[k + 1 :] for k in range(5) for c in "abcé"} | {word[:k] + c + word[k:] for k in range(6) for c in "abcé"}
        want = sorted(want - {word})
        names = list(zip(*spelling.names_of(want), strict=True))
        made = [pair for _, first, second in spelling.neighbours(np.array([[ord(c) for c in word]], np.uint32), alphabet) for pair in zip(first, second, strict=True)]
        assert sorted(made) == sorted(names) and len(set(made)) == len(made)


def test_nothing(spark):
    none = frame(spark, [])
    items = frame(spark, ITEMS, "item_id long, text string")
    assert spelling.group_variants(none).count() == 0
    assert lexical.rank_documents(none, items).count() == 0
    assert lexical.rank_documents(frame(spark, some_documents(1, 30)), items.limit(0)).count() == 0
    assert main_text.extract_pages(frame(spark, [], "page_id long, url string, html string")).count() == 0

