"""Where in a document the terms are: lines, compact windows, headings, blocks, JSON paths."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

MOST = 3


def _has(content: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(F.lower(content), F.lower(t)))


def locate_lines(documents: DataFrame, terms: Column, most: int = MOST) -> DataFrame:
    """Up to three lines with any term, each with its neighbours as snippet.

    All inside the row: the lines are an array, so nothing is exploded that is not returned and
    nothing is shuffled.
    """
    rows = documents.select("doc_id", tx.lines(F.col("text")).alias("ls"), terms.alias("terms"))
    hit = F.filter(F.transform("ls", lambda c, i: F.when(_has(c, F.col("terms")), i + 1)), lambda n: n.isNotNull())
    few = rows.select("doc_id", "ls", F.explode(F.slice(hit, 1, most)).alias("line"))
    first = F.greatest(F.col("line") - 1, F.lit(1))
    return few.select("doc_id", "line", F.trim(F.array_join(F.slice("ls", first, F.least(F.col("line") + 1, F.size("ls")) - first + 1), "\n")).alias("snippet"))


def compact_window(documents: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, start_line, end_line) of the smallest span of lines with all terms, the first of equals.

    One pass over the lines inside the row: at each line the last place of each term is known, and a span that ends
    here begins at the earliest of them. Linear in the lines, and nothing is shuffled.
    """
    held = F.transform(tx.lines(F.col("text")), lambda c: F.array(*(F.contains(F.lower(c), F.lit(t.lower())) for t in terms)))
    none = F.lit(None).cast("int")
    start = F.struct(F.array_repeat(F.lit(0), len(terms)).alias("last"), F.lit(0).alias("line"), none.alias("span"), none.alias("first"))

    def step(state: Column, here: Column) -> Column:
        line = state["line"] + 1
        last = F.zip_with(state["last"], here, lambda place, found: F.when(found, line).otherwise(place))
        low = F.array_min(last)
        better = (low > 0) & F.exists(here, lambda found: found) & (state["span"].isNull() | (line - low < state["span"]))
        return F.struct(last.alias("last"), line.alias("line"), F.when(better, line - low).otherwise(state["span"]).alias("span"), F.when(better, low).otherwise(state["first"]).alias("first"))

    found = documents.select("doc_id", F.aggregate(held, start, step).alias("b")).filter("b.span is not null")
    return found.select("doc_id", F.col("b.first").alias("start_line"), (F.col("b.first") + F.col("b.span")).alias("end_line"))


def heading_paths(lines: DataFrame) -> DataFrame:
    """(doc_id, line, heading_path) of rows (doc_id, line, text): the headings above each line.

    The last heading of a level counts unless a shallower one came after it.
    """
    mark = F.regexp_extract(F.col("text"), r"^\s*(#{1,6})\s+(.*)$", 1)
    title = F.trim(F.regexp_extract(F.col("text"), r"^\s*(#{1,6})\s+(.*)$", 2))
    rows = lines.select("doc_id", "line", F.length(mark).alias("level"), title.alias("title"))
    above = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {k: F.max(F.when(F.col("level") == k, F.struct("line", "title"))).over(above).alias(f"h{k}") for k in range(1, 7)}
    rows = rows.select("doc_id", "line", *last.values())
    parts = []
    for k in range(1, 7):
        shallower = [F.coalesce(F.col(f"h{j}.line"), F.lit(0)) for j in range(1, k)]
        newest = F.greatest(*shallower) if len(shallower) > 1 else (shallower[0] if shallower else F.lit(0))
        parts.append(F.when((F.col(f"h{k}.line") > newest) & (F.col(f"h{k}.title") != ""), F.col(f"h{k}.title")))
    path = F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), " > ")
    return rows.select("doc_id", "line", F.nullif(path, F.lit("")).alias("heading_path"))


def location_map(blocks: DataFrame) -> DataFrame:
    """(doc_id, ordinal, start, length, label, heading_path) of blocks (doc_id, ordinal, text, label,
    heading_path): where each stands in the text that joins them with line ends. A running sum, linear
    in the blocks."""
    above = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(above), F.lit(0)).cast("int")
    return blocks.select("doc_id", "ordinal", start.alias("start"), F.length("text").alias("length"), "label", "heading_path")


def valid_map(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """Stored map entries that lie within their text (doc_id, text); blank labels and headings are null."""
    joined = entries.join(texts.select("doc_id", F.length("text").alias("n")), "doc_id")
    inside = (F.col("ordinal") >= 1) & (F.col("start") >= 0) & (F.col("length") >= 0) & (F.col("start") + F.col("length") <= F.col("n"))
    filled = lambda c: F.when(F.trim(c) != "", F.col(c)).alias(c)
    return joined.filter(inside).select("doc_id", "ordinal", "start", "length", filled("label"), filled("heading_path"))


def locate_blocks(blocks: DataFrame, terms: list[str]) -> DataFrame:
    """The block a hit is reported at: the end of the smallest run of blocks with all terms, else the
    first three with any. Rows (doc_id, ordinal, text, label, heading_path)."""
    joined = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda b: F.regexp_replace(b["text"], r"[\r\n]+", " ")), "\n").alias("text"))
    window = compact_window(joined, terms).select("doc_id", F.col("end_line").alias("ordinal"))
    any_of = locate_lines(joined, F.array(*(F.lit(t) for t in terms))).select("doc_id", F.col("line").alias("ordinal"))
    chosen = window.unionByName(any_of.join(window, "doc_id", "left_anti")) if len(terms) > 1 else any_of
    return chosen.join(blocks, ["doc_id", "ordinal"]).select("doc_id", "ordinal", "label", "heading_path", "text")


#: Deeper JSON is read as text.
MAX_DEPTH = 64
_JSON = re.compile(r'[ \t\r\n]*+(?:([{}\[\],:])|"((?:[^"\\\x00-\x1f]++|\\.)*+)"|(-?+(?:0|[1-9]\d*+)(?:\.\d++)?+(?:[eE][+-]?+\d++)?+|true|false|null)(?![\w.+-])|(\Z))', re.ASCII)


def _step(place: str | int) -> str:
    if isinstance(place, int):
        return f"[{place}]"
    return f".{place}" if place.isidentifier() else "['" + place.replace("'", "\\'") + "']"


def json_hits(text: str, terms: list[str], most: int = MOST) -> list[tuple[int, str | None, str | None]] | None:
    """(line, path, label) of up to three property names or values with any term; None: not JSON, or too deep.

    One pass without recursion: what is open is a list of places (a name or an index). Paths and lines
    are made for hits only, and reading stops with the last one that is wanted."""
    lowered = [t.lower() for t in terms]
    found: list[tuple[int, str | None, str | None]] = []
    open_: list[str | int] = []
    expects = "value"  # value, first value or ], name, first name or }, colon, comma or end, end
    at = line_at = 0
    line = 1
    while len(found) < most:
        token = _JSON.match(text, at)
        if not token:
            return None
        mark, string, literal, end = token.groups()
        at = token.end()
        if end is not None:
            return found if expects == "end" else None
        value = None
        if string is not None:
            try:
                value = json.loads(f'"{string}"') if "\\" in string else string
            except ValueError:
                return None
        elif literal is not None:
            value = literal
        if expects in ("name", "name or }") and string is not None:
            open_[-1], expects = value, "colon"
        elif expects in ("value", "value or ]") and value is not None:
            expects = "comma" if open_ else "end"
        elif expects in ("value", "value or ]") and mark in ("{", "["):
            if len(open_) == MAX_DEPTH:
                return None
            open_.append("" if mark == "{" else 0)
            expects = "name or }" if mark == "{" else "value or ]"
            continue
        elif mark == ":" and expects == "colon":
            expects = "value"
            continue
        elif mark == "," and expects == "comma":
            if isinstance(open_[-1], int):
                open_[-1] += 1
            expects = "value" if isinstance(open_[-1], int) else "name"
            continue
        elif open_ and mark == ("]" if isinstance(open_[-1], int) else "}") and expects in ("comma", "value or ]", "name or }"):
            open_.pop()
            expects = "comma" if open_ else "end"
            continue
        else:
            return None
        low = value.lower()
        if any(t in low for t in lowered):
            line += text.count("\n", line_at, at)
            line_at = at
            hit = (line, "$" + "".join(map(_step, open_)), None)
            if hit not in found:
                found.append(hit)
    return found


Hit = tuple[int, int, str, str | None, str | None, str | None]
HIT = "array<struct<start_line:int,end_line:int,snippet:string,heading_path:string,json_path:string,label:string>>"
INVALID_JSON = "Invalid JSON · text fallback"
_HEADING = re.compile(r"\s*(#{1,6})\s(.*)")


def smallest_span(parts: list[str], terms: list[str]) -> tuple[int, int] | None:
    """The first of the smallest runs of parts that hold all terms, in one pass: the last place of each term."""
    last: dict[str, int] = {}
    best = None
    for end, part in enumerate(parts):
        low = part.lower()
        here = [t for t in terms if t in low]
        last.update(dict.fromkeys(here, end))
        if here and len(last) == len(terms):
            start = min(last.values())
            if best is None or end - start < best[1] - best[0]:
                best = start, end
    return best


def headings_of(lines: list[str]) -> list[str | None]:
    """The path of headings above each line, its own included."""
    levels: list[str | None] = [None] * 6
    out = []
    for line in lines:
        found = _HEADING.match(line)
        if found:
            depth = len(found[1])
            levels[depth - 1 :] = [found[2].strip()] + [None] * (6 - depth)
        out.append(" > ".join(x for x in levels if x) or None)
    return out


def text_hits(lines: list[str], terms: list[str], headings: list[str | None] | None = None, label: str | None = None, most: int = MOST) -> list[Hit]:
    """Of several terms the smallest span of lines with all of them; else the first lines with any."""
    span = smallest_span(lines, terms) if len(terms) > 1 else None
    spans = [span] if span else [(k, k) for k, x in enumerate(lines) if any(t in x.lower() for t in terms)][:most]
    out = []
    for a, b in spans:
        heading = headings[a] if headings else None
        where = f"lines {a + 1}-{b + 1}"
        out.append((a + 1, b + 1, "\n".join(lines[max(0, a - 1) : b + 2]).strip(), heading, None, label or (f"{heading} · {where}" if heading else where)))
    return out


def block_hits(blocks: list[dict], terms: list[str], most: int = MOST) -> list[Hit]:
    """The same over blocks; a span is reported at its last block, with the text of all."""
    span = smallest_span([b["text"] for b in blocks], terms) if len(terms) > 1 else None
    spans = [span] if span else [(k, k) for k, b in enumerate(blocks) if any(t in b["text"].lower() for t in terms)][:most]
    return [(blocks[b]["ordinal"], blocks[b]["ordinal"], "\n".join(x["text"] for x in blocks[a : b + 1]), blocks[b]["heading_path"], None, blocks[b]["label"]) for a, b in spans]


def resolve(text: str, extension: str, terms: list[str], blocks: list[dict] | None = None, most: int = MOST) -> list[Hit]:
    """Where a document of any kind holds the terms: blocks of a docx, paths of JSON, lines under the
    headings of Markdown, else lines. No terms, no hits."""
    extension, terms = (extension or "").lower(), list(dict.fromkeys(t.lower() for t in terms))
    if not terms:
        return []
    if extension == "docx" and blocks:
        return block_hits(blocks, terms, most)
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if extension == "json":
        found = json_hits(text, terms, most)
        if found:
            return [(line, line, "\n".join(lines[max(0, line - 2) : line + 1]).strip(), None, where, where) for line, where, _ in found]
        return text_hits(lines, terms, None, INVALID_JSON if found is None else None, most)
    return text_hits(lines, terms, headings_of(lines) if extension in ("md", "markdown") else None, None, most)


def locate(rows: DataFrame) -> DataFrame:
    """Rows (text, extension, terms and, if there are any, blocks) with one more column, ``hits``. Meant for
    the documents of a page, after its limit: nothing is shuffled."""
    blocks = F.col("blocks") if "blocks" in rows.columns else F.lit(None).cast("array<struct<ordinal:int,text:string,label:string,heading_path:string>>")

    @F.arrow_udf(HIT)
    def hits(texts: pa.Array, extensions: pa.Array, terms: pa.Array, parts: pa.Array) -> pa.Array:
        columns = (c.to_pylist() for c in (texts, extensions, terms, parts))
        fields = ("start_line", "end_line", "snippet", "heading_path", "json_path", "label")
        found = [[dict(zip(fields, h, strict=True)) for h in resolve(t or "", e, q or [], b)] for t, e, q, b in zip(*columns, strict=True)]
        kind = pa.struct([(f, pa.int32() if f.endswith("line") else pa.string()) for f in fields])
        return pa.array(found, pa.list_(kind))

    return rows.withColumn("hits", hits(F.col("text"), F.col("extension"), F.col("terms"), blocks))


def locate_json(documents: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, line, json_path, label). Text that is not JSON, and JSON without a hit, fall back to lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                hits = json_hits(text or "", terms)
                label = INVALID_JSON if hits is None else None
                if not hits:
                    lowered = [t.lower() for t in terms]
                    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
                    hits = [(k + 1, None, label) for k, x in enumerate(lines) if any(t in x.lower() for t in lowered)][:MOST]
                out += [(doc_id, line, where, mark) for line, where, mark in hits]
            yield pd.DataFrame(out, columns=["doc_id", "line", "json_path", "label"])

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, line int, json_path string, label string")
