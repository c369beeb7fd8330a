"""Files of any kind give one row each; patterns of the dialect; JSON of any depth."""

import io
import json
import time
import zipfile

import pytest

from corpusloom.functions import text as tx
from corpusloom.operators import locate, names
from corpusloom.sources import extract, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def archive(parts: dict, method=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


DOCX = archive({"word/document.xml": f"<w:document {W}><w:body>" + "".join(f"<w:p><w:r><w:t>line {k}</w:t></w:r></w:p>" for k in range(300)) + "</w:body></w:document>"})


def damaged(data: bytes) -> bytes:
    at = data.index(b"document.xml") + 12
    return data[:at] + bytes(b ^ 0x5A for b in data[at : at + 40]) + data[at + 40 :]


def patched(data: bytes, local: int, central: int, value: bytes) -> bytes:
    """A field of the first entry, in its local and its central header."""
    out = bytearray(data)
    out[local : local + len(value)] = value
    at = data.index(b"PK\x01\x02") + central
    out[at : at + len(value)] = value
    return bytes(out)


FILES = {
    "good.docx": (DOCX, None),
    "damaged.docx": (damaged(DOCX), "CORRUPT_DOCUMENT"),
    "half.docx": (DOCX[: len(DOCX) // 2], "CORRUPT_DOCUMENT"),
    "locked.docx": (patched(DOCX, 6, 8, b"\x01\x00"), "UNSUPPORTED_OR_ENCRYPTED_DOCUMENT"),
    "odd.docx": (patched(DOCX, 8, 10, b"\x63\x00"), "UNSUPPORTED_OR_ENCRYPTED_DOCUMENT"),
    "compound.docx": (office.COMPOUND + b"\x00" * 600, "UNSUPPORTED_OR_ENCRYPTED_DOCUMENT"),
    "noparts.docx": (archive({"x": "y"}), "CORRUPT_DOCUMENT"),
    "notxml.xlsx": (archive({"xl/worksheets/sheet1.xml": "<a>"}), "CORRUPT_DOCUMENT"),
    "badindex.xlsx": (archive({"xl/worksheets/sheet1.xml": '<s xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><c t="s"><v>x</v></c></s>'}), "CORRUPT_DOCUMENT"),
    "entity.pptx": (archive({"ppt/slides/slide1.xml": '<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'}), "CORRUPT_DOCUMENT"),
    "deep.pptx": (archive({"ppt/slides/slide1.xml": "<a>" * 50_000 + "</a>" * 50_000}), None),
    "none.docx": (None, "ACCESS_DENIED"),
    "none": (b"x", "UNSUPPORTED_FILE_TYPE"),
    "empty.docx": (b"", "CORRUPT_DOCUMENT"),
    "empty.txt": (b"", None),
}


def test_every_file_gives_a_row(spark):
    rows = [(name, None if data is None else bytearray(data)) for name, (data, _) in FILES.items()] + [(None, bytearray(b"x"))]
    got = {r.path: r for r in extract.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {name: got[name].error_code for name in FILES} == {name: code for name, (_, code) in FILES.items()}
    assert got["good.docx"].text.startswith("line 0\nline 1") and got["empty.txt"].text == "" and got[None].error_code == "UNSUPPORTED_FILE_TYPE"


def test_unpacked_bytes_are_bounded(monkeypatch):
    bomb = archive({"word/document.xml": f"<w:document {W}>" + " " * 3_000_000 + "</w:document>"})
    monkeypatch.setattr(office.Parts.__init__, "__defaults__", (1_000_000,))
    assert len(bomb) < 10_000 and office.extract_one("b.docx", bomb, 10**7, 100)["error_code"] == "FILE_TOO_LARGE"


def test_a_hung_or_dying_reader_costs_one_file(spark):
    def read(content: bytes) -> str:
        import os
        import re
        import signal

        if content == b"hang":  # native code that no Python signal ends
            signal.pthread_sigmask(signal.SIG_BLOCK, set(signal.Signals))
            re.match(r"(a|aa)+$", "a" * 60 + "b")
        if content == b"die":
            os._exit(3)
        if content == b"raise":
            raise ArithmeticError
        if content == b"grow":
            return "x" * (1 << 33)
        return content.decode() + "!"

    bodies = ["one", "hang", "two", "die", "three", "raise", "grow", "four"]
    frame = spark.createDataFrame([(f"{k}.pdf", bytearray(b.encode())) for k, b in enumerate(bodies)], "path string, content binary").coalesce(1)
    start = time.time()
    got = {r.path: r.text or r.error_code for r in extract.extract(frame, seconds=3, readers={"pdf": read}).collect()}
    assert [got[f"{k}.pdf"] for k in range(8)] == ["one!", "EXTRACTION_TIMEOUT", "two!", "EXTRACTION_FAILED", "three!", "EXTRACTION_FAILED", "EXTRACTION_FAILED", "four!"]
    assert time.time() - start < 60


def test_json_of_any_depth_and_length():
    start = time.time()
    assert locate.json_hits("[" * 100_000, ["x"]) is None
    assert locate.json_hits("[" * 64 + '"x"' + "]" * 64, ["x"]) == [(1, "$" + "[0]" * 64, None)]
    assert locate.json_hits("[" * 65 + '"x"' + "]" * 65, ["x"]) is None
    big = json.dumps([{"key": k, "name": f"value {k}"} for k in range(100_000)], indent=1)
    assert locate.json_hits(big, ["value 99999"]) == [(400_000, "$[99999].name", None)]
    assert time.time() - start < 8
    for bad in ("", " ", "{", "[1,]", '{"a":1,}', "01", "1 2", '{"a" 1}', "nul", '"\n"', "[1 2]", "{1:2}", "]", "tru e", '["\\x"]', "-", "1.", "NaN"):
        assert locate.json_hits(bad, ["1"]) is None, bad
    assert locate.json_hits('{"a b": {"c\'d": [true, null, -1.5e3, "\\u0078y"]}}\n', ["x", "true", "-1.5"]) == [(1, "$['a b']['c\\'d'][0]", None), (1, "$['a b']['c\\'d'][2]", None), (1, "$['a b']['c\\'d'][3]", None)]
    assert locate.json_hits('[\n"x",\n\n"x"]', ["x"], 1) == [(2, "$[0]", None)]


def test_patterns_of_the_dialect(spark, tmp_path):
    files = [("a.md", "d:\\x\\a.md", "md", 5), ("abmd", "d:\\x\\abmd", "", 2048), ("100%_x.txt", "d:\\x\\100%_x.txt", "txt", 1024), ("read me.md", "d:\\y\\read me.md", "md", None), ("b*c.txt", "d:\\y\\b*c.txt", "txt", 3 << 20)]
    rows = spark.createDataFrame([(n, p, e, "file", s) for n, p, e, s in files], "name string, path_key string, extension string, kind string, size long").withColumn("modified_at", names.F.lit("2024-01-05 12:00:00").cast("timestamp"))
    grams = names.write_grams(rows, f"file://{tmp_path}/g")

    def found(text):
        plain, pruned = ({r.name for r in names.search_raw(rows, text, g).collect()} for g in (None, grams))
        assert plain == pruned
        return plain

    assert found("*.md") == {"a.md", "read me.md"} and found("a?md") == {"a.md", "abmd"} and found("!md") == {"100%_x.txt", "b*c.txt"}
    assert found("*%_*") == {"100%_x.txt"} and found("?.md") == {"a.md"} and found('"b*c"') == {"b*c.txt"} and found('*"d me".md') == {"read me.md"}
    assert found("size:>=1kb") == {"abmd", "100%_x.txt", "b*c.txt"} and found("size:1kb..2kb") == {"abmd", "100%_x.txt"} and found("!size:>0") == {"read me.md"}
    assert found("dm:2024-01-05T00:00:00..2024-01-06 !<*.md|*.txt>") == {"abmd"} and found("!!a.md") == {"a.md"} and found("d:\\?\\*.txt") == {"100%_x.txt", "b*c.txt"}
    assert found("<read|none> me") == {"read me.md"} and found("read.me") == set()
    assert set(names.required_grams("read*me.md !xyzzy <abcd|abce>")) == {"abc", "rea", "ead", "me.", "e.m", ".md"}
    for bad in ("!", "a !", "! | b", "size:1zb", "size:..", "dm:1..2..3", "regex:x", "<a", "a>", "size:-1"):
        with pytest.raises(ValueError, match="INVALID_QUERY"):
            names.parse_raw(bad)


def test_cuts_count_utf16_units(spark):
    values = ["", "ab", "a😀b", "😀😀", "é日", "😀" * 200, "x" * 199 + "😀y", None]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", tx.truncate_chars(names.F.col("t"), 3).alias("c"), tx.snippet_200(names.F.col("t")).alias("s")).collect()
    units = lambda t: len(t.encode("utf-16-le")) // 2

    def cut(t, most):
        while units(t) > most:
            t = t[:-1]
        return t

    for r in rows:
        if r.t is None:
            assert r.c.text is None and r.s is None
        else:
            assert (r.c.text, r.c.truncated, r.s) == (cut(r.t, 3), units(r.t) > 3, cut(r.t, 200))


def test_results_are_held_in_small_parts():
    import pandas as pd

    from corpusloom.sources import extract

    batch = pd.DataFrame({"path": [f"p{k}" for k in range(1000)]})
    parts = list(extract.parts(iter([batch, batch.iloc[:0], batch.iloc[:3]])))
    assert max(map(len, parts)) == extract.FILES < 100
    assert pd.concat(parts)["path"].tolist() == batch["path"].tolist() + ["p0", "p1", "p2"]
