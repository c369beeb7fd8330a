"""Office files from lines of text, as small as the formats allow."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

from .extract import parts

_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"
_KEPT = 'xml:space="preserve"'


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def docx(lines: list[str]) -> bytes:
    """A paragraph a line."""
    body = "".join(f"<w:p><w:r><w:t {_KEPT}>{escape(x)}</w:t></w:r></w:p>" for x in lines)
    return _archive({"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>'})


def xlsx(lines: list[str]) -> bytes:
    """A row a line; every other one refers to a shared string."""
    cells = "".join(f'<row><c t="s"><v>{k // 2}</v></c></row>' if k % 2 == 0 else f'<row><c t="inlineStr"><is><t {_KEPT}>{escape(x)}</t></is></c></row>' for k, x in enumerate(lines))
    shared = "".join(f"<si><t {_KEPT}>{escape(x)}</t></si>" for x in lines[::2])
    return _archive({"xl/sharedStrings.xml": f'<sst xmlns="{_SHEET}">{shared}</sst>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEET}"><sheetData>{cells}</sheetData></worksheet>'})


def pptx(lines: list[str], a_slide: int = 10) -> bytes:
    """Ten lines a slide."""
    slides = [lines[k : k + a_slide] for k in range(0, len(lines), a_slide)]
    return _archive({f"ppt/slides/slide{k}.xml": f'<a:sld xmlns:a="{_DRAWING}">' + "".join(f"<a:t>{escape(x)}</a:t>" for x in some) + "</a:sld>" for k, some in enumerate(slides, 1)})


def spoilt(data: bytes, how: str) -> bytes:
    """A damaged file (its first part is cut short), or one whose first part has a password."""
    if how == "damaged":
        return data[: len(data) // 2]
    out = bytearray(data)
    out[6] |= 1
    out[data.index(b"PK\x01\x02") + 8] |= 1
    return bytes(out)


MAKERS = {"docx": docx, "xlsx": xlsx, "pptx": pptx}


def files(rows: DataFrame) -> DataFrame:
    """(path, content) of rows (path, lines, how): the extension tells the format, ``how`` what is wrong with the file, if anything."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts(batches):
            made = [MAKERS[p.rsplit(".", 1)[1]](list(x)) for p, x in zip(batch["path"], batch["lines"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "content": [m if how is None else spoilt(m, how) for m, how in zip(made, batch["how"], strict=True)]})

    return rows.select("path", "lines", "how").mapInPandas(run, "path string, content binary")
