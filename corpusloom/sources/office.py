"""The text of one file: strict decoding and office formats. Only the standard library is needed, as this runs in a
process of its own."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree as ET

# Formats read as text.
TEXT_EXTENSIONS = [
    "txt", "md", "markdown", "rst", "csv", "tsv", "json", "xml", "yaml", "yml", "log", "ini", "config", "cs", "py", "js", "ts", "tsx", "jsx", "java",
    "go", "rs", "sql", "ps1", "sh", "bat",
]
MAX_CHARACTERS = 1_000_000
#: Decompressed bytes that one document may have, all its parts together.
MAX_UNPACKED = 256 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


#: What an encrypted office document starts with: it is no zip archive, but a compound file.
COMPOUND = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"


class ExtractionError(Exception):
    pass


class Parts:
    """The parts of an office document, read under a limit of bytes for all of them."""

    def __init__(self, content: bytes, most: int = MAX_UNPACKED):
        if content.startswith(COMPOUND):
            raise ExtractionError("UNSUPPORTED_OR_ENCRYPTED_DOCUMENT")
        self.archive, self.left = zipfile.ZipFile(io.BytesIO(content)), most
        self.names = self.archive.namelist()

    def xml(self, name: str) -> ET.Element:
        with self.archive.open(name) as part:
            data = part.read(self.left + 1)
        self.left -= len(data)
        if self.left < 0:
            raise ExtractionError("FILE_TOO_LARGE")
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:  # the formats have none; entities can grow without bound
            raise ExtractionError("CORRUPT_DOCUMENT")
        return ET.fromstring(data)

    def numbered(self, pattern: str) -> list[str]:
        """Parts whose whole name fits, in the order of their number."""
        return sorted((n for n in self.names if re.fullmatch(pattern, n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))


def decode_strict(content: bytes) -> str:
    """UTF-8 unless a byte-order mark says otherwise; anything malformed is an error."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            break
    else:
        mark, name = b"", "utf-8"
    try:
        return content[len(mark) :].decode(name)
    except UnicodeDecodeError as error:
        raise ExtractionError("UNSUPPORTED_ENCODING") from error


def _styles(parts: Parts) -> dict[str, tuple[str, int | None, str | None]]:
    if "word/styles.xml" not in parts.names:
        return {}
    out = {}
    for style in parts.xml("word/styles.xml").iter(f"{_W}style"):
        name, base, outline = style.find(f"{_W}name"), style.find(f"{_W}basedOn"), style.find(f"{_W}pPr/{_W}outlineLvl")
        out[style.get(f"{_W}styleId", "")] = ("" if name is None else name.get(f"{_W}val", ""), None if outline is None else int(outline.get(f"{_W}val", "9")), None if base is None else base.get(f"{_W}val"))
    return out


def _heading_level(paragraph: ET.Element, styles: dict) -> int | None:
    direct = paragraph.find(f"{_W}pPr/{_W}outlineLvl")
    if direct is not None and int(direct.get(f"{_W}val", "9")) < 9:
        return int(direct.get(f"{_W}val")) + 1
    style = paragraph.find(f"{_W}pPr/{_W}pStyle")
    at, seen = None if style is None else style.get(f"{_W}val"), set()
    while at and at not in seen:
        seen.add(at)
        for name in (at, styles.get(at, ("", None, None))[0]):
            if m := re.fullmatch(r"heading ?([1-9])", name, re.IGNORECASE):
                return int(m[1])
        name, outline, base = styles.get(at, ("", None, None))
        if outline is not None and outline < 9:
            return outline + 1
        at = base
    return None


def docx_blocks(content: bytes) -> list[tuple[str, str, str | None]]:
    """(text, label, heading path) of paragraphs and table cells in order."""
    parts = Parts(content)
    styles = _styles(parts)
    body = parts.xml("word/document.xml").find(f"{_W}body")
    levels = [""] * 9
    out: list[tuple[str, str, str | None]] = []
    paragraphs = tables = 0

    def where() -> str | None:
        return " > ".join(x for x in levels if x.strip()) or None

    def text_of(node: ET.Element) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t"))

    for child in body if body is not None else []:
        if child.tag == f"{_W}p":
            text = text_of(child)
            if not text.strip():
                continue
            level = _heading_level(child, styles)
            if level:
                levels[level - 1 :] = [text.strip()] + [""] * (9 - level)
                out.append((text, f"{where()} · 标题 {level}", where()))
            else:
                paragraphs += 1
                out.append((text, (f"{where()} · " if where() else "") + f"第 {paragraphs} 段", where()))
        elif child.tag == f"{_W}tbl":
            tables += 1
            for r, row in enumerate(child.iter(f"{_W}tr"), 1):
                for c, cell in enumerate(row.iter(f"{_W}tc"), 1):
                    text = text_of(cell)
                    if text.strip():
                        out.append((text, (f"{where()} · " if where() else "") + f"表格 {tables} · 第 {r} 行 · 第 {c} 列", where()))
    return out


def xlsx_text(content: bytes) -> str:
    parts = Parts(content)
    shared = []
    if "xl/sharedStrings.xml" in parts.names:
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in parts.xml("xl/sharedStrings.xml").iter(f"{_S}si")]
    out = []
    for sheet in parts.numbered(r"xl/worksheets/sheet\d+\.xml"):
        for cell in parts.xml(sheet).iter(f"{_S}c"):
            value = cell.find(f"{_S}v")
            if cell.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
            elif value is None:
                continue
            elif cell.get("t") == "s":
                text = shared[int(value.text)] if int(value.text or -1) in range(len(shared)) else ""
            else:
                text = value.text or ""
            if text.strip():
                out.append(text)
    return "\n".join(out)


def pptx_text(content: bytes) -> str:
    parts = Parts(content)
    return "\n".join(t.text for n in parts.numbered(r"ppt/slides/slide\d+\.xml") for t in parts.xml(n).iter(f"{_A}t") if t.text and t.text.strip())


def space_camel_case(text: str) -> str:
    """Page text often loses spaces; one goes back between a small letter and a capital."""
    return re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", " ", text)


def cut_blocks(blocks: list[tuple[str, str, str | None]], most: int) -> tuple[list[tuple[str, str, str | None]], bool]:
    """Blocks, joined by line ends, up to a number of characters; the last one is cut."""
    out, left = [], most
    for text, label, heading in blocks:
        if out:
            left -= 1
        if left <= 0:
            return out, True
        out.append((text[:left], label, heading))
        if len(text) > left:
            return out, True
        left -= len(text)
    return out, False


def extract_one(path: str | None, content: bytes | None, max_bytes: int, max_characters: int, readers: dict | None = None) -> dict:
    """One row for any file, good or bad; without content there was nothing to be read."""
    out = {"path": path, "text": None, "truncated": None, "characters": None, "blocks": None, "error_code": None}
    extension = path.rsplit(".", 1)[-1].lower() if path and "." in path else ""
    try:
        if content is None:
            raise ExtractionError("ACCESS_DENIED")
        if len(content) > max_bytes:
            raise ExtractionError("FILE_TOO_LARGE")
        if extension == "docx":
            blocks, cut = cut_blocks(docx_blocks(content), max_characters)
            text = "\n".join(b[0] for b in blocks)
            out["blocks"] = [{"ordinal": k, "text": t, "label": x, "heading_path": h} for k, (t, x, h) in enumerate(blocks, 1)]
        else:
            if extension in TEXT_EXTENSIONS:
                text = decode_strict(content)
            elif extension == "xlsx":
                text = xlsx_text(content)
            elif extension == "pptx":
                text = pptx_text(content)
            elif extension in (readers or {}):
                text = readers[extension](content)
                if not text.strip():
                    raise ExtractionError("OCR_REQUIRED")
            elif extension == "pdf":
                raise ExtractionError("OCR_REQUIRED")  # no reader of the format is installed
            else:
                raise ExtractionError("UNSUPPORTED_FILE_TYPE")
            cut = len(text) > max_characters
            text = text[:max_characters]
        out |= {"text": text, "truncated": cut, "characters": len(text)}
    except ExtractionError as error:
        out["error_code"] = str(error)
    except (RuntimeError, NotImplementedError) as error:  # zip parts with a password, or packed in a way that is not known
        out["error_code"] = "CORRUPT_DOCUMENT" if isinstance(error, RecursionError) else "UNSUPPORTED_OR_ENCRYPTED_DOCUMENT"
    except (zipfile.BadZipFile, zlib.error, ET.ParseError, LookupError, ValueError, EOFError, OSError):
        out["error_code"] = "CORRUPT_DOCUMENT"
    except MemoryError:
        out["error_code"] = "EXTRACTION_FAILED"
    except Exception:  # a reader that was brought along may raise anything
        out["error_code"] = "EXTRACTION_FAILED"
    return out
