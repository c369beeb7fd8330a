"""Column functions on text: tokens, snippets, line splitting, query shapes."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters with marks and what they fold to, for SQL, which has no decomposition at hand.
MARKED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįñńňòóôõöøōőřśšťùúûüūůűýÿžźż"
FOLDED = "aaaaaaaaacccdeeeeeeeeiiiiiinnnoooooooorsstuuuuuuuyyzzz"

IDENTIFIER = r"[\p{L}\p{N}\p{Mn}\p{Mc}_.+#-]+"
CJK = r"㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"


class _Folds(dict):
    """What a character folds to, found once: its base letter, nothing for a mark. Kana and Hangul,
    whose decomposition changes the letter itself, stay."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if unicodedata.category(c).startswith("M"):
            found = ""
        else:
            found = parts[0] if len(parts) > 1 and not 0x3040 <= code <= 0xD7FF else c
        self[code] = found
        return found


_FOLDS = _Folds()


def _mapped(change):
    """A function of strings as one on Arrow batches; nulls stay."""

    @F.arrow_udf(T.StringType())
    def mapped(texts: pa.Array) -> pa.Array:
        # some texts at a time as Python's own strings, not a whole batch of them
        parts = [pa.array([None if t is None else change(t) for t in texts.slice(b, 256).to_pylist()], pa.string()) for b in range(0, len(texts), 256)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return mapped


def folded(text: str) -> str:
    """The characters of a text as they fold. A text of which none folds, as most of ideographs, stays as it is."""
    return text.translate(_FOLDS) if any(_FOLDS[ord(c)] != c for c in set(text)) else text


def searchable(text: str) -> str:
    """Compatibility forms composed, small letters, no marks."""
    return folded(unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text).lower()))


_nfkc = _mapped(lambda t: unicodedata.normalize("NFKC", t))
_unmarked = _mapped(lambda t: folded(unicodedata.normalize("NFC", t)))
_searchable = _mapped(searchable)


def _plain_characters() -> tuple[str, dict[str, str]]:
    """Characters of European texts that fold one by one, as a regular expression's class, and what the
    letters among them fold to: Latin letters with marks, and punctuation."""
    ranges, folds, begin = "", {}, None
    codes = [*range(0x180), *range(0x2010, 0x2060), 0x20AC]
    for code in range(0x20AE):
        c = chr(code)
        ok = False
        if code in codes and len(c.lower()) == 1:
            want, have = searchable(c), c.lower().translate(_FOLDS)
            letters = "".join(x for x in want if x.isalnum())
            ok = letters == (have if have.isalnum() else "") and not unicodedata.category(c).startswith("M")
            if ok and have != c.lower():
                folds[c.lower()] = have
        if ok and begin is None:
            begin = code
        if not ok and begin is not None:
            ranges += f"\\x{{{begin:x}}}-\\x{{{code - 1:x}}}"
            begin = None
    return f"^[{ranges}]*$", folds


PLAIN, _PLAIN_FOLDS = _plain_characters()


def is_plain(text: Column) -> Column:
    return is_ascii(text) | text.rlike(PLAIN)


def _fold_plain(text: Column) -> Column:
    return F.when(is_ascii(text), text).otherwise(F.translate(text, "".join(_PLAIN_FOLDS), "".join(_PLAIN_FOLDS.values())))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _beyond(simple: Column, change, text: Column, plain: Column) -> Column:
    """A Python function for the texts that are not simple; it gets null for the others, whose characters so
    never leave the JVM (a condition around the call alone would not keep them from it)."""
    return F.coalesce(change(F.when(~simple, text)), plain)


def normalize_nfkc(text: Column) -> Column:
    """Compatibility composition. Plain ASCII never leaves the JVM."""
    return _beyond(is_ascii(text), _nfkc, text, text)


def fold_marks(text: Column) -> Column:
    """Small letters without their marks, by decomposition. Plain European text never leaves the JVM."""
    return _beyond(is_plain(text), _unmarked, text, _fold_plain(text))


def tokenize_app(text: Column) -> Column:
    """Identifiers in lower case without edge dots, dashes and underscores, if a letter or digit is left.

    For text without CJK runs; ``tokenize_mixed`` handles both.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(IDENTIFIER), F.lit(0))
    cut = F.transform(runs, lambda t: F.regexp_replace(t, r"^[._-]+|[._-]+$", ""))
    return F.filter(cut, lambda t: t.rlike(r"[\p{L}\p{Nd}]"))


def cjk_bigrams(run: Column) -> Column:
    """Overlapping pairs of a run of CJK characters; one character is itself."""
    return F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))


def tokenize_mixed(text: Column) -> Column:
    """Tokens in order: CJK runs as bigrams, everything between as identifiers."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(f"[{CJK}]+|(?:(?![{CJK}]){IDENTIFIER[:-1]})+"), F.lit(0))
    cut = F.transform(parts, lambda p: F.when(p.rlike(f"^[{CJK}]"), cjk_bigrams(p)).otherwise(F.filter(F.array(F.regexp_replace(p, r"^[._-]+|[._-]+$", "")), lambda t: t.rlike(r"[\p{L}\p{Nd}]"))))
    return F.flatten(cut)


def tokenize_fts(text: Column) -> Column:
    """The second stage: letters and digits, marks folded, lower case."""
    return F.regexp_extract_all(fold_marks(F.lower(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def index_terms(text: Column) -> Column:
    """What the index stores of a text, in order: the tokens of both stages at once.

    Compatibility forms are composed, letters are small and without marks, runs of CJK characters
    are overlapping pairs, everything else parts words. Plain European texts never leave the JVM; one
    Arrow pass for others.
    """
    plain = F.regexp_extract_all(_fold_plain(F.lower(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    parts = F.regexp_extract_all(_searchable(F.when(~is_plain(text), text)), F.lit(rf"[{CJK}]+|(?:(?![{CJK}])[\p{{L}}\p{{N}}])+"), F.lit(0))
    mixed = F.flatten(F.transform(parts, lambda p: F.when(p.rlike(f"^[{CJK}]"), cjk_bigrams(p)).otherwise(F.array(p))))
    return F.when(is_plain(text), plain).otherwise(mixed)


def count_terms(text: Column) -> Column:
    """How many tokens ``index_terms`` gives. Folding plain text leaves their number as it is."""
    return F.when(is_plain(text), F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+"))).otherwise(F.size(index_terms(F.when(~is_plain(text), text))))


def query_terms(query: Column) -> Column:
    """Distinct tokens in order of appearance; null where a query is blank or one CJK character."""
    plain = F.trim(normalize_nfkc(query))
    terms = F.array_distinct(tokenize_mixed(plain))
    broad = (plain == "") | plain.rlike(f"^[{CJK}]$") | (F.size(terms) == 0)
    return F.when(~broad, terms)


def match_expression(terms: Column) -> Column:
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " AND ")


def lines(text: Column) -> Column:
    return F.split(text, "\r\n|\r|\n", -1)


def snippet_fallback(text: Column, terms: Column) -> Column:
    """240 characters from 80 before the first place of any term, trimmed."""
    places = F.filter(F.transform(terms, lambda t: F.instr(F.lower(text), F.lower(t))), lambda p: p > 0)
    first = F.coalesce(F.array_min(places) - 1, F.lit(0))
    return F.trim(F.substring(text, F.greatest(first - 80, F.lit(0)) + 1, F.lit(240)))


def snippet_mail(body: Column, query: Column) -> Column:
    """Collapsed white space; up to 220 characters whole, else a window from 70 before the query."""
    flat = F.trim(F.regexp_replace(body, r"\s+", " "))
    at = F.greatest(F.instr(F.lower(flat), F.lower(F.trim(query))) - 1, F.lit(0))
    start = F.greatest(at - 70, F.lit(0))
    size = F.least(F.lit(220), F.length(flat) - start)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.trim(F.substring(flat, start + 1, size)), F.when(start + size < F.length(flat), "…").otherwise(""))
    return F.when(F.length(flat) <= 220, flat).otherwise(cut)


def left_units(text: Column, most: int) -> Column:
    """The first UTF-16 units of a text; a character beyond the basic plane has two and is never cut in half."""
    units = F.encode(text, "UTF-16BE")
    half = F.hex(F.substring(units, 2 * most - 1, 1)).between("D8", "DB")
    cut = F.decode(F.substring(units, F.lit(1), F.when(half, 2 * most - 2).otherwise(2 * most)), "UTF-16BE")
    return F.when(F.length(text) <= most // 2, text).when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), cut).otherwise(F.left(text, F.lit(most)))


def units(text: Column) -> Column:
    """How many UTF-16 units a text has."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def snippet_200(text: Column) -> Column:
    return left_units(F.regexp_replace(text, r"\s+", " "), 200)


def explicit_file_query(query: Column) -> Column:
    """Quoted as a whole, rooted, with a separator, or with an extension or a leading dot."""
    q = F.trim(query)
    quoted = q.rlike("^\".*\"$") | q.rlike("^'.*'$") | q.rlike("^“.*”$")
    return (F.length(q) > 0) & ((quoted & (F.length(q) >= 2)) | q.rlike(r"^[A-Za-z]:|[\\/]") | ((F.length(q) > 1) & q.rlike(r"\.[^.]+$|^\.")))


# Cues of a question.
CUES = ["find ", "show me", "where is", "which ", "what ", "帮我找", "找一下", "查找", "哪个", "哪里", "什么"]


def natural_language_query(query: Column) -> Column:
    q = F.lower(F.trim(query))
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.contains(q, F.lit(c))
    return q.rlike("[?？]") | (F.size(F.filter(F.split(q, r"\s+"), lambda t: t != "")) >= 4) | cue


def preview_terms(query: Column) -> Column:
    """The terms of a query, longest first, equal lengths in order of appearance; a query that is too
    broad for terms gives its words."""
    terms = F.coalesce(query_terms(query), F.filter(F.split(F.trim(query), r"\s+"), lambda t: t != ""))
    keyed = F.transform(terms, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def truncate_chars(text: Column, most: int) -> Column:
    """(text, truncated): at most so many UTF-16 units."""
    return F.struct(left_units(text, most).alias("text"), (units(text) > most).alias("truncated"))


def truncate_message(text: Column, most: int = 500) -> Column:
    """An error message as it is stored: 500 characters at most, 300 for mail."""
    return F.left(text, F.lit(most))


def mail_identity_path(store: Column, entry: Column) -> Column:
    return F.concat(F.lit("outlook://mail/"), F.substring(F.sha2(F.concat(store, F.lit("\n"), entry), 256), 1, 24))


def channel_name(identity: Column, prefix: str) -> Column:
    """The name of a user's local channel: a prefix and half of the SHA-256 of who it is."""
    if not prefix.strip() or any(c in prefix for c in "\\/"):
        raise ValueError("INVALID_ARGUMENTS: the prefix must be a plain name")
    return F.concat(F.lit(prefix + "-"), F.left(F.sha2(identity, 256), F.lit(32)))


def sentence_piece_id(n: Column) -> Column:
    return F.when(n == 0, 3).otherwise(n + 1)


def hmac_key(salt: bytes, kind: str, path: Column) -> Column:
    """HMAC-SHA256 of kind, a zero byte and the upper-case path."""

    @F.pandas_udf(T.BinaryType())
    def keyed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(salt, kind.encode() + b"\0" + v.upper().encode(), hashlib.sha256).digest())

    return keyed(path)


def mail_detail(sender: Column, recipients: Column, ts: Column) -> Column:
    """What a mail row shows below its subject: who wrote to whom, and when."""
    people = F.when(F.trim(F.coalesce(recipients, F.lit(""))) == "", sender).otherwise(F.concat(sender, F.lit(" → "), recipients))
    return F.concat(people, F.lit(" · "), F.date_format(ts, "yyyy-MM-dd HH:mm"))


def mail_reference(subject: Column, sender: Column, recipients: Column, ts: Column, folder: Column, attachments: Column, snippet: Column) -> Column:
    """A mail as text to be quoted, a line for each part; attachments only where there are any."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    line = lambda label, value: F.concat(F.lit(label), F.coalesce(value, F.lit("")), F.lit("\n"))
    return F.concat(
        line("邮件：", F.when(blank(subject), "(无主题)").otherwise(subject)), line("发件人：", sender), line("收件人：", recipients), line("时间：", F.date_format(ts, "yyyy-MM-dd HH:mm")), line("文件夹：", folder),
        F.when(blank(attachments), "").otherwise(line("附件：", attachments)), F.lit("正文片段："), F.coalesce(snippet, F.lit("")),
    )


def truncated_blocks(blocks: Column, most: int) -> Column:
    """Blocks, joined by line ends, up to a number of characters; the last one is cut.

    A fold: the state is the room left and what has been taken.
    """
    kind = "struct<left:int,out:array<string>>"
    start = F.struct(F.lit(most).alias("left"), F.array().cast("array<string>").alias("out")).cast(kind)

    def step(s: Column, text: Column) -> Column:
        room = s["left"] - F.when(F.size(s["out"]) > 0, 1).otherwise(0)
        taken = F.struct((room - F.length(text)).alias("left"), F.concat(s["out"], F.array(F.left(text, F.greatest(room, F.lit(0))))).alias("out")).cast(kind)
        return F.when(room > 0, taken).otherwise(F.struct(F.lit(0).alias("left"), s["out"].alias("out")).cast(kind))

    return F.aggregate(blocks, start, step)["out"]


def pair_ids(query_ids: Column, text_ids: Column, query_most: int = 48, most: int = 192, begin: int = 0, pad: int = 1, end: int = 2) -> Column:
    """The ids of a pair: begin, query, end, end, text, end, padded to a fixed length."""
    q = F.slice(query_ids, 1, query_most)
    room = F.lit(most - 4) - F.size(q)
    ids = F.concat(F.array(F.lit(begin)), q, F.array(F.lit(end), F.lit(end)), F.slice(text_ids, F.lit(1), room), F.array(F.lit(end)))
    return F.concat(ids, F.array_repeat(F.lit(pad), F.lit(most) - F.size(ids)))
