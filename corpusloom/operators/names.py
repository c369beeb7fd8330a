"""Search over names and metadata of the catalog."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from . import policy

MAX_LIMIT = 100
PAGE, PAGES = 100, 5


@dataclass
class NameQuery:
    text: str
    path: str | None = None
    extensions: list[str] = field(default_factory=list)
    kind: str | None = None
    modified_after: str | None = None
    modified_before: str | None = None
    sort_by: str = "name"
    descending: bool = False
    limit: int = 50
    offset: int = 0


def validate(query: NameQuery) -> None:
    if not 1 <= query.limit <= MAX_LIMIT or query.offset < 0:
        raise ValueError("INVALID_QUERY: limit is 1 to 100, offset is 0 and more")
    if query.path is not None and not (len(query.path) > 2 and query.path[1:3] == ":\\"):
        raise ValueError("INVALID_QUERY: the path must be absolute")
    if query.modified_after and query.modified_before and query.modified_after > query.modified_before:
        raise ValueError("INVALID_QUERY: dates are inverted")
    for e in normalized_extensions(query.extensions):
        if not (e.isascii() and e.isalnum()):
            raise ValueError("INVALID_QUERY: bad extension")
    if query.sort_by not in ("name", "path", "size", "modified"):
        raise ValueError("INVALID_QUERY: bad sort")


def normalized_extensions(extensions: list[str]) -> list[str]:
    return list(dict.fromkeys(e.strip().lstrip(".").lower() for e in extensions))


def compiled_text(query: NameQuery) -> str:
    """The query as one string of the catalog's dialect."""
    validate(query)
    parts = ['"' + query.text.strip().replace('"', "quot:") + '"']
    if query.path:
        parts.append('"' + query.path.rstrip("\\") + '\\"')
    if query.extensions:
        parts.append("<" + "|".join(f"ext:{e}" for e in normalized_extensions(query.extensions)) + ">")
    if query.kind:
        parts.append(f"{query.kind}:")
    for sign, value in ((">=", query.modified_after), ("<=", query.modified_before)):
        if value:
            parts.append(f"dm:{sign}" + value.replace("-", "").replace(":", "").replace(" ", "T"))
    return " ".join(parts)


def predicate(query: NameQuery) -> Column:
    """The same query as one condition, so that Spark can push it into the scan."""
    validate(query)
    where = F.contains(F.col("path_key") if "\\" in query.text else F.lower("name"), F.lit(query.text.strip().lower()))
    if query.path:
        where = where & F.startswith(F.col("path_key"), F.lit(query.path.lower().rstrip("\\") + "\\"))
    if query.extensions:
        where = where & F.lower("extension").isin(normalized_extensions(query.extensions))
    if query.kind:
        where = where & (F.col("kind") == query.kind)
    if query.modified_after:
        where = where & (F.col("modified_at") >= F.lit(query.modified_after).cast("timestamp"))
    if query.modified_before:
        where = where & (F.col("modified_at") <= F.lit(query.modified_before).cast("timestamp"))
    return where


def order(sort_by: str, descending: bool) -> list[Column]:
    first = {"name": F.lower("name"), "path": F.col("path_key"), "size": F.col("size"), "modified": F.col("modified_at")}[sort_by]
    return [first.desc_nulls_last() if descending else first.asc_nulls_first(), F.col("path_key").asc()]


def search(catalog: DataFrame, query: NameQuery) -> DataFrame:
    """One page of a name query, in order."""
    return catalog.filter(predicate(query)).orderBy(*order(query.sort_by, query.descending)).offset(query.offset).limit(query.limit)


#: A batch of more queries than this meets names by shared grams, a smaller one by scanning all names.
SCANNED = 32
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))))


def containing(files: DataFrame, queries: DataFrame, few: int | None = None) -> DataFrame:
    """Files joined with the queries (query_id, query) whose trimmed text their name contains, whatever the case.

    A batch of up to SCANNED queries is broadcast: its size is checked, and each file is read once. A
    larger batch would make that a product of both sides; there each query is looked up by the rarest
    of its grams of three characters (or of all of it, if shorter), an equi-join whose hits are then
    verified. Grams of names are counted before they are shuffled, so a common one is no hot key:
    it is the rarest of a query only if all its grams are common. A blank query finds nothing.
    """
    queries = queries.filter(F.trim("query") != "")
    if few is None:
        few = queries.limit(SCANNED + 1).count()
    wanted = F.lower(F.trim("query"))
    held = F.contains(F.lower(files["name"]), F.lower(F.trim(queries["query"])))
    if few <= SCANNED:
        return files.join(F.broadcast(queries), held)
    asked = queries.withColumn("wanted", wanted)
    keys = files.select(*files.columns, F.lower("name").alias("low"))
    parts = []
    for n in range(1, GRAM + 1):
        some = asked.filter((F.length("wanted") == n) if n < GRAM else (F.length("wanted") >= n))
        grams = keys.select(F.explode(_grams(F.col("low"), n)).alias("gram"))
        counted = grams.groupBy("gram").agg(F.count("*").alias("held_by"))
        each = some.select("query_id", F.explode(_grams(F.col("wanted"), n)).alias("gram"))
        rarest = each.join(counted, "gram", "left").groupBy("query_id").agg(F.min_by("gram", F.struct(F.coalesce("held_by", F.lit(0)), F.col("gram"))).alias("gram"))
        probes = some.join(rarest, "query_id")
        named = keys.withColumn("gram", F.explode(_grams(F.col("low"), n)))
        parts.append(named.join(probes, "gram").filter(F.contains(F.col("low"), F.col("wanted"))).select(*files.columns, *queries.columns))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


#: Words of the dialect for spans of time, as (unit, units back).
SPANS = {"today": ("day", 0), "yesterday": ("day", 1), **{f"{which}{unit}": (unit, back) for which, back in (("this", 0), ("last", 1)) for unit in ("week", "month", "year")}}


def _span(word: str, as_of: Column) -> tuple[Column, Column]:
    """Begin and end of a named span of time; a week begins on Monday."""
    unit, back = SPANS[word]
    begin = F.date_trunc(unit, as_of)
    step = lambda k: F.expr(f"INTERVAL {k} {unit}")
    return begin - step(back), begin + step(1 - back)


def _moment(text: str) -> Column:
    for pattern in ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y%m%dT%H%M%S", "%Y%m%d", "%Y-%m", "%Y"):
        try:
            return F.lit(datetime.datetime.strptime(text, pattern).isoformat(sep=" ")).cast("timestamp")
        except ValueError:
            continue
    raise ValueError("INVALID_QUERY: not a date " + text)


def parse_raw(text: str, as_of: Column | None = None) -> Column:
    """A condition from the catalog's dialect: space is AND, ``|`` is OR, ``!`` is NOT, ``< >`` groups, quotes are
    literal. A word with ``*`` or ``?`` is a pattern of the whole name (of the whole path, with a ``\\`` in it),
    other words are parts of it. Functions are ext:, file:, folder:, size: (with kb, mb, gb, tb) and dm:, whose dates may be
    literal or spans such as thisweek, seen from ``as_of`` (now); both take ranges such as 1kb..2mb, ends
    included. What is not understood raises INVALID_QUERY."""
    as_of = F.current_timestamp() if as_of is None else as_of
    return _condition(_tree(text), as_of)


def required_grams(text: str) -> list[str]:
    """Grams of GRAM characters that every name which passes the query holds, as far as its words tell."""
    return sorted(_required(_tree(text)))


def _tree(text: str) -> tuple:
    """The query as ("and" | "or", parts), ("not", part) or ("term", token)."""
    tokens: list[str] = []
    at = 0
    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
        elif c in "<>|!":
            tokens.append(c)
            at += 1
        else:
            end, quoted = at, False
            while end < len(text) and (quoted or not (text[end].isspace() or text[end] == "|" or (text[end] in "<>" and text[end - 1] != ":"))):
                quoted ^= text[end] == '"'
                end += 1
            if quoted:
                raise ValueError("INVALID_QUERY: open quote")
            tokens.append(text[at:end])
            at = end
    place = 0

    def alternatives() -> tuple:
        nonlocal place
        parts = [sequence()]
        while place < len(tokens) and tokens[place] == "|":
            place += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence() -> tuple:
        parts = []
        while place < len(tokens) and tokens[place] not in ("|", ">"):
            parts.append(one())
        if not parts:
            raise ValueError("INVALID_QUERY: empty expression")
        return parts[0] if len(parts) == 1 else ("and", parts)

    def one() -> tuple:
        nonlocal place
        token = tokens[place] if place < len(tokens) else "|"
        if token in ("|", ">"):
            raise ValueError("INVALID_QUERY: nothing to negate")
        place += 1
        if token == "!":
            return "not", one()
        if token != "<":
            return "term", token
        found = alternatives()
        if place >= len(tokens) or tokens[place] != ">":
            raise ValueError("INVALID_QUERY: open group")
        place += 1
        return found

    found = alternatives()
    if place != len(tokens):
        raise ValueError("INVALID_QUERY: unexpected " + tokens[place])
    return found


def _condition(tree: tuple, as_of: Column) -> Column:
    kind, rest = tree
    if kind == "term":
        return _term(rest, as_of)
    if kind == "not":  # what is not known to hold does not hold
        return ~F.coalesce(_condition(rest, as_of), F.lit(False))
    parts = [_condition(x, as_of) for x in rest]
    return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), parts)


def _required(tree: tuple) -> set[str]:
    kind, rest = tree
    if kind == "not":
        return set()
    if kind != "term":
        parts = [_required(x) for x in rest]
        return set.union(*parts) if kind == "and" else set.intersection(*parts)
    pattern = _pattern(rest)
    if pattern is None or "\\" in rest:
        return set()
    words = [w for part, literal in pattern for w in ([part] if literal else re.split(r"[*?]", part))]
    return {w[k : k + GRAM] for w in words for k in range(len(w) - GRAM + 1)}


def _pattern(token: str) -> list[tuple[str, bool]] | None:
    """A word in lower case as (text, quoted) parts; None for functions."""
    lower = token.lower()
    plain = re.sub(r'"[^"]*"', "", lower)
    if ":" in plain and not (len(plain) > 2 and plain[1] == ":" and plain[0].isalpha() and plain[2] == "\\"):
        return None
    return [(part, k % 2 == 1) for k, part in enumerate(lower.split('"')) if part]


def _bytes_of(text: str) -> int:
    found = re.fullmatch(r"(\d+)(b|kb|mb|gb|tb)?", text.lower())
    if not found:
        raise ValueError("INVALID_QUERY: not a size " + text)
    return int(found[1]) << {"kb": 10, "mb": 20, "gb": 30, "tb": 40}.get(found[2], 0)


def _term(token: str, as_of: Column) -> Column:
    pattern = _pattern(token)
    if pattern is not None:
        text = "".join(part for part, _ in pattern)
        column = F.col("path_key") if "\\" in text else F.lower("name")
        if any(not literal and re.search(r"[*?]", part) for part, literal in pattern):
            escaped = [re.sub(r"[%_^]", r"^\g<0>", part) for part, _ in pattern]
            like = "".join(part if literal else part.replace("*", "%").replace("?", "_") for part, (_, literal) in zip(escaped, pattern, strict=True))
            return F.like(column, F.lit(like), F.lit("^"))
        return F.contains(column, F.lit(text))
    lower = token.lower()
    if lower.startswith("ext:"):
        return F.lower("extension").isin([e.strip().lstrip(".") for e in lower[4:].split(";")])
    if lower in ("file:", "folder:"):
        return F.col("kind") == lower[:-1]
    for name, column in (("dm:", F.col("modified_at")), ("size:", F.col("size"))):
        if lower.startswith(name):
            value = lower[len(name) :]
            sign = next((s for s in (">=", "<=", ">", "<", "=") if value.startswith(s)), "")
            value = value[len(sign) :]
            if not sign and ".." in value:
                least, _, most = value.partition("..")
                return _compare(column, ">=", name, least, as_of) & _compare(column, "<=", name, most, as_of)
            return _compare(column, sign, name, value, as_of)
    raise ValueError("INVALID_QUERY: unknown function " + token)


def _compare(column: Column, sign: str, name: str, value: str, as_of: Column) -> Column:
    if name == "dm:" and value in SPANS:
        begin, end = _span(value, as_of)
        return {">=": column >= begin, "<=": column < end, ">": column >= end, "<": column < begin}.get(sign, (column >= begin) & (column < end))
    limit = _moment(value.upper()) if name == "dm:" else F.lit(_bytes_of(value))
    return {">=": column >= limit, "<=": column <= limit, ">": column > limit, "<": column < limit}.get(sign, column == limit)


GRAM_BUCKETS = 64


def _gram_bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BUCKETS)).cast("int")


def write_grams(files: DataFrame, folder: str) -> DataFrame:
    """Stores (gram, path_key) of all names, by bucket of the gram and sorted, and gives the stored table."""
    rows = files.select(F.explode(_grams(F.lower("name"), GRAM)).alias("gram"), "path_key").withColumn("bucket", _gram_bucket(F.col("gram")))
    rows.repartition("bucket", F.pmod(F.xxhash64("path_key"), F.lit(4))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(folder)
    return files.sparkSession.read.schema("gram string, path_key string, bucket int").parquet(folder)


def candidates(grams: DataFrame, text: str) -> DataFrame | None:
    """(path_key) of files whose name holds the rarest gram that the query requires; None if it requires none.

    Counts of the required grams alone come to the driver; the scans are pruned to their buckets."""
    wanted = required_grams(text)
    if not wanted:
        return None
    spark = grams.sparkSession
    buckets = dict(map(tuple, spark.createDataFrame([(g,) for g in wanted], "gram string").select("gram", _gram_bucket(F.col("gram"))).collect()))
    asked = grams.filter(F.col("bucket").isin(sorted(set(buckets.values()))) & F.col("gram").isin(wanted))
    counts = dict(map(tuple, asked.groupBy("gram").agg(F.count("*")).collect()))
    rarest = min(wanted, key=lambda g: (counts.get(g, 0), g))
    return grams.filter((F.col("bucket") == buckets[rarest]) & (F.col("gram") == rarest)).select("path_key")


def search_raw(files: DataFrame, text: str, grams: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """The files that pass a query of the dialect; with stored grams only candidates are tested."""
    keys = candidates(grams, text) if grams is not None else None
    some = files if keys is None else files.join(keys, "path_key", "left_semi")
    return some.filter(parse_raw(text, as_of))


def noise_aware(catalog: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """The first pages in name order, without filtered names; normal names first.

    Pages of 100 candidates are read until one ends with ``limit`` normal names, at most five: a page
    counts if fewer normal names than that lie before it. The candidates are the 500 first by name,
    a top-k, so the windows that follow see 500 rows whatever the catalog.
    """
    query = F.lit(text)
    rows = catalog.filter(F.contains(F.lower("name"), F.lit(text.strip().lower())))
    first = rows.orderBy(F.lower("name"), "path_key").limit(PAGE * PAGES)
    by_name = Window.orderBy(F.lower("name"), "path_key")
    paged = first.withColumn("page", F.floor((F.row_number().over(by_name) - 1) / PAGE).cast("int"))
    level = policy.noise(query, F.col("name"), F.col("path_key"), F.col("extension"), F.col("attributes"))
    judged = paged.withColumn("noise", level)
    before = F.coalesce(F.sum((F.col("noise") == 0).cast("int")).over(Window.orderBy("page").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = judged.withColumn("before", before).filter((F.col("before") < limit) & (F.col("noise") < 2))
    rank = policy.name_match_rank(query, F.col("name"))
    order = ["noise", rank, F.length("name"), F.lower("name"), "path_key"]
    ranked = kept.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return ranked.filter(F.col("position") <= limit).select("position", "name", "full_path", "noise")


def items(catalog: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """The page of ``noise_aware`` as items: baseline_index from 0, tier (0 exact, 1 eligible, 2 soft), size null for folders."""
    page = noise_aware(catalog, text, limit).select("position", "full_path", "noise")
    facts = page.join(catalog, "full_path")
    exact = policy.exact_query(F.lit(text), F.col("name"), F.col("path_key"))
    tier = F.when(exact, 0).when(F.col("noise") == 1, 2).otherwise(1)
    return facts.select((F.col("position") - 1).alias("baseline_index"), "name", "full_path", "extension", "kind", F.when(F.col("kind") != "folder", F.col("size")).alias("size"), "modified_at", F.lit("name").alias("match_source"), tier.alias("tier"))


def decode(rows: DataFrame) -> DataFrame:
    """Native catalog rows: FILETIME to UTC (null unless above 0), size -1 to null, kind by flag."""
    ticks = F.when(F.col("filetime") > 0, F.timestamp_micros(((F.col("filetime") - 116444736000000000) / 10).cast("long")))
    return rows.select("name", F.when(F.col("is_folder"), "folder").otherwise("file").alias("kind"), F.when(F.col("size") >= 0, F.col("size")).alias("size"), ticks.alias("modified_at"))


def name_components(catalog: DataFrame) -> DataFrame:
    return catalog.select("full_path", paths.components(F.col("path_key")).alias("components"), paths.dotted_extension(F.col("extension"), F.col("name")).alias("dotted"))
