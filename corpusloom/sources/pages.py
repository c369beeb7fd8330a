"""Catalogs and mailboxes as folders of page files, read by a Python data source.

A page file is what one call of a paged source gives: a first line with its envelope (kind, rows, and the least
and largest value of each column), then one JSON row a line. A partition is a run of files of about PARTITION
bytes. With the option ``push`` the source takes filters over: they are tested against a page's envelope, which skips
the rest of the file, and then row by row; both happen in the tasks. A frame that was loaded so is for one query: Spark 4.1
keeps what was pushed into a loaded Python source and would apply it to a second query of the same frame. Without the
option Spark filters by itself and a frame may be used again.

``spark.read.format("corpusloom-pages").option("kind", "catalog").load(folder)``; ``read`` registers it.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shipping import ship

FORMAT = "corpusloom-pages"
SCHEMAS = {
    "catalog": "name string, full_path string, parent_path string, extension string, kind string, size long, modified_at timestamp, attributes int",
    "mailbox": "store_id string, entry_id string, subject string, sender string, recipients string, folder string, body string, attachment_names string, ts timestamp, item_class int",
}
#: Rows of a page, bytes of a partition, rows that are decoded at once.
PAGE, PARTITION, ROWS = 1000, 32 << 20, 4096
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def export(rows: DataFrame, folder: str, order: str, page: int = PAGE) -> None:
    """Writes page files of a catalog or mailbox, of about ``page`` rows each, in the order of a column."""
    count = rows.count()
    parts = max(1, math.ceil(count / page))
    spans = [F.struct(F.min(c).alias("least"), F.max(c).alias("most")).alias(c) for c in rows.columns]
    whole = rows.select([F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) if t == "timestamp" else F.col(c) for c, t in rows.dtypes])
    dealt = whole.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id())
    envelope = dealt.groupBy("part").agg(F.lit(0).alias("nth"), F.to_json(F.struct(F.count("*").alias("rows"), F.struct(*spans).alias("columns"))).alias("value"))
    lines = dealt.select("part", F.lit(1).alias("nth"), F.to_json(F.struct(*rows.columns)).alias("value"))
    # a page is one group: its envelope first
    both = envelope.unionByName(lines).repartition(parts, "part").sortWithinPartitions("part", "nth")
    both.select("part", "value").write.partitionBy("part").text(folder)


@dataclass
class Pages(InputPartition):
    files: list[str]
    filters: list[tuple] = field(default_factory=list)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        kind = self.options.get("kind", "catalog")
        if kind not in SCHEMAS:
            raise ValueError(f"unknown kind of pages: {kind}")
        return SCHEMAS[kind]

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options["path"], schema, self.options.get("push", "false").lower() == "true")


class PageReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, push: bool):
        self.path, self.schema, self.push = path, schema, push
        self.filters: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of one column with values; gives back the rest, which Spark applies."""
        for f in filters:
            if self.push and type(f) in (*_COMPARE, In, IsNull, IsNotNull, StringStartsWith) and len(f.attribute) == 1:
                self.filters.append((type(f), f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Pages]:
        files, root = pa.fs.FileSystem.from_uri(self.path)
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        found = sorted((f.path, f.size) for f in files.get_file_info(pa.fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", ".")))
        out, size = [Pages([], self.filters)], 0
        for path, length in found:
            if size and size + length > PARTITION:
                out.append(Pages([], self.filters))
                size = 0
            out[-1].files.append(prefix + path)
            size += length
        return out

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        times = {f.name for f in schema if pa.types.is_timestamp(f.type)}
        for name in partition.files:
            files, path = pa.fs.FileSystem.from_uri(name)
            with files.open_input_stream(path) as stream:
                lines = _lines(stream)
                envelope = json.loads(next(lines, "{}"))
                if all(_may_hold(envelope.get("columns", {}).get(c), kind, value, c in times) for kind, c, value in partition.filters):
                    rows = (json.loads(x) for x in lines)
                    yield from _batches(({c: _typed(r.get(c), c in times) for c in schema.names} for r in rows), partition.filters, schema)


def _lines(stream) -> Iterator[str]:
    rest = b""
    while chunk := stream.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            if line:
                yield line.decode()
    if rest:
        yield rest.decode()


def _typed(value, time: bool):
    if value is None or not time:
        return value
    return dt.datetime.fromisoformat(value).replace(tzinfo=dt.timezone.utc)


def _bounds(value):
    return value.astimezone(dt.timezone.utc) if isinstance(value, dt.datetime) else value


def _may_hold(span: dict | None, kind: type, value, time: bool) -> bool:
    """Whether a page with these bounds of a column can hold a row that passes; unknown bounds can."""
    if kind is IsNull or span is None:
        return True
    least, most = (_typed(span.get(k), time) for k in ("least", "most"))
    if least is None:
        return False  # only nulls
    if kind is IsNotNull:
        return True
    if kind is StringStartsWith:
        return least[: len(value)] <= value <= most[: len(value)]
    if kind in (EqualTo, In):
        return any(v is not None and least <= _bounds(v) <= most for v in (value if kind is In else (value,)))
    return _COMPARE[kind](most if kind in (GreaterThan, GreaterThanOrEqual) else least, _bounds(value))


def _passes(value, kind: type, wanted) -> bool:
    if kind is IsNull:
        return value is None
    if value is None:
        return False
    if kind is IsNotNull:
        return True
    if kind is StringStartsWith:
        return value.startswith(wanted)
    if kind is In:
        return value in tuple(map(_bounds, wanted))
    return _COMPARE[kind](value, _bounds(wanted))


def _batches(rows: Iterator[dict], filters: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        if all(_passes(row[c], kind, value) for kind, c, value in filters):
            held.append(row)
            if len(held) == ROWS:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def read(spark: SparkSession, folder: str, kind: str, push: bool = False) -> DataFrame:
    """A folder of page files of a kind. With ``push`` the frame's filters are pushed into the source, for one query."""
    ship(spark)
    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).option("kind", kind).option("push", str(push).lower()).load(folder)
