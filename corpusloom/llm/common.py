"""Shared pieces of the training-data operators: scratch tables, global ranks, batch helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

_SCRATCH: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _SCRATCH.setdefault("own", "file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone; the folder is then left to the cluster's own clean-up
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_HOLDER: list = [None, None]


def claim(name: str, release=None) -> None:
    """Tells a Python worker, which Spark uses again for other operators, which one works in it now:
    what the last one had cached is released."""
    held, free = _HOLDER
    if held != name:
        if free is not None:
            free()
        _HOLDER[:] = [name, release]


class Scratch:
    """Tables of one operator call in the shared folder; each cuts the lineage before it.

    ``drop`` removes one that is no longer needed. What the returned frame still reads
    lives until the session ends.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.paths: dict[int, str] = {}
        self.kept: list[DataFrame] = []

    def folder(self, name: str) -> str:
        path = scratch_path(self.spark, name)
        atexit.register(_forget, weakref.ref(self.spark), path)
        return path

    def table(self, frame: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        schema = frame.schema
        frame.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = path
        self.kept.append(out)
        return out

    def drop(self, frame: DataFrame) -> None:
        path = self.paths.pop(id(frame), None)
        if path:
            _remove(self.spark, path)


def _forget(session, path: str) -> None:
    spark = session()
    if spark is not None and spark.sparkContext._jsc is not None:
        _remove(spark, path)


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def globally_ranked(scratch: Scratch, frame: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """Adds ``g``, the row's 0-based place in the order of the named columns, and gives the row count.

    One range shuffle; only one number per partition comes to the driver. The sorted rows are
    written once, so a lost executor cannot move a boundary between the count and the use. Rows that
    are alike in all named columns are dealt by their place in the input, so a third of all rows
    may be alike.
    """
    spark = scratch.spark
    low = F.lit((1 << 33) - 1)
    dealt = (
        frame.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(partitions(spark), *order, "tie")
        .sortWithinPartitions(*order, "tie")
        .drop("tie")
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND(low))
    )
    kept = scratch.table(dealt, name)
    counts = {r["part"]: r["n"] for r in kept.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(counts):
        starts[part] = total
        total += counts[part]
    if not starts:
        return kept.withColumn("g", F.col("at")).drop("part", "at"), 0
    size = max(starts) + 1
    base = F.lit([starts.get(k, 0) for k in range(size)])
    return kept.withColumn("g", F.element_at(base, F.col("part") + 1) + F.col("at")).drop("part", "at"), total


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Row ranges of a batch whose values of one binary or string column stay near ``most`` bytes."""
    values = batch.column(column)
    n = len(values)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type) else np.int32
    ends = np.frombuffer(values.buffers()[1], kind)[values.offset : values.offset + n + 1].astype(np.int64)
    start = 0
    while start < n:
        stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def flat_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, end to end, and the offsets of its values."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    offsets = np.frombuffer(values.buffers()[1], kind)[values.offset : values.offset + n + 1].astype(np.int64)
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slots(n: int) -> np.ndarray:
    """n different integers that Spark's hash partitioning deals to n different partitions.

    Groups named by them are one to a partition; names 0 to n - 1 would leave a third of the
    partitions empty and put several groups into others.
    """
    found = np.full(n, -1, np.int32)
    missing, start = n, 0
    while missing:
        names = np.arange(start, start + 4 * n, dtype=np.int32)
        place = _spark_hash(names).astype(np.int64) % n
        for name, k in zip(names.tolist(), place.tolist(), strict=True):
            if found[k] < 0:
                found[k] = name
                missing -= 1
        start += 4 * n
    return found


def _spark_hash(values: np.ndarray) -> np.ndarray:
    """Murmur3 (32 bits, seed 42) of 32-bit integers, as Spark partitions by it."""
    u = np.uint32

    def turn(x, r):
        return (x << u(r)) | (x >> u(32 - r))

    with np.errstate(over="ignore"):
        k = turn(values.astype(np.int32).view(np.uint32) * u(0xCC9E2D51), 15) * u(0x1B873593)
        h = turn(u(42) ^ k, 13) * u(5) + u(0xE6546B64)
        h ^= u(4)
        h ^= h >> u(16)
        h *= u(0x85EBCA6B)
        h ^= h >> u(13)
        h *= u(0xC2B2AE35)
        h ^= h >> u(16)
    return h.view(np.int32)


def deal(rows: np.ndarray, number: np.ndarray, names: np.ndarray) -> pa.Table:
    """Packed rows as (part, blob), dealt by a number to the named parts."""
    part = (number % np.uint64(len(names))).astype(np.int64)
    order = np.argsort(part, kind="stable")
    rows, ends = rows[order], np.cumsum(np.bincount(part, minlength=len(names)))
    starts = np.concatenate([[0], ends[:-1]])
    keep = np.flatnonzero(ends > starts)
    return pa.table({"part": pa.array(names[keep], pa.int32()), "blob": pa.array([rows[starts[k] : ends[k]].tobytes() for k in keep.tolist()], pa.binary())})


def unpack(table: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column("blob").to_pylist()])
