"""The stored table of daily behavior: immutable versions below a folder, the newest committed one counts."""

from __future__ import annotations

import secrets
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import behavior

SCHEMA_VERSION = 2
DAYS = "day date, path_key string, directory_key string, extension string, weight_sum double, event_count long"
KEYS = ["day", "path_key", "directory_key", "extension"]


class BehaviorStore:
    """``root/v=<n>`` holds a version's days, ``root/committed/v=<n>`` its marker with the salt of its keys
    and the schema's version. A store of another schema is moved aside, not read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        found = self._marker()
        if found is not None and found["schema"] != SCHEMA_VERSION:
            self._move(self.root, f"{self.root}.legacy-{found['schema']}")
            found = None
        if found is None:
            self._commit(1, spark.createDataFrame([], DAYS), secrets.token_hex(32))

    def read(self) -> DataFrame:
        return self.spark.read.schema(DAYS).parquet(f"{self.root}/v={self._newest()}")

    def salt(self) -> bytes:
        return bytes.fromhex(self._marker()["salt"])

    def add(self, feedback: DataFrame) -> None:
        """Adds the daily sums of feedback rows to what is stored of the same day and keys."""
        both = self.read().unionByName(behavior.daily(feedback).select(*self.read().columns))
        sums = both.groupBy(*KEYS).agg(F.sum("weight_sum").alias("weight_sum"), F.sum("event_count").cast("long").alias("event_count"))
        self._commit(self._newest() + 1, sums, self._marker()["salt"])

    def prune(self, today: Column) -> None:
        self._commit(self._newest() + 1, behavior.retained(self.read(), today), self._marker()["salt"])

    def clear(self) -> None:
        """Forgets everything; keys that were hashed with the old salt cannot be told any more."""
        self._commit(self._newest() + 1, self.spark.createDataFrame([], DAYS), secrets.token_hex(32))

    def _commit(self, version: int, days: DataFrame, salt: str) -> None:
        days.write.mode("overwrite").parquet(f"{self.root}/v={version}")
        marker = self.spark.createDataFrame([(SCHEMA_VERSION, salt)], "schema int, salt string")
        marker.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/committed/v={version}")
        for old in self._versions():
            if old < version - 1:  # readers of the version before may still be at work
                self._delete(f"{self.root}/committed/v={old}")
                self._delete(f"{self.root}/v={old}")

    def _marker(self) -> dict | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.root}/committed/v={max(versions)}").first().asDict() if versions else None

    def _newest(self) -> int:
        return max(self._versions())

    def _versions(self) -> list[int]:
        where, files = self._path(f"{self.root}/committed")
        found: Iterable = files.listStatus(where) if files.exists(where) else []
        return [int(s.getPath().getName().split("=")[1]) for s in found if "=" in s.getPath().getName()]

    def _path(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _move(self, path: str, to: str) -> None:
        where, files = self._path(path)
        files.rename(where, self._path(to)[0])

    def _delete(self, path: str) -> None:
        where, files = self._path(path)
        files.delete(where, True)
