"""Decisions of which only one writer can make each: the base of transactional tables.

A decision is a small JSON file with a name. It is written whole under another name and then put in its place by an
operation that fails if the place is taken: a hard link on a POSIX file system, a rename on
distributed ones such as HDFS. Stores without such an operation cannot hold decisions.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer was first."""


class Decisions:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._array = spark.sparkContext._gateway.new_array
        self._configuration = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.root).getFileSystem(self._configuration)
        self._local = self._files.getUri().getScheme() == "file"

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _plain(self, name: str):
        return self._jvm.java.io.File(self._path(name).toUri().getPath()).toPath()

    def decide(self, name: str, **content) -> bool:
        """Writes the decision; False if there is one already."""
        staged, target = f"{self.root}/.{name}.{uuid.uuid4().hex}", f"{self.root}/{name}"
        data = bytearray(json.dumps(content, sort_keys=True).encode())
        self._files.mkdirs(self._path(self.root))
        if self._local:
            paths = self._jvm.java.nio.file.Files
            paths.write(self._plain(staged), data, self._array(self._jvm.java.nio.file.OpenOption, 0))
            try:
                paths.createLink(self._plain(target), self._plain(staged))
                return True
            except Py4JJavaError as error:
                if "FileAlreadyExists" not in str(error.java_exception):
                    raise
                return False
            finally:
                paths.deleteIfExists(self._plain(staged))
        out = self._files.create(self._path(staged), True)
        out.write(data)
        out.close()
        if not self._files.exists(self._path(target)) and self._files.rename(self._path(staged), self._path(target)):
            return True
        self._files.delete(self._path(staged), False)
        return False

    def read(self, name: str) -> dict | None:
        where = self._path(f"{self.root}/{name}")
        if not self._files.exists(where):
            return None
        stream = self._files.open(where)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def names(self) -> list[str]:
        where = self._path(self.root)
        if not self._files.exists(where):
            return []
        return sorted(n for s in self._files.listStatus(where) if not (n := s.getPath().getName()).startswith("."))

    def children(self, folder: str) -> list[str]:
        """Names in any folder of the same store."""
        where = self._path(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(where)) if self._files.exists(where) else []

    def move(self, folder: str, to: str) -> None:
        if not self._files.rename(self._path(folder), self._path(to)):
            raise OSError(f"{folder} could not be moved")

    def delete(self, folder: str) -> None:
        self._files.delete(self._path(folder), True)


class Versions:
    """A log of numbered decisions without gaps: each version is the whole state of a table."""

    def __init__(self, spark: SparkSession, root: str):
        self.decisions = Decisions(spark, root)

    def latest(self) -> tuple[int, dict]:
        found = self.decisions.names()
        return (int(found[-1]), self.decisions.read(found[-1])) if found else (0, {})

    def read(self, version: int) -> dict | None:
        return self.decisions.read(f"{version:012d}")

    def propose(self, version: int, **content) -> None:
        if not self.decisions.decide(f"{version:012d}", **content):
            raise Conflict(f"version {version} is taken")
