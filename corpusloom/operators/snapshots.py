"""Scan snapshots in folders: staged, then committed or aborted, once and for all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queue
from .commits import Conflict, Decisions

STAGING, COMMITTED, ABORTED = "staging", "committed", "aborted"
REASON = 500


class SnapshotStore:
    """``root/scan=<id>/attempt=<name>`` holds what one writer staged of a scan, its paths and fingerprints;
    ``root/decided/<id>`` tells whether the scan is committed, and with which attempt, or aborted. Any number of
    writers may stage a scan; one decision is made, by whoever is first, and never changed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.decided = Decisions(spark, f"{self.root}/decided")

    def stage(self, scan_id: int, rows: DataFrame, attempt: str | None = None) -> str:
        """Writes one fingerprint a path (the largest, if a path comes more than once) and gives the attempt's name."""
        attempt = attempt or uuid.uuid4().hex
        if self.state(scan_id) in (COMMITTED, ABORTED):
            raise ValueError("SCAN_NOT_STAGING")
        one = rows.groupBy("path_key").agg(F.max("fingerprint").alias("fingerprint"))
        one.write.mode("overwrite").parquet(f"{self.root}/scan={scan_id}/attempt={attempt}")
        return attempt

    def commit(self, scan_id: int, rows: DataFrame | None = None, attempt: str | None = None) -> None:
        """Commits a staged scan: the named attempt or the only one. With rows, these are staged first."""
        if rows is not None:
            attempt = self.stage(scan_id, rows, attempt)
        attempts = self._attempts(scan_id)
        if self.state(scan_id) == ABORTED or not attempts or (attempt is not None and attempt not in attempts):
            raise ValueError("SCAN_NOT_STAGING")
        if attempt is None and len(attempts) > 1:
            raise ValueError("SCAN_HAS_SEVERAL_ATTEMPTS")
        self._decide(scan_id, state=COMMITTED, attempt=attempt or attempts[0])

    def abort(self, scan_id: int, reason: str = "") -> None:
        """A committed scan stays as it is (Conflict). What an aborted one had staged is removed."""
        if self.state(scan_id) != ABORTED:
            self._decide(scan_id, state=ABORTED, reason=reason[:REASON])
        self.decided.delete(f"{self.root}/scan={scan_id}")

    def _decide(self, scan_id: int, **content) -> None:
        if not self.decided.decide(str(scan_id), **content):
            raise Conflict(f"scan {scan_id} is {self.state(scan_id)}")

    def _attempts(self, scan_id: int) -> list[str]:
        # a writer that failed half way has left no _SUCCESS
        folder = f"{self.root}/scan={scan_id}"
        return [n.split("=", 1)[1] for n in self.decided.children(folder) if n.startswith("attempt=") and "_SUCCESS" in self.decided.children(f"{folder}/{n}")]

    def state(self, scan_id: int) -> str | None:
        found = self.decided.read(str(scan_id))
        return found["state"] if found else STAGING if self._attempts(scan_id) else None

    def states(self) -> DataFrame:
        """(scan_id, state, reason) of all scans that were staged or decided."""
        ids = {int(n) for n in self.decided.names()} | {int(n.split("=")[1]) for n in self.decided.children(self.root) if n.startswith("scan=")}
        rows = [(k, self.state(k), (self.decided.read(str(k)) or {}).get("reason")) for k in sorted(ids)]
        return self.spark.createDataFrame(rows, "scan_id long, state string, reason string")

    def committed(self) -> list[int]:
        return sorted(int(n) for n in self.decided.names() if self.decided.read(n)["state"] == COMMITTED)

    def read(self, scan_id: int) -> DataFrame:
        found = self.decided.read(str(scan_id))
        if not found or found["state"] != COMMITTED:
            raise ValueError("SCAN_NOT_COMMITTED")
        return self.spark.read.schema("path_key string, fingerprint string").parquet(f"{self.root}/scan={scan_id}/attempt={found['attempt']}")

    def diff(self, before: int, after: int) -> DataFrame:
        return queue.snapshot_diff(self.read(before), self.read(after))
