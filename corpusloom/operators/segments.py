"""A stored index of immutable segments: cheap updates, deletions by mark, size-tiered compaction.

A round writes one segment with the postings of what changed and the ids that it takes out of older segments; nothing
stored is rewritten. A numbered manifest (one decision, made by one writer) names the segments of
each version and the corpus statistics. A row counts if no later segment took its document out.

Compaction merges the newest segments whenever FANOUT or more of them are of like size, so a document is
rewritten a number of times that grows with the logarithm of the index; and all of them when half
of what is stored no longer counts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import index as ix
from .commits import Conflict, Versions

#: Segments of like size that are merged, and what like means.
FANOUT, LIKE = 4, 4
#: Part of the stored documents that may be dead before everything is merged.
DEAD = 0.5
#: Documents taken out, from which on their ids are hashed for the join with stored rows.
GONE = 20_000
#: Attempts of a round that another writer overtakes.
ATTEMPTS = 5
TABLES = ("postings", "stats", "documents")
STORED = {
    "postings": "doc_id long, field string, term string, tf long, positions array<int>, bucket int, seg string",
    "stats": "doc_id long, title_len long, body_len long, seg string",
    "gone": "path_key string, old_id long, seg string",
}


@dataclass(frozen=True)
class Version:
    number: int
    segments: list[dict]  # oldest first: name, at (its round), docs, gone
    n_docs: int
    length: int


class SegmentedIndex:
    """An index below ``root``; documents are rows (doc_id, name, extension, path_key, text, ...) of one schema."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, f"{self.root}/manifest")

    def version(self, number: int | None = None) -> Version:
        number, entry = self.versions.latest() if number is None else (number, self.versions.read(number))
        if entry is None:
            raise ValueError("VERSION_NOT_FOUND")
        return Version(number, entry.get("segments", []), entry.get("n_docs", 0), entry.get("length", 0))

    # rounds

    def apply(self, changed: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """One round: documents that came or changed (of several rows of a path the newest counts, as in ``index.merged``)
        and paths that went (path_key). Gives the new version. A path keeps its doc_id while it is indexed. A round that
        another writer overtakes is made again on what that one left."""
        for _ in range(ATTEMPTS):
            try:
                return self._round(changed, gone)
            except Conflict:
                continue
        raise Conflict("other writers were first each time")

    def _round(self, changed: DataFrame | None, gone: DataFrame | None) -> int:
        base = self.version()
        number = base.number + 1
        name = f"{number:012d}_{uuid.uuid4().hex}"
        paths = [f.select("path_key") for f in (changed, gone) if f is not None]
        if changed is None and not (gone is not None and base.segments):
            return base.number
        touched = paths[0] if len(paths) == 1 else paths[0].unionByName(paths[1])
        old = None
        if base.segments:
            live = self._live("documents", base).select("path_key", F.col("doc_id").alias("old_id"))
            old = live.join(touched.distinct(), "path_key", "left_semi")
            old.write.parquet(self._folder("gone", name))
            old = self._stored("gone", [name]).drop("seg")
        if changed is not None:
            order = [F.col(c).desc() for c in ("indexed_at", "doc_id") if c in changed.columns]
            one = changed.withColumn("nth", F.row_number().over(Window.partitionBy("path_key").orderBy(*order))).filter("nth = 1").drop("nth")
            if old is not None:
                one = one.join(old, "path_key", "left").withColumn("doc_id", F.coalesce("old_id", "doc_id")).drop("old_id")
            one.write.parquet(self._folder("documents", name))
            fresh = self.spark.read.schema(one.schema).parquet(self._folder("documents", name))
            self._write(ix.build(fresh), name)
        added, removed = self._totals(name) if changed is not None else (0, 0), (0, 0)
        if old is not None:
            ids = old.select(F.col("old_id").alias("doc_id"))
            removed = self._sum(self._live("stats", base).join(ids, "doc_id", "left_semi"))
        segment = {"name": name, "at": number, "docs": added[0], "gone": removed[0], "rows": changed is not None, "marks": old is not None}
        self.versions.propose(number, segments=[*base.segments, segment], n_docs=base.n_docs + added[0] - removed[0], length=base.length + added[1] - removed[1])
        return number

    def compact(self) -> int:
        """Merges what has grown alike; gives the version, a new one if there was something to merge."""
        base = self.version()
        some = self._mergeable(base)
        if len(some) < 2 and not (some and some[0]["gone"]):
            return base.number
        number = base.number + 1
        name = f"{number:012d}_{uuid.uuid4().hex}"
        rest = base.segments[: len(base.segments) - len(some)]
        part = Version(base.number, some, 0, 0)
        documents = self._live("documents", part)
        documents.write.parquet(self._folder("documents", name))
        self._write(ix.Index(self._live("postings", part).drop("bucket"), self._live("stats", part), None, None), name)
        marks = [s for s in some if s["marks"]]
        if rest and marks:  # older segments still need the marks
            self._stored("gone", [s["name"] for s in marks]).select("path_key", "old_id").distinct().write.parquet(self._folder("gone", name))
        docs, _ = self._totals(name)
        segment = {"name": name, "at": some[-1]["at"], "docs": docs, "gone": sum(s["gone"] for s in some) if rest else 0, "rows": True, "marks": bool(rest and marks)}
        self.versions.propose(number, segments=[*rest, segment], n_docs=base.n_docs, length=base.length)
        return number

    @staticmethod
    def _mergeable(base: Version) -> list[dict]:
        stored = sum(s["docs"] for s in base.segments)
        if stored and base.n_docs < (1 - DEAD) * stored:
            return base.segments
        size, k = 0, len(base.segments)
        while k and base.segments[k - 1]["docs"] <= LIKE * max(1, size):
            k -= 1
            size += base.segments[k]["docs"]
        some = base.segments[k:]
        return some if len(some) >= FANOUT else []

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes segments that none of the newest ``keep`` versions names; not while rounds or readers of older versions run."""
        newest = self.version().number
        named = {s["name"] for n in range(max(1, newest - keep + 1), newest + 1) for s in self.version(n).segments}
        files = self.versions.decisions
        old = sorted({n.split("=", 1)[1] for t in (*TABLES, "gone") for n in files.children(f"{self.root}/{t}") if n.startswith("seg=")} - named)
        for name in old:
            for table in (*TABLES, "gone"):
                files.delete(self._folder(table, name))
        return old

    # reading

    def index(self, number: int | None = None, terms: list[str] | None = None) -> ix.Index:
        """The index of a version, the newest by default; with terms, scans are pruned to their buckets."""
        version = self.version(number)
        if not any(s["rows"] for s in version.segments):
            raise ValueError("INDEX_EMPTY")
        postings = self._live("postings", version, terms)
        average = version.length / version.n_docs if version.n_docs else None
        corpus = self.spark.createDataFrame([(version.n_docs, average)], "n_docs long, avgdl double")
        return ix.Index(postings, self._live("stats", version), corpus, self._live("documents", version))

    def _folder(self, table: str, name: str) -> str:
        return f"{self.root}/{table}/seg={name}"

    def _live(self, table: str, version: Version, terms: list[str] | None = None) -> DataFrame:
        """Rows of a table that no later segment took out."""
        names = [s["name"] for s in version.segments if s["rows"]]
        rows = self._stored(table, names)
        if terms is not None:
            rows = ix.of_terms(rows, terms)
        marked = [s["name"] for s in version.segments if s["marks"]]
        if marked:
            # a merged segment stands where its newest member stood
            order = F.substring("seg", 1, 12).cast("long")
            for segment in version.segments:
                if int(segment["name"][:12]) != segment["at"]:
                    order = F.when(F.col("seg") == segment["name"], segment["at"]).otherwise(order)
            gone = self._stored("gone", marked).select(F.col("old_id").alias("doc_id"), order.alias("gone_at")).groupBy("doc_id").agg(F.max("gone_at").alias("gone_at"))
            if sum(s["gone"] for s in version.segments) > GONE:
                gone = gone.hint("shuffle_hash")  # the rows pass by the ids; a sort of all rows for a merge would grow with them
            rows = rows.withColumn("at", order).join(gone, "doc_id", "left").filter("gone_at is null or at >= gone_at").drop("at", "gone_at")
        return rows.drop("seg")

    def _stored(self, table: str, names: list[str]) -> DataFrame:
        reader = self.spark.read.option("basePath", f"{self.root}/{table}")
        if table in STORED:
            reader = reader.schema(STORED[table])
        return reader.parquet(*[self._folder(table, n) for n in names])

    def _write(self, index: ix.Index, name: str) -> None:
        index.stats.write.parquet(self._folder("stats", name))
        ix.write_postings(index.postings, self._folder("postings", name), parts=ix.parts_of(self._stored("stats", [name])))

    def _totals(self, name: str) -> tuple[int, int]:
        return self._sum(self._stored("stats", [name]))

    @staticmethod
    def _sum(stats: DataFrame) -> tuple[int, int]:
        n, length = stats.agg(F.count("*"), F.sum(F.col("title_len") + F.col("body_len"))).first()
        return n, length or 0
