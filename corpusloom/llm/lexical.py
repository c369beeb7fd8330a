"""Ranked lexical search by MaxScore in shards.

Documents are read once: each leaves its number of terms and, for the terms that the items ask for, how
often they occur. Its share of the postings is dealt to shards of a bounded size. A task inverts its shard
and answers every item in it by MaxScore: lists are ordered by the most that a posting of theirs can give;
those whose bounds together stay below the score of the k-th best so far are non-essential. Only
documents of essential lists are candidates, and a non-essential list is looked up only for those
that can still get among the best. The best of all shards meet in a window that Spark limits before
its shuffle.

Items are answered in blocks whose terms have a bounded size; each block reads the documents anew.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, slices, slots, text_bytes

#: Terms: ASCII letters and digits, and all code points beyond ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of items that are answered together; their terms go to every task.
ITEM_BYTES = 32 << 20
#: Postings of a shard (24 bytes each while it is searched).
SHARD_POSTINGS = 4_000_000
#: Documents of a shard that are scored at once, at first; each further block is twice as large.
FIRST_BLOCK = 256
#: Code points of a text that are searched at once.
PIECE = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms_of(body: bytes) -> Counter[str]:
    """How often each term occurs in a text; a long text is searched in pieces that cut no term."""
    text = body.translate(_LOWER).decode("utf-8", "replace")
    found: Counter[str] = Counter()
    start = 0
    while len(text) - start > PIECE:
        inside = TERM.match(text, start + PIECE)
        stop = inside.end() if inside else start + PIECE
        found.update(TERM.findall(text[start:stop]))
        start = stop
    found.update(TERM.findall(text[start:]))
    return found


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term) of all items, each once; rows with one id are one item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                each = [(i, t) for i, body in zip(part.column("item_id").to_pylist(), part.column("body").to_pylist(), strict=True) for t in terms_of(body)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in each], pa.int64()), pa.array([t for _, t in each], pa.string())], names=["item_id", "term"])

    return items.select(F.col(id_col).cast("long").alias("item_id"), text_bytes(text_col).alias("body")).mapInArrow(run, "item_id long, term string").distinct()


def document_rows(docs: DataFrame, number: dict[str, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): a document's number of terms, and the asked terms that it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            for part in slices(batch, "body", 2 << 20):
                n, terms, tfs = [], [], []
                for body in part.column("body").to_pylist():
                    found = terms_of(body)
                    held = sorted((asked[t], tf) for t, tf in found.items() if t in asked)
                    n.append(found.total())
                    terms.append([k for k, _ in held])
                    tfs.append([tf for _, tf in held])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Shard:
    """The inverted lists of one shard: documents by id, and what each posting adds to a score."""

    def __init__(self, doc_ids: np.ndarray, null: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weight: np.ndarray, total: int, length: int):
        order = np.lexsort((doc_ids, ~null))  # ties of scores fall to the smaller id, null first
        self.doc_ids, self.null = doc_ids[order], null[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, sizes)
        m = 10 + (90 * n * total) // length
        add = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, sizes)))
        by_list = np.lexsort((doc, terms))
        self.doc, self.add, self.terms = doc[by_list], add[by_list], terms[by_list]
        self.known, starts = np.unique(self.terms, return_index=True)
        self.start = np.append(starts, len(self.terms))
        self.bound = np.maximum.reduceat(self.add, starts) if len(starts) else np.zeros(0, np.int64)
        self.probed = self.scored = 0

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents with a score above 0, best first."""
        at = np.searchsorted(self.known, terms)
        at = at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == terms)] if len(self.known) else at[:0]
        at = at[np.argsort(self.bound[at], kind="stable")]  # small bounds first
        sums = np.concatenate([[0], np.cumsum(self.bound[at])])
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, size = 0, FIRST_BLOCK
        cursor = self.start[at].copy()
        while low < len(self.doc_ids):
            high = min(len(self.doc_ids), low + size)
            least = scores[-1] if len(scores) == k else 1
            # documents come by ascending id: a later one must beat the k-th best, an equal score stays behind it
            essential = int(np.searchsorted(sums[1:], least + (len(scores) == k), side="left"))
            if essential == len(at):
                break  # no list can lift a document among the best any more
            ends = np.array([c + np.searchsorted(self.doc[c : self.start[j + 1]], high) for c, j in zip(cursor, at, strict=True)], np.int64)
            spans = [slice(cursor[i], ends[i]) for i in range(essential, len(at))]
            held = np.concatenate([self.doc[x] for x in spans])
            total = np.zeros(high - low, np.int64)
            np.add.at(total, held - low, np.concatenate([self.add[x] for x in spans]))
            found = np.flatnonzero(total)
            self.scored += len(found)
            for i in range(essential - 1, -1, -1):
                found = found[total[found] + sums[i + 1] >= least + (len(scores) == k)]
                if not len(found):
                    break
                mine = self.doc[cursor[i] : ends[i]]
                self.probed += len(found)
                spot = np.searchsorted(mine, found + low)
                hit = spot < len(mine)
                hit[hit] = mine[spot[hit]] == found[hit] + low
                total[found[hit]] += self.add[cursor[i] + spot[hit]]
            if len(found):
                docs, scores = np.concatenate([docs, found + low]), np.concatenate([scores, total[found]])
                top = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[top], scores[top]
            cursor, low, size = ends, high, size * 2
        keep = scores > 0
        return docs[keep], scores[keep]


def _search(scratch: Scratch, docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """The k best documents of each item (item_id, term)."""
    spark = docs.sparkSession
    rows = items.toArrow()
    vocabulary = sorted(set(rows.column("term").to_pylist()))
    number = {t: i for i, t in enumerate(vocabulary)}
    asked: dict[int | None, list[int]] = {}
    for item, term in zip(rows.column("item_id").to_pylist(), rows.column("term").to_pylist(), strict=True):
        asked.setdefault(item, []).append(number[term])
    lists = [(item, np.array(sorted(t), np.int64)) for item, t in asked.items()]

    held = scratch.table(document_rows(docs, number, id_col, text_col), "terms")
    total, length, postings = held.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n"), F.sum(F.size("terms").cast("long"))).first()
    total, length, postings = total or 0, length or 1, postings or 0
    weight = np.zeros(len(vocabulary), np.int64)
    # one number for each asked term, at most
    counted = held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
    df = np.asarray(counted.column("df"), np.int64)
    weight[np.asarray(counted.column("t"), np.int64)] = np.floor(1000 * np.log((2 * total + 2) / (2 * df + 1))).astype(np.int64)
    shared = spark.sparkContext.broadcast((lists, weight))

    def run(table: pa.Table) -> pa.Table:
        lists, weight = shared.value
        ids, flat, tfs = table.column("doc_id").combine_chunks(), table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        shard = Shard(
            np.asarray(ids.fill_null(0), np.int64),
            np.asarray(ids.is_null().to_numpy(zero_copy_only=False)),
            np.asarray(table.column("n"), np.int64),
            np.asarray(flat.value_lengths(), np.int64),
            np.asarray(flat.flatten(), np.int64),
            np.asarray(tfs.flatten(), np.int64),
            weight,
            total,
            length,
        )
        out: list[tuple] = []
        for item, terms in lists:
            at, scores = shard.best(terms, k)
            out += [(item, None if shard.null[d] else int(shard.doc_ids[d]), int(s)) for d, s in zip(at.tolist(), scores.tolist(), strict=True)]
        return pa.table({"item_id": pa.array([x[0] for x in out], pa.int64()), "doc_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.int64())})

    shards = max(partitions(spark), postings // SHARD_POSTINGS + 1)
    names = F.array(*[F.lit(int(x)) for x in slots(shards)])
    # rows are dealt by what they hold and their place, so repeated rows spread
    dealt = held.filter(F.size("terms") > 0).withColumn("shard", F.element_at(names, (F.pmod(F.xxhash64("doc_id", "n", F.monotonically_increasing_id()), F.lit(shards)) + 1).cast("int")))
    return dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "item_id long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0.

    Null and empty texts have no terms; such documents count nowhere, and such items get no rows. Rows
    that share an item's id are one item with the terms of all (null is an id as well). Each row of the documents is a
    document: repeated rows rank side by side. Equal scores are ranked by ascending id, null first. Empty tables give
    no rows; other columns are ignored. A text of any length is searched in pieces.
    """
    scratch = Scratch(docs.sparkSession)
    asked = scratch.table(item_terms(items, item_col, item_text_col), "items")
    size = asked.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    blocks = size // ITEM_BYTES + 1
    parts = [_search(scratch, docs, asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k, id_col, text_col) for b in range(blocks)]
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
