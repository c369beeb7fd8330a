"""Models that rank: their files are checked before they run, and one that is fitted from stored feedback."""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rerank

READY, MISSING, MISMATCH, INVALID, FAILED = "ready", "missing_assets", "hash_mismatch", "invalid_model", "inference_failed"
#: Bytes of an asset that are hashed at once.
CHUNK = 4 << 20
WARM_UP = ("local search", "document")


class ModelRefused(Exception):
    """A model that must not be used; the message begins with its status."""


def digests(assets: DataFrame, root: str) -> DataFrame:
    """(asset, found, bytes): SHA-256 in capital hex of each named file below ``root``, read in chunks; null if there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, where = pa.fs.FileSystem.from_uri(root)
        for batch in batches:
            rows = []
            for asset in batch["asset"]:
                path = f"{where}/{asset}"
                if files.get_file_info(path).type != pa.fs.FileType.File:
                    rows.append((asset, None, None))
                    continue
                digest, size = hashlib.sha256(), 0
                with files.open_input_stream(path) as stream:
                    while chunk := stream.read(CHUNK):
                        digest.update(chunk)
                        size += len(chunk)
                rows.append((asset, digest.hexdigest().upper(), size))
            yield pd.DataFrame(rows, columns=["asset", "found", "bytes"]).astype({"bytes": "Int64"})

    return assets.select("asset").mapInPandas(run, "asset string, found string, bytes long")


def integrity(manifest: DataFrame, root: str) -> DataFrame:
    """(asset, bytes, status) of each asset of a manifest (asset, sha256), whatever the case of its digest."""
    found = manifest.join(digests(manifest, root), "asset")
    status = F.when(F.col("found").isNull(), MISSING).when(F.upper("sha256") == F.col("found"), READY).otherwise(MISMATCH)
    return found.select("asset", "bytes", F.coalesce(status, F.lit(MISMATCH)).alias("status"))


def checked(manifest: DataFrame, root: str, load: Callable[[], Callable]) -> Callable[[], Callable]:
    """``load`` for ``rerank.scored``, after its assets are as the manifest tells. The model is tried on one pair in each task
    that loads it; one that is refused raises ModelRefused, here or there."""
    bad = integrity(manifest, root).filter(F.col("status") != READY).orderBy("status", "asset").limit(1).collect()
    if bad:
        raise ModelRefused(f"{bad[0].status}: {bad[0].asset}")

    def tried() -> Callable:
        try:
            model = load()
        except Exception as error:
            raise ModelRefused(f"{INVALID}: {type(error).__name__}") from error
        try:
            values = list(model(pd.Series([WARM_UP[0]]), pd.Series([WARM_UP[1]])))
        except Exception as error:
            raise ModelRefused(f"{FAILED}: {type(error).__name__}") from error
        if len(values) != 1 or not math.isfinite(values[0]):
            raise ModelRefused(f"{FAILED}: the first score is not finite")
        return model

    return tried


# A scorer that is fitted

#: Hashed features of a pair, steps and rate of the fit, weight of the square norm, pairs of one gradient batch.
FEATURES, STEPS, RATE, SHRINK = 1 << 14, 30, 1.0, 1e-4


def features(query: str, text: str) -> dict[int, float]:
    """Hashed features of a pair, of length 1: which query words the text holds and how early and often, and words that
    stand side by side."""
    asked, words = _words(query), _words(text)
    first: dict[str, int] = {}
    count: dict[str, int] = {}
    for k, w in enumerate(words):
        first.setdefault(w, k)
        count[w] = count.get(w, 0) + 1
    out: dict[int, float] = {}

    def add(name: str, value: float) -> None:
        key = zlib.crc32(name.encode()) % FEATURES
        out[key] = out.get(key, 0.0) + value

    for w in dict.fromkeys(asked):
        add("held" if w in first else "lacks", 1.0)
        if w in first:
            add("early", 1 / (1 + first[w]))
            add("often", math.log1p(count[w]) / math.log1p(len(words)))
            add("held:" + w, 1.0)
    following = set(zip(words, words[1:], strict=False))
    for pair in zip(asked, asked[1:], strict=False):
        add("beside" if pair in following else "apart", 1.0)
    add("short", 1 / (1 + math.log1p(len(words))))
    norm = math.sqrt(sum(v * v for v in out.values())) or 1.0
    return {k: v / norm for k, v in out.items()}


def _words(text: str | None) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def preferences(feedback: DataFrame, shown: DataFrame, key: str = "query_id") -> DataFrame:
    """(query_id, better, worse): of the candidates that were shown (query_id, cand_id, idx), one that was acted on and each
    one above it that was not. ``feedback`` are rows (query_id, cand_id) with positive actions."""
    acted = feedback.select(key, "cand_id").distinct().join(shown, [key, "cand_id"]).select(key, F.col("cand_id").alias("better"), F.col("idx").alias("at"))
    passed = shown.join(feedback.select(key, "cand_id").distinct(), [key, "cand_id"], "left_anti").select(key, F.col("cand_id").alias("worse"), F.col("idx").alias("over"))
    return acted.join(passed, key).filter("over < at").select(key, "better", "worse")


def differences(pairs: DataFrame) -> DataFrame:
    """(keys, values): the features of the better text less those of the worse, of rows (query, better_text, worse_text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, values = [], []
            for q, a, b in zip(batch["query"], batch["better_text"], batch["worse_text"], strict=True):
                d = features(q, a)
                for k, v in features(q, b).items():
                    d[k] = d.get(k, 0.0) - v
                d = {k: v for k, v in d.items() if v}
                keys.append(list(d))
                values.append(list(d.values()))
            yield pd.DataFrame({"keys": keys, "values": values})

    return pairs.select("query", "better_text", "worse_text").mapInPandas(run, "keys array<int>, values array<double>")


def loss_and_gradient(rows: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray, int]:
    """Sum of log(1 + exp(-w.d)) over all pairs and its gradient. Each task sums its pairs; one vector of FEATURES numbers
    a task is added up in the tree below, so the driver gets one."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, gradient, n = shared.value, 0.0, np.zeros(len(shared.value)), 0
        for batch in batches:
            keys, values = batch.column("keys"), batch.column("values")
            sizes = np.asarray(keys.value_lengths(), np.int64)
            k, v = np.asarray(keys.flatten(), np.int64), np.asarray(values.flatten(), np.float64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            margin = np.bincount(row, w[k] * v, len(sizes))
            total += float(np.logaddexp(0, -margin).sum())
            pull = -1 / (1 + np.exp(np.minimum(margin, 500)))
            gradient += np.bincount(k, pull[row] * v, len(w))
            n += len(sizes)
        at = np.flatnonzero(gradient)
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.append(at, [-1, -2]), pa.int32()), "v": pa.array(np.append(gradient[at], [total, n]))})

    sums = rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    found = dict(zip(sums.column("k").to_pylist(), sums.column("v").to_pylist(), strict=True))
    gradient = np.zeros(len(weights))
    for k, v in found.items():
        if k >= 0:
            gradient[k] = v
    return found.get(-1, 0.0), gradient, int(found.get(-2, 0))


def fit(pairs: DataFrame, steps: int = STEPS, rate: float = RATE, shrink: float = SHRINK) -> np.ndarray:
    """Weights of pairwise logistic ranking, by Adagrad on the whole gradient. ``pairs`` should be stored rows of ``differences``."""
    weights, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    for _ in range(steps):
        _, gradient, n = loss_and_gradient(pairs, weights)
        if not n:
            break
        gradient = gradient / n + shrink * weights
        squares += gradient**2
        weights -= rate * gradient / np.sqrt(squares)
    return weights


def scorer(weights: np.ndarray) -> Callable[[], Callable[[pd.Series, pd.Series], list[float]]]:
    """``load`` for ``rerank.scored``: the weighted sum of a pair's features."""
    kept = pickle.dumps(weights)

    def load():
        w = pickle.loads(kept)
        return lambda queries, texts: [sum(w[k] * v for k, v in features(q or "", t or "").items()) for q, t in zip(queries, texts, strict=True)]

    return load


def right_of(pairs: DataFrame, load: Callable) -> DataFrame:
    """(n, right): how many preferences (query, better_text, worse_text) a scorer puts in their order; half of a tie."""
    both = rerank.scored(rerank.scored(pairs, load, "query", "better_text").withColumnRenamed("semantic_score", "a"), load, "query", "worse_text")
    right = F.when(F.col("a") > F.col("semantic_score"), 1.0).when(F.col("a") == F.col("semantic_score"), 0.5).otherwise(0.0)
    return both.agg(F.count("*").alias("n"), F.sum(right).alias("right"))

