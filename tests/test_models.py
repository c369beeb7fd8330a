"""Checked and fitted models, against plain arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import models, ranks, rerank, settings
from corpusloom.operators.commits import Conflict


def test_integrity_and_refusal(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 100_000)
    (tmp_path / "b.bin").write_bytes(b"")
    (tmp_path / "folder").mkdir()
    digest = lambda data: hashlib.sha256(data).hexdigest()
    root = f"file://{tmp_path}"
    manifest = lambda rows: spark.createDataFrame(rows, "asset string, sha256 string")
    rows = [("a.bin", digest(b"x" * 100_000)), ("b.bin", digest(b"").upper()), ("folder", digest(b"")), ("none", digest(b"")), ("a.bin", "00"), ("b.bin", None)]
    got = sorted(map(str, (tuple(r) for r in models.integrity(manifest(rows[:4]), root).collect())))
    assert got == sorted(map(str, [("a.bin", 100_000, "ready"), ("b.bin", 0, "ready"), ("folder", None, "missing_assets"), ("none", None, "missing_assets")]))
    assert {r.status for r in models.integrity(manifest(rows[4:]), root).collect()} == {"hash_mismatch"}
    good = manifest(rows[:2])
    pairs = spark.createDataFrame([(1, "q", "t")], "id int, query string, text string")
    load = lambda value: lambda: lambda queries, texts: [value] * len(queries)
    assert rerank.scored(pairs, models.checked(good, root, load(0.5))).first().semantic_score == 0.5
    with pytest.raises(models.ModelRefused, match="hash_mismatch: a.bin"):
        models.checked(manifest(rows[4:5]), root, load(0.5))
    with pytest.raises(models.ModelRefused, match="missing_assets: none"):
        models.checked(manifest(rows[3:4]), root, load(0.5))
    for bad, status in ((load(math.nan), "inference_failed"), (lambda: 1 / 0, "invalid_model"), (lambda: lambda queries, texts: 1 / 0, "inference_failed"), (lambda: lambda queries, texts: [], "inference_failed")):
        with pytest.raises(models.ModelRefused, match=status):
            models.checked(good, root, bad)()
        with pytest.raises(Exception, match="ModelRefused"):
            rerank.scored(pairs, models.checked(good, root, bad)).collect()


def test_gradient_equals_differences(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(20)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(some(2), some(12), some(12)) for _ in range(60)] + [("", "a", None), ("x y", "x y", "y x")]
    pairs = models.differences(spark.createDataFrame(rows, "query string, better_text string, worse_text string")).repartition(3)
    dense = np.zeros((len(rows), models.FEATURES))
    for k, (q, a, b) in enumerate(rows):
        for key, v in models.features(q, a).items():
            dense[k, key] += v
        for key, v in models.features(q, b).items():
            dense[k, key] -= v
    weights = np.random.default_rng(1).normal(size=models.FEATURES)
    loss, gradient, n = models.loss_and_gradient(pairs, weights)
    value = lambda w: np.log1p(np.exp(-(dense @ w))).sum()
    assert n == len(rows) and math.isclose(loss, value(weights), rel_tol=1e-9)
    for key in np.flatnonzero(np.abs(dense).sum(0))[:40].tolist():
        step = np.zeros(models.FEATURES)
        step[key] = 1e-6
        assert math.isclose(gradient[key], (value(weights + step) - value(weights - step)) / 2e-6, abs_tol=1e-4)
    fitted = models.fit(pairs, steps=10)
    assert value(fitted) < value(np.zeros(models.FEATURES))
    assert models.fit(pairs.limit(0)).any() == np.False_


def test_preferences_are_of_what_stood_above(spark):
    shown = spark.createDataFrame([(1, k, k) for k in range(4)] + [(2, 0, 0), (2, 1, 1)], "query_id int, cand_id int, idx int")
    acted = spark.createDataFrame([(1, 2), (1, 2), (1, 0), (2, 0), (3, 1)], "query_id int, cand_id int")
    assert sorted(map(tuple, models.preferences(acted, shown).collect())) == [(1, 2, 1)]


def test_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(ranks, "PARTS", 8)
    r = random.Random(3)
    for values in ([], [None], [5.0], [1.0, 2.0], [2.0] * 50 + [3.0], [r.gauss(0, 1) for _ in range(501)], [10.0 ** r.randint(-20, 20) for _ in range(200)], [1.0, math.nan, 2.0, None]):
        kept = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
        total, found = ranks.at_ranks(spark.createDataFrame([(v,) for v in values], "x double").repartition(3), "x", lambda n: range(0, n, max(1, n // 7)))
        assert total == len(kept) and str(found) == str([kept[k] for k in range(0, len(kept), max(1, len(kept) // 7))] if kept else [])


def test_settings(spark, tmp_path):
    texts = [None, "", "null", "5", "{}", '{"Width": 1000, "Height": null}', '{"Width": 819.9, "Height": 520}', '{"Width": "1000"}', '{"Ranking": {"CloudEnabled": false, "BehaviorEnabled": 1}}', '{"BehaviorDisclosureAcknowledged": "yes", "Width": 5000}', '{"Width": 1000']
    got = [r.asDict() for r in settings.read(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, json string")).orderBy("k").collect()]
    changed = [{n: r[n] for n in settings.DEFAULTS if r[n] != settings.DEFAULTS[n]} for r in got]
    assert changed == [{}, {}, {}, {}, {}, {}, {"height": 520.0}, {}, {"cloud_enabled": False}, {"width": 5000.0}, {}]
    mine, other = (settings.SettingsStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    assert mine.load() == settings.DEFAULTS and mine.save(width=1200.0) == 1 and other.save(maximized=True) == 2
    assert mine.load() == settings.DEFAULTS | {"width": 1200.0, "maximized": True}
    with pytest.raises(ValueError, match="INVALID_ARGUMENTS"):
        mine.save(colour="red")
    with pytest.raises(Conflict):
        mine.versions.propose(2, width=1.0)


def test_outside_orders_keep_to_their_time(spark):
    """Late answers change nothing, and after three in a row the task asks no more."""
    rows = spark.createDataFrame([(q, f"q{q}", k, k, f"n{k}", "s") for q in range(8) for k in range(3)], "query_id int, query string, cand_id int, idx int, name string, snippet string").coalesce(1)

    def ask(query, offered):
        import time

        if query in ("q1", "q4", "q5", "q6"):
            time.sleep(5)
        if query == "q2":
            raise OSError
        return [offered[-1]["cand_id"]]

    def of(asked):
        return {r.query_id: r.cand_id for r in rerank.external_order(rows.filter(F.col("query_id").isin(asked)).repartition(1), ask, seconds=0.3).collect()}

    assert of([0, 1, 2, 3]) == {0: 2, 3: 2}
    got = of([4, 5, 6])
    assert got == {}
    assert len(of(list(range(8)))) <= 4
