"""Structured Streaming forms: feedback aggregates, debounce, and the small state machines
(rate window, circuit breaker, cache, retry queue, latest pending)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, WINDOW_SECONDS = 10, 60
OPEN_SECONDS, FAILURES = 30, 2
CACHE_SECONDS = 600
PENDING_SECONDS = 0.4
DEBOUNCE = "320 milliseconds"


def daily_feedback(feedback: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Daily sums of a feedback stream (ts, doc_id, weight); late days close with the watermark."""
    return feedback.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day").alias("w"), "doc_id").agg(F.sum("weight").alias("weight_sum"), F.count("*").alias("event_count")).select(F.to_date("w.start").alias("day"), "doc_id", "weight_sum", "event_count")


def debounced(keystrokes: DataFrame, watermark: str = "1 minute", gap: str = DEBOUNCE) -> DataFrame:
    """The last event of each burst of a session (session, ts, text)."""
    return keystrokes.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "session").agg(F.max_by("text", "ts").alias("text"), F.max("ts").alias("ts"), F.count("*").alias("keys")).select("session", "ts", "text", "keys")


def latest_pending(requests: DataFrame) -> DataFrame:
    """Of each session's requests in a micro-batch only the newest version is worked on."""
    return requests.groupBy("session").agg(F.max("version").alias("version"), F.max_by("query", "version").alias("query"))


def pending_outcomes(requests: DataFrame, seconds: float = PENDING_SECONDS) -> DataFrame:
    """What becomes of each request (session, version, requested_at, free_at, ...): the newest of its session
    runs if the worker is free soon enough; others are superseded, late ones expired, and both fall back."""
    newest = requests.groupBy("session").agg(F.max("version").alias("newest"))
    late = F.unix_micros("free_at") - F.unix_micros("requested_at") > int(seconds * 1e6)
    outcome = F.when(F.col("version") < F.col("newest"), "superseded").when(late, "expired").otherwise("run")
    return requests.join(newest, "session").withColumn("outcome", outcome).drop("newest")


def admit(times: list[float], limit: int = LIMIT, seconds: float = WINDOW_SECONDS, held: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Which requests a rolling window admits; refused ones do not count. Also what the state holds then."""
    held = list(held or [])
    out = []
    for t in times:
        held = [h for h in held if h > t - seconds]
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out, held


def break_circuit(events: list[tuple[float, int]], state: tuple[float, int, bool] = (0.0, 0, False)) -> tuple[list[str], tuple[float, int, bool]]:
    """What happens to each (time, HTTP status, 0 for no answer): state is (open until, failures, disabled).

    429 opens for 30 s, so do two failures in a row; success and ordinary 4xx reset; 401 and 403
    disable the key.
    """
    until, failures, disabled = state
    out = []
    for t, status in events:
        if disabled:
            out.append("disabled")
            continue
        if t < until:
            out.append("open")
            continue
        if status in (401, 403):
            disabled = True
        elif status == 429:
            until, failures = t + OPEN_SECONDS, 0
        elif status == 0 or status >= 500:
            failures += 1
            if failures >= FAILURES:
                until, failures = t + OPEN_SECONDS, 0
        else:
            failures = 0
        out.append("sent")
    return out, (until, failures, disabled)


def cached(requests: list[tuple[float, str]], state: dict[str, float] | None = None, seconds: float = CACHE_SECONDS) -> tuple[list[bool], dict[str, float]]:
    """Hits of a cache whose entries live ten minutes. Dead entries go when they are half of what is held."""
    held = dict(state or {})
    out, clean = [], 2 * len(held) + 64
    for t, key in requests:
        hit = key in held and t < held[key]
        out.append(hit)
        if not hit:
            held[key] = t + seconds
            if len(held) > clean:
                held = {k: until for k, until in held.items() if t < until}
                clean = 2 * len(held) + 64
    last = requests[-1][0] if requests else 0.0
    return out, {k: until for k, until in held.items() if last < until}


def _seconds(rows: pd.DataFrame) -> list[float]:
    return (rows["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist()


def _per_key(frame: DataFrame, key: str, step, name: str, kind: str) -> DataFrame:
    """Batch replay of a state machine: (event_id, outcome) of each key's rows in order of time. Rows come
    sorted and are read as they come; one key's state is all that is held."""
    kept = frame.withColumnRenamed(key, "key")

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for table in tables:
            for value, rows in table.groupby("key", sort=False, dropna=False):
                value = None if pd.isna(value) else value
                if state is None or value != now:
                    now, state = value, {}
                outcome, state["held"] = step(rows, state.get("held"))
                yield pd.DataFrame({"event_id": rows["event_id"], name: outcome})

    parts = kept.repartition("key").sortWithinPartitions("key", "ts", "event_id")
    return parts.mapInPandas(run, f"event_id long, {name} {kind}")


def _admit(rows: pd.DataFrame, held):
    return admit(_seconds(rows), held=held)


def _break(rows: pd.DataFrame, held):
    pairs = list(zip(_seconds(rows), rows["status"].tolist(), strict=True))
    return break_circuit(pairs) if held is None else break_circuit(pairs, held)


def _cache(rows: pd.DataFrame, held):
    return cached(list(zip(_seconds(rows), rows["payload"], strict=True)), held)


def admitted(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(event_id, admitted) by the exact rolling window of each key."""
    return _per_key(events.select(key, "event_id", "ts"), key, _admit, "admitted", "boolean")


def circuit(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(event_id, outcome) of requests with an HTTP status."""
    return _per_key(events.select(key, "event_id", "ts", "status"), key, _break, "outcome", "string")


def cache_hits(events: DataFrame, key: str = "user_id", payload: str = "payload") -> DataFrame:
    """(event_id, hit) of requests whose answer a cache may hold."""
    return _per_key(events.select(key, "event_id", "ts", F.col(payload).alias("payload")), key, _cache, "hit", "boolean")


def _stream(events: DataFrame, key: str, step, name: str, kind: str, state_kind: str, pack, unpack) -> DataFrame:
    """The same as keyed state of a stream; rows of a micro-batch are taken in order of time."""

    def run(_, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["ts", "event_id"], kind="stable")
        outcome, held = step(rows, unpack(state.get) if state.exists else None)
        state.update(pack(held))
        yield pd.DataFrame({"event_id": rows["event_id"], name: outcome})

    return events.groupBy(key).applyInPandasWithState(run, f"event_id long, {name} {kind}", state_kind, "append", "NoTimeout")


def admitted_stream(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The exact limiter: the admitted times of the last minute are the state."""
    return _stream(events.select(key, "event_id", "ts"), key, _admit, "admitted", "boolean", "held array<double>", lambda held: (held,), lambda state: list(state[0]))


def circuit_stream(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The breaker: until when it is open, failures in a row, and whether it is off for good."""
    return _stream(events.select(key, "event_id", "ts", "status"), key, _break, "outcome", "string", "until double, failures int, disabled boolean", lambda held: (float(held[0]), int(held[1]), bool(held[2])), tuple)


def cache_hits_stream(events: DataFrame, key: str = "user_id", payload: str = "payload") -> DataFrame:
    """The cache: the entries that are alive."""
    rows = events.select(key, "event_id", "ts", F.col(payload).alias("payload"))
    return _stream(rows, key, _cache, "hit", "boolean", "names array<string>, untils array<double>", lambda held: (list(held), list(held.values())), lambda state: dict(zip(*state, strict=True)))


def presented(results: DataFrame) -> DataFrame:
    """The results (session, version, shown_version, ...) that may still be shown: of the newest version
    of their session, and not older than what is on the screen."""
    newest = results.groupBy("session").agg(F.max("version").alias("newest"))
    return results.join(newest, "session").filter((F.col("version") == F.col("newest")) & (F.col("version") >= F.coalesce("shown_version", F.lit(0)))).drop("newest")


def reconcile(batch: DataFrame, store, scan_id: int) -> None:
    """For foreachBatch: one scan becomes one committed snapshot, or an aborted one if it is empty. A batch that
    comes again after a restart finds its scan decided and changes nothing."""
    if store.state(scan_id) in ("committed", "aborted"):
        return
    if batch.isEmpty():
        store.abort(scan_id, "empty scan")
    else:
        store.commit(scan_id, batch)
