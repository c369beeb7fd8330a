"""Bounded reranking: behavior, semantic blend, external order, and the gates before them.

Rows are candidates of many queries: (query_id, cand_id, idx from 0, tier, ...). Only the first ten of
a query move, and only inside their tier.
"""

from __future__ import annotations

import json
import queue
import threading
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOP, SHOWN = 10, 5
BEHAVIOR_SHARE, SEMANTIC_SHARE = 0.35, 0.65
EXACT, ELIGIBLE = 0, 1
#: Seconds that an outside order may take, and how many late ones in a row end the asking.
ASKED_SECONDS, GIVEN_UP = 1.5, 3


def behavior(rows: DataFrame) -> DataFrame:
    """New places by tier, then index less promotion; the tail keeps its places."""
    moved = F.col("idx") - F.least(F.greatest(F.col("promotion"), F.lit(0)), F.lit(10))
    order = Window.partitionBy("query_id", F.col("idx") < TOP).orderBy("tier", moved, "idx")
    place = F.row_number().over(order) - 1
    return rows.withColumn("behavior_index", F.when(F.col("idx") < TOP, place).otherwise(F.col("idx")))


def gate(rows: DataFrame, mode: str = "Hybrid") -> DataFrame:
    """(query_id, semantic): queries that are reranked; an exact candidate rules out the scorer."""
    found = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.bool_or(F.col("tier") == EXACT).alias("exact"))
    return found.filter((F.col("n") >= 2) & F.lit(mode != "Content")).select("query_id", (~F.col("exact")).alias("semantic"))


def scored(rows: DataFrame, load: Callable[[], Callable[[pd.Series, pd.Series], Iterable[float]]], query: str = "query", text: str = "text") -> DataFrame:
    """A score for each pair by any model. ``load`` gives a function of a whole batch (queries, texts) and
    is called once in each task; scores that are not finite become null."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            yield pd.Series(model(queries, texts), dtype="float64")

    out = rows.withColumn("semantic_score", score(F.col(query), F.col(text)))
    return out.withColumn("semantic_score", F.when(F.abs("semantic_score") < float("inf"), F.col("semantic_score")))


def semantic_rank(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id", "tier").orderBy(F.col("semantic_score").desc(), "behavior_index")
    return rows.withColumn("semantic_rank", F.row_number().over(order))


def rank_value(n: Column, rank: Column) -> Column:
    return F.when(n <= 1, 1.0).otherwise((n - rank) / (n - 1))


def blend(rows: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first of each query by tier, then by the blended rank values; exact ones keep their order."""
    n = F.count("*").over(Window.partitionBy("query_id", "tier"))
    ranked = semantic_rank(rows).withColumn("n", n)
    value = BEHAVIOR_SHARE * rank_value(F.col("n"), F.col("behavior_index") + 1) + SEMANTIC_SHARE * rank_value(F.col("n"), F.col("semantic_rank"))
    ranked = ranked.withColumn("blended", F.round(value, 6))
    key = F.when(F.col("tier") == EXACT, -F.col("behavior_index").cast("double")).otherwise(F.col("blended"))
    order = Window.partitionBy("query_id").orderBy("tier", key.desc(), "behavior_index")
    return ranked.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= shown).select("query_id", "position", "cand_id", "tier", "blended")


def protected(rows: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested ids (query_id, cand_id, wanted) first inside their tier, the others as they were; what
    lies beyond the first ten stays."""
    joined = rows.join(requested, ["query_id", "cand_id"], "left")
    head = F.col("idx") < TOP
    order = Window.partitionBy("query_id", head).orderBy("tier", F.coalesce("wanted", F.lit(2**31 - 1)), "idx")
    return joined.withColumn("new_index", F.when(head, F.row_number().over(order) - 1).otherwise(F.col("idx"))).drop("wanted")


def low_confidence(rows: DataFrame) -> DataFrame:
    """(query_id, low): the best two scores, and with six the fifth and sixth, are close."""
    order = Window.partitionBy("query_id").orderBy(F.col("semantic_score").desc(), "idx")
    r = rows.withColumn("r", F.row_number().over(order))
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("semantic_score")))
    found = r.groupBy("query_id").agg(F.count("*").alias("n"), F.max("semantic_score").alias("top"), F.min("semantic_score").alias("low"), at(1).alias("s1"), at(2).alias("s2"), at(5).alias("s5"), at(6).alias("s6"))
    spread = F.greatest(F.col("top") - F.col("low"), F.lit(1e-9))
    low = F.coalesce((F.col("s1") - F.col("s2")) / spread < 0.15, F.lit(False)) | F.coalesce((F.col("n") >= 6) & ((F.col("s5") - F.col("s6")) / spread < 0.15), F.lit(False))
    return found.select("query_id", low.alias("low_confidence"))


def duplicate_names(rows: DataFrame) -> DataFrame:
    """(query_id, duplicate): a name occurs twice, whatever its case."""
    per = rows.groupBy("query_id", F.lower(F.trim("name")).alias("n")).agg(F.count("*").alias("k"))
    return per.groupBy("query_id").agg((F.max("k") > 1).alias("duplicate_names"))


def mixed_evidence(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id").agg((F.bool_or(F.col("match_source").isin("name", "both")) & F.bool_or(F.col("match_source").isin("content", "both"))).alias("mixed_evidence"))


def ambiguity(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, ambiguous): no exact or mail candidate, three eligible ones, not a file query, and a
    sign of doubt. ``questions``: (query_id, explicit, natural)."""
    base = rows.groupBy("query_id").agg(F.bool_or(F.col("tier") == EXACT).alias("exact"), F.bool_or(F.col("is_mail")).alias("mail"), F.sum((F.col("tier") == ELIGIBLE).cast("int")).alias("eligible"))
    for part in (low_confidence(rows), duplicate_names(rows), mixed_evidence(rows), questions):
        base = base.join(part, "query_id")
    doubt = F.col("low_confidence") | F.col("duplicate_names") | F.col("mixed_evidence") | F.col("natural")
    return base.select("query_id", (~F.col("exact") & ~F.col("mail") & (F.col("eligible") >= 3) & ~F.col("explicit") & doubt).alias("ambiguous"))


def valid_order(ids: Column, candidates: Column) -> Column:
    """One to five ids, all different, all candidates."""
    return (F.size(ids) >= 1) & (F.size(ids) <= SHOWN) & (F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(F.array_except(ids, candidates)) == 0)


def _within(seconds: float, call: Callable, *args):
    """The result of a call, or TimeoutError when it takes longer. The call goes on in a thread that ends with the worker."""
    got: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            got.put((True, call(*args)))
        except Exception as error:
            got.put((False, error))

    threading.Thread(target=run, daemon=True).start()
    try:
        good, value = got.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError from None
    if not good:
        raise value
    return value


def external_order(rows: DataFrame, ask: Callable[[str, list[dict]], list], most_bytes: int = 24 * 1024, query: str = "query", seconds: float = ASKED_SECONDS) -> DataFrame:
    """(query_id, cand_id, wanted): the order that an outside service asks for, of queries that keep to
    its limits and answers that are valid.

    ``ask`` gets a query and its first candidates (cand_id, name, snippet) and returns one to five of
    their ids. A request of more than ``most_bytes`` of JSON is not sent, and an answer that fails
    (an exception, unknown or repeated ids) or is not there after ``seconds`` changes nothing. After
    GIVEN_UP answers in a row that were late, a task asks no more. Rows (query_id, query, cand_id, idx, name, snippet).
    """
    first = rows.filter(F.col("idx") < TOP).groupBy("query_id", F.col(query).alias("query")).agg(F.array_sort(F.collect_list(F.struct("idx", "cand_id", "name", F.left("snippet", F.lit(200)).alias("snippet")))).alias("shown"))
    kind = rows.schema["cand_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late = 0
        for batch in batches:
            out = []
            for query_id, text, shown in zip(batch["query_id"], batch["query"], batch["shown"], strict=True):
                if late >= GIVEN_UP:
                    break
                offered = [{k: r[k] for k in ("cand_id", "name", "snippet")} for r in shown]
                if len(json.dumps({"query": text, "candidates": offered}, ensure_ascii=False, default=str).encode()) > most_bytes:
                    continue
                try:
                    ids = list(_within(seconds, ask, text, offered))
                    late = 0
                except TimeoutError:
                    late += 1
                    continue
                except Exception:  # the service is down: the local order stays
                    continue
                known = {r["cand_id"] for r in offered}
                if 1 <= len(ids) <= SHOWN and len(set(ids)) == len(ids) and known.issuperset(ids):
                    out += [(query_id, x, k + 1) for k, x in enumerate(ids)]
            yield pd.DataFrame(out, columns=["query_id", "cand_id", "wanted"])

    return first.mapInPandas(run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, cand_id {kind}, wanted int")


def orders_equal(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy("query_id").agg(F.bool_and(F.col(a) == F.col(b)).alias("equal"))


def feedback_rows(actions: DataFrame, shown: DataFrame) -> DataFrame:
    """Feedback of actions (query_id, cand_id, action, presented) on what was shown: the baseline rank is
    the index plus 1, or the presented rank where the candidate had none."""
    rows = actions.join(shown.select("query_id", "cand_id", "idx"), ["query_id", "cand_id"], "left")
    return rows.select("query_id", "cand_id", "action", F.coalesce(F.col("idx") + 1, F.col("presented")).alias("baseline_rank"), F.col("presented").alias("presented_rank"))
