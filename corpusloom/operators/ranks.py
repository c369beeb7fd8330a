"""Exact order statistics by counting: rows are never sorted, shuffled or gathered."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts into which an interval of values is cut in each round.
PARTS = 1024


def at_ranks(rows: DataFrame, column: str, wanted) -> tuple[int, list[float | None]]:
    """How many values there are, and those at the ranks (from 0) that ``wanted`` gives for that number.

    A round counts the values of each interval that holds a wanted rank in PARTS equal parts; the part with the rank is the
    next interval, until all its values are equal. A round leaves a thousandth of an interval of evenly
    spread values, and less than all of any other. What comes to the driver is a count for each part.
    Nulls are no values; NaN is larger than all others, as Spark orders it.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    finite = values.filter(~F.isnan("v"))
    total, real, low, high = values.agg(F.count("*"), F.count_if(~F.isnan("v")), F.min(F.when(~F.isnan("v"), F.col("v"))), F.max(F.when(~F.isnan("v"), F.col("v")))).first()
    ranks = list(wanted(total)) if total else []
    found = {r: (low if low == high else None) if r < real else math.nan for r in ranks}
    spans = {r: (low, high, 0) for r in ranks if found[r] is None}  # least and largest value, values below
    while spans:
        intervals = sorted({s[:2] for s in spans.values()})
        part = F.lit(None).cast("int")
        for k, (a, b) in enumerate(intervals):
            inside = F.least(F.floor((F.col("v") - a) / F.lit(b - a) * PARTS), F.lit(PARTS - 1)).cast("int") + k * PARTS
            part = F.when(F.col("v").between(a, b), inside).otherwise(part)
        counted = finite.select(part.alias("part"), "v").filter("part is not null").groupBy("part").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        by_interval: dict[int, list] = {}
        for row in sorted(counted):
            by_interval.setdefault(row.part // PARTS, []).append(row)
        for rank, (a, b, below) in list(spans.items()):
            for row in by_interval[intervals.index((a, b))]:
                if rank < below + row.n:
                    break
                below += row.n
            if row.a == row.b:
                found[rank] = row.a
                del spans[rank]
            else:
                spans[rank] = (row.a, row.b, below)
    return total, [found[r] for r in ranks]
