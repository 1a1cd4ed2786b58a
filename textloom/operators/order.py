"""Order statistics without an order: selection in rounds over a shrinking range of values.

A round counts the rows of each of BINS equal parts of a range and goes on in the parts that hold a wanted place. The driver sees
BINS rows a round, and at most FEW values in the end; no task sees all values, and nothing is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, FEW = 1024, 4096


def _bin(value: Column, low: float, high: float) -> Column:
    """The part of [low, high] that a value is in. Halves, so that the range of very large values is finite."""
    share = (value / 2 - low / 2) / (high / 2 - low / 2)
    return F.least(F.floor(share * BINS), F.lit(BINS - 1))


def nth(rows: DataFrame, value: str, places: Sequence[int], weight: str | None = None) -> list[float | None]:
    """The values at places (from 0) of all rows in order, each row as often as its weight (whole numbers) says; None beyond the
    last. Null and NaN values are left out. Rows are read again each round: store them first if they are costly."""
    rows = rows.select(F.col(value).cast("double").alias("v"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("w")).where("v IS NOT NULL AND NOT isnan(v) AND w > 0")
    found: dict[int, float] = {}

    def parts(of: DataFrame, key: Column) -> list:
        return sorted(of.groupBy(key.alias("k")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("w").alias("n"), F.count("*").alias("rows")).collect(), key=lambda p: p["low"])

    def place(kinds: list, before: int, wanted: list[int]) -> list[tuple[object, int, list[int]]]:
        """Which of the parts hold the wanted places, and what comes before each."""
        out = []
        for p in kinds:
            inside = [x for x in wanted if before <= x < before + p["n"]]
            if inside:
                out.append((p, before, inside))
            before += p["n"]
        return out

    open_ = place(parts(rows, F.lit(0)), 0, sorted(set(places)))
    while open_:
        p, before, wanted = open_.pop()
        if p["low"] == p["high"]:
            found.update(dict.fromkeys(wanted, p["low"]))
            continue
        near = rows.where(F.col("v").between(p["low"], p["high"]))
        key = F.col("v") if p["rows"] <= FEW else _bin(F.col("v"), p["low"], p["high"])
        open_ += place(parts(near, key), before, wanted)
    return [found.get(x) for x in places]


def quantiles(rows: DataFrame, value: str, shares: Sequence[float], weight: str | None = None) -> list[float | None]:
    """Continuous percentiles: between the values at the two places next to each share, in proportion; None of no rows."""
    counted = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    total = counted.agg((F.sum(F.col(weight).cast("long")) if weight else F.count("*")).alias("n")).first()["n"] or 0
    if not total:
        return [None] * len(shares)
    at = [s * (total - 1) for s in shares]
    low, high = [math.floor(a) for a in at], [math.ceil(a) for a in at]
    values = nth(rows, value, [*low, *high], weight)
    return [a + (b - a) * (x - i) for a, b, x, i in zip(values[: len(at)], values[len(at) :], at, low, strict=True)]


def weighted_median(rows: DataFrame, value: str, weight: str) -> float | None:
    """The first value at which the weights so far are half of all or more."""
    total = rows.where(F.col(value).isNotNull()).agg(F.sum(F.col(weight).cast("long")).alias("n")).first()["n"] or 0
    return nth(rows, value, [max(0, -(-total // 2) - 1)], weight)[0] if total else None
