"""Exact quantiles that do not depend on a column fitting in memory.

Small columns use the built-in exact ``percentile``. Larger ones are narrowed: an approximate
quantile gives a bracket, counting below and inside the bracket shows which ranks it holds, and the
next round looks only inside it, for all columns and ranks at once. Each round keeps a few thousandths of
the rows; at most ``GATHER`` rows for each rank are left to be ordered in the end, and one row for each
rank reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import DataFrame, Window, functions as F

from tidemill.functions.columns import col

IN_MEMORY_VALUES = 4_000_000
GATHER = 100_000
ACCURACY = 20_000


@dataclass
class _Target:
    """One wanted rank, and the open interval its value is known to lie in."""

    column: str
    rank: int
    below: int
    inside: int
    low: float | None = None
    high: float | None = None
    value: float | None = None


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    in_memory: int = IN_MEMORY_VALUES,
                    gather: int = GATHER) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of every column, NULLs ignored, as doubles."""
    if not columns:
        return {}
    data = df.select([col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    names = data.columns
    counts = dict(zip(names, data.agg(*[F.count(n) for n in names]).first()))
    result: dict[str, list[float | None]] = {}

    limit = in_memory // len(names)  # one task holds the values of all columns
    small = [n for n in names if 0 < counts[n] <= limit]
    if small:
        row = data.agg(*[F.percentile(n, F.lit(probs)).alias(n) for n in small]).first()
        result.update({n: list(row[n]) for n in small})

    targets: dict[tuple[str, int], _Target] = {}
    for n in names:
        if counts[n] > limit:
            for p in probs:
                for rank in {floor((counts[n] - 1) * p), ceil((counts[n] - 1) * p)}:
                    targets[n, rank] = _Target(n, rank, 0, counts[n])
    _narrow(data, list(targets.values()), gather)
    for n in names:
        if counts[n] > limit:
            result[n] = []
            for p in probs:
                place = (counts[n] - 1) * p
                a = targets[n, floor(place)].value
                b = targets[n, ceil(place)].value
                result[n].append(a + (b - a) * (place - floor(place)) if a != b else a)
    return {c: result.get(n, [None] * len(probs)) for c, n in zip(columns, names)}


def _narrow(data: DataFrame, targets: list[_Target], gather: int) -> None:
    """Two scans for each round of narrowing and one for the last step, whatever the number of columns and ranks."""
    while wide := [t for t in targets if t.value is None and t.inside > gather]:
        _shrink(data, wide)
    _pick(data, [t for t in targets if t.value is None])


def _band(t: _Target):
    c = F.col(t.column)
    band = c.isNotNull()
    if t.low is not None:
        band = band & (c > t.low)
    if t.high is not None:
        band = band & (c < t.high)
    return band


def _pick(data: DataFrame, targets: list[_Target]) -> None:
    """The value at each target's rank, from the counts of the values in its interval."""
    if not targets:
        return
    kept = F.array(*[F.when(_band(t), F.struct(F.lit(i).alias("i"), F.col(t.column).alias("v"))) for i, t in enumerate(targets)])
    counts = (data.select(F.explode(F.filter(kept, lambda p: p.isNotNull())).alias("p"))
              .groupBy("p.i", "p.v").agg(F.count(F.lit(1)).alias("n")))
    wanted = F.element_at(F.array(*[F.lit(t.rank - t.below) for t in targets]), F.col("i") + 1)
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("v"))  # an interval holds few rows by now
    found = counts.withColumn("upto", upto).filter((F.col("upto") > wanted) & (F.col("upto") - F.col("n") <= wanted))
    for row in found.select("i", "v").collect():  # one row for each target
        targets[row["i"]].value = row["v"]


def _shrink(data: DataFrame, targets: list[_Target]) -> None:
    margin = 2.0 / ACCURACY
    places = [(t.rank - t.below) / t.inside for t in targets]
    guesses = data.agg(*[
        F.percentile_approx(F.when(_band(t), F.col(t.column)),
                            [max(0.0, p - margin), min(1.0, p + margin)], ACCURACY)
        for t, p in zip(targets, places)]).first()
    tests = []
    for t, (low, high) in zip(targets, guesses):
        c, band = F.col(t.column), _band(t)
        tests.append(F.struct(*[F.count_if(band & x) for x in (c < low, c <= low, c < high, c <= high)]))
    for t, (low, high), counted in zip(targets, guesses, data.agg(*tests).first()):
        to_low, with_low, to_high, with_high = (t.below + n for n in counted)
        end = t.below + t.inside
        if t.rank < to_low:
            t.high, t.inside = low, to_low - t.below
        elif t.rank < with_low:
            t.value = low
        elif t.rank < to_high:
            t.low, t.high, t.below, t.inside = low, high, with_low, to_high - with_low
        elif t.rank < with_high:
            t.value = high
        else:
            t.low, t.below, t.inside = high, with_high, end - with_high
