"""Exact join of texts whose longest common subsequence is long, without comparing all pairs.

For lengths lx <= ly a score of the threshold or more leaves dx characters of the shorter and dy of the longer text
unmatched at most. One unmatched character breaks at most q runs of q characters of its own text and q - 1 of the other
text. The runs of a text that an alignment keeps are therefore all but m, so the m + 1 rarest runs of both texts share one that
is kept, and its places differ by dx to the left or dy to the right at most. Each text gives its rarest runs once as the
shorter text and once for each length a shorter partner can have; both sides meet on run and length. q is the
largest of ``RUNS`` with which the shorter text surely keeps a run. What meets is compared in full.

Lengths split common runs further, both sides are staged, so a run that stays common is split by the adaptive planner,
and no value or run is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemill.functions.durable import stage
from tidemill.functions.lookup import lookup_join

RUNS = (3, 2, 1)


def unmatched(lx: int, ly: int, threshold: float) -> tuple[int, int] | None:
    """The most unmatched characters of a text of length lx and a longer one of length ly, or None where none fit."""
    most = floor((1 - threshold / 100) * (lx + ly) + 1e-9)
    most -= (most - (ly - lx)) % 2
    if most < ly - lx:
        return None
    dx = (most - (ly - lx)) // 2
    return dx, dx + ly - lx


class Plan:
    """How many of its rarest runs a text of some length has to show; remembered by length."""

    def __init__(self, threshold: float):
        self.threshold, self._shorter, self._longer = threshold, {}, {}

    def shorter(self, length: int) -> tuple[int, int]:
        """(q, runs) of a text as the shorter or equal one of a pair."""
        if length not in self._shorter:
            most = floor(length * (200 / self.threshold - 1) + 1e-9)
            gaps = [g for ly in range(length, max(length, most) + 1) if (g := unmatched(length, ly, self.threshold))]
            for q in RUNS:
                lost = max((q * dx + (q - 1) * dy for dx, dy in gaps), default=0)
                if lost < length - q + 1 or q == 1:
                    self._shorter[length] = q, lost + 1
                    break
        return self._shorter[length]

    def longer(self, length: int) -> list[tuple[int, int, int, int, int]]:
        """(shorter length, q, runs, dx, dy) for each length that a shorter or equal partner can have."""
        if length not in self._longer:
            out = []
            for lx in range(max(1, ceil(length / (200 / self.threshold - 1) - 1e-9) - 1), length + 1):
                if gap := unmatched(lx, length, self.threshold):
                    q, _ = self.shorter(lx)
                    out.append((lx, q, q * gap[1] + (q - 1) * gap[0] + 1, *gap))
            self._longer[length] = out
        return self._longer[length]

    def sizes(self, length: int) -> set[int]:
        return {self.shorter(length)[0], *(q for _, q, *_ in self.longer(length))}


def _runs(texts: DataFrame, threshold: float) -> DataFrame:
    """(rank, gram, pos) of all runs that a text could show."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = Plan(threshold)
        for batch in batches:
            yield pd.DataFrame([(rank, text[i:i + q], i) for rank, text in zip(batch["_rank"], batch["text"]) if text
                                for q in plan.sizes(len(text)) for i in range(len(text) - q + 1)], columns=["_rank", "gram", "pos"])

    return texts.mapInPandas(cut, "_rank long, gram string, pos int")


def subsequence_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """(better, worse) ranks of all pairs of ``texts`` (_rank, text) that can score ``threshold`` (above 0 to 100) or more.

    No such pair is missing; pairs that score less may be among them. Empty texts pair with each other. Each pair comes once.
    """
    runs = stage(_runs(texts, threshold), "runs")
    rarity = stage(runs.groupBy("gram").agg(F.count("*").alias("_seen"), F.count("*").alias("_n")), "rarity")
    ordered = lookup_join(runs, rarity, "gram", "_n").groupBy("_rank").agg(  # one group holds the runs of one text
        F.array_sort(F.collect_list(F.struct("_seen", "gram", "pos"))).alias("runs"))
    placed = ordered.join(texts.select("_rank", F.char_length("text").alias("length")), "_rank")

    def shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = Plan(threshold)
        for batch in batches:
            out = []
            for rank, length, found in zip(batch["_rank"], batch["length"], batch["runs"]):
                of = {q: [(r["gram"], r["pos"]) for r in found if len(r["gram"]) == q] for q in plan.sizes(length)}
                q, most = plan.shorter(length)
                out += [(rank, gram, length, pos, length, -1, -1) for gram, pos in of[q][:most]]
                for lx, q, most, dx, dy in plan.longer(length):
                    out += [(rank, gram, lx, pos, length, dx, dy) for gram, pos in of[q][:most]]
            yield pd.DataFrame(out, columns=["rank", "gram", "lx", "pos", "length", "dx", "dy"])

    rows = stage(placed.mapInPandas(shown, "rank long, gram string, lx int, pos int, length int, dx int, dy int"), "rarest-runs")
    short = rows.filter("dx < 0").select("gram", "lx", F.col("rank").alias("a"), F.col("pos").alias("at"))
    long = rows.filter("dx >= 0").select("gram", "lx", F.col("rank").alias("b"), F.col("pos").alias("to"), "length", "dx", "dy")
    apart = F.col("to") - F.col("at")
    met = short.join(long, ["gram", "lx"]).filter((apart >= -F.col("dx")) & (apart <= F.col("dy")) & F.when(
        F.col("lx") == F.col("length"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    empty = texts.filter(F.col("text") == "").select(F.col("_rank").alias("worse"))
    first = empty.agg(F.min("worse").alias("better"))  # empty texts differ in nothing: each with the first is enough
    return met.select(F.least("a", "b").alias("better"), F.greatest("a", "b").alias("worse")).distinct() \
        .unionByName(empty.join(F.broadcast(first), F.col("better") < F.col("worse")).select("better", "worse"))
