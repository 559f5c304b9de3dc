"""Model-based outlier filters on one numeric column.

In one dimension both models are functions of the value alone, so they are worked out on the distinct
values (a value held by a third of the rows is one row there) and joined back.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from tidemill.functions.columns import ColumnError, col, finite, free_name, require_numeric
from tidemill.functions.durable import stage
from tidemill.functions.lookup import lookup_join
from tidemill.operators.ordered import SLICE, in_slices, shuffle_partitions
from tidemill.operators.quantiles import exact_quantiles
from tidemill.operators.sampling import position_blocks, values_at

# Model settings
TREES, SAMPLE = 100, 256
NEIGHBOURS, LOF_SHARE = 20, 0.1
MIN_FOREST_ROWS, MIN_LOF_ROWS = 10, 5
EULER = 0.5772156649


def contamination(threshold: float | None) -> float | None:
    """Share of outliers, or None for automatic."""
    if threshold is None or threshold > 1.0:
        return None
    if threshold <= 0:
        raise ColumnError("contamination must be greater than 0")
    if threshold > 0.5:
        raise ColumnError("use at most 0.5 for contamination, or more than 1 for automatic")
    return threshold


def _values(df: DataFrame, column: str) -> DataFrame:
    return df.select(finite(col(column)).alias("x")).filter("x is not null")


@dataclass
class ForestFilter:
    """Anomaly score as a step function of the value: ``scores[i]`` holds between two split points."""

    column: str
    splits: list[float] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    cut: float = 0.5
    drops_rows: ClassVar[bool] = True

    def scored(self, df: DataFrame, name: str) -> DataFrame:
        value, step = free_name(df, "_value"), free_name(df, "_step")
        buckets = Bucketizer(splits=[float("-inf"), *self.splits, float("inf")], inputCol=value,
                             outputCol=step, handleInvalid="keep")
        marked = buckets.transform(df.withColumn(value, finite(col(self.column))))
        # one literal instead of an expression per score; the optimizer folds it to a constant
        table = F.from_json(F.lit(json.dumps(self.scores)), "array<double>")
        score = F.when(F.col(value).isNotNull(), F.get(table, F.col(step).cast("int")))
        return marked.withColumn(name, score).drop(value, step)

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.splits:
            return df
        name = free_name(df, "_score")
        scored = self.scored(df, name)
        return scored.filter(F.coalesce(F.col(name) <= self.cut, F.lit(True))).drop(name)


def _average_path(n: np.ndarray | float):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    deep = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, deep))


def _grow(part: np.ndarray, depth: int, limit: int,
          rng: np.random.Generator) -> tuple[list[float], list[float]]:
    """Split points of one tree in ascending order, and the path length in each gap between them."""
    if depth >= limit or len(part) <= 1 or part[0] == part[-1]:
        return [], [depth + float(_average_path(len(part)))]
    cut = rng.uniform(part[0], part[-1])
    at = int(np.searchsorted(part, cut, side="right"))
    ls, ld = _grow(part[:at], depth + 1, limit, rng)
    rs, rd = _grow(part[at:], depth + 1, limit, rng)
    return ls + [cut] + rs, ld + rd


def fit_isolation_forest(df: DataFrame, column: str, threshold: float | None = None,
                         seed: int = 42) -> ForestFilter:
    """100 trees on 256 drawn values each, whatever the size of the table."""
    require_numeric(df, column)
    share = contamination(threshold)
    data = _values(df, column)
    n, low, high = data.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if n < MIN_FOREST_ROWS or low == high:
        return ForestFilter(column)
    rng = np.random.default_rng(seed)
    per_tree = min(SAMPLE, n)
    draws = [(t, int(p)) for t in range(TREES) for p in _distinct_positions(rng, n, per_tree)]
    blocks, _ = position_blocks(data, "x")
    wanted = df.sparkSession.createDataFrame(draws, "tree int, position bigint")
    drawn = values_at(wanted, "position", blocks).select("tree", "_value").toPandas()  # 25,600 rows

    trees = []
    for tree in range(TREES):
        sample = np.sort(drawn.loc[drawn["tree"] == tree, "_value"].to_numpy())
        limit = int(np.ceil(np.log2(max(len(sample), 2))))
        trees.append(_grow(sample, 0, limit, rng))
    splits = np.unique(np.concatenate([np.array(s) for s, _ in trees]))
    total = np.zeros(len(splits) + 1)
    for cuts, depths in trees:
        # values up to and including a cut go left
        total += np.array(depths)[np.searchsorted(cuts, np.append(splits, np.inf), side="left")]
    scores = 2.0 ** (-(total / TREES) / float(_average_path(per_tree)))
    # a bucket starts at its split point: move each split to the next larger number
    fitted = ForestFilter(column, np.nextafter(splits, np.inf).tolist(), scores.tolist())
    if share is not None:
        scored = fitted.scored(data.withColumnRenamed("x", column), "_score")
        fitted.cut = exact_quantiles(scored, ["_score"], [1.0 - share])["_score"][0]
    return fitted


def _distinct_positions(rng: np.random.Generator, n: int, size: int) -> np.ndarray:
    if n <= 4 * size:
        return rng.permutation(n)[:size]
    picked = np.unique(rng.integers(0, n, size))
    while len(picked) < size:
        picked = np.unique(np.concatenate([picked, rng.integers(0, n, size - len(picked))]))
    return picked


@dataclass
class FactorFilter:
    """Local outlier factor per distinct value, joined back to the rows."""

    column: str
    factors: DataFrame | None = None
    cut: float = float("inf")
    drops_rows: ClassVar[bool] = True

    def scored(self, df: DataFrame, name: str) -> DataFrame:
        value = free_name(df, "_x")
        keyed = df.withColumn(value, finite(col(self.column)))
        joined = lookup_join(keyed, self.factors.withColumnsRenamed({"x": value, "lof": name}),
                             value, "_n")
        return joined.drop(value)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.factors is None:
            return df
        name = free_name(df, "_lof")
        return self.scored(df, name).filter(F.coalesce(F.col(name) <= self.cut, F.lit(True))).drop(name)


def fit_local_outlier_factor(df: DataFrame, column: str, threshold: float | None = None) -> FactorFilter:
    """Nearest neighbours of a value lie next to it in sorted order, at most k distinct values away."""
    require_numeric(df, column)
    share = contamination(threshold) or LOF_SHARE
    data = _values(df, column)
    n, low, high = data.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if n < MIN_LOF_ROWS or low == high:
        return FactorFilter(column)
    k = min(NEIGHBOURS, n - 1)
    counts = data.groupBy("x").agg(F.count(F.lit(1)).alias("_n"))
    ranges = shuffle_partitions(df)
    sliced = _with_halo(in_slices(counts, ["x"], ranges), 3 * k).repartition(ranges, "_part")
    around = Window.partitionBy("_part").orderBy("x")

    def neighbours(fields: list[str]):
        """What is known of the values within k places."""
        return F.collect_list(F.struct(*fields)).over(around.rowsBetween(-k, k))

    # 1. the k nearest rows of each value: its own other copies first, then outwards
    near = sliced.withColumn("_all", neighbours(["x", "_n"]))
    spread = F.array_sort(F.transform("_all", lambda e: F.struct(
        F.abs(e["x"] - F.col("x")).alias("d"), e["x"].alias("x"),
        F.when(e["x"] == F.col("x"), e["_n"] - 1).otherwise(e["_n"]).alias("m"))))
    copies = F.flatten(F.transform(spread, lambda e: F.array_repeat(
        F.struct(e["d"].alias("d"), e["x"].alias("x")), F.least(e["m"], F.lit(k)).cast("int"))))
    near = near.withColumn("_near", F.slice(copies, 1, k)).drop("_all")
    near = near.withColumn("_kd", F.element_at("_near", -1)["d"])
    # 2. local density, from the larger of distance and the neighbour's own reach
    near = near.withColumn("_reach", F.map_from_entries(neighbours(["x", "_kd"])))
    reach = F.aggregate("_near", F.lit(0.0), lambda acc, e: acc + F.greatest(
        e["d"], F.try_element_at("_reach", e["x"])))
    near = near.withColumn("_lrd", 1.0 / (reach / F.lit(float(k)) + 1e-10)).drop("_reach")
    # 3. neighbours' densities relative to the value's own
    near = near.withColumn("_dens", F.map_from_entries(neighbours(["x", "_lrd"])))
    total = F.aggregate("_near", F.lit(0.0), lambda acc, e: acc + F.try_element_at("_dens", e["x"]))
    factors = stage(near.withColumn("lof", total / F.lit(float(k)) / F.col("_lrd"))
                    .filter(F.col("_part") == F.col(SLICE)).select("x", "_n", "lof"), "lof")
    fitted = FactorFilter(column, factors)
    scored = fitted.scored(data.withColumnRenamed("x", column), "_lof")
    fitted.cut = exact_quantiles(scored, ["_lof"], [1.0 - share])["_lof"][0]
    return fitted


def _with_halo(sliced: DataFrame, reach: int) -> DataFrame:
    """Copy the ``reach`` values next to each range into it, under ``_part``.

    Ranges may hold fewer than ``reach`` values, so a value may go into several neighbouring ranges:
    those for which fewer than ``reach`` values lie in between.
    """
    rows = sorted((r[SLICE], r["count"]) for r in sliced.groupBy(SLICE).count().collect())
    targets = []
    for i, (here, size) in enumerate(rows):
        between = 0
        for there, count in rows[i + 1:]:
            targets.append((here, there, reach - between, True))   # tail rows go up
            between += count
            if between >= reach:
                break
        between = 0
        for there, count in reversed(rows[:i]):
            targets.append((here, there, reach - between, False))  # head rows go down
            between += count
            if between >= reach:
                break
    numbered = sliced.withColumn("_up", F.row_number().over(
        Window.partitionBy(SLICE).orderBy(F.desc("x")))).withColumn(
        "_down", F.row_number().over(Window.partitionBy(SLICE).orderBy("x")))
    plan = sliced.sparkSession.createDataFrame(
        targets, f"{SLICE} int, _part int, _take int, _tail boolean")
    copied = numbered.filter((F.col("_up") <= reach) | (F.col("_down") <= reach)) \
        .join(F.broadcast(plan), SLICE).filter(F.when(
            F.col("_tail"), F.col("_up") <= F.col("_take")).otherwise(F.col("_down") <= F.col("_take")))
    columns = sliced.columns
    return stage(sliced.withColumn("_part", F.col(SLICE)).unionByName(
        copied.select(*columns, "_part")), "halo")
