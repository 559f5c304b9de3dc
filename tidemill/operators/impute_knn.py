"""Nearest-neighbour imputation: blocks of queries against all donors, the k best kept in each task.

Distinct query points are taken in blocks of bounded size, each broadcast to the tasks that hold the donors. A task
keeps the k nearest of each query that it has seen and sends on only those, and the few left per task are merged. Rows
with gaps need no search of their own: a distance uses the columns that both rows have. There is no cell or key that a
dense spot of donors could make hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemill.functions.columns import ColumnError, col, require, require_numeric
from tidemill.functions.durable import stage
from tidemill.functions.lookup import lookup_join
from tidemill.operators.ordered import global_index

QUERY_BLOCK, DONOR_BLOCK = 1024, 2048
NEAR = "query long, far double, place long, value double"


@dataclass
class NeighbourFill:
    column: str
    features: list[str]
    k: int
    donors: DataFrame
    mean: float

    def transform(self, df: DataFrame) -> DataFrame:
        f = _names(self.features)
        point = F.struct(*[col(c).cast("double").alias(n) for c, n in zip(self.features, f)])
        vector = F.to_json(point)
        empty = col(self.column).isNull()
        counted = df.filter(empty).groupBy(point.alias("p")).agg(F.count(F.lit(1)).alias("_rows"))
        queries = stage(counted.select(F.to_json("p").alias("_vector"), "p.*", "_rows",
                                       F.monotonically_increasing_id().alias("query")), "queries")
        found = _nearest(queries, self.donors, f, self.k)
        value = F.lit(self.mean)
        if found is not None:
            best = found.groupBy("query").agg(F.avg("value").alias("_fill"))
            fills = stage(queries.select("query", "_vector", "_rows").join(best, "query").drop("query"), "fills")
            df = lookup_join(df.withColumn("_vector", F.when(empty, vector)), fills, "_vector", "_rows")
            value = F.coalesce(F.col("_fill"), value)
        filled = F.coalesce(col(self.column).cast("double"), value)
        return df.select(*[filled.alias(c) if c == self.column else col(c)
                           for c in df.columns if c not in ("_vector", "_fill")])


def _names(features: list[str]) -> list[str]:
    return [f"f{i}" for i in range(len(features))]


def _nearest(queries: DataFrame, donors: DataFrame, f: list[str], k: int) -> DataFrame | None:
    """The k nearest donors of each query, over all its blocks; None without queries."""
    total = queries.count()
    blocks = -(-total // QUERY_BLOCK)
    found = None
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", *f).toPandas()
        if not len(part):
            continue
        near = donors.mapInPandas(_search(donors.sparkSession.sparkContext.broadcast(
            (part["query"].to_numpy(np.int64), part[f].to_numpy(float))), f, k), NEAR)
        order = Window.partitionBy("query").orderBy("far", "place")  # k rows from each task at most
        best = stage(near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r"), "near")
        found = best if found is None else found.unionByName(best)
    return found


def _search(asked, f: list[str], k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, points = asked.value
        best = pd.DataFrame({"at": np.empty(0, np.int64), "far": np.empty(0), "place": np.empty(0, np.int64), "value": np.empty(0)})
        bound = np.full(len(points), np.inf)
        for batch in batches:
            for start in range(0, len(batch), DONOR_BLOCK):
                some = batch.iloc[start:start + DONOR_BLOCK]
                held = some[f].to_numpy(float)
                squared, present = np.zeros((len(points), len(held))), np.zeros((len(points), len(held)))
                for j in range(len(f)):
                    gap = points[:, j, None] - held[None, :, j]
                    met = ~np.isnan(gap)
                    squared += np.where(met, gap * gap, 0.0)
                    present += met
                with np.errstate(divide="ignore", invalid="ignore"):
                    far = np.where(present > 0, squared * (float(len(f) + 1) / present), np.inf)
                reach = bound if len(held) < k else np.minimum(bound, np.partition(far, k - 1, axis=1)[:, k - 1])
                at, row = np.nonzero((far <= reach[:, None]) & np.isfinite(far))
                best = pd.concat([best, pd.DataFrame({
                    "at": at, "far": far[at, row], "place": some["place"].to_numpy()[row], "value": some["value"].to_numpy()[row]})])
                best = best.sort_values(["at", "far", "place"])
                rank = best.groupby("at").cumcount()
                best = best[rank < k]
                last = best[rank[rank < k] == k - 1]
                bound[last["at"].to_numpy()] = last["far"].to_numpy()
        yield pd.DataFrame({"query": names[best["at"].to_numpy(np.int64)], "far": best["far"], "place": best["place"],
                            "value": best["value"]})

    return run


def fit_neighbour_fill(df: DataFrame, column: str, key: list[str], columns: list[str],
                       k: int = 5) -> NeighbourFill:
    """``columns`` are all columns of the distance; ``key`` orders donors at equal distance.

    Of donors with equal cells only the first k by key can ever be used, so only those are kept.
    """
    require_numeric(df, column, *columns)
    require(df, *key)
    features = [c for c in columns if c != column]
    if not features:
        raise ColumnError("neighbours need two or more numeric columns")
    f = _names(features)
    order = [f"k{i}" for i in range(len(key))]
    rows = df.filter(col(column).isNotNull()).select(
        *[col(c).cast("double").alias(n) for c, n in zip(features, f)],
        col(column).cast("double").alias("value"), *[col(c).alias(n) for c, n in zip(key, order)])
    # a group of equal rows is cut in two steps, so that a very large one is spread over many tasks first
    spread = F.pmod(F.xxhash64(*order), F.lit(64))
    for keys in ([*f, spread], f):
        first = Window.partitionBy(*keys).orderBy(*order)
        rows = rows.withColumn("copy", F.row_number().over(first)).filter(F.col("copy") <= k).drop("copy")
    donors = stage(global_index(rows, order, "place").select(*f, "value", "place"), "donors")
    mean = df.agg(F.avg(col(column).cast("double"))).first()[0]
    if mean is None:
        raise ColumnError(f"column {column!r} has no values")
    return NeighbourFill(column, features, k, donors, mean)
