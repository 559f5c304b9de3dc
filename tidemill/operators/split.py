"""Train/test splits with exact sizes.

A row's place in the shuffled order is a hash of its key. Counting hash ranges finds the range in
which the cut falls; only the rows of that one range are ranked, everything else is a row filter.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, Window, functions as F

from tidemill.functions.columns import ColumnError, col, free_name, require
from tidemill.functions.durable import stage
from tidemill.functions.lookup import lookup_join
from tidemill.operators.ordered import global_index

RANGE_ROWS = 50_000
MAX_RANGE_BITS = 24


@dataclass
class Split:
    train: DataFrame
    test: DataFrame

    def __post_init__(self) -> None:
        if self.train.schema != self.test.schema:
            raise ColumnError("train and test have different schemas")

    def apply(self, fitted) -> "Split":
        """Transform both parts with something fitted on the training part.

        What drops rows leaves the test part alone, and what treats its own training rows apart (leave-one-out)
        does so for the training part only.
        """
        train = getattr(fitted, "fit_transform", fitted.transform)(self.train)
        return Split(train, self.test if getattr(fitted, "drops_rows", False) else fitted.transform(self.test))


def test_rows(rows: int, test_size: float) -> int:
    if not 0 < test_size < 1:
        raise ColumnError("test_size must be between 0 and 1")
    if rows < 2:
        raise ColumnError("a split needs at least two rows")
    return min(ceil(rows * test_size - 1e-12), rows - 1)


def class_quotas(counts: DataFrame, label: str, test_size: float) -> tuple[DataFrame, int]:
    """(label, n, q): test rows per class, proportional, the remainder to the largest fractions; and the largest class."""
    rows, classes, least, most, gaps = counts.agg(
        F.sum("n"), F.count(F.lit(1)), F.min("n"), F.max("n"), F.count_if(F.col(label).isNull())).first()
    if gaps:
        raise ColumnError("the stratify column has missing values")
    wanted = test_rows(rows or 0, test_size)
    if least < 2:
        raise ColumnError("every class needs at least two rows")
    if wanted < classes or rows - wanted < classes:
        raise ColumnError("both parts need at least one row per class")
    exact = F.lit(float(wanted)) * F.col("n") / F.lit(float(rows))
    shares = stage(counts.withColumns({"q": F.floor(exact), "short": F.floor(exact) - exact, "name": F.col(label).cast("string")}), "shares")
    left = wanted - shares.agg(F.sum("q")).first()[0]
    ranked = global_index(shares, ["short", "name"], "rank")
    return stage(ranked.select(label, "n", (F.col("q") + (F.col("rank") < left).cast("int")).alias("q")), "quotas"), most


def train_test_split(df: DataFrame, test_size: float, key: list[str], seed: int = 42,
                     stratify: str | None = None) -> Split:
    """``key`` must tell rows apart: it decides where each row falls."""
    require(df, *key)
    label = free_name(df, "_class")
    if stratify:
        require(df, stratify)
        quotas, most = class_quotas(stage(df.groupBy(col(stratify).alias(label)).agg(
            F.count(F.lit(1)).alias("n")), "classes"), label, test_size)
        classed = df.withColumn(label, col(stratify))
    else:
        most = df.count()
        quotas = df.sparkSession.createDataFrame([(0, test_rows(most, test_size))], f"{label} int, q bigint")
        classed = df.withColumn(label, F.lit(0))

    place, part, bound, left = (free_name(df, n) for n in ("_place", "_range", "_bound", "_left"))
    bits = min(MAX_RANGE_BITS, max(0, (most // RANGE_ROWS).bit_length()))
    hashed = classed.withColumn(place, F.xxhash64(F.lit(seed), *map(col, key)))
    # the top bits of the hash, as an unsigned range number
    hashed = hashed.withColumn(part, F.pmod(F.shiftright(F.col(place), 64 - bits), F.lit(1 << bits))
                               if bits else F.lit(0).cast("bigint"))

    sizes = hashed.groupBy(label, part).agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(Window.partitionBy(label).orderBy(part))  # at most 2^bits rows per class
    cut = (sizes.withColumn("upto", run).join(quotas.select(label, "q"), label)
           .filter((F.col("upto") >= F.col("q")) & (F.col("upto") - F.col("n") < F.col("q")))
           .select(label, F.col(part).alias(bound),
                   (F.col("q") - F.col("upto") + F.col("n")).alias(left)))
    cuts = stage(cut, "cuts")  # one row per class
    placed = lookup_join(hashed, cuts, label) if stratify else hashed.withColumns(
        {c: F.lit(v).cast("bigint") for c, v in (cuts.first() or {bound: -1, left: 0}).asDict().items()
         if c != label})
    # classes whose quota is zero have no cut
    before = F.coalesce(F.col(part) < F.col(bound), F.lit(False))
    on_cut = F.coalesce(F.col(part) == F.col(bound), F.lit(False))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(place, *map(col, key)))
    edge = placed.filter(on_cut).withColumn("_rank", rank)
    columns = [col(c) for c in df.columns]
    test = placed.filter(before).select(*columns).unionByName(
        edge.filter(F.col("_rank") <= F.col(left)).select(*columns))
    train = placed.filter(~before & ~on_cut).select(*columns).unionByName(
        edge.filter(F.col("_rank") > F.col(left)).select(*columns))
    return Split(train, test)


def ordered_split(df: DataFrame, test_size: float, order_by: list[str]) -> Split:
    """The last rows in ``order_by`` order are the test part."""
    require(df, *order_by)
    position = free_name(df, "_position")
    tie = free_name(df, "_tie")
    tied = df.withColumn(tie, F.xxhash64(*map(col, df.columns)))
    placed = global_index(tied, [*order_by, tie], position)
    rows = df.count()
    cut = rows - test_rows(rows, test_size)
    columns = [col(c) for c in df.columns]
    return Split(placed.filter(F.col(position) < cut).select(*columns),
                 placed.filter(F.col(position) >= cut).select(*columns))
