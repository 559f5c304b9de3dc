"""Filling or dropping missing values; fitted on one table, applied to any."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import DataFrame, functions as F

from tidemill.functions.columns import ColumnError, col, q, require, require_numeric
from tidemill.operators import ordered
from tidemill.operators.quantiles import exact_quantiles
from tidemill.operators.sampling import position_blocks, values_at
from tidemill.operators.valuecounts import column_counts, count_name


@dataclass
class ValueFill:
    """A column and the one value its missing cells receive."""

    column: str
    strategy: str
    value: Any

    def transform(self, df: DataFrame) -> DataFrame:
        kind = df.schema[self.column].dataType.simpleString()
        if self.strategy in ("mean", "median") and kind not in ("double", "float"):
            kind = "double"
        filled = F.coalesce(col(self.column).cast(kind), F.lit(self.value).cast(kind))
        return df.select(*[filled.alias(c) if c == self.column else col(c) for c in df.columns])

    def report(self, df: DataFrame) -> DataFrame:
        return df.agg(F.count_if(col(self.column).isNull()).alias("rows_affected"),
                      F.count(F.lit(1)).alias("total_rows")).select(
            F.lit(self.column).alias("column"), F.lit(self.strategy).alias("strategy"),
            F.lit(str(self.value)).alias("value_used"), "rows_affected", "total_rows",
            F.lit(df.schema[self.column].dataType.simpleString()).alias("dtype"))


@dataclass
class RowDrop:
    """Drop rows whose column is missing."""

    column: str
    strategy: str = "drop_rows"
    drops_rows: ClassVar[bool] = True

    def transform(self, df: DataFrame) -> DataFrame:
        return df.filter(col(self.column).isNotNull())

    def report(self, df: DataFrame) -> DataFrame:
        return df.agg(F.count_if(col(self.column).isNull()).alias("rows_removed"),
                      F.count_if(col(self.column).isNotNull()).alias("remaining_rows")).select(
            F.lit(self.column).alias("column"), F.lit(self.strategy).alias("strategy"),
            "rows_removed", "remaining_rows")


def fit_value_fill(df: DataFrame, column: str, strategy: str, constant: Any = None) -> ValueFill | RowDrop:
    """mean, median, mode, constant or drop_rows."""
    require(df, column)
    if strategy == "drop_rows":
        return RowDrop(column)
    if strategy == "constant":
        if constant is None:
            raise ColumnError("constant needs a value")
        kind = df.schema[column].dataType
        fits = df.sparkSession.range(1).select(
            F.lit(str(constant)).try_cast(kind.simpleString()).alias("v")).first()["v"]
        if fits is None:
            raise ColumnError(f"{constant!r} does not fit type {kind.simpleString()}")
        return ValueFill(column, strategy, constant)
    if strategy == "mean":
        require_numeric(df, column)
        value = df.agg(F.avg(col(column).cast("double"))).first()[0]
    elif strategy == "median":
        require_numeric(df, column)
        value = exact_quantiles(df, [column], [0.5])[column][0]
    elif strategy == "mode":
        best = column_counts(df, column).orderBy(F.desc(count_name(column)), F.asc(q(column))).first()
        value = best[column] if best else None
    else:
        raise ColumnError(f"unknown strategy {strategy!r}")
    if value is None:
        raise ColumnError(f"column {column!r} has no values to take the {strategy} of")
    return ValueFill(column, strategy, value)


@dataclass
class OrderedFill:
    """forward, backward or interpolate, worked out within each table it is applied to."""

    column: str
    strategy: str
    order_by: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        run = {"forward": fill_forward, "backward": fill_backward, "interpolate": fill_interpolated}[self.strategy]
        return run(df, self.column, self.order_by)


def ordered_fill(column: str, strategy: str, order_by: list[str]) -> OrderedFill:
    if strategy not in ("forward", "backward", "interpolate"):
        raise ColumnError(f"unknown strategy {strategy!r}")
    return OrderedFill(column, strategy, order_by)


def fill_forward(df: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    require(df, column, *order_by)
    return ordered.fill_from_neighbours(df, column, order_by, forward=True)


def fill_backward(df: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    require(df, column, *order_by)
    return ordered.fill_from_neighbours(df, column, order_by, forward=False)


def fill_interpolated(df: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    require_numeric(df, column)
    require(df, *order_by)
    return ordered.interpolate(df, column, order_by)


@dataclass
class RandomFill:
    """Missing cells draw, with replacement, from the values seen at fit time."""

    column: str
    blocks: DataFrame
    total: int
    key: list[str] | None = None
    seed: int = 42

    def transform(self, df: DataFrame, key: list[str] | None = None, seed: int | None = None) -> DataFrame:
        """``key`` names columns that tell rows apart, so that equal seeds give equal draws."""
        key, seed = key or self.key, self.seed if seed is None else seed
        if not key:
            raise ColumnError("a random fill needs key columns")
        empty = col(self.column).isNull()
        draw = F.pmod(F.xxhash64(F.lit(seed), *map(col, key)), F.lit(self.total))
        missing = df.filter(empty).withColumn("_draw", draw)
        filled = values_at(missing, "_draw", self.blocks)
        return df.filter(~empty).unionByName(filled.select(
            *[F.col("_value").alias(c) if c == self.column else col(c) for c in df.columns]))


def fit_random_fill(df: DataFrame, column: str, key: list[str] | None = None, seed: int = 42) -> RandomFill:
    require(df, column, *(key or []))
    blocks, total = position_blocks(df, column)
    if total == 0:
        raise ColumnError(f"column {column!r} has no values to draw from")
    return RandomFill(column, blocks, total, key, seed)
