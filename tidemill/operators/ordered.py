"""Row-order operators without a single-task window.

A table is range-partitioned on its order key (tie-breakers included) and written with the number
of the range each row fell into. Windows then run inside one range; what crosses a range border is
a carry of one value per range, at most one per shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemill.functions.columns import col, q
from tidemill.functions.durable import stage

SLICE = "_slice"


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_slices(df: DataFrame, order_by: list[str], ranges: int | None = None) -> DataFrame:
    """Small ranges are merged at run time unless ``ranges`` fixes their number, for work that is heavy
    on few bytes."""
    keys = [col(c).asc_nulls_first() for c in order_by]
    ranged = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    return stage(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")


def within(order_by: list[str], backwards: bool = False):
    """A window over one range. Looking ahead means running backwards: a frame that ends at the
    current row is extended by one row at a time, one that starts there is worked out anew."""
    return Window.partitionBy(SLICE).orderBy(*[
        col(c).desc_nulls_last() if backwards else col(c).asc_nulls_first() for c in order_by])


def slice_rows(sliced: DataFrame, *aggregates) -> list:
    """One summary row per range, in order; bounded by the number of shuffle partitions."""
    return sliced.groupBy(SLICE).agg(*aggregates).orderBy(SLICE).collect()


def join_carry(sliced: DataFrame, rows: list[tuple], fields: list[T.StructField]) -> DataFrame:
    schema = T.StructType([T.StructField(SLICE, T.IntegerType()), *fields])
    carry = sliced.sparkSession.createDataFrame(rows, schema)
    return sliced.join(F.broadcast(carry), SLICE, "left")


def number_rows(sliced: DataFrame, order_by: list[str], name: str, start: int = 0) -> DataFrame:
    """Global position of every row of a table made by ``in_slices``."""
    rows, seen = [], start
    for row in slice_rows(sliced, F.count(F.lit(1)).alias("n")):
        rows.append((row[SLICE], seen))
        seen += row["n"]
    joined = join_carry(sliced, rows, [T.StructField("_before", T.LongType())])
    position = F.col("_before") + F.row_number().over(within(order_by)) - 1
    return joined.withColumn(name, position).drop("_before")


def global_index(df: DataFrame, order_by: list[str], name: str, start: int = 0) -> DataFrame:
    """``order_by`` must tell rows apart, so that the index is the same every time."""
    return number_rows(in_slices(df, order_by), order_by, name, start).drop(SLICE)


def running_total(sliced: DataFrame, order_by: list[str], amount: str, name: str) -> DataFrame:
    """Sum of ``amount`` over all rows before this one."""
    rows, seen = [], 0
    for row in slice_rows(sliced, F.sum(amount).alias("n")):
        rows.append((row[SLICE], seen))
        seen += row["n"]
    joined = join_carry(sliced, rows, [T.StructField("_before", T.LongType())])
    inside = F.sum(amount).over(within(order_by).rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn(name, F.col("_before") + F.coalesce(inside, F.lit(0))).drop("_before")


def _unbroken(df: DataFrame, order_by: list[str]) -> tuple[DataFrame, list[str]]:
    """Add a hash of the row as last order column: rows with equal keys can then be cut into ranges
    anywhere, and fall in the same order every time."""
    return df.withColumn("_tie", F.xxhash64(*map(col, df.columns))), [*order_by, "_tie"]


def _order_struct(order_by: list[str]):
    return F.struct(*[col(c) for c in order_by])


def fill_from_neighbours(df: DataFrame, column: str, order_by: list[str], forward: bool) -> DataFrame:
    """Fill NULLs from the nearest earlier (or later) value; the open end takes the first one found."""
    tied, order_by = _unbroken(df, order_by)
    sliced = in_slices(tied, order_by)
    seen = col(column).isNotNull()
    key = F.when(seen, _order_struct(order_by))
    ends = slice_rows(sliced, F.min_by(col(column), key).alias("head"),
                      F.max_by(col(column), key).alias("tail"))
    rows = []
    walk, carried = (ends, "tail") if forward else (ends[::-1], "head")
    last = None
    for row in walk:
        rows.append((row[SLICE], last))
        last = row[carried] if row[carried] is not None else last
    edge = next((r["head"] for r in ends if r["head"] is not None), None) if forward else \
        next((r["tail"] for r in ends[::-1] if r["tail"] is not None), None)
    kind = df.schema[column].dataType
    joined = join_carry(sliced, rows, [T.StructField("_carry", kind)])
    near = F.last(col(column), ignorenulls=True).over(
        within(order_by, backwards=not forward).rowsBetween(Window.unboundedPreceding, 0))
    filled = F.coalesce(near, F.col("_carry"), F.lit(edge).cast(kind))
    return joined.withColumn("_filled", filled).select(
        *[F.col("_filled").alias(c) if c == column else col(c) for c in df.columns])


def interpolate(df: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    """Linear by row position between known neighbours; ends take the nearest known value."""
    tied, order_by = _unbroken(df, order_by)
    placed = number_rows(in_slices(tied, order_by), order_by, "_pos")
    value = col(column).cast("double")
    point = F.when(value.isNotNull(), F.struct(F.col("_pos").alias("p"), value.alias("v")))
    # the same ranges serve the carry: one first and one last known point per range
    ends = slice_rows(placed, F.min_by(point, F.when(value.isNotNull(), F.col("_pos"))).alias("head"),
                      F.max_by(point, F.when(value.isNotNull(), F.col("_pos"))).alias("tail"))
    before, after, last, following = {}, {}, None, None
    for row in ends:
        before[row[SLICE]] = last
        last = row["tail"] or last
    for row in ends[::-1]:
        after[row[SLICE]] = following
        following = row["head"] or following
    kind = T.StructType([T.StructField("p", T.LongType()), T.StructField("v", T.DoubleType())])
    joined = join_carry(placed, [(s, before[s], after[s]) for s in before],
                        [T.StructField("_prev", kind), T.StructField("_next", kind)])

    def nearest(backwards: bool):
        return F.last(point, ignorenulls=True).over(
            within(["_pos"], backwards).rowsBetween(Window.unboundedPreceding, 0))

    prev, following = F.coalesce(nearest(False), F.col("_prev")), F.coalesce(nearest(True), F.col("_next"))
    known = joined.withColumn("_a", prev).withColumn("_b", following)
    a, b = F.col("_a"), F.col("_b")
    step = F.try_divide((F.col("_pos") - a["p"]).cast("double"), (b["p"] - a["p"]).cast("double"))
    filled = F.coalesce(value, F.when(a.isNotNull() & b.isNotNull(), a["v"] + (b["v"] - a["v"]) * step),
                        a["v"], b["v"])
    return known.withColumn("_filled", filled).select(
        *[F.col("_filled").alias(c) if c == column else col(c) for c in df.columns])
