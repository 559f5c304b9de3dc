"""Draw values of a column by position in its sorted multiset.

The distinct values, with the running total of their counts, stand for the sorted column. A draw is
a position; it meets its value through an equality join on blocks of ``BLOCK`` positions, so a value
covering a third of all positions is spread over as many blocks as it covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemill.functions.columns import col
from tidemill.operators.ordered import in_slices, running_total
from tidemill.operators.valuecounts import column_counts, count_name

BLOCK = 64


def position_blocks(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(_block, _from, _to, _value) rows covering positions 0..n-1, and n."""
    n = count_name(column)
    sliced = in_slices(column_counts(df, column), [column])
    total = sliced.agg(F.sum(n)).first()[0] or 0
    placed = running_total(sliced, [column], n, "_from")
    ranges = placed.select(F.col("_from"), (F.col("_from") + F.col(n)).alias("_to"),
                           col(column).alias("_value"))
    first = F.floor(F.col("_from") / BLOCK).cast("bigint")
    last = F.floor((F.col("_to") - 1) / BLOCK).cast("bigint")
    return ranges.withColumn("_block", F.explode(F.sequence(first, last))), total


def values_at(positions: DataFrame, position: str, blocks: DataFrame) -> DataFrame:
    """Add ``_value``, the value at each row's position."""
    drawn = positions.withColumn("_block", F.floor(F.col(position) / BLOCK).cast("bigint"))
    return (drawn.join(blocks, "_block")
            .filter((F.col(position) >= F.col("_from")) & (F.col(position) < F.col("_to")))
            .drop("_block", "_from", "_to"))
