"""User functions for derived columns: Arrow functions for a value, table functions for rows.

Both are registered under a name in the session and then used in expressions; they get Arrow batches or rows inside tasks, so the
table stays partitioned as it is and is not shuffled. Built-in SQL functions stay the faster way where they suffice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemill.functions.columns import ColumnError, q, require


def _checked(spark: SparkSession, name: str, replace: bool) -> str:
    if not name.isidentifier():
        raise ColumnError(f"{name!r} cannot name a function")
    if not replace and spark.catalog.functionExists(name):
        raise ColumnError(f"a function {name!r} already exists")
    return name


def register_scalar(spark: SparkSession, name: str, function: Callable, returns: str, replace: bool = False) -> None:
    """``function`` takes Arrow arrays of one batch, one for each argument, and returns an Arrow array of the same length."""
    spark.udf.register(_checked(spark, name, replace), F.arrow_udf(function, returns))


def register_table(spark: SparkSession, name: str, handler: type, returns: str, replace: bool = False) -> None:
    """``handler`` is a class whose ``eval`` takes the arguments of one row and yields the rows made of it, as tuples.

    It is registered once more as ``name``_outer, which yields a row of nulls where the handler yields none: a lateral left
    join drops such rows in this version of Spark.
    """
    width = len(T.StructType.fromDDL(returns))

    class Outer(handler):
        def eval(self, *args):
            empty = True
            for row in super().eval(*args) or ():
                empty = False
                yield row
            if empty:
                yield (None,) * width

    made = {name: handler, f"{name}_outer": Outer}
    for each in made:
        _checked(spark, each, replace)
    for each, kind in made.items():
        spark.udtf.register(each, F.udtf(kind, returnType=returns, useArrow=True))


def create_rows(df: DataFrame, function: str, arguments: list[str], keep_empty: bool = True) -> DataFrame:
    """``df`` with the columns of a function registered by ``register_table`` beside it, one row for each row that the function yields.

    A row for which it yields none stays, with nulls, unless ``keep_empty`` is off. Columns of the function that are called as
    one of the table are refused.
    """
    require(df, *arguments)
    if not function.isidentifier():
        raise ColumnError(f"{function!r} cannot name a function")
    called = f"{function}_outer" if keep_empty else function
    made = df.sparkSession.sql(f"SELECT * FROM {{df}} AS t, LATERAL {called}({', '.join('t.' + q(a) for a in arguments)})", df=df)
    clash = {c.lower() for c in df.columns} & {c.lower() for c in made.columns[len(df.columns):]}
    if clash:
        raise ColumnError(f"columns already exist: {sorted(clash)}")
    return made
