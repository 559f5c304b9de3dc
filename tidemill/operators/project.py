"""Projections: dropping, casting and deriving columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.utils import AnalysisException, ParseException

from tidemill.functions.columns import ColumnError, col, is_numeric, require
from tidemill.functions.moments import ratio
from tidemill.operators.profile import stack_columns

IDENTITY_SHARE = 0.95

# Accepted type names and the Spark type each becomes
TARGET_TYPES = {
    "int": "bigint", "int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint",
    "float": "double", "float64": "double", "float32": "float", "float16": "float",
    "str": "string", "string": "string", "object": "string",
    "bool": "boolean", "boolean": "boolean",
    "datetime": "timestamp", "datetime64": "timestamp", "datetime64[ns]": "timestamp",
    "category": "string",
}
# Largest magnitude a whole number of each type can take
INTEGER_BITS = {"bigint": 63, "int": 31, "smallint": 15, "tinyint": 7}


def drop_columns(df: DataFrame, columns: list[str], errors: str = "raise") -> DataFrame:
    if not columns:
        raise ColumnError("no columns given")
    if errors not in ("raise", "ignore"):
        raise ColumnError(f"errors must be 'raise' or 'ignore', not {errors!r}")
    if errors == "raise":
        require(df, *columns)
    kept = [c for c in df.columns if c not in columns]
    if not kept:
        raise ColumnError("dropping every column would leave an empty table")
    return df.select(*map(col, kept))


def drop_columns_impact(df: DataFrame, columns: list[str]) -> DataFrame:
    """Identity columns among those dropped, and rows that become duplicates of one another."""
    require(df, *columns)
    kept = [c for c in df.columns if c not in columns]

    def repeated(names: list[str], out: str) -> DataFrame:
        groups = df.groupBy(*map(col, names)).agg(F.count(F.lit(1)).alias("_n"))
        return groups.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias(out))

    before = repeated(df.columns, "n").first()["n"]
    after = repeated(kept, "n").first()["n"]
    return stack_columns(df, columns, lambda c: {
        "unique_count": F.count_distinct(col(c)), "total_rows": F.count(F.lit(1))}).select(
        "column", "unique_count", "total_rows",
        (ratio(F.col("unique_count"), F.col("total_rows")) > IDENTITY_SHARE).alias("is_identity"),
        F.lit(before).cast("bigint").alias("duplicates_before"),
        F.lit(after).cast("bigint").alias("duplicates_after"))


def _target(dtype: str) -> str:
    if dtype.lower() not in TARGET_TYPES:
        raise ColumnError(f"unsupported type {dtype!r}")
    return TARGET_TYPES[dtype.lower()]


def _parsed(df: DataFrame, column: str, target: str, fmt: str | None = None) -> Column:
    c, kind = col(column), df.schema[column].dataType
    if target in INTEGER_BITS:
        if isinstance(kind, T.IntegralType):
            return c.try_cast(target)
        if isinstance(kind, T.BooleanType):
            return c.cast("int").cast(target)
        return c.try_cast("double").try_cast(target)
    if target in ("double", "float"):
        number = c.cast("int").cast(target) if isinstance(kind, T.BooleanType) else c.try_cast(target)
        return F.when(~F.isnan(number), number)
    if target == "boolean":
        return (c != 0) if isinstance(kind, T.NumericType) else c.try_cast("boolean")
    if target == "timestamp" and isinstance(kind, T.StringType):
        return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return c.cast(target)


def cast_failures(df: DataFrame, casts: dict[str, str]) -> dict[str, str]:
    """Columns a whole-number cast must leave unchanged, with the reason; one pass over the table."""
    checks = {}
    for c, dtype in casts.items():
        target, kind = _target(dtype), df.schema[c].dataType
        if target in INTEGER_BITS and not isinstance(kind, T.BooleanType):
            limit = F.lit(2.0 ** INTEGER_BITS[target])
            x = col(c).cast("double") if isinstance(kind, T.NumericType) else col(c).try_cast("double")
            x = F.when(~F.isnan(x), x)
            checks[c] = F.count_if((x != F.floor(x)) | (x < -limit) | (x >= limit))
    if not checks:
        return {}
    row = df.agg(*[v.alias(f"n{i}") for i, v in enumerate(checks.values())]).first()
    return {c: f"{n} values are fractional or out of range for {casts[c]}"
            for c, n in zip(checks, row) if n}


def cast_columns(df: DataFrame, casts: dict[str, str], fmt: str | None = None) -> DataFrame:
    """Cast columns; unreadable text becomes NULL, a failing whole-number cast changes nothing."""
    require(df, *casts)
    failed = cast_failures(df, casts)
    out = []
    for c in df.columns:
        if c not in casts or c in failed:
            out.append(col(c))
        elif casts[c].lower() == "category":
            out.append(col(c).cast("string").alias(c, metadata={"category": True}))
        else:
            out.append(_parsed(df, c, _target(casts[c]), fmt).alias(c))
    return df.select(*out)


def cast_report(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    require(df, *casts)
    failed = cast_failures(df, casts)
    new = {c: df.schema[c].dataType.simpleString() if c in failed else _target(t)
           for c, t in casts.items()}

    def stats(c: str) -> dict[str, Column]:
        made = col(c) if c in failed else _parsed(df, c, new[c])
        return {"old_type": F.lit(df.schema[c].dataType.simpleString()),
                "new_type": F.lit(new[c]),
                "turned_null": F.count_if(made.isNull() & col(c).isNotNull()),
                "error": F.lit(failed.get(c)).cast("string")}

    return stack_columns(df, list(casts), stats)


def create_feature(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add a column from a SQL expression over the others."""
    if not name or not expression or not expression.strip():
        raise ColumnError("a feature needs a name and an expression")
    if name in df.columns:
        raise ColumnError(f"column {name!r} already exists")
    try:
        return df.withColumn(name, F.expr(expression))
    except (AnalysisException, ParseException) as error:
        raise ColumnError(f"invalid expression {expression!r}: {error}") from error


def _new_names(df: DataFrame, made: list[str], new_names: list[str] | None) -> list[str]:
    names = new_names or made
    if len(names) != len(made):
        raise ColumnError(f"{len(made)} names needed, {len(names)} given")
    clash = [n for n in names if n in df.columns]
    if clash:
        raise ColumnError(f"columns already exist: {clash}")
    return names


def _date_part(c: Column, part: str) -> Column:
    return {"year": lambda: F.year(c), "month": lambda: F.month(c), "day": lambda: F.dayofmonth(c),
            "dayofweek": lambda: F.weekday(c), "hour": lambda: F.hour(c),
            "is_weekend": lambda: (F.weekday(c) >= 5).cast("int")}[part]()


DATE_PARTS = ("year", "month", "day", "dayofweek", "hour", "is_weekend")


def extract_datetime(df: DataFrame, column: str, parts: list[str],
                     new_names: list[str] | None = None) -> DataFrame:
    require(df, column)
    unknown = [p for p in parts if p not in DATE_PARTS]
    if unknown:
        raise ColumnError(f"unknown date parts: {unknown}")
    names = _new_names(df, [f"{column}_{p}" for p in parts], new_names)
    c = col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        c = F.try_to_timestamp(c)
    return df.withColumns({n: _date_part(c, p) for n, p in zip(names, parts)})


def extract_text(df: DataFrame, column: str, ops: list[str],
                 new_names: list[str] | None = None) -> DataFrame:
    """``length`` counts characters, ``word_count`` counts single spaces plus one."""
    require(df, column)
    c = col(column).cast("string")
    made = {"length": F.char_length(c),
            "word_count": F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit(""))) + 1}
    unknown = [o for o in ops if o not in made]
    if unknown:
        raise ColumnError(f"unknown text operations: {unknown}")
    names = _new_names(df, [f"{column}_{o}" for o in ops], new_names)
    return df.withColumns({n: made[o] for n, o in zip(names, ops)})


def extract_math(df: DataFrame, columns: list[str], ops: list[str],
                 new_names: list[str] | None = None) -> DataFrame:
    """log, sqrt and square of one column; interaction is the product of two or more."""
    require(df, *columns)
    wrong = [c for c in columns if not is_numeric(df, c)]
    if wrong:
        raise ColumnError(f"columns are not numeric: {wrong}")
    made: dict[str, Column] = {}
    for op in ops:
        if op == "interaction":
            if len(columns) < 2:
                raise ColumnError("interaction needs two or more columns")
            product = col(columns[0]).cast("double")
            for c in columns[1:]:
                product = product * col(c).cast("double")
            made["_x_".join(columns)] = product
            continue
        for name in columns:
            c = col(name).cast("double")
            if op == "log":
                made[f"{name}_log"] = F.when(c > 0, F.log(c))
            elif op == "sqrt":
                made[f"{name}_sqrt"] = F.when(c >= 0, F.sqrt(c))
            elif op == "square":
                made[f"{name}_square"] = c * c
            else:
                raise ColumnError(f"unknown math operation {op!r}")
    names = _new_names(df, list(made), new_names)
    return df.withColumns(dict(zip(names, made.values())))
