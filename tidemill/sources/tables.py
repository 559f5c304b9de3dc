"""Reading, writing and listing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemill.functions.columns import ColumnError, col, nan_to_null
from tidemill.operators.profile import stack_columns

FORMATS = ("csv", "json", "parquet")


def format_of(path: str, fmt: str | None = None) -> str:
    found = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if found not in FORMATS:
        raise ColumnError(f"unsupported format {found!r}; supported: {list(FORMATS)}")
    return found


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | str | None = None, lines: bool = False) -> DataFrame:
    """Read a table with NaN turned to NULL. Give ``schema`` for large text files: without it they are
    read once more to infer types. ``lines`` reads JSON with one record per line, which can be split."""
    kind = format_of(path, fmt)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        df = reader.csv(path, header=True, inferSchema=schema is None)
    elif kind == "json":
        df = reader.json(path, multiLine=not lines)
    else:
        df = reader.parquet(path)
    return nan_to_null(df)


def write_table(df: DataFrame, path: str, fmt: str | None = None) -> str:
    """Write to a new path; existing data and the files the table came from are never replaced."""
    kind = format_of(path, fmt)
    if reads_from(df, path):
        raise ColumnError(f"{path} holds the data this table is read from")
    writer = df.write.mode("errorifexists")
    if kind == "csv":
        writer.csv(path, header=True)
    elif kind == "json":
        writer.json(path)
    else:
        writer.parquet(path)
    return path


def _plain(path: str) -> str:
    return path.split(":", 1)[-1].replace("///", "/").replace("//", "/").rstrip("/")


def reads_from(df: DataFrame, path: str) -> bool:
    target = _plain(path)
    return any(_plain(f) == target or _plain(f).startswith(target + "/") for f in df.inputFiles())


def list_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, size_bytes) of the data files in a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option(
        "pathGlobFilter", "*.{csv,json,parquet}").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"),
                        F.col("length").alias("size_bytes"))


def table_metadata(df: DataFrame) -> DataFrame:
    """One row per column: type, rows and share of missing cells."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return stack_columns(df, df.columns, lambda c: {
        "dtype": F.lit(types[c]), "total_rows": F.count(F.lit(1)),
        "missing_fraction": F.round(F.coalesce(F.avg(col(c).isNull().cast("double")), F.lit(0.0)), 6)})


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)
