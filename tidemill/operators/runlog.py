"""The list of steps taken, as a table, and its reading in plain words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.functions.columns import ColumnError

SCHEMA = "step int, op string, params map<string,string>, ts timestamp"


class RunLog:
    """Append-only steps of one run; tens of rows, kept by the caller and written on export."""

    def __init__(self, spark: SparkSession):
        self.spark, self.steps = spark, []

    def add(self, op: str, **params) -> "RunLog":
        self.steps.append((op, {k: str(v) for k, v in params.items() if v is not None}))
        return self

    def table(self) -> DataFrame:
        rows = [(i, op, params) for i, (op, params) in enumerate(self.steps, 1)]
        frame = self.spark.createDataFrame(rows, "step int, op string, params map<string,string>")
        return frame.withColumn("ts", F.current_timestamp())

    def export(self, path: str) -> DataFrame:
        if not self.steps:
            raise ColumnError("no steps to export")
        self.table().write.mode("errorifexists").json(path)
        return self.spark.read.schema(SCHEMA).json(path)


def run_report(log: DataFrame) -> DataFrame:
    """One line per step: its number, the operation in words and what it was given, by name."""
    given = F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(
        F.translate(e["key"], "_", " "), F.lit(" "), e["value"]))
    words = F.translate(F.col("op"), "_", " ")
    line = F.concat(F.col("step").cast("string"), F.lit(". "), words,
                    F.when(F.size(given) > 0, F.concat(F.lit(" with "), F.array_join(given, "; "))).otherwise(""))
    return log.select("step", "op", line.alias("description"))
