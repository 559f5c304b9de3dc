"""Numbered snapshots of a table: one Parquet folder per version and a table of events about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemill.functions.columns import ColumnError, col, numeric_columns
from tidemill.operators.fitted import FittedStore  # noqa: F401  kept here for earlier callers
from tidemill.operators.profile import stack_columns
from tidemill.operators.split import Split

KEEP = 10
EVENTS = ("seq bigint, event string, version int, op string, params map<string,string>, rows bigint, "
          "columns int, column_names array<string>, has_test boolean, ts timestamp")


class VersionStore:
    """Versions of one dataset below ``path``; version 0 is always kept."""

    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._seq = self._next = 0

    def _folder(self, version: int, part: str = "train") -> str:
        return f"{self.path}/v={version}/{part}"

    def _append(self, event: str, version: int, op: str = "", params: dict | None = None,
                rows: int | None = None, names: list[str] | None = None, has_test: bool = False) -> None:
        row = [(self._seq, event, version, op, {k: str(v) for k, v in (params or {}).items()}, rows,
                None if names is None else len(names), names, has_test, None)]
        self.spark.createDataFrame(row, EVENTS).withColumn("ts", F.current_timestamp()) \
            .coalesce(1).write.mode("append").parquet(f"{self.path}/events")
        self._seq += 1

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(f"{self.path}/events")

    def open(self) -> "VersionStore":
        """Continue a store written earlier."""
        seq, version = self.events().agg(F.max("seq"), F.max("version")).first()
        self._seq, self._next = seq + 1, version + 1
        return self

    def snapshot(self, df: DataFrame | Split, op: str, params: dict | None = None) -> int:
        train, test = (df.train, df.test) if isinstance(df, Split) else (df, None)
        version = self._next
        train.write.mode("errorifexists").parquet(self._folder(version))
        if test is not None:
            test.write.mode("errorifexists").parquet(self._folder(version, "test"))
        rows = self.spark.read.parquet(self._folder(version)).count()  # from the file footers
        self._append("snapshot", version, op, params, rows, train.columns, test is not None)
        if version == 0:
            self._append("pin", 0)
        self._next += 1
        if version >= self.keep:
            for old in expired_versions(self.list(), self.keep).collect():
                self._expire(old["version"])
        return version

    def _expire(self, version: int) -> None:
        """Free the space of a version: its folder is left with the schema only."""
        self._append("expire", version)
        entry = self.events().filter((F.col("event") == "snapshot") & (F.col("version") == version)).first()
        for part in ["train"] + (["test"] if entry["has_test"] else []):
            schema = self.spark.read.parquet(self._folder(version, part)).schema
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(
                self._folder(version, part))

    def pin(self, version: int) -> None:
        self._require(version)
        self._append("pin", version)

    def unpin(self, version: int) -> None:
        self._require(version)
        self._append("unpin", version)

    def list(self) -> DataFrame:
        """Stored versions with their metadata and whether they are pinned; a few rows."""
        events = self.events()
        state = events.groupBy("version").agg(
            (F.max_by("event", F.when(F.col("event").isin("pin", "unpin"), F.col("seq"))) == "pin").alias("pinned"),
            F.bool_or(F.col("event") == "expire").alias("expired"))
        return (events.filter("event = 'snapshot'").join(F.broadcast(state), "version")
                .filter(~F.col("expired"))
                .select("version", "op", "params", "rows", "columns", "column_names", "has_test", "ts",
                        F.coalesce("pinned", F.lit(False)).alias("pinned")))

    def _require(self, version: int) -> None:
        if self.list().filter(F.col("version") == version).isEmpty():
            known = [r["version"] for r in self.list().select("version").orderBy("version").collect()]
            raise ColumnError(f"version {version} not found; stored versions: {known}")

    def read(self, version: int, part: str = "train") -> DataFrame:
        self._require(version)
        return self.spark.read.parquet(self._folder(version, part))

    def rollback(self, version: int) -> int:
        """Store the content of an old version as the newest one, and pin the old one."""
        entry = self.list().filter(F.col("version") == version).first()
        self._require(version)
        df = self.read(version)
        new = self.snapshot(Split(df, self.read(version, "test")) if entry["has_test"] else df,
                            "rollback", {"rolled_back_to": version})
        self.pin(version)
        return new

    def steps_between(self, a: int, b: int) -> DataFrame:
        low, high = min(a, b), max(a, b)
        shown = F.transform(F.map_entries(F.map_filter("params", lambda k, v: k != "dataset_name")),
                            lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        text = F.array_join(F.array_sort(shown), ", ")
        return (self.list().filter((F.col("version") > low) & (F.col("version") <= high))
                .select("version", F.concat(F.format_string("v%d: %s", "version", "op"), F.when(
                    text != "", F.concat(F.lit("("), text, F.lit(")"))).otherwise("")).alias("step")))


def expired_versions(versions: DataFrame, keep: int = KEEP) -> DataFrame:
    """Oldest unpinned versions beyond ``keep`` in total; the newest one never goes.

    The table has one row per stored version.
    """
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    newest = F.max("version").over(Window.partitionBy(F.lit(1)))
    counted = versions.withColumn("_over", total - F.lit(keep)).withColumn("_newest", newest)
    free = counted.filter(~F.col("pinned") & (F.col("version") != F.col("_newest")))
    age = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("version"))
    return free.withColumn("_age", age).filter(F.col("_age") <= F.col("_over")).select("version")


def diff_shape(a: DataFrame, b: DataFrame) -> DataFrame:
    rows = [("rows", a.count(), b.count()), ("columns", len(a.columns), len(b.columns))]
    return a.sparkSession.createDataFrame(rows, "measure string, before bigint, after bigint") \
        .withColumn("delta", F.col("after") - F.col("before"))


def diff_schema(a: DataFrame, b: DataFrame) -> DataFrame:
    before = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    after = {f.name: f.dataType.simpleString() for f in b.schema.fields}
    rows = [(c, "added" if c not in before else "removed" if c not in after else "retyped",
             before.get(c), after.get(c))
            for c in sorted({**before, **after}) if before.get(c) != after.get(c)]
    return a.sparkSession.createDataFrame(
        rows, "column string, change string, type_before string, type_after string")


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return sorted(set(a.columns) & set(b.columns))


def diff_missing(a: DataFrame, b: DataFrame) -> DataFrame:
    shared = _shared(a, b)

    def counted(df: DataFrame, name: str) -> DataFrame:
        return stack_columns(df, shared, lambda c: {name: F.count_if(col(c).isNull())})

    return (counted(a, "before").join(F.broadcast(counted(b, "after")), "column")  # one row per column
            .withColumn("delta", F.col("after") - F.col("before")).filter("delta <> 0"))


def diff_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    shared = [c for c in _shared(a, b) if c in numeric_columns(a) and c in numeric_columns(b)]
    names = ("mean", "std", "min", "max")

    def measured(df: DataFrame, tag: str) -> DataFrame:
        def stats(c: str) -> dict:
            x = col(c).cast("double")
            return {f"{n}_{tag}": F.round(f(x), 4) for n, f in zip(
                names, (F.avg, F.stddev_samp, F.min, F.max))}
        return stack_columns(df, shared, stats)

    joined = measured(a, "before").join(F.broadcast(measured(b, "after")), "column")
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"{n}_before").eqNullSafe(F.col(f"{n}_after"))
    return joined.filter(~same)


def diff_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows gained and lost, as a multiset."""
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(
        a.exceptAll(b).withColumn("change", F.lit("removed")))
