import pytest
from pyspark.sql import functions as F

from tidemill.functions.columns import ColumnError
from tidemill.functions.durable import fresh_path
from tidemill.operators import quality, sketches


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_estimates_are_inside_the_bound(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 7).alias("few"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("gaps"),
                                    F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.0)).alias("zeros"),
                                    F.lit(None).cast("string").alias("nothing"), F.concat(F.lit("t"), F.col("id") % 5000).alias("n"))
    got = by_column(sketches.sketched_summary(sketches.column_sketches(df)))
    exact = {"id": 60_000, "few": 7, "gaps": 20_000, "zeros": 1, "nothing": 0, "n": 5000}
    for name, count in exact.items():
        assert abs(got[name]["unique_count"] - count) <= sketches.error_bound() * count
    assert got["gaps"]["non_null_count"] == 20_000 and got["n"]["is_numeric"] is False
    # grades come out as on exact counts
    graded, want = (by_column(quality.quality_cardinality(df, s)) for s in (sketches.sketched_summary(sketches.column_sketches(df)), None))
    assert {c: r["severity"] for c, r in graded.items()} == {c: r["severity"] for c, r in want.items()}


def test_merged_equals_direct(spark):
    df = spark.range(30_000).select("id", (F.col("id") % 100).cast("string").alias("word"))
    parts = [df.filter(F.col("id") % 3 == k) for k in range(3)] + [df.limit(0)]
    merged = by_column(sketches.sketched_summary(sketches.merge_sketches(*map(sketches.column_sketches, parts))))
    direct = by_column(sketches.sketched_summary(sketches.column_sketches(df)))
    assert merged["word"] == direct["word"]
    assert merged["id"]["total_rows"] == 30_000 and merged["id"]["is_numeric"]
    assert abs(merged["id"]["unique_count"] - 30_000) <= sketches.error_bound() * 30_000
    empty = by_column(sketches.sketched_summary(sketches.column_sketches(df.limit(0))))
    assert (empty["id"]["total_rows"], empty["id"]["unique_count"]) == (0, 0)
    with pytest.raises(ColumnError):
        sketches.column_sketches(df, 3)


def test_a_grown_table_is_read_from_its_new_files(spark):
    folder, log = fresh_path(spark, "grown"), sketches.SketchLog(spark, fresh_path(spark, "sketch-log"))
    spark.range(1000).repartition(2).write.parquet(folder)
    assert log.update(folder) == 2
    assert log.update(folder) == 0
    spark.range(500, 3000).select("id", F.lit("x").alias("late")).coalesce(1).write.mode("append").parquet(folder)
    assert sketches.SketchLog(spark, log.path).update(folder) == 1
    got = by_column(sketches.sketched_summary(log.merged()))
    assert got["id"]["total_rows"] == 3500 and got["late"]["total_rows"] == 3500
    assert abs(got["id"]["unique_count"] - 3000) <= sketches.error_bound() * 3000
    assert (got["late"]["non_null_count"], got["late"]["unique_count"]) == (2500, 1)
