import pytest
from conftest import column
from pyspark.sql import functions as F

from tidemill.functions.columns import ColumnError
from tidemill.functions.durable import fresh_path, shared_folder, stage
from tidemill.operators import profile, quality, versions
from tidemill.operators.outliers import OutlierBounds, fit_outliers
from tidemill.operators.preflight import preflight
from tidemill.operators.runlog import RunLog, run_report
from tidemill.operators.split import Split
from tidemill.sources import tables
from tidemill.streaming.apply import transform_stream


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A,B\n1,x\n2,y\n3,z\n")
    (tmp_path / "b.json").write_text('[{"X": 10, "Y": "a"}, {"X": 20, "Y": "b"}]')
    spark.createDataFrame([(1, 4.0), (2, float("nan"))], "P int, Q double").coalesce(1).write.parquet(
        str(tmp_path / "c.parquet"))
    assert tables.read_table(spark, str(tmp_path / "a.csv")).count() == 3
    assert tables.read_table(spark, str(tmp_path / "b.json")).count() == 2
    assert column(tables.read_table(spark, str(tmp_path / "c.parquet")), "Q", "P") == [4.0, None]
    listed = {r["filename"]: r["size_bytes"] for r in tables.list_sources(spark, str(tmp_path)).collect()}
    assert listed["a.csv"] == 16 and "b.json" in listed
    with pytest.raises(ColumnError):
        tables.read_table(spark, "x.xlsx")


def test_source_files_are_never_replaced(spark):
    path = tables.write_table(spark.range(5).toDF("a"), fresh_path(spark, "t"), "parquet")
    df = tables.read_table(spark, path, "parquet")
    with pytest.raises(ColumnError):
        tables.write_table(df, path, "parquet")
    assert df.count() == 5


def test_metadata(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    got = {r["column"]: (r["dtype"], r["total_rows"], r["missing_fraction"])
           for r in tables.table_metadata(df).collect()}
    assert got == {"a": ("int", 2, 0.0), "b": ("string", 2, 0.5)}


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert stage(spark.range(3)).inputFiles()[0].startswith("file://" + shared_folder(spark))


def test_profile(spark):
    df = spark.createDataFrame([(float(v), "ab"[i % 2]) for i, v in enumerate([1, 2, 3, 4, 100, 7, 7, 9])],
                               "x double, c string")
    row = profile.describe_numeric(df).first()
    assert (row["skewness"], row["kurtosis"]) == (2.7908, 7.84)
    assert (row["q25"], row["q50"], row["q75"]) == (2.75, 5.5, 7.5)
    flat = profile.describe_numeric(spark.createDataFrame([(5.0,)] * 4, "x double")).first()
    assert (flat["std"], flat["skewness"], flat["kurtosis"]) == (0.0, 0.0, 0.0)
    top = profile.describe_categorical(df).orderBy("rank").collect()
    assert [(r["value"], r["count"], r["percentage"]) for r in top] == [("a", 4, 50.0), ("b", 4, 50.0)]


def test_quality(spark):
    rows = [(i, float(i % 7) if i % 4 else None, 1, 0 if i else 1) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, v double, one int, rare int").union(
        spark.createDataFrame(rows[:20], "id int, v double, one int, rare int"))
    found = {(r["type"], r["column"]): r["severity"] for r in quality.quality_issues(df).collect()}
    assert found["missing_values", "v"] == "high"
    assert found["duplicate_rows", "ALL_COLUMNS"] == "medium"
    assert found["zero_variance", "one"] == "high"
    assert found["near_zero_variance", "rare"] == "medium"
    assert found["high_cardinality", "id"] == "medium"
    assert quality.quality_outliers(spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")) \
        .first()["method_reason"] == "small_sample_size"


def test_run_log(spark):
    log = RunLog(spark).add("load_data", dataset_name="t").add("mystery").add(
        "train_test_split", test_size=0.2, train_rows=8, test_rows=2)
    said = column(run_report(log.table()), "description", "step")
    assert said == ["1. load data with dataset name t", "2. mystery",
                    "3. train test split with test rows 2; test size 0.2; train rows 8"]
    assert log.export(fresh_path(spark, "log")).count() == 3


def test_versions(spark):
    store = versions.VersionStore(spark, fresh_path(spark, "v"), keep=3)
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "age int, income double")
    assert [store.snapshot(df, "load_data") , store.snapshot(df.filter("age > 0"), "clean")] == [0, 1]
    both = Split(df.filter("age < 4"), df.filter("age >= 4"))
    assert store.snapshot(both, "split", {"test_size": 0.2}) == 2
    assert store.rollback(2) == 3  # version 1 is the oldest that may go
    assert column(store.list(), "version", "version") == [0, 2, 3]
    assert store.read(3, "test").count() == 1
    again = versions.VersionStore(spark, store.path, keep=3).open()
    assert again.snapshot(df, "more") == 4
    assert column(again.list(), "version", "version") == [0, 2, 4]
    with pytest.raises(ColumnError):
        again.read(1)
    assert versions.diff_shape(df, df.filter("age > 0")).filter("measure = 'rows'").first()["delta"] == -1
    assert versions.diff_schema(df, df.withColumn("x", F.lit(1))).first()["change"] == "added"


def test_fitted_store(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    store = versions.FittedStore(spark, fresh_path(spark, "f"))
    fitted = fit_outliers(df, "x", "iqr")
    assert [store.save("iqr", fitted), store.save("iqr", fitted)] == ["iqr_v1", "iqr_v2"]
    assert store.get("iqr_v2", OutlierBounds) == fitted
    assert store.list().count() == 2
    with pytest.raises(ColumnError):
        store.get("iqr_v3", OutlierBounds)


def test_preflight(spark):
    df = spark.createDataFrame([(25, 10.5, "Alice"), (30, None, "Bob"), (25, 10.5, "Alice")],
                               "Age int, Fare double, Name string")
    checks = [("impute", {"column": "Fare", "strategy": "drop_rows"}), ("remove_outliers", {"column": "Name"}),
              ("drop_duplicate_rows", {}), ("drop_columns", {"columns": ["Nope"]}),
              ("encode", {"column": "Name", "method": "one_hot"}), ("reduce", {"n_components": 9}),
              ("create_feature", {"name": "Age", "expression": "1"}), ("whatever", {})]
    got = preflight(df, checks).collect()
    assert [r["allowed"] for r in got] == [True, False, True, False, True, False, False, False]
    assert got[2]["reason"] == "drops 1 duplicate rows" and got[0]["est_bytes"] < got[1]["est_bytes"]


def test_fitted_transform_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    fitted = fit_outliers(df, "x", "iqr")
    path = str(tmp_path / "in")
    df.write.parquet(path)
    stream = transform_stream(spark.readStream.schema(df.schema).parquet(path), [fitted])
    query = stream.writeStream.format("memory").queryName("kept").trigger(availableNow=True) \
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    assert spark.table("kept").count() == 4
