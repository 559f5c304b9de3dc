import pytest
from conftest import column

from tidemill.functions.columns import ColumnError
from tidemill.operators import dedupe, project


def casts(spark):
    return spark.createDataFrame([
        (0, "25", "10.5", "2023-01-01", 1, 1, 10), (1, "30", "20.0", "2023-02-15", 2, 0, 20),
        (2, "35", "15.75", "not_a_date", 1, 1, 30), (3, "nan", "invalid", "2023-03-30", 3, 0, 40)],
        "i int, age_str string, price_str string, date_str string, code long, flag long, whole long")


def test_casts(spark):
    out = project.cast_columns(casts(spark), {"age_str": "int64", "price_str": "float64", "date_str": "datetime",
                                              "code": "category", "flag": "bool", "whole": "int32"})
    assert column(out, "age_str") == [25, 30, 35, None]
    assert column(out, "price_str") == [10.5, 20.0, 15.75, None]
    assert [d is None for d in column(out, "date_str")] == [False, False, True, False]
    assert column(out, "flag") == [True, False, True, False]
    assert out.schema["whole"].dataType.simpleString() == "int"
    assert sorted(set(column(out, "code"))) == ["1", "2", "3"]
    assert out.schema["code"].metadata == {"category": True}


def test_fractional_whole_number_cast_changes_nothing(spark):
    df = spark.createDataFrame([(0, "1.5"), (1, "2")], "i int, x string")
    assert column(project.cast_columns(df, {"x": "int64"}), "x") == ["1.5", "2"]
    report = project.cast_report(df, {"x": "int64"}).first()
    assert report["error"] and report["new_type"] == "string"
    whole = spark.createDataFrame([(0, "1.0"), (1, None)], "i int, x string")
    assert column(project.cast_columns(whole, {"x": "int8"}), "x") == [1, None]


def test_out_of_range_cast(spark):
    df = spark.createDataFrame([(0, 300)], "i int, x long")
    assert project.cast_failures(df, {"x": "int8"})
    assert not project.cast_failures(df, {"x": "int16"})
    with pytest.raises(ColumnError):
        project.cast_columns(df, {"x": "decimal"})


def test_drop_columns(spark):
    df = spark.createDataFrame([(1, "x", 10.0)], "A int, B string, C double")
    assert project.drop_columns(df, ["B"]).columns == ["A", "C"]
    assert project.drop_columns(df, ["B", "Z"], errors="ignore").columns == ["A", "C"]
    for wrong in ([], ["Z"], ["A", "B", "C"]):
        with pytest.raises(ColumnError):
            project.drop_columns(df, wrong)


def test_create_feature(spark):
    df = spark.createDataFrame([(25, 10.5, "Alice")], "Age int, Fare double, Name string")
    assert project.create_feature(df, "r", "Fare / Age").first()["r"] == pytest.approx(0.42)
    assert project.create_feature(df, "u", "upper(Name)").first()["u"] == "ALICE"
    for name, expression in (("Age", "1"), ("x", ""), ("x", "Nothing + 1"), ("x", "1 +")):
        with pytest.raises(ColumnError):
            project.create_feature(df, name, expression)


def test_features(spark):
    df = spark.createDataFrame([
        (0, "2023-01-15", "hello world", 10.0), (1, "2024-06-30", "hi", 0.0),
        (2, "2025-12-01", "this is a longer sentence", -5.0), (3, "bad", "", None)],
        "i int, d string, t string, a double")
    parts = project.extract_datetime(df, "d", ["year", "dayofweek", "is_weekend"])
    assert column(parts, "d_year") == [2023, 2024, 2025, None]
    assert column(parts, "d_dayofweek") == [6, 6, 0, None]
    assert column(parts, "d_is_weekend") == [1, 1, 0, None]
    text = project.extract_text(df, "t", ["length", "word_count"])
    assert column(text, "t_length") == [11, 2, 25, 0]
    assert column(text, "t_word_count") == [2, 1, 5, 1]
    maths = project.extract_math(df, ["a"], ["log", "sqrt", "square"])
    assert column(maths, "a_log")[1:] == [None, None, None]
    assert column(maths, "a_sqrt")[1:] == [0.0, None, None]
    assert project.extract_math(df, ["i", "a"], ["interaction"]).columns[-1] == "i_x_a"
    with pytest.raises(ColumnError):
        project.extract_text(df, "t", ["length"], ["a"])


def test_duplicates(spark):
    rows = list(zip(range(5), [1, 1, 2, 3, 2], "xxyzy", [10, 10, 20, 30, 20]))
    df = spark.createDataFrame(rows, "i int, A int, B string, C int")
    kept = {k: column(dedupe.drop_duplicate_rows(df, ["A", "B", "C"], k, ["i"]), "i") for k in ("first", "last")}
    assert kept == {"first": [0, 2, 3], "last": [1, 3, 4]}
    assert column(dedupe.drop_duplicate_rows(df, ["A", "B", "C"], "none"), "i") == [3]
    assert dedupe.drop_duplicate_rows(df.drop("i"), keep="none").count() == 1
    nulls = spark.createDataFrame([(0, None), (1, None)], "i int, A int")
    assert column(dedupe.drop_duplicate_rows(nulls, ["A"], "first", ["i"]), "i") == [0]
    with pytest.raises(ColumnError):
        dedupe.drop_duplicate_rows(df, ["A"])


def test_drop_impact(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "k int, g string")
    row = project.drop_columns_impact(df, ["k"]).first()
    assert (row["is_identity"], row["duplicates_before"], row["duplicates_after"]) == (True, 0, 10)
