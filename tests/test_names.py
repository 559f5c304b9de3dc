"""Operators on tables whose columns have the names that the operators use inside."""
import pytest
from conftest import column

from tidemill.operators import association, catnorm, cluster, dedupe, encode, impute


@pytest.fixture(params=["n", "N", "value_"])
def named(spark, request):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, None, "y"), (4, "b", "x")]
    return spark.createDataFrame(rows, f"i int, {request.param} string, _count string"), request.param


def test_values_are_counted_under_another_name(named):
    df, name = named
    assert impute.fit_value_fill(df, name, "mode").value == "a"
    assert column(encode.fit_encoder(df, name, "frequency").transform(df), f"{name}_freq")[0] == pytest.approx(2 / 3)
    assert column(encode.fit_encoder(df, name, "label").transform(df), f"{name}_encoded") == [0, 0, None, 1]
    assert column(cluster.cluster_values(df, name), name) == ["a", "a", None, "b"]
    assert set(column(impute.fit_random_fill(df, name, ["i"]).transform(df), name)) <= {"a", "b"}
    assert column(catnorm.normalize_text(df, name), name) == ["a", "a", None, "b"]


def test_ranks_of_such_a_column(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 5.0), (3, 5.0), (4, 9.0)], "i int, n double")
    rows = association.spearman_pairs(df, ["i", "n"]).collect()
    assert len(rows) == 1


@pytest.mark.parametrize("name", ["_n", "_row", "_tie", "n"])
def test_duplicates_of_such_a_column(spark, name):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0)], f"i int, {name} string, w double")
    assert [tuple(r) for r in dedupe.drop_duplicate_rows(df, [name], "none").collect()] == [(3, "b", 3.0)]
    assert sorted(r["i"] for r in dedupe.drop_duplicate_rows(df, [name], "last", ["i"]).collect()) == [2, 3]
    assert dedupe.drop_duplicate_rows(df.select(name), keep="none").count() == 1
    assert dedupe.duplicate_count(df, [name]).first()[0] == 1
