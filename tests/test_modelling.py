import numpy as np
import pytest
from conftest import column
from pyspark.sql import functions as F

from tidemill.functions.columns import ColumnError
from tidemill.operators import select, split
from tidemill.operators.outliers import fit_outliers
from tidemill.operators.reduce import fit_reduction


def table(spark, seed=0, n=100):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    rows = [(float(a[i]), float(b[i]), "abc"[i % 3], 0, float(a[i] * .99 + .001 * b[i]), int(a[i] + .3 * b[i] > 0),
             None if i > 5 else 1.0) for i in range(n)]
    return spark.createDataFrame(
        rows, "A double, B double, C string, Constant int, Correlated double, Target int, Mostly double")


def test_selectors(spark):
    df = table(spark)
    assert select.select_missing(df, 0.5, "Target").dropped == ["Mostly"]
    assert "Constant" in select.select_variance(df, 0.0, "Target").dropped
    assert select.select_correlation(df.drop("Mostly"), 0.95, "Target").dropped == ["Correlated"]
    best = select.select_k_best(df.drop("Mostly", "Constant"), 2, "Target")
    assert best.dropped == ["B"] and best.transform(df.drop("Mostly", "Constant")).columns[-1] == "Target"
    assert select.select_rfe(df.drop("Mostly", "Correlated"), 1, "Target").dropped == ["Constant", "B"]
    assert select.select_by_name(df, ["A"]).dropped == ["A"]
    names = spark.createDataFrame([(float(i), float(i)) for i in range(1, 6)], "Z_Feat double, A_Feat double")
    assert select.select_correlation(names, 0.99).dropped == ["Z_Feat"]


def test_selector_errors(spark):
    df = table(spark)
    for call in (lambda: select.select_missing(df, 1.5), lambda: select.select_correlation(df, 0.0),
                 lambda: select.select_k_best(df, 1, "Target"), lambda: select.select_k_best(df, 99, "Target"),
                 lambda: select.select_by_name(df, ["absent"]), lambda: select.select_by_name(df, []),
                 lambda: select.select_by_name(df.select("A"), ["A"]).transform(df.select("A"))):
        with pytest.raises(ColumnError):
            call()


def matrix(df, *drop):
    return np.array([list(r) for r in df.drop(*drop).collect()], dtype=float)


def test_pca_and_svd(spark):
    df = table(spark).select("A", "B", "Correlated", "Target")
    fitted = fit_reduction(df, "pca", 2, "Target")
    out = fitted.transform(df)
    assert out.columns == ["pca_1", "pca_2", "Target"]
    x = matrix(df, "Target")
    z = (x - x.mean(0)) / x.std(0)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(matrix(out, "Target")), np.abs(z @ v[:2].T), atol=1e-9)
    assert fitted.explained == pytest.approx((s[:2] ** 2 / (s ** 2).sum()).tolist())
    svd = fit_reduction(df, "truncated_svd", 2, "Target").transform(df)
    assert np.allclose(matrix(svd, "Target"), matrix(out, "Target"))


def test_lda_separates_classes(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.normal(3 * (i % 3), 1)), float(rng.normal(0, 5)), "xyz"[i % 3]) for i in range(150)]
    df = spark.createDataFrame(rows, "a double, b double, label string")
    fitted = fit_reduction(df, "lda", 1, "label")
    means = {r["label"]: r["m"] for r in fitted.transform(df).groupBy("label").agg(F.avg("lda_1").alias("m")).collect()}
    assert means["x"] < means["y"] < means["z"] or means["x"] > means["y"] > means["z"]
    inner = np.mean([r["v"] for r in fitted.transform(df).groupBy("label").agg(
        F.var_samp("lda_1").alias("v")).collect()])
    assert inner == pytest.approx(1.0, rel=0.02)  # scaled to unit variance within classes
    for k, target in ((3, "label"), (1, None)):
        with pytest.raises(ColumnError):
            fit_reduction(df, "lda", k, target)


def test_reduction_needs_complete_numbers(spark):
    with pytest.raises(ColumnError):
        fit_reduction(table(spark), "pca", 1)
    with pytest.raises(ColumnError):
        fit_reduction(table(spark).select("C"), "pca", 1)


def test_random_split(spark):
    df = spark.range(100)
    s = split.train_test_split(df, 0.2, ["id"])
    train, test = set(column(s.train, "id", "id")), set(column(s.test, "id", "id"))
    assert (len(train), len(test)) == (80, 20) and not train & test
    assert test == set(column(split.train_test_split(df, 0.2, ["id"]).test, "id", "id"))
    assert test != set(column(split.train_test_split(df, 0.2, ["id"], seed=1).test, "id", "id"))


def test_split_with_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(split, "RANGE_ROWS", 5)
    df = spark.range(1003).withColumn("g", F.expr("CASE WHEN id < 700 THEN 'a' WHEN id < 1001 THEN 'b' ELSE 'c' END"))
    plain = split.train_test_split(df, 0.3, ["id"])
    assert (plain.train.count(), plain.test.count()) == (702, 301)
    s = split.train_test_split(df, 0.3, ["id"], stratify="g")
    sizes = {r["g"]: r["count"] for r in s.test.groupBy("g").count().collect()}
    assert sizes == {"a": 210, "b": 90, "c": 1}
    assert s.train.unionByName(s.test).distinct().count() == 1003


def test_stratified_split(spark):
    df = spark.range(100).withColumn("g", F.when(F.col("id") < 90, "A").otherwise("B"))
    s = split.train_test_split(df, 0.2, ["id"], stratify="g")
    assert s.test.filter("g = 'B'").count() == 2 and s.test.count() == 20
    lone = spark.range(11).withColumn("g", F.when(F.col("id") < 1, "A").otherwise("B"))
    for bad in (lone, df.withColumn("g", F.when(F.col("id") > 5, F.col("g")))):
        with pytest.raises(ColumnError):
            split.train_test_split(bad, 0.2, ["id"], stratify="g")


def test_ordered_split(spark):
    s = split.ordered_split(spark.range(10), 0.2, ["id"])
    assert column(s.train, "id", "id") == list(range(8)) and column(s.test, "id", "id") == [8, 9]
    for size, rows in ((0.0, 10), (1.0, 10), (0.5, 1)):
        with pytest.raises(ColumnError):
            split.ordered_split(spark.range(rows), size, ["id"])


def test_fit_on_train_apply_to_both(spark):
    s = split.ordered_split(spark.range(100).select(F.col("id"), F.col("id").cast("double").alias("x")), 0.2, ["id"])
    both = s.apply(fit_outliers(s.train, "x", "iqr", 0.4))
    # what drops rows does so in the training part only
    assert both.train.schema == both.test.schema and both.test.count() == s.test.count() == 20
    assert both.train.count() < s.train.count() == 80
    with pytest.raises(ColumnError):
        split.Split(s.train, s.test.drop("x"))
