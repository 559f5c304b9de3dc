"""Every fitted object gives the same rows after another session has loaded it."""

import random

import numpy as np
import pytest

from tidemill.functions.columns import ColumnError
from tidemill.functions.durable import claim, fresh_path
from tidemill.operators import impute
from tidemill.operators.encode import METHODS, Encoder, fit_encoder
from tidemill.operators.fitted import FittedStore
from tidemill.operators.impute_iterative import fit_regression_fill
from tidemill.operators.impute_knn import fit_neighbour_fill
from tidemill.operators.outlier_models import fit_isolation_forest, fit_local_outlier_factor
from tidemill.operators.outliers import OutlierBounds, fit_outliers
from tidemill.operators.reduce import fit_reduction
from tidemill.operators.select import select_correlation, select_missing


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c d", "é", None]), rng.gauss(0, 1) if i % 5 else None, float(i % 7), i % 2) for i in range(120)]
    return spark.createDataFrame(rows, "i int, kind string, x double, y double, z int").cache()


def made(table):
    yield from ((f"encode-{m}", fit_encoder(table, "kind", m, unknown=u, target="z", order_by=["i"],
                                           ordinal_mapping={"a": 1.0, "é": 2.5}))
                for m in METHODS for u in ("ignore", "new_category"))
    yield from ((f"fill-{s}", impute.fit_value_fill(table, "x", s)) for s in ("mean", "median", "mode", "drop_rows"))
    yield "forward", impute.ordered_fill("x", "forward", ["i"])
    yield "draws", impute.fit_random_fill(table, "x", ["i"])
    yield "neighbours", fit_neighbour_fill(table, "x", ["i"], ["x", "y", "z"], 3)
    yield "rounds", fit_regression_fill(table, ["x", "y", "z"])
    yield from ((f"bounds-{m}", fit_outliers(table, "y", m)) for m in ("iqr", "zscore"))
    yield "forest", fit_isolation_forest(table, "y")
    yield "factor", fit_local_outlier_factor(table, "y")
    yield "projection", fit_reduction(table.drop("x"), "pca", 2, target="z")
    yield "missing", select_missing(table, 0.1)
    yield "correlation", select_correlation(table, 0.9)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_every_object_after_another_session(spark, table):
    path = fresh_path(spark, "fitted")
    saved = [(FittedStore(spark, path).save(base, one), one) for base, one in made(table)]
    later = FittedStore(spark.newSession(), path)
    assert sorted(r["name"] for r in later.list().collect()) == sorted(n for n, _ in saved)
    for name, one in saved:
        got = later.get(name, type(one))
        assert rows(got.transform(table)) == rows(one.transform(table)), name
        if isinstance(one, Encoder):
            assert rows(got.fit_transform(table)) == rows(one.fit_transform(table)), name


def test_a_store_opened_again_goes_on_counting(spark, table):
    path = fresh_path(spark, "fitted")
    fitted = fit_outliers(table, "y", "iqr")
    assert FittedStore(spark, path).list().count() == 0
    assert [FittedStore(spark, path).save(n, fitted) for n in ("iqr", "iqr", "iqr_v1", "iqr")] == \
        ["iqr_v1", "iqr_v2", "iqr_v1_v1", "iqr_v3"]
    assert FittedStore(spark, path).get("iqr_v2") == fitted
    for wrong in (lambda s: s.get("none_v1"), lambda s: s.get("iqr_v1", Encoder), lambda s: s.save("../out", fitted)):
        with pytest.raises(ColumnError):
            wrong(FittedStore(spark, path))
    with pytest.raises(TypeError):
        FittedStore(spark, path).save("f", lambda df: df)


def test_a_save_that_breaks_off_is_not_listed(spark, table):
    path = fresh_path(spark, "fitted")
    broken = fit_encoder(table, "kind", "label")
    broken.facts = {"cause": object()}
    with pytest.raises(TypeError):
        FittedStore(spark, path).save("label", broken)
    assert FittedStore(spark, path).list().count() == 0
    assert FittedStore(spark, path).save("label", fit_encoder(table, "kind", "label")) == "label_v1"


def test_values_come_back_with_their_types(spark):
    from datetime import date, datetime
    from decimal import Decimal

    store = FittedStore(spark, fresh_path(spark, "fitted"))
    for value in (Decimal("1.50"), date(2024, 2, 29), datetime(2024, 2, 29, 1, 2, 3, 4), True, 7, "x", None, float("inf"), (1, "a"), {3: [1.5]}):
        name = store.save("v", OutlierBounds("c", "m", 1.0, {"a": value}))
        assert store.get(name).stats == {"a": value} and type(store.get(name).stats["a"]) is type(value)
    weights = np.arange(6.0).reshape(2, 3)
    assert (store.get(store.save("w", OutlierBounds("c", "m", 1.0, {"a": weights}))).stats["a"] == weights).all()


def test_a_number_that_another_writer_has_is_left_to_it(spark, table):
    path = fresh_path(spark, "fitted")
    assert claim(spark, f"{path}/claims/iqr_v1") and not claim(spark, f"{path}/claims/iqr_v1")
    store = FittedStore(spark, path)
    assert store.save("iqr", fit_outliers(table, "y", "iqr")) == "iqr_v2"
    assert [r["name"] for r in store.list().collect()] == ["iqr_v2"]
