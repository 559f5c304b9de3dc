import hashlib
import math

import pytest
from conftest import column
from pyspark.sql import functions as F

from tidemill.functions.columns import ColumnError
from tidemill.functions.durable import stage
from tidemill.functions.lookup import lookup_join
from tidemill.operators.split import Split
from tidemill.operators.encode import encode_report, encode_risk, fit_encoder, unmapped_categories

COLOR = ["red", "blue", "green", "blue", "red", "green", None, "red"]
SIZE = ["S", "M", "L", "XL", "S", "M", "L", None]


@pytest.fixture()
def df(spark):
    return spark.createDataFrame([(i, COLOR[i], SIZE[i], 10 * (i + 1), (i + 1) % 2) for i in range(8)],
                                 "i int, color string, size string, score int, target int")


def encoded(df, method, **kw):
    return fit_encoder(df, "color", method, **kw).transform(df)


def test_one_hot(df):
    out = encoded(df, "one_hot")
    assert [c for c in out.columns if c.startswith("color")] == ["color_blue", "color_green", "color_red"]
    assert column(out, "color_red") == [1, 0, 0, 0, 1, 0, None, 1]
    assert "color" in encoded(df, "one_hot", drop_original=False).columns


def test_one_hot_limit(spark):
    wide = spark.range(150).select(F.concat(F.lit("v"), "id").alias("color"))
    with pytest.raises(ColumnError):
        fit_encoder(wide, "color", "one_hot")


def test_label_ordinal_frequency(df):
    assert column(encoded(df, "label"), "color_encoded") == [2, 0, 1, 0, 2, 1, None, 2]
    out = fit_encoder(df, "size", "ordinal", ordinal_mapping={"S": 1, "M": 2, "L": 3}).transform(df)
    assert column(out, "size_ordinal") == [1, 2, 3, None, 1, 2, 3, None]
    assert unmapped_categories(df, "size", {"S": 1, "M": 2, "L": 3}).collect() == [("XL", 1)]
    shares = column(encoded(df, "frequency"), "color_freq")
    assert shares[0] == pytest.approx(3 / 7) and shares[6] is None


def test_target_and_leave_one_out(df):
    y = [1, 0, 1, 0, 1, 0, 1, 0]
    prior = 0.5
    n, mean = 3, (1 + 1 + 0) / 3
    w = 1 / (1 + math.exp(-(n - 20)))
    out = column(encoded(df, "target", target="target"), "color_target")
    assert out[0] == pytest.approx(prior * (1 - w) + mean * w) and out[6] is None
    loo = column(fit_encoder(df, "color", "leave_one_out", target="target").fit_transform(df), "color_loo")
    assert loo[0] == pytest.approx((2 - y[0]) / 2) and loo[7] == pytest.approx((2 - y[7]) / 2)
    fitted = fit_encoder(df, "color", "leave_one_out", target="target")
    assert column(fitted.transform(df.drop("target")), "color_loo")[0] == pytest.approx(2 / 3)
    unseen = df.sparkSession.createDataFrame([(0, "red", 100), (1, "pink", 7)], "i int, color string, target int")
    assert column(fitted.transform(unseen), "color_loo") == [pytest.approx(2 / 3), 0.5]
    test = df.limit(0).unionByName(unseen, allowMissingColumns=True)
    parts = Split(df, test).apply(fitted)
    assert column(parts.train, "color_loo")[0] == pytest.approx(0.5)
    assert column(parts.test, "color_loo") == [pytest.approx(2 / 3), 0.5]


def test_binary_and_hashing(df):
    out = encoded(df, "binary", order_by=["i"])  # red 1, blue 2, green 3
    assert column(out, "color_bin_0") == [0, 1, 1, 1, 0, 1, None, 0]
    assert column(out, "color_bin_1") == [1, 0, 1, 0, 1, 1, None, 1]
    for buckets in (8, 7, 50):
        out = encoded(df, "hashing", n_components=buckets)
        spot = int(hashlib.md5(b"red").hexdigest(), 16) % buckets
        assert column(out, f"color_hash_{spot}")[0] == 1
        row = out.orderBy("i").first()
        assert sum(row[f"color_hash_{i}"] for i in range(buckets)) == 1
        risk = fit_encoder(df, "color", "hashing", n_components=buckets).facts["collision_risk"]
        assert risk == pytest.approx(1 - (1 - 1 / buckets) ** 2)


def test_unknown_values(df, spark):
    new = spark.createDataFrame([(0, "pink"), (1, None)], "i int, color string")
    assert column(fit_encoder(df, "color", "label").transform(new), "color_encoded") == [None, None]
    strict = fit_encoder(df, "color", "label", unknown="error")
    with pytest.raises(Exception, match="unknown category"):
        strict.transform(new).collect()
    for method, kw in (("one_hot", {}), ("ordinal", {"ordinal_mapping": {"red": 1, "blue": 2, "green": 3}}), ("label", {}),
                       ("binary", {"order_by": ["i"]}), ("target", {"target": "target"}), ("frequency", {}),
                       ("leave_one_out", {"target": "target"})):
        strict, lax = (fit_encoder(df, "color", method, unknown=u, **kw) for u in ("error", "ignore"))
        assert strict.transform(df).dtypes == lax.transform(df).dtypes  # refusing changes no type
        assert strict.transform(df).count() == 8
        with pytest.raises(Exception, match="unknown category"):
            strict.transform(new).collect()
    gaps = df.withColumn("target", F.expr("CASE WHEN color <> 'red' THEN target END"))
    known = fit_encoder(gaps, "color", "target", target="target", unknown="error")
    assert known.transform(gaps).count() == 8  # red is known though its targets are all missing
    filled = fit_encoder(df, "color", "label", unknown="new_category")
    assert column(filled.transform(df), "color_encoded")[6] == 0  # "__unknown__" sorts first


def test_arguments(df):
    for kw in ({"method": "nothing"}, {"method": "ordinal"}, {"method": "target"}, {"method": "binary"},
               {"method": "target", "target": "absent"}):
        with pytest.raises(ColumnError):
            fit_encoder(df, "color", **kw)
    with pytest.raises(ColumnError):
        fit_encoder(df, "score", "label")


def test_risk(df):
    assert encode_risk("target", 1, 5, 1000) == {"memory_risk": "low", "leakage_risk": True, "overfit_risk": "low"}
    assert encode_risk("one_hot", 60, 60, 1000)["memory_risk"] == "high"
    row = encode_report(df, fit_encoder(df, "color", "one_hot")).first()
    assert (row["cardinality"], row["overfit_risk"], row["feature_space_delta"]) == (3, "high", 2)


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_lookup_join_with_a_hot_key(spark, limit):
    """The map is broadcast when small; otherwise hot and missing keys are kept out of the key shuffle."""
    rows = spark.range(6000).select("id", F.expr(
        "CASE WHEN id < 2000 THEN 'hot' WHEN id < 3000 THEN NULL ELSE concat('k', id) END AS k"))
    counts = stage(rows.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
                   .withColumn("v", F.col("_n") * 10))
    out = lookup_join(rows, counts, "k", "_n", broadcast_bytes=limit)
    assert out.columns == ["id", "k", "v"]
    got = {r["id"]: r["v"] for r in out.collect()}
    assert len(got) == 6000
    assert got[0] == 20000 and got[2500] is None and got[5999] == 10
    if limit == 0:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert out.groupBy("v").count().filter("v = 20000").first()["count"] == 2000
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
