import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import hard_negatives as module
from tidemill.llm.hard_negatives import _bounds, candidate_blocks, choose, hard_negatives, product, whole_vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def expected(rows, anchors):
    """(anchor, positive, rank, negative, scores) by all pairs; of rows that repeat an id the smallest counts."""
    best = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, len(v), [math.floor(256 * x) for x in v])
        best[i] = min(best.get(i, row), row)
    out = []
    for a, (label, size, v) in best.items():
        if not anchors(a):
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), i, other) for i, (other, n, w) in best.items() if i != a and n == size]
        same = sorted(((-s, i) for s, i, other in scores if other == label))[:5]
        apart = sorted(((-s, i) for s, i, other in scores if other != label))
        for p, i in same:
            met = [(-s, j) for s, j in apart if 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(a, i, rank, j, -p, s) for rank, (s, j) in enumerate(met, 1)]
    return sorted(out)


def got(table, every=3, **more):
    rows = hard_negatives(table, F.col("id") % every == 0, F.col("label"), **more)
    assert rows.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in rows.collect())


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BLOCK_ROWS", 7), ("UNIT_BLOCKS", 3), ("PAGE", 10), ("PART", 9), ("AT_ONCE", 4)):
        monkeypatch.setattr(module, name, value)


def test_odd_rows_against_all_pairs(spark, small):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], rng.randint(0, 2)) for i in range(250)]
    rows += [(1000 + i, [0.5, 0.5, 0.25, 0.0, 0.0, 0.1], i % 2) for i in range(60)]  # one very common vector, ties
    rows += [(2000 + i, [rng.gauss(0, 1) for _ in range(rng.choice([0, 1, 5]))], 1 if i % 3 else 0) for i in range(40)]  # lengths
    rows += [(3000, None, 1), (3003, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (3006, [math.nan] + [0.0] * 5, 1), (3009, [math.inf] + [0.0] * 5, 0),
             (3012, [0.0] * 6, 0), (3015, [1.0] * 6, None), (None, [1.0] * 6, 1), (3, [9.0] * 6, 0), (3, [1.0] * 6, 0)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("score", F.lit(1))
    assert got(table) == expected(rows, lambda i: i % 3 == 0)


def test_given_vectors_against_all_pairs(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table.collect()]
    assert got(table, 25) == expected(rows, lambda i: i % 25 == 0)


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(1e5, 3e5) for _ in range(3)], i % 2) for i in range(40)] + [(40, [1e30, 0.0, 0.0], 0)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert got(table) == expected(rows[:40], lambda i: i % 3 == 0)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    rows = rng.integers(-300, 300, (50, 8))
    a = rng.integers(-300, 300, (20, 8))
    least, most = _bounds(a, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = product(a, rows)
    assert (least[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= most[:, 0]).all()


def test_zone_maps_spare_blocks_of_clustered_vectors(spark, small):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 4)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=4) * 0.05).tolist(), i % 2) for i in range(600)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert got(table, 30) == expected(rows, lambda i: i % 30 == 0)
    whole = whole_vectors(table, "vec_id", "embedding", F.col("label"))
    blocks = candidate_blocks(whole)
    assert blocks.agg(F.sum("n")).first()[0] == 600
    asks = [(0, 4, 0, np.array(np.floor(256 * np.array(rows[0][1])), np.int32).tobytes(), False, [int(200 * 256 ** 2 / 10)], [1 << 40])]
    read = choose(spark.createDataFrame(asks, module.ASKS), blocks).agg(F.sum(F.bit_count("bits"))).first()[0] or 0
    assert read < blocks.count() / 2


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(3, [1.0], 1)], SCHEMA)) == []
