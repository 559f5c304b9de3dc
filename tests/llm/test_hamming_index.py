import numpy as np
from pyspark.sql import functions as F

from tidemill.llm.hamming_index import BITS, Codes, fit_codes, probe, probe_radii, search


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    rows, queries = rng.integers(0, 1 << 16, (3000, 8), np.uint16), rng.integers(0, 1 << 16, (40, 8), np.uint16)
    rows[:500] = rows[0] ^ (np.uint16(1) << rng.integers(0, 16, (500, 8)).astype(np.uint16))
    queries[0] = rows[0]
    apart = np.bitwise_count(rows[:, None] ^ queries[None]).sum(axis=2)
    for radius in (0, 3, 7, 8, 9, 30, 50, 64, BITS):
        q, r = probe(rows, queries, radius)
        want = {(b, a) for a, b in np.argwhere(apart <= radius)}
        assert set(zip(q.tolist(), r.tolist())) == {(int(b), int(a)) for b, a in want}
        assert sum(x + 1 for x in probe_radii(radius, 8)) == radius + 1


def exact(vectors, asked, k):
    out = {}
    for i in asked:
        apart = sorted((float(np.sqrt(((vectors[j] - vectors[i]) ** 2).sum())), j) for j in vectors if j != i)
        out[i] = apart[:k]
    return out


def test_recall_and_scores(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in frame.collect()}
    want = exact(vectors, [i for i in vectors if i % 100 == 0], 10)
    got = {}
    for r in search(frame, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for i, near in want.items():
        found = sorted(got[i])
        assert [f[0] for f in found] == list(range(1, 11))
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        assert all(abs(f[2] - np.sqrt(((vectors[f[1]] - vectors[i]) ** 2).sum())) < 1e-12 for f in found)
        hits += len({j for _, j in near} & {f[1] for f in found})
    assert hits / (10 * len(want)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (2, [1.0, 0.0], "b"), (3, None, "c"), (4, [0.0, 0.0], "d"),
            (5, [nan, 1.0], "e"), (6, [inf, 1.0], "f"), (7, [None, 1.0], "g"), (8, [1.0, 2.0, 3.0], "h"), (9, [0.0, 2.0], "i"),
            (None, [1.0, 1.0], "j"), (100, [0.5, 0.5], "k"), (200, None, "l")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, _query string")
    got = [tuple(r)[:3] for r in search(frame, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (0, 4, 9), (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, 9)]
    assert search(frame.limit(0), F.lit(True)).count() == 0
    assert search(frame.filter("vec_id = 0"), F.lit(True)).count() == 0
    assert search(frame, F.lit(False)).count() == 0


def test_a_narrow_radius_widens_until_each_query_has_its_own(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fitted = fit_codes(np.array([r[1] for r in rows]), 10)
    narrow = Codes(fitted.centre, fitted.rotations, 0)
    got = search(frame, F.col("vec_id") % 100 == 0, codes=narrow).groupBy("query_id").count().collect()
    assert sorted((r["query_id"], r["count"]) for r in got) == [(0, 10), (100, 10), (200, 10)]
