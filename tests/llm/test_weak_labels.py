import numpy as np
from pyspark.sql import functions as F

from tidemill.llm.weak_labels import (LABELLERS, PIECE, SAMPLE_ROWS, drawn_by, fit_labels, fit_scorer, keep_good, measures, pieces,
                                      scored, votes, words)


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r.doc_id for r in keep_good(docs).select("doc_id").collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good, bad = ([i for i, q in truth.items() if q == k] for k in (1, 0))
    assert sum(i in kept for i in good) / len(good) > 0.99
    assert sum(i in kept for i in bad) / len(bad) < 0.25


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    right = np.linspace(0.7, 0.97, len(LABELLERS))
    good = rng.random(20_000) < 0.85
    cast = []
    for g in good:
        hit = rng.random(len(right)) < right
        cast.append("".join("0" if rng.random() < 0.1 else "+" if h == g else "-" for h in hit))
    counts = {}
    for v in cast:
        counts[v] = counts.get(v, 0) + 1
    model = fit_labels(counts)
    assert abs(model.good - 0.85) < 0.02 and np.abs(model.accuracies() - right).max() < 0.03
    assert model.posterior("0" * len(right)) == model.good or abs(model.posterior("0" * len(right)) - model.good) < 1e-9


def test_measures_do_not_depend_on_pieces():
    texts = [None, "", " \n", "One two TWO two!! | three.", "a" * 50, "x y " * (PIECE // 3)]
    alone = [measures(map(words, pieces([t])), 1) for t in texts]
    all_ = measures(map(words, pieces(texts)), len(texts))
    for k in range(len(texts)):
        for name in all_:
            assert abs(all_[name][k] - alone[k][name][0]) < 1e-9
    assert list(all_["words"][:5]) == [0, 0, 0, 6, 1] and all_["words"][5] == 2 * (PIECE // 3)
    assert abs(all_["repeats"][3] - 1 / 6) < 1e-9 or abs(all_["repeats"][3] - 2 / 6) < 1e-9
    assert votes(all_)[0] == "0" * len(LABELLERS)


def test_variety_is_that_of_the_whole_text():
    """Words that come back in every piece of a long text count once, also between other texts."""
    own = [f"word{k:06d}" for k in range(60_000)]
    long = " ".join(own * 5)
    assert len(long) > 3 * PIECE
    texts = ["some words before before", long, "some words after", "", long + " one more", "last last"]
    got = measures(map(words, pieces(texts)), len(texts))["variety"]
    assert np.allclose(got, [3 / 4, 60_000 / 300_000, 1, 0, 60_002 / 300_002, 1 / 2], atol=0, rtol=1e-12)
    assert votes(measures(map(words, pieces([long])), 1))[0][list(LABELLERS).index("variety")] == "-"


def test_no_share_is_too_small_to_be_drawn(spark):
    keys = spark.range(-2 ** 63, 2 ** 63 - 2 ** 55, 2 ** 48)  # even over all hashes
    key = F.col("id")
    for total in (10 ** 5, 10 ** 7):
        share = 0.9 * SAMPLE_ROWS / total
        assert abs(keys.filter(drawn_by(key, share)).count() - 2 ** 16 * share) <= 1
    ends = spark.createDataFrame([(-2 ** 63,), (-2 ** 63 + 10 ** 9,), (0,), (2 ** 63 - 1,)], "id long")
    assert ends.filter(drawn_by(key, 0.9 * SAMPLE_ROWS / 10 ** 11)).count() == 2
    assert ends.filter(drawn_by(key, 1.0)).count() == 4


def test_odd_rows(odd, none):
    scorer = fit_scorer(odd)
    got = scored(odd, scorer, with_votes=True)
    assert got.columns == [*odd.columns, "score", "score_votes"]
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    again = {}
    for r in rows:
        assert again.setdefault((r.text or ""), r.score) == r.score
    clash = odd.withColumnRenamed("id", "score")
    assert "_score" in scored(clash, scorer).columns
    assert keep_good(none).count() == 0 and keep_good(none).schema == none.schema
