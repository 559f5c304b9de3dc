import hashlib
import random

import pyarrow as pa
import pytest

from tidemill.llm import fill_middle as module
from tidemill.llm.fill_middle import cut, fill_middle, restored
from pyspark.sql import functions as F

from .conftest import pairs


def expected(i, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def checked(docs):
    got = fill_middle(docs)
    names = got.columns[len(docs.columns):]
    back = restored(F.col(names[4]), F.col(names[1]))
    rows = got.select("doc_id", F.col("text").alias("t"), *names, back.alias("back")).collect()
    assert sorted((str(r[0]), r["t"], *map(str, r[2:7])) for r in rows) == \
        sorted((str(i), t or "", *map(str, expected(i, t))) for i, t in pairs(docs))
    assert all(r["back"] == r["t"] for r in rows)
    return rows


def test_cuts_forms_and_round_trip(odd, documents):
    checked(odd)
    forms = {r["form"] for r in checked(documents)}
    assert forms == {"plain", "psm", "spm"}


def test_sentinels_and_look_alikes_in_texts(spark):
    texts = ["<P>", "a<S>b", "x <M> y", "<P", "<<S", "P>S>M>", "<<<", "<p><s><m>", "a<P​>b"]
    docs = spark.createDataFrame([(i * 10 + k, t) for i in range(9) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r["form"] for r in checked(docs)} == {"plain", "psm", "spm"}


def test_other_columns_stay(odd):
    docs = odd.withColumn("n", F.lit("own")).withColumn("output", F.lit(1))
    got = fill_middle(docs)
    assert got.columns == [*docs.columns, "_n", "form", "prefix_chars", "middle_chars", "_output"]
    assert {(r["n"], r["output"], r["source"]) for r in got.collect()} == {("own", 1, "y")}


@pytest.mark.parametrize("stretch", [1, 3, 17, 1 << 18])
def test_stretches_do_not_show(monkeypatch, stretch):
    monkeypatch.setattr(module, "STRETCH", stretch)
    rng = random.Random(3)
    texts = ["".join(rng.choice("aé漢😀\n") for _ in range(rng.choice([0, 0, 1, 2, 9, 40]))) for _ in range(200)]
    cuts = [sorted((rng.randint(0, len(t)), rng.randint(0, len(t)))) for t in texts]
    # a slice, so that offsets do not start at nought
    got = cut(pa.array(["before", *texts])[1:], pa.array([a for a, _ in cuts]), pa.array([b for _, b in cuts]))
    assert [p.to_pylist() for p in got] == [[t[:a] for t, (a, _) in zip(texts, cuts)],
                                            [t[a:b] for t, (a, b) in zip(texts, cuts)], [t[b:] for t, (_, b) in zip(texts, cuts)]]


def test_long_text_without_blanks(spark):
    docs = spark.createDataFrame([(i, "漢" * 1_000_000) for i in range(4)], "doc_id long, text string")
    checked(docs)


def test_text_that_is_not_utf8_comes_back(spark):
    docs = spark.sql("SELECT id AS doc_id, CAST(unhex('80bfff41c3') AS STRING) AS text FROM range(6)")
    got = fill_middle(docs)
    back = got.select(F.hex(restored(F.col("output"), F.col("form"))).alias("b")).distinct().collect()
    assert [r["b"] for r in back] == ["80BFFF41C3"]


def test_empty_table(none):
    assert fill_middle(none).count() == 0
