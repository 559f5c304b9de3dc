from collections import Counter

import corpus_pipeline
from tidemill.functions.durable import stage

from .test_line_dedup import expected as without_repeats
from .test_near_dups import expected as near
from .test_secret_ledger import spans


def test_each_stage_does_its_work_on_what_the_one_before_kept(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    tables = []
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, folder), "stage")
        tables.append(docs)
    for made in tables[:-1]:
        assert made.columns == columns
    good, lines, near_dups, secrets = ({r.doc_id: r for r in t.collect()} for t in tables[:4])
    assert set(good) < set(before) and all(good[i] == before[i] for i in good)
    assert sorted((str(i), r.text) for i, r in lines.items()) == sorted(x[:2] for x in without_repeats([(i, r.text) for i, r in good.items()]))
    assert all(r.n_chars == len(r.text) for r in lines.values())
    groups = near([(i, r.text) for i, r in lines.items()])
    assert sorted(map(str, near_dups)) == sorted(i for i, _, root in groups if i == root)
    assert set(secrets) == set(near_dups)
    for i, r in secrets.items():
        assert spans(r.text) == "" and (r.text == near_dups[i].text) == (spans(near_dups[i].text) == "")
    packed = Counter()
    for r in tables[4].collect():
        packed[r.doc_id] += r.length
    assert packed == {i: len(r.text.split()) + 1 for i, r in secrets.items()}


def test_run_gives_the_last_stages_rows(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and got.columns[:2] == ["doc_id", "size"]
