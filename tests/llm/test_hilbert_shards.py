import itertools

import pytest
from pyspark.sql import functions as F

from tidemill.llm.hilbert_shards import curve_index, hilbert_shards, shard_bounds, write_shards


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    grid = spark.createDataFrame(cells, ", ".join(f"c{k} int" for k in range(dims)))
    rows = grid.withColumn("at", curve_index([F.col(f"c{k}") for k in range(dims)], bits)).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(len(cells)))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(x - y) for x, y in zip(a[:dims], b[:dims])) == 1


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_laws_and_slots(documents, law):
    got = hilbert_shards(documents, law=law).collect()
    assert len(got) == documents.count()
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) == set(range(24))
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert [r.curve for r in sorted(rows, key=lambda r: r.slot)] == sorted(r.curve for r in rows)
    if law == "rows":
        sizes = [len(v) for v in shards.values()]
        assert max(sizes) - min(sizes) <= 1
    else:
        sizes = [sum(r.size for r in v) for v in shards.values()]
        assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    texts = {r.doc_id: r.text for r in documents.collect()}
    import zlib
    assert all(r.size == len(texts[r.id].encode()) + 8 and r.crc32 == zlib.crc32(texts[r.id].encode()) for r in got)


def test_filters_skip_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bounds = shard_bounds(hilbert_shards(docs)).collect()
    for lang, most in (("de", 18), ("es", 8), ("fr", 8)):
        assert sum(b["min_lang"] <= lang <= b["max_lang"] for b in bounds) <= most
    assert sum(b["min_size"] < 200 for b in bounds) <= 14 and sum(b["max_size"] > 5000 for b in bounds) <= 14
    assert sum(b["min_doc_id"] <= 5 <= b["max_doc_id"] for b in bounds) <= 16


def test_odd_rows_and_files(odd, tmp_path):
    placed = hilbert_shards(odd, shards=4, dimensions=("source", "size", "n_lines", "doc_id"))
    assert placed.count() == odd.count()
    assert {r["count"] for r in placed.groupBy("shard").count().collect()} == {4, 5}
    write_shards(odd, placed, str(tmp_path / "shards"))
    back = odd.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert back.count() == odd.count() and set(odd.columns) < set(back.columns)
    clash = odd.withColumns({"shard": F.lit("own"), "_slot": F.lit(1)})
    assert write_shards(clash, placed, str(tmp_path / "clash")) == "_shard"
    again = odd.sparkSession.read.parquet(str(tmp_path / "clash"))
    assert {r.shard for r in again.collect()} == {"own"} and again.select("_shard").distinct().count() == 4
    nulls = odd.withColumn("source", F.lit(None).cast("string"))
    assert hilbert_shards(nulls, shards=4, dimensions=("source", "doc_id")).count() == odd.count()


def test_fewer_rows_than_shards_and_none(odd, none):
    few = hilbert_shards(odd.limit(3), dimensions=("size", "doc_id")).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (8, 0), (16, 0)]
    assert hilbert_shards(none, dimensions=("size", "doc_id")).count() == 0
    with pytest.raises(ValueError):
        hilbert_shards(odd, law="key")
