from tidemill.llm.line_dedup import dedup_lines

from .conftest import lower, pairs


def expected(rows, min_points=10, min_docs=2):
    holders = {}
    last = float("inf")
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(" \t\n\x0b\f\r"))
            if len(key) >= min_points:
                holders.setdefault(key, set()).add(last if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keys = [lower(x.strip(" \t\n\x0b\f\r")) for x in lines]
        kept = [x for x, k in zip(lines, keys)
                if len(holders.get(k, ())) < min_docs or min(holders[k]) == (last if i is None else i)]
        out.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_lines_stay_in_the_first_document_only(odd, documents):
    for docs in (odd, documents):
        for min_docs in (2, 3):
            got = dedup_lines(docs, min_docs=min_docs)
            counts = got.columns[-2:]
            assert sorted((str(r.doc_id), r.text, r[counts[0]], r[counts[1]]) for r in got.collect()) == \
                expected(pairs(docs), min_docs=min_docs)


def test_columns_of_the_same_names_stay(odd):
    got = dedup_lines(odd)
    assert got.columns == [*odd.columns, "_n_lines", "n_dropped"]
    assert {r["n_lines"] for r in got.collect()} == {1.5}


def test_a_text_may_lose_all_lines(spark):
    docs = spark.createDataFrame([(1, "same line here"), (2, " SAME line here\t\nsame LINE here")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in dedup_lines(docs).collect()) == [(1, "same line here", 0), (2, "", 2)]


def test_empty_table(none):
    assert dedup_lines(none).count() == 0
