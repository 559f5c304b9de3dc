import random
import re
from pathlib import Path

import pytest
from conftest import column
from pyspark.sql import functions as F

from tidemill.functions.columns import ColumnError
from tidemill.operators import catnorm, cluster

CITIES = ["  São   Paulo  ", "MÜNCHEN", "café", "tokyo", None, "New\tYork", "naïve", "Zürich", "Straße\n9", "ﬁne"]


def words(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, w string")


def test_normalize(spark):
    df = words(spark, CITIES)
    out = catnorm.normalize_text(df, "w")
    assert column(out, "w") == ["sao paulo", "munchen", "cafe", "tokyo", None, "new york", "naive", "zurich",
                                "strasse 9", "fine"]
    assert column(catnorm.normalize_text(out, "w"), "w") == column(out, "w")
    assert column(catnorm.normalize_text(df, "w", ("strip_whitespace",)), "w")[0] == "São Paulo"
    assert column(catnorm.normalize_text(df, "w", ("lowercase",)), "w")[1] == "münchen"
    report = catnorm.change_report(df, F.lower("w"), "w").first()
    assert (report["values_changed"], report["rows_affected"]) == (5, 9)
    with pytest.raises(ColumnError):
        catnorm.normalize_text(df, "i")


def test_harmonize(spark):
    df = words(spark, ["soft drink", "s.d.", "SODA", "black tea", "tea", "milk", None, "pop",
                       "sodas", "teatime", "from the tea to pop"])
    out = catnorm.harmonize_values(df, "w", {"soda": ["soft drink", "s.d.", "pop"],
                                            "tea": ["black tea", "green tea"]})
    assert column(out, "w") == ["soda", "soda", "soda", "tea", "tea", "milk", None, "soda", "sodas", "teatime",
                                "from the tea to soda"]
    strict = catnorm.harmonize_values(df, "w", {"soda": ["pop"]}, case_sensitive=True)
    assert column(strict, "w")[2] == "SODA"


SYNONYMS = {"soda": ["soft drink", "s.d.", "pop", "soft"], "Tea": ["black tea", "green tea", ".tea"], "ΟΔΌΣ": ["straße", "οδος"],
            "k": ["drink pop now"]}
PIECES = ["soft", "drink", "SOFT DRINK", "s.d.", "pop", "pops", "Tea", ".tea", "black", "Straße", "ΟΔΟΣ", "now", "_", " ", "  ", "-", ".", "é", "\n"]


@pytest.mark.parametrize("case_sensitive", [False, True])
def test_harmonize_automaton_equals_expression(spark, case_sensitive):
    """Texts put together from words, parts of words and marks; the map as one expression, one automaton and seven."""
    pick = random.Random(5)
    texts = ["".join(pick.choice(PIECES) for _ in range(pick.randint(0, 12))) for _ in range(400)] + [None, "", "pop"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "i int, w string, _hits array<int>")
    want = column(catnorm.harmonize_values(df, "w", SYNONYMS, case_sensitive), "w")
    for size in (1 << 20, 16):
        out = catnorm.harmonize_values(df, "w", SYNONYMS, case_sensitive, expression_words=0, automaton_bytes=size)
        assert out.columns == df.columns
        assert column(out, "w") == want


def test_harmonize_large_map(spark):
    names = {f"name{i % 1000}": [] for i in range(1000)}
    for i in range(200_000):
        names[f"name{i % 1000}"].append(f"word{i} of {i % 7}")
    df = words(spark, [" ".join(f"Word{i} of {i % 7}," for i in range(k, k + 3000)) for k in range(0, 60000, 3000)]
               + ["word199999 of 4", "word199999 of 45", "word5 word6 of 6"])
    out = column(catnorm.harmonize_values(df, "w", names), "w")
    assert out[:20] == [" ".join(f"name{i % 1000}," for i in range(k, k + 3000)) for k in range(0, 60000, 3000)]
    assert out[20:] == ["name999" if 199999 % 7 == 4 else "word199999 of 4", "word199999 of 45", "word5 name6"]
    assert catnorm.harmonize_values(df.limit(0), "w", names).count() == 0


def worker_memory(field):
    """MB of each Python worker that is alive, as its status file names them."""
    found = {}
    for folder in Path("/proc").glob("[0-9]*"):
        try:
            if b"pyspark.daemon" in (folder / "cmdline").read_bytes():
                found[folder] = int(re.search(rf"{field}:\s+(\d+)", (folder / "status").read_text())[1]) / 1024
        except (OSError, TypeError):  # it has ended meanwhile
            pass
    return found


@pytest.mark.parametrize("automaton_bytes", [1 << 20, 4000])
def test_harmonize_holds_the_hits_of_few_texts(spark, automaton_bytes):
    """10,000 texts of 300 words each in one partition; the map as one automaton and in parts."""
    names = {f"<{i}>": [f"word{i}"] for i in range(300)}
    df = spark.range(10_000, numPartitions=1).select("id", F.lit(" ".join(f"Word{i}" for i in range(300))).alias("w"))
    for folder in worker_memory("VmRSS"):
        (folder / "clear_refs").write_text("5")  # peaks start anew
    before = worker_memory("VmRSS")
    out = catnorm.harmonize_values(df, "w", names, automaton_bytes=automaton_bytes)
    assert out.filter(F.col("w") == " ".join(names)).count() == 10_000
    assert max(peak - before.get(folder, 0) for folder, peak in worker_memory("VmHWM").items()) < 450


@pytest.mark.parametrize("window", [1, 7, 1000])
def test_harmonize_long_text_window_by_window(monkeypatch, window):
    pick, fold = random.Random(6), catnorm._fold_case
    table = catnorm._synonym_table({**SYNONYMS, "long": ["now - soft drink pop now - now"]}, fold)
    monkeypatch.setattr(catnorm, "WINDOW", window)
    hits = catnorm._searcher(table, fold)
    words = "|".join(re.escape(w) for w in sorted(table, key=lambda w: (-len(w), w)))
    pattern = re.compile(f"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])")
    for _ in range(20):
        text = "".join(pick.choice([*PIECES, " ", " ", "now - soft drink pop now - now"]) for _ in range(300))
        low, want, done = fold(text), [], 0
        for hit in pattern.finditer(low):
            want += [text[done:hit.start()], table[hit[0]]]
            done = hit.end()
        assert catnorm._replaced(text, hits(text)) == "".join(want) + text[done:]
        packs = b"".join(catnorm._packed(catnorm._searcher(part, fold)(text)) for part in catnorm._table_parts(table, 30))
        assert catnorm._replaced(text, catnorm._unpacked(packs)) == "".join(want) + text[done:]


def test_packed_hits():
    many = [(k, k + 1, f"é{k}") for k in range(0, 90_000, 3)]
    for hits in ([], [(0, 3, "")], [(70_000, 70_400, "a"), (70_001, 200_000, "b"), (90_000, 90_001, "a")], many):
        assert list(catnorm._unpacked(catnorm._packed(hits))) == hits
    assert list(catnorm._unpacked(catnorm._packed([(5, 6, "a")]) + catnorm._packed([]) + catnorm._packed([(4, 9, "c"), (5, 7, "b")]))) == [
        (4, 9, "c"), (5, 7, "b"), (5, 6, "a")]


def lcs_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200 * row[-1] / (len(a) + len(b))


def greedy(counts, threshold):
    order, owner = sorted(counts, key=lambda v: (-counts[v], v)), {}
    for v in order:
        if v not in owner:
            owner[v] = v
            for o in order:
                if o not in owner and lcs_ratio(v, o) >= threshold:
                    owner[o] = v
    return owner


@pytest.mark.parametrize("threshold", [85, 70])
def test_clusters_equal_the_sequential_rule(spark, threshold):
    rng = random.Random(1)
    seeds = ["peppermint", "red clay", "topaz", "saffron", "red carpet", "indigo"]
    counts = {}
    for _ in range(150):
        word = list(rng.choice(seeds))
        for _ in range(rng.randrange(3)):
            word[rng.randrange(len(word))] = rng.choice("aeiou")
        counts["".join(word)] = counts.get("".join(word), 0) + 1
    df = words(spark, [w for w, n in counts.items() for _ in range(n)])
    got = {r["value"]: r["canonical"] for r in cluster.cluster_map(df, "w", threshold).collect()}
    assert got == greedy(counts, threshold)


def test_cluster_fixture(spark):
    df = words(spark, ["peppermint", "pepperimnt", "pepermint", "peppermint", "red clay", "red clya", None, "topaz"])
    out = column(cluster.cluster_values(df, "w", 80), "w")
    assert out == ["peppermint"] * 4 + ["red clay"] * 2 + [None, "topaz"]
    fixed = cluster.cluster_values(df, "w", 80, override={"topaz": "TZ", "pepermint": "PM"})
    assert column(fixed, "w") == ["peppermint", "peppermint", "PM", "peppermint", "red clay", "red clay", None, "TZ"]
    report = cluster.cluster_report(cluster.cluster_map(df, "w", 80)).orderBy("canonical").collect()
    assert [(r["canonical"], r["frequency"], r["size"]) for r in report] == [("peppermint", 4, 3), ("red clay", 2, 2)]
    many = spark.range(600).select(F.md5(F.col("id").cast("string")).alias("w"))
    assert cluster.cluster_map(many, "w", 90).filter("value = canonical").count() == 600
    with pytest.raises(ColumnError):
        cluster.cluster_values(many, "w", max_values=500)


def test_short_values_inside_longer_ones(spark):
    df = words(spark, ["Volt", "Volt Corp", "Volt", "Z", "Z grade", "Z grade", "other"])
    for threshold in (95, 85):
        got = {r["value"]: r["canonical"] for r in cluster.cluster_map(df, "w", threshold, "partial_ratio").collect()}
        assert got == {"Volt": "Volt", "Volt Corp": "Volt", "Z grade": "Z grade", "Z": "Z grade", "other": "other"}


def test_scorers(spark):
    df = spark.createDataFrame([("abcd", "xxabcdyy"), ("abc", "abd"), ("ab", "zzza")], "a string, b string")
    whole = [r[0] for r in df.select(cluster.similarity(F.col("a"), F.col("b"), False)).collect()]
    part = [r[0] for r in df.select(cluster.similarity(F.col("a"), F.col("b"), True)).collect()]
    assert whole == pytest.approx([lcs_ratio(*p) for p in [("abcd", "xxabcdyy"), ("abc", "abd"), ("ab", "zzza")]])
    assert part[0] == 100.0 and part[2] == pytest.approx(200 / 3)


def test_spelling_groups_and_topics(spark):
    df = words(spark, ["Lantern", "lantern", "Lanern", "Driftwood", "Driftwod", "Maple", None, "maple", "Driftwood"])
    out = column(cluster.dedupe_values(df, "w"), "w")
    assert out[6] is None and out[4] == "Driftwood" and len(set(out)) < 8
    topics = cluster.topic_encode(df, "w", 3)
    assert [c for c in topics.columns if c.startswith("w_gap")] == ["w_gap_0", "w_gap_1", "w_gap_2"]
    rows = topics.orderBy("i").collect()
    assert rows[6]["w_gap_0"] is None and all(v >= 0 for v in list(rows[0])[1:])


def test_runs_of_characters_are_told_apart(spark):
    """More distinct runs than 32,768 get a number each; beyond the vocabulary they are hashed and none is dropped."""
    runs = [f"{k:05d}" for k in range(40_000)]
    rows = [(k, runs[at:at + 100] + runs[at:at + 1]) for k, at in enumerate(range(0, len(runs), 100))] + [(400, [])]
    values = spark.createDataFrame(rows, "k int, _grams array<string>").repartition(4)
    exact = [r._counts for r in cluster.gram_counts(values).orderBy("k").collect()]
    assert {v.size for v in exact} == {40_000} and exact[400].numNonzeros() == 0
    assert sorted(int(i) for v in exact for i in v.indices) == list(range(40_000))
    assert all(sorted(v.values)[-2:] == [1, 2] for v in exact[:400])
    hashed = [r._counts for r in cluster.gram_counts(values, 39_999, 1 << 20).collect()]
    assert {v.size for v in hashed} == {1 << 20} and sum(sum(v.values) for v in hashed) == 40_400
    empty = cluster.gram_counts(values.filter("k = 400")).first()
    assert empty._counts.size == 1 and empty._counts.numNonzeros() == 0


def test_connected_groups_follow_chains(spark):
    nodes = spark.range(200).select(F.format_string("%03d", "id").alias("value"))
    edges = spark.range(198).filter("id <> 99").select(
        F.format_string("%03d", "id").alias("x"), F.format_string("%03d", F.col("id") + 1).alias("y"))
    groups = cluster.connected_groups(nodes, edges).groupBy("group").count().orderBy("group").collect()
    assert [tuple(r) for r in groups] == [("000", 100), ("100", 99), ("199", 1)]
