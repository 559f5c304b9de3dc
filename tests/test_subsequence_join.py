import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import cluster
from tidemill.operators.subsequence_join import Plan, subsequence_pairs, unmatched

from test_text import lcs_ratio


def texts():
    rng = random.Random(9)
    made = {"", "a", "b", "ab", "ba", "aaaaaaaaaaaa", "aaaaaaaaaaab", "abababababab", "babababababa", "漢字漢字漢字", "漢字漢字字漢"}
    seeds = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 30))) for _ in range(25)]
    while len(made) < 300:
        text = list(rng.choice(seeds))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(text) + 1)
            text[at:at + rng.randrange(2)] = rng.choice(["", "a", "x", "b"])
        made.add("".join(text))
    return sorted(made)


@pytest.mark.parametrize("threshold", [100, 90, 85, 70, 40])
def test_no_pair_is_missing(spark, threshold):
    values = texts()
    table = spark.createDataFrame(list(enumerate(values)), "_rank long, text string")
    rows = [(r["better"], r["worse"]) for r in subsequence_pairs(table, threshold).collect()]
    assert len(rows) == len(set(rows)) and all(a < b for a, b in rows)
    wanted = {(i, j) for j, y in enumerate(values) for i, x in enumerate(values[:j]) if (x or y) and lcs_ratio(x, y) >= threshold}
    assert wanted <= set(rows)


def test_rare_runs_spare_most_pairs(spark):
    """Words of one language share short runs with nearly all others; few pairs are compared in full."""
    rng = random.Random(4)
    parts = ["ta", "re", "mi", "no", "sel", "ver", "ka", "lin", "os", "ten", "per", "un"]
    values = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(3, 6))) for _ in range(3000)})
    table = spark.createDataFrame(list(enumerate(values)), "_rank long, text string")
    assert subsequence_pairs(table, 85).count() < len(values) * (len(values) - 1) / 2 / 10


def test_unmatched_characters_and_plans():
    assert unmatched(10, 10, 85) == (1, 1) and unmatched(5, 5, 85) == (0, 0) and unmatched(5, 6, 85) == (0, 1)
    assert unmatched(5, 10, 85) is None
    plan = Plan(85)
    assert all(plan.shorter(n)[1] <= n - plan.shorter(n)[0] + 1 for n in range(1, 400))
    assert {lx for lx, *_ in plan.longer(20)} == {lx for lx in range(1, 21) if unmatched(lx, 20, 85)}


def test_words_in_another_order(spark):
    df = spark.createDataFrame([(w,) for w in ["red clay", "clay  red", "clay reb", " ", "", "topaz"]], "w string")
    got = {r["value"]: r["canonical"] for r in cluster.cluster_map(df, "w", 85, "token_sort_ratio").collect()}
    assert got["clay reb"] == got["clay  red"] == got["red clay"] and got["topaz"] == "topaz" and got[" "] == got[""]


def test_nothing_to_join(spark):
    empty = spark.createDataFrame([], "_rank long, text string")
    assert subsequence_pairs(empty, 85).count() == 0
    assert subsequence_pairs(empty.union(spark.createDataFrame([(0, "a")], empty.schema)), 85).filter(F.lit(True)).count() == 0
