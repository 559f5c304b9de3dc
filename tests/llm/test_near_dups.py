import random
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import near_dups
from tidemill.llm.components import components
from tidemill.llm.near_dups import BATCH, MISS, drop_near_copies, near_groups, posterior_bounds
from tidemill.llm.shingles import LANES, MinHasher, WordHashes, shingle_set

from .conftest import pairs


def sets_of(text):
    words = (text or "").encode().lower().split()
    width = min(5, len(words))
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)} if words else set()


def expected(rows):
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, sets_of(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((str(i), len(s), str(None if i is None else find(i))) for i, s in sets)


def got(docs):
    return sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in near_groups(docs).collect())


def test_groups_are_those_of_brute_force(odd, documents):
    for docs in (odd, documents):
        assert got(docs) == expected(pairs(docs))


@pytest.mark.parametrize("part", [2000, 6])
def test_chains_families_and_loose_buckets(spark, monkeypatch, part):
    """Chains whose ends are far apart, a family of near copies, and texts that share much without being near copies."""
    monkeypatch.setattr(near_dups, "PART", part)  # buckets of several parts of members and of leaders
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    texts = []
    step = [word() for _ in range(200)]
    for _ in range(12):
        texts.append(list(step))
        at = draw.randrange(190)
        step[at:at + 4] = [word() for _ in range(4)]
    base = [word() for _ in range(120)]
    for _ in range(60):
        copy = list(base)
        copy[draw.randrange(120)] = word()
        texts.append(copy)
    shared = [word() for _ in range(60)]
    for _ in range(40):
        texts.append(shared + [word() for _ in range(draw.randrange(15, 45))])
    draw.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == expected(rows)


def test_bucket_that_one_task_holds_ends_in_the_second_turn(spark, monkeypatch):
    """Texts that share most, but not enough: nothing links them, so every pair of a bucket has to be looked at."""
    turns, by_leaders = [], near_dups._by_leaders
    monkeypatch.setattr(near_dups, "_by_leaders", lambda *args: turns.append(1) or by_leaders(*args))
    draw = random.Random(11)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    shared = [word() for _ in range(160)]
    rows = [(i, " ".join(shared + [word() for _ in range(30)])) for i in range(150)]
    rows.append((150, rows[40][1] + " " + word()))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)
    assert len(turns) == 2


def test_one_document_of_each_group_stays(odd):
    left = drop_near_copies(odd)
    assert left.schema == odd.schema
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 8, 9, 10, 12, 13, 14, 15]
    assert ids.count(None) == 2


def test_empty_table(none):
    assert near_groups(none).count() == 0 and drop_near_copies(none).count() == 0


def test_posterior_is_cautious():
    """Pairs at the threshold are hardly ever dropped, and far pairs are dropped after one batch."""
    bounds = posterior_bounds(0.75, 1e-6, 128, 16)
    rng = np.random.default_rng(1)
    matches = rng.binomial(1, 0.75, (20_000, 128)).cumsum(axis=1)
    dropped = np.zeros(20_000, bool)
    for k in range(8):
        dropped |= bounds[k, matches[:, 16 * (k + 1) - 1]] < 0.75
    assert dropped.mean() < 1e-3
    assert bounds[0, 0] < 0.6 and bounds[7, 128] == 1 or bounds[7, 128] > 0.99


def test_chance_to_be_pruned():
    """Worked out batch by batch, for pairs at the threshold and just above it."""
    for lanes, batch, at_threshold, above in ((128, 16, 1e-5, 5e-7), (LANES, BATCH, 2e-5, 1e-6)):
        bounds = posterior_bounds(0.75, MISS, lanes, batch)
        for similarity, most in ((0.75, at_threshold), (0.78, above)):
            step = [comb(batch, m) * similarity ** m * (1 - similarity) ** (batch - m) for m in range(batch + 1)]
            open_, pruned = np.ones(1), 0.0
            for row in bounds:
                open_ = np.convolve(open_, step)
                gone = row[:len(open_)] < 0.75
                pruned += open_[gone].sum()
                open_[gone] = 0
            assert pruned < most


def test_signatures_estimate_similarity():
    words = [f"w{k}" for k in range(2000)]
    hashes, hasher = WordHashes(), MinHasher()
    a, b = (shingle_set(" ".join(w), hashes) for w in (words[:1500], words[300:]))
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((hasher.signature(a) == hasher.signature(b)).mean() - exact) < 0.15


@pytest.mark.parametrize("size", [300, 5000])
def test_lanes_agree_like_independent_ones(size):
    """Mean and spread of the matches of pairs of similarity 0.75: the posterior takes them as binomial."""
    rng, hasher = np.random.default_rng(2), MinHasher()
    matches = []
    for _ in range(60):
        words = np.sort(rng.integers(0, 2 ** 64, 8 * size // 7, np.uint64, endpoint=False))
        part = rng.permutation(len(words)) < len(words) // 8
        other = rng.permutation(np.flatnonzero(~part))[:len(words) // 8]
        matches.append((hasher.signature(words[~part]) == hasher.signature(np.delete(words, other))).sum())
    assert abs(np.mean(matches) / LANES - 0.75) < 0.015
    assert 0.6 < np.std(matches) / (LANES * 0.75 * 0.25) ** 0.5 < 1.4


def test_components(spark):
    draw = random.Random(5)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(60)] + [(5, 5)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        x, y = sorted((find(u), find(v)))
        root[y] = x
    frame = spark.createDataFrame(links, "u long, v long")
    found = {r.id: r.root for r in components(frame).collect()}
    assert found == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in links)}
    assert components(frame.filter(F.lit(False))).count() == 0
