import heapq
import random
import re
from collections import defaultdict
from fractions import Fraction
import struct

import xxhash
from pyspark.sql import functions as F

from tidemill.llm import source_mix as module
from tidemill.llm.source_mix import apportion, mixed_texts, op11_source_mix, source_mix, source_targets, word_count

from .conftest import pairs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hashed(*values):
    """Spark's xxhash64 of 32-bit (given as tuples of one), 64-bit and text values; nulls leave the hash as it is."""
    h = 42
    for v in values:
        if v is not None:
            raw = struct.pack("<i", v[0]) if isinstance(v, tuple) else v.encode() if isinstance(v, str) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(raw, h)
    return h - 2 ** 64 if h >= 2 ** 63 else h


def seats_by_quotient(votes, caps, seats, tie):
    quota = dict.fromkeys(votes, 0)
    heap = [(-Fraction(v), tie(k), k) for k, v in votes.items() if caps[k] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, _, k = heapq.heappop(heap)
        quota[k] += 1
        if quota[k] < caps[k]:
            heapq.heappush(heap, (-Fraction(votes[k]) / (2 * quota[k] + 1), tie(k), k))
    return quota


def targets(sizes, weights=(5, 2, 1), repeats=3):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(repeats * sizes[s] for s in full)
        among = sum(weight[s] for s in order if s not in full)
        got = {s: Fraction(repeats * sizes[s]) if s in full else left * weight[s] / among for s in order}
        more = {s for s in order if got[s] >= repeats * sizes[s]} - full
        if not more:
            return order, got, full
        full |= more


def expected(rows, block, shard_blocks, seed=11, repeats=3):
    """(id, size, source_size, taken) by one walk over all words."""
    docs = [(i, s, len(WORD.findall(t or "")), hashed(t or "")) for i, s, t in rows]
    sizes = defaultdict(int)
    for _, s, n, _ in docs:
        sizes[s] += n
    order, goal, full = targets(sizes)
    blocks = {s: max(1, int(sizes[s] / block + 0.5)) if sizes[s] else 0 for s in order}
    votes = {k: float(blocks[s] * repeats if s in full else float(goal[s]) * blocks[s] / sizes[s]) for k, s in enumerate(order) if blocks[s]}
    caps = {k: blocks[order[k]] * repeats for k in votes}
    seats = seats_by_quotient(votes, caps, int(sum(Fraction(v) for v in votes.values()) + Fraction(1, 2)), lambda k: hashed((seed,), (0,), k))
    out = []
    for k, s in enumerate(order):
        own = sorted((d for d in docs if d[1] == s), key=lambda d: (hashed((seed,), d[0], d[3]), d[3], d[0] is not None, d[0] or 0, d[2]))
        n, b = sizes[s], blocks[s]
        times = []
        if b:
            length, odd = divmod(n, b)
            shards = {x: min(shard_blocks, b - x * shard_blocks) for x in range(-(-b // shard_blocks))}
            quota = seats_by_quotient(shards, {x: m * repeats for x, m in shards.items()}, seats[k], lambda x: hashed((seed,), k, x))
            for x, m in shards.items():
                key = {j: (hashed((seed,), k, x, j) & -shard_blocks) | j for j in range(m)}
                extra = set(sorted(range(m), key=key.get)[:quota[x] % m])
                for j in range(m):
                    width = length + (x * shard_blocks + j < odd)
                    times += [quota[x] // m + (j in extra)] * width
        at = 0
        for i, _, size, _ in own:
            out.append((i, size, n, float(goal[s]), sum(times[at:at + size])))
            at += size
    return sorted(out, key=str)


def got(docs, **more):
    return sorted(((r["id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in source_mix(docs, **more).collect()), key=str)


def close(a, b):
    return len(a) == len(b) and all(x[:3] + x[4:] == y[:3] + y[4:] and abs(x[3] - y[3]) <= 1e-9 * max(1, y[3]) for x, y in zip(a, b))


def test_against_a_walk_over_all_words(odd, documents, monkeypatch):
    monkeypatch.setattr(module, "SHARD", 8)
    small = documents.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").when(F.col("doc_id") % 7 > 0, F.col("source")))
    for docs in (documents, small, odd):
        rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.select("doc_id", "source", "text").collect()]
        assert close(got(docs), expected(rows, 32, 8))
    assert close(got(small, block=5, seed=3), expected([(r["doc_id"], r["source"], r["text"]) for r in
                                                        small.select("doc_id", "source", "text").collect()], 5, 8, 3))


def test_quotas_are_those_of_the_highest_quotients(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for g in range(60):
        keys = rng.choice([1, 2, 7, 40])
        votes = {k: float(rng.choice([rng.randint(1, 5), rng.randint(1, 1000), rng.randint(1, 10 ** 9)])) for k in range(keys)}
        seats = rng.choice([0, 1, keys, 10 * keys])
        caps = {k: rng.choice([0, 1, 3, 1000]) for k in votes}
        rows += [(g, k, v, sum(votes.values()), seats, caps[k]) for k, v in votes.items()]
        want |= {(g, k): n for k, n in seats_by_quotient(votes, caps, seats, lambda k: hashed((11,), g, k)).items()}
    table = spark.createDataFrame(rows, "g long, k long, votes double, total double, seats long, cap long")
    assert {(r["g"], r["k"]): r["quota"] for r in apportion(table).collect()} == want


def test_targets_stop_at_three_times_the_size(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 0, "é": 77, "Z": 300}, {"x": 0, None: 9}, {"x": 0}, {str(i): 2 ** i for i in range(14)}):
        table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, rows long")
        order, goal, _ = targets(sizes)
        rows = sorted(source_targets(table).collect(), key=lambda r: r["source_no"])
        assert [r["source"] for r in rows] == order
        assert all(abs(r["target"] - float(goal[r["source"]])) < 1e-6 for r in rows)


def test_words_near_targets_spans_and_texts(documents):
    mix = source_mix(documents)
    rows = mix.collect()
    taken = defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["taken"] == sum((s["to"] - s["from"]) * s["times"] for s in r["spans"]) <= 3 * r["size"]
        assert all(0 <= s["from"] < s["to"] <= r["size"] for s in r["spans"])
    assert all(abs(taken[r["source"]] - r["target"]) <= 64 for r in rows)
    texts = {i: WORD.findall(t or "") for i, t in pairs(documents)}
    made = mixed_texts(documents, mix).collect()
    assert all(r["text"].split() == texts[r["id"]][r["from"]:r["to"]] for r in made)
    assert sum(len(r["text"].split()) for r in made) == sum(r["taken"] for r in rows)


def test_reruns_agree_however_the_rows_lie(documents, tmp_path, spark):
    again = documents.repartition(7).orderBy(F.rand(1))
    assert got(documents) == got(again)
    assert op11_source_mix(spark, "/root/testdata/sf0.001").count() == documents.count()


def test_very_long_text_lies_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(module, "SHARD", 16)
    rows = [(1, "a", "w " * 50_000), (2, "a", "x"), (3, "b", "y " * 3), (4, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert close(got(docs), expected([(i, s, t) for i, s, t in rows], 32, 16))
    # only 3 words of b: it is given three times, the rest falls to a
    assert {r["id"]: r["taken"] for r in source_mix(docs).collect()}[3] == 9


def test_word_count(spark):
    texts = ["", " ", "a", " a", "a ", "a\t\nb\x0bc\r\x0cd", "ü x y", "a\x00b c", "\x1c"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in table.select(word_count(F.col("t"))).collect()] == [len(WORD.findall(t)) for t in texts]


def test_no_python_on_the_main_path(documents):
    plan = source_mix(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(none):
    assert source_mix(none).count() == 0
