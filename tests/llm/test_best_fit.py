import random

from tidemill.llm.best_fit import best_fit, bins, document_items, pack


def naive(items, capacity):
    """The same rule, by looking at all bins."""
    held, placed = [], []
    for length, source, cluster in items:
        fits = [(capacity - sum(x[0] for x in b), k) for k, b in enumerate(held)
                if sum(x[0] for x in b) + length <= capacity and all(x[1] != source and x[2] != cluster for x in b)]
        at = min(fits)[1] if fits else len(held)
        if not fits:
            held.append([])
        placed.append((at, len(held[at])))
        held[at].append((length, source, cluster))
    return placed, [capacity - sum(x[0] for x in b) for b in held]


def test_tightest_compatible_bin():
    draw = random.Random(1)
    for capacity, sources, clusters in ((20, 3, 5), (50, 1, 9), (100, 8, 200), (100, 40, 2)):
        items = [(draw.randrange(1, capacity + 1), draw.randrange(sources), draw.randrange(clusters)) for _ in range(300)]
        for order in (items, sorted(items, reverse=True)):
            assert pack(order, capacity) == naive(order, capacity)
    assert pack([], 10) == ([], [])


def check(rows, sizes, capacity):
    held, covered = {}, {}
    for r in rows:
        covered.setdefault(r.row, []).append((r.start, r.length))
        held.setdefault((r.block, r.bin), []).append(r)
    for row, parts in covered.items():
        end = 0
        for start, length in sorted(parts):
            assert start == end and 0 < length <= capacity
            end += length
        assert end == sizes[row]
    for content in held.values():
        assert sum(r.length for r in content) == capacity - content[0].room
        assert sorted(r.slot for r in content) == list(range(len(content)))
    return held


def test_documents_are_packed_whole(documents):
    for block_rows in (20_000, 50):
        rows = best_fit(document_items(documents), 300, block_rows).collect()
        held = check(rows, {r.row: r.size for r in rows}, 300)
        info = {r.doc_id: r for r in documents.collect()}
        assert sorted({r.id for r in rows}) == sorted(info)
        assert all(r.size == len(info[r.id].text.split()) + 1 for r in rows)
        for content in held.values():
            assert len({info[r.id].source for r in content}) == len(content)
            assert len({info[r.id].text.lower() for r in content}) == len(content)


def test_odd_rows(odd, spark):
    items = document_items(odd)
    rows = best_fit(items, 100).collect()
    assert len({r.row for r in rows}) == odd.count()
    check(rows, {r.row: r.size for r in rows}, 100)
    assert sum(r.length for r in rows) == sum(r["size"] for r in items.collect())
    free = spark.createDataFrame([("a", 3, None, None), ("b", 3, None, None), ("c", 0, None, None), ("d", None, "s", "t")],
                                 "id string, size long, source string, cluster string")
    packed = best_fit(free, 10)
    assert sorted((r.id, r.bin) for r in packed.collect()) == [("a", 0), ("b", 0)]
    assert bins(packed).collect()[0]["used"] == 6


def test_empty_table(none):
    assert best_fit(document_items(none)).count() == 0
