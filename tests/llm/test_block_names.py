from collections import Counter
from hashlib import sha256

import pytest

from tidemill.llm import block_names
from tidemill.llm.block_names import drop_equal_texts, duplicate_groups

from .conftest import lower, pairs


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = Counter()
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        out[i, max(ids, default=None), len(groups[lower(t)]), sha256(lower(t).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block_bytes, warm", [(4096, 1000), (3, 1000), (7, 1)])
def test_groups_are_those_of_equal_texts(odd, documents, monkeypatch, block_bytes, warm):
    monkeypatch.setattr(block_names, "WARM_ROWS", warm)
    short = odd.filter("text IS NULL OR length(text) < 1000") if block_bytes < 100 else odd
    for docs in (short, documents) if block_bytes > 100 else (short,):
        got = duplicate_groups(docs, block_bytes=block_bytes).collect()
        assert Counter((r.id, r.keep_id, r.group_size, r.sha256) for r in got) == expected(pairs(docs))
        assert all(n == 1 for n in Counter(r.sha256 for r in got if r.kept).values())
        assert {r.sha256 for r in got if r.kept} == {r.sha256 for r in got}
        assert all(r.id == r.keep_id for r in got if r.kept)


def test_what_stays_has_all_its_columns(odd):
    left = drop_equal_texts(odd)
    assert left.schema == odd.schema
    assert sorted(lower(t) for _, t in pairs(left)) == sorted({lower(t) for _, t in pairs(odd)})


def test_empty_table(none):
    assert duplicate_groups(none).count() == 0 and drop_equal_texts(none).count() == 0
