import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemill.llm import byte_bpe
from tidemill.llm.byte_bpe import PATTERN, Tokenizer, decode, encode, read_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_vocabularys():
    assert PATTERN == public_tokenizers.PATTERN and len(read_ranks(PATH)) == 50256


def test_ids_are_those_of_the_library(reference):
    own = Tokenizer(PATH)
    draw = random.Random(4)
    odd = ["", " ", "\n\n \t x", "it's WE'LL they'd 's", "a\x00b\x1c\x1d\x85\xa0c  d", "ÄÖÜ ß ñ 中文字 日本語 한국어 עברית", "🙂🙃 👩‍👩‍👧 é é",
           "½ ² Ⅷ ٣٤ 10²", "a_b__c ++==##", "x" * 700, "ab" * 900, "=" * 1000, " " * 300 + "x", " 　​ z", "<|endoftext|>"]
    letters = "abcdefgh ABC.,;'\n\t 0123 äöüéñß中文🙂'stll"
    odd += ["".join(draw.choices(letters, k=draw.randrange(1, 200))) for _ in range(300)]
    sizes, ids = own.encode(odd)
    at = 0
    for text, size in zip(odd, sizes):
        assert list(ids[at:at + size]) == reference.encode_ordinary(text), repr(text[:60])
        at += size
    assert own.decode(sizes, ids) == [t.encode() for t in odd]


@pytest.mark.parametrize("turns", [64, 2])
def test_many_words_are_one_call(reference, monkeypatch, turns):
    """Words that end in different turns, and words that go round again, in few passes over the merge table."""
    monkeypatch.setattr(byte_bpe, "TURNS", turns)
    own, sizes = Tokenizer(PATH), []
    contract = own._contract
    monkeypatch.setattr(own, "_contract", lambda word, *args: sizes.append(len(word)) or contract(word, *args))
    draw = random.Random(6)
    text = " ".join("".join(draw.choices("abcdeéß", k=draw.randrange(2, 15))) for _ in range(12_000))
    lengths, ids = own.encode([text])
    assert list(ids) == reference.encode_ordinary(text) and list(lengths) == [len(ids)]
    assert len(sizes) == 1 if turns == 64 else sizes == sorted(sizes, reverse=True)


def test_round_trip_of_documents(odd, documents, reference):
    for docs in (odd.filter("text IS NULL OR length(text) < 1000"), documents):
        ids = encode(docs, PATH)
        assert ids.columns == [*docs.columns, "ids"]
        for r in decode(ids, PATH).collect():
            assert r.ids == reference.encode_ordinary(r.text or "") and bytes(r.bytes) == (r.text or "").encode()


def test_clashing_names_and_empty_table(odd, none):
    clash = odd.limit(2).withColumn("ids", F.lit(1))
    assert encode(clash, PATH).columns == [*clash.columns, "_ids"]
    assert decode(encode(none, PATH), PATH).count() == 0
    assert decode(odd.limit(1).select(F.lit(None).cast("array<int>").alias("ids")), PATH).first()["bytes"] == b""
