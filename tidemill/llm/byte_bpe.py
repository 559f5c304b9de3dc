"""Byte-level BPE with the merges done by recursive queries in DuckDB, inside each Spark task.

Texts are cut into words by the tokenizer's pattern. A word that is in the vocabulary is one token. Every other distinct
word of a stretch of text becomes rows (word, position, token, following token), one for each byte. The recursive query joins
them with the merge table, takes each word's pair of least rank (leftmost among equals), contracts it and moves
later positions up by one; a word without a pair left is marked as ended. Words are encoded once for each worker as long as its bounded
cache holds them. Decoding joins token rows with the vocabulary and puts the bytes together by ordered aggregation, a byte as the character of that number.

Everything is local to a partition: no shuffle, and memory is bounded by ``STRETCH`` characters, ``CACHED_WORDS``
and DuckDB's own limit, not by the partition.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import regex
from pyspark.sql import DataFrame, functions as F

from tidemill.functions.columns import col, free_name

STRETCH = 2_000_000
CACHED_WORDS = 500_000
ROWS_AT_ONCE = 2_000_000  # a call goes through the merge table once a turn, so calls are few
TURNS = 64
MEMORY = "400MB"

# The public pattern of this vocabulary family, and the same for text of ASCII characters alone
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

CONTRACT = """
WITH RECURSIVE step(turn, word, pos, token, following, ended) AS (
    SELECT 0, word, pos, token, following, false FROM bytes
    UNION ALL
    (WITH least AS (
        SELECT word, min((m.merged::BIGINT << 32) + pos) AS pair
        FROM step JOIN merges m ON m.couple = (token::BIGINT << 32) + following
        WHERE NOT ended AND turn < {turns} GROUP BY word),
    best AS (
        SELECT least.word, (pair & 4294967295)::INTEGER AS place, (pair >> 32)::INTEGER AS merged, step.following AS beyond
        FROM least JOIN step ON step.word = least.word AND step.pos = (pair & 4294967295) + 1)
    SELECT turn + 1, step.word, CASE WHEN pos > place THEN pos - 1 ELSE pos END, CASE WHEN pos = place THEN merged ELSE token END,
        CASE WHEN pos = place THEN beyond WHEN pos = place - 1 THEN merged ELSE following END, place IS NULL
    FROM step LEFT JOIN best ON best.word = step.word WHERE NOT ended AND turn < {turns} AND (place IS NULL OR pos <> place + 1)))
SELECT word, token, turn FROM step WHERE ended OR turn = {turns} ORDER BY word, pos"""

DECODE = """
SELECT doc, string_agg(letters, '' ORDER BY pos) AS letters FROM tokens JOIN vocabulary USING (token) GROUP BY doc ORDER BY doc"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class Tokenizer:
    """One for each worker process: the vocabulary, the merge table and the words it has encoded."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.split_ascii = re.compile(ASCII_PATTERN).findall if pattern == PATTERN else self.split
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.words: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        self.db.execute("SET preserve_insertion_order = false")
        vocabulary = pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "letters": [t.decode("latin-1") for t in self.ranks]})
        pairs = ((self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t))
                 if t[:k] in self.ranks and t[k:] in self.ranks)
        first, second, merged = (pa.array(c, pa.int32()) for c in zip(*pairs))
        merges = pa.table({"couple": pa.compute.add(pa.compute.multiply(first.cast(pa.int64()), 1 << 32), second.cast(pa.int64())), "merged": merged})
        for name, table in (("vocabulary", vocabulary), ("merges", merges)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _contract(self, word: np.ndarray, token: np.ndarray, turns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        pos = np.arange(len(word)) - np.repeat(starts, np.diff(starts, append=len(word)))
        following = np.append(token[1:], np.int32(-1))
        following[starts[1:] - 1] = -1
        self.db.register("bytes", pa.table({"word": word.astype(np.int32), "pos": pos.astype(np.int32), "token": token, "following": following}))
        got = self.db.execute(CONTRACT.format(turns=turns)).fetchnumpy()
        return np.asarray(got["word"]), np.asarray(got["token"], np.int32), np.asarray(got["turn"])

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as bytes of 32-bit integers. Words too long for ``TURNS`` contractions go round again."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), lengths)
        token = self.single[np.frombuffer(b"".join(words), np.uint8)]
        while len(word):
            word, token, turn = self._contract(word, token, TURNS)
            more = turn == TURNS
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            ids, ends = token.tobytes(), np.append(starts[1:], len(token)) * 4
            for k, at, end in zip(word[starts].tolist(), (starts * 4).tolist(), ends.tolist()):
                out[k] = ids[at:end]
            word, token = word[more], token[more]
        return out

    def learn(self, words: set[str]) -> None:
        """Put the words into the cache, in groups whose rows over all turns stay below ``ROWS_AT_ONCE``."""
        if len(self.words) + len(words) > CACHED_WORDS:
            self.words = {}
        group: list[str] = []
        rows = 0
        for word in words - self.words.keys():
            data = word.encode("utf-8", "replace")
            rank = self.ranks.get(data)
            if rank is not None:
                self.words[word] = np.int32(rank).tobytes()
                continue
            group.append(word)
            rows += len(data) * min(len(data), TURNS)
            if rows >= ROWS_AT_ONCE:
                self._learn_group(group)
                group, rows = [], 0
        if group:
            self._learn_group(group)

    def _learn_group(self, group: list[str]) -> None:
        self.words.update(zip(group, self._encode_words([w.encode("utf-8", "replace") for w in group])))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each text, all tokens in order)."""
        words = [(self.split_ascii if t.isascii() else self.split)(t) for t in texts]
        self.learn(set().union(*words))
        ids = [b"".join(map(self.words.__getitem__, own)) for own in words]
        return np.array([len(i) // 4 for i in ids], np.int64), np.frombuffer(b"".join(ids), np.int32)

    def decode(self, sizes: np.ndarray, tokens: np.ndarray) -> list[bytes]:
        """The bytes of each text, given the number of tokens of each and all tokens in order."""
        out = [b""] * len(sizes)
        if len(tokens):
            self.db.register("tokens", pa.table({
                "doc": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), "token": tokens.astype(np.int32),
                "pos": np.arange(len(tokens), dtype=np.int32)}))
            for doc, text in self.db.execute(DECODE).fetchall():
                out[doc] = text.encode("latin-1")
        return out


@lru_cache(maxsize=1)
def tokenizer(path: str, pattern: str = PATTERN) -> Tokenizer:
    return Tokenizer(path, pattern)


def _stretches(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``; a larger row stands alone."""
    at = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > most:
            yield at, k
            at, total = k, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def _appended(docs: DataFrame, source: str, run, name: str, kind: str) -> DataFrame:
    """``docs`` with a column that ``run`` makes from Arrow batches of the column ``source``; rows keep their order."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(source))
            for at, end in _stretches(_sizes(values), STRETCH):
                made = run(values.slice(at, end - at))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns, made], [*batch.schema.names, name])

    return docs.mapInArrow(over, f"{schema}, `{name}` {kind}")


def _sizes(values: pa.Array) -> list[int]:
    if pa.types.is_list(values.type):
        return [4 * (s or 0) for s in pa.compute.list_value_length(values).to_pylist()]
    return [s or 0 for s in pa.compute.binary_length(values).to_pylist()]


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids", pattern: str = PATTERN) -> DataFrame:
    """``docs`` with the token ids of each whole text, as the vocabulary at ``path`` encodes it, without special tokens.

    A null or empty text has no ids (an empty array). ``out`` is prefixed where ``docs`` has a column of that name.
    The file is read by each worker from its own disk, where the tokenizer's package is installed.
    """
    def run(texts: pa.Array) -> pa.Array:
        sizes, ids = tokenizer(path, pattern).encode([t or "" for t in texts.to_pylist()])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))

    return _appended(docs, text_col, run, free_name(docs, out), "array<int>")


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "bytes", pattern: str = PATTERN) -> DataFrame:
    """``docs`` with the bytes that each array of ids stands for. A null array gives no bytes."""
    def run(ids: pa.Array) -> pa.Array:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(ids), 0))
        return pa.array(tokenizer(path, pattern).decode(sizes, np.asarray(ids.flatten())), pa.binary())

    return _appended(docs, ids_col, run, free_name(docs, out), "binary")


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode(docs, path, pattern=public_tokenizers.PATTERN).drop("text")
    back = decode(ids, path, pattern=public_tokenizers.PATTERN)
    return back.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))
