"""A quality classifier without labels: heuristic labellers, their accuracies by expectation-maximisation, a linear scorer.

1. Overlapping heuristics each call a text good, bad or abstain. The votes of all documents are counted by pattern.
2. Expectation-maximisation over the patterns (one latent class, votes independent given the class) estimates the share of
   good texts and each labeller's chances of its three votes in either class. There are at most three to the power
   of the labellers patterns, so the counts of a corpus of any size fit the driver.
3. The posteriors are soft labels for a logistic scorer over hashed features (words, word shapes and repetitions) of whole
   texts. It is fitted on at most ``SAMPLE_ROWS`` documents, drawn by hash over the corpus.
4. The scorer runs over every whole text inside tasks; its weights are a fixed ``2 ** BITS`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.columns import col, free_name

SAMPLE_ROWS = 4000
BITS = 16
PIECE = 1 << 20  # bytes looked at together; longer texts are cut at a blank, and only their distinct hashes are held

# classes of bytes: 1 lower-case letter, 2 upper-case letter, 3 digit, 4 blank, 5 punctuation, 6 beyond ASCII, 0 other
CLASS = np.zeros(256, np.uint8)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 10, 11, 12, 13, 32)), 1):
    CLASS[list(_bytes)] = _k
CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 5
CLASS[128:] = 6
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_DRAW = np.random.default_rng(5)
BYTE_CODES = _DRAW.integers(0, 2 ** 63, 256, np.uint64)
PLACE_CODES = _DRAW.integers(0, 2 ** 63, 64, np.uint64) | np.uint64(1)
SHAPES = 7 ** 3 * 4


def pieces(texts: Iterable[str | None]) -> Iterator[list[tuple[int, bytes]]]:
    """(number of the text, bytes) in lists of about ``PIECE`` bytes."""
    held, size = [], 0
    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        at = 0
        while at < len(data) or not at:
            end = min(len(data), at + PIECE)
            if end < len(data):
                end = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end)) + 1 or end
            held.append((k, data[at:end]))
            size += end - at
            at = max(end, 1)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def words(part: list[tuple[int, bytes]]) -> dict[str, np.ndarray]:
    """One entry for each word of the pieces: the text it is from, hash, shape, whether it repeats the one before, ...;
    and counts of byte classes by piece."""
    sizes = np.array([len(d) + 1 for _, d in part])
    data = np.frombuffer(b"\n".join(d for _, d in part) + b"\n", np.uint8)
    kind = CLASS[data]
    solid = kind != 4
    edges = np.diff(solid, prepend=False)
    bounds = np.flatnonzero(edges)
    starts, ends = bounds[::2], bounds[1::2]
    piece = np.searchsorted(np.cumsum(sizes), starts, "right")
    lengths = ends - starts
    classes = np.bincount(np.repeat(np.arange(len(part)), sizes) * 7 + kind, minlength=7 * len(part)).reshape(-1, 7)
    inside = np.flatnonzero(solid)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    codes = BYTE_CODES[LOWER[data[inside]]] * PLACE_CODES[place & 63]
    hashes = np.add.reduceat(codes, first) if len(first) else np.empty(0, np.uint64)
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    last = ends - 1
    before = np.maximum(last - 1, starts)
    twin = (lengths > 1) & (data[last] == data[before]) & (kind[last] == 5)
    shape = ((kind[starts].astype(np.int64) * 7 + kind[last]) * 7 + kind[before]) * 4 + twin * 2 \
        + ((lengths > 2) & (kind[np.minimum(starts + 1, last)] == 2))
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (piece[1:] == piece[:-1])
    return {"text": np.array([k for k, _ in part])[piece] if len(piece) else piece, "hash": hashes, "shape": shape,
            "again": again, "twin": twin, "bare": (lengths == 1) & (kind[starts] == 5), "length": lengths,
            "stop": np.isin(data[last], list(b".?!")) & ~twin, "owner": np.array([k for k, _ in part]), "classes": classes}


def measures(parts: Iterable[dict[str, np.ndarray]], n: int) -> dict[str, np.ndarray]:
    """What the labellers look at, for each of ``n`` whole texts; shares are 0 where there is nothing to share."""
    sums = {c: np.zeros(n) for c in ("words", "again", "twin", "bare", "stop", "short", "distinct", "size")}
    classes = np.zeros((n, 7))
    last, seen = -1, []  # the text that the next part may go on with, and its distinct hashes so far
    for w in parts:
        np.add.at(classes, w["owner"], w["classes"])
        text = w["text"]
        each = np.unique(w["hash"] ^ (text.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)), return_index=True)[1]
        for name, rows, weight in (("words", text, None), ("again", text, w["again"]), ("twin", text, w["twin"]),
                                   ("bare", text, w["bare"]), ("stop", text, w["stop"]), ("size", text, w["length"]),
                                   ("short", text, w["length"] <= 3)):
            sums[name] += np.bincount(rows, weight, n)
        owners, hashes = text[each], w["hash"][each]
        if w["owner"][0] == last:
            seen.append(hashes[owners == last])
        inside = (owners != last) & (owners != w["owner"][-1])
        sums["distinct"] += np.bincount(owners[inside], None, n)
        if w["owner"][-1] != last:
            if seen:
                sums["distinct"][last] = len(np.unique(np.concatenate(seen)))
            last, seen = w["owner"][-1], [hashes[owners == w["owner"][-1]]]
    if seen:
        sums["distinct"][last] = len(np.unique(np.concatenate(seen)))
    many = np.maximum(1, sums["words"])
    letters = classes[:, 1] + classes[:, 2] + classes[:, 6]
    return {
        "words": sums["words"], "letters": letters / np.maximum(1, sums["size"]),
        "upper": classes[:, 2] / np.maximum(1, classes[:, 1] + classes[:, 2]), "marks": sums["twin"] / many,
        "bare": sums["bare"] / many, "repeats": sums["again"] / many, "variety": sums["distinct"] / many,
        "stops": sums["stop"] / many, "length": sums["size"] / many, "short": (sums["short"] - sums["bare"]) / many,
    }


#: name: (measure, good from-to, bad from-to, words needed to vote at all)
LABELLERS = {
    "trailing marks": ("marks", (0, 0.02), (0.08, 1), 3),
    "shouting": ("upper", (0, 0.15), (0.3, 1), 5),
    "stuttering": ("repeats", (0, 0.05), (0.15, 1), 10),
    "variety": ("variety", (0.4, 1), (0, 0.3), 30),
    "bare marks": ("bare", (0, 0.01), (0.05, 1), 10),
    "letters": ("letters", (0.9, 1), (0, 0.8), 5),
    "sentences": ("stops", (0.01, 0.5), (0, 0.003), 60),
    "short words": ("short", (0.12, 0.7), (0, 0.06), 30),
    "word length": ("length", (3, 9), (12, 1e9), 10),
}


def votes(measured: dict[str, np.ndarray]) -> list[str]:
    """For each text one sign for each labeller: + good, - bad, 0 no vote."""
    signs = []
    for name, good, bad, least in LABELLERS.values():
        m = measured[name]
        vote = np.where((m >= good[0]) & (m <= good[1]), "+", np.where((m >= bad[0]) & (m <= bad[1]), "-", "0"))
        signs.append(np.where(measured["words"] < least, "0", vote))
    return list(map("".join, zip(*signs)))


@dataclass(frozen=True)
class LabelModel:
    """Estimated share of good texts, and for each labeller the chances of (-, +) in bad and in good texts where it votes."""
    good: float
    chances: np.ndarray  # labeller x class x vote

    def posterior(self, pattern: str) -> float:
        """The probability that a text with these votes is good. A labeller that abstains says nothing."""
        seen = [(k, "-+".index(v)) for k, v in enumerate(pattern) if v != "0"]
        bad, good = (np.log(p) + sum(np.log(self.chances[k, c, v]) for k, v in seen)
                     for c, p in enumerate((1 - self.good, self.good)))
        return float(1 / (1 + np.exp(np.clip(bad - good, -500, 500))))

    def accuracies(self) -> np.ndarray:
        """Each labeller's probability of being right where it votes."""
        return (1 - self.good) * self.chances[:, 0, 0] + self.good * self.chances[:, 1, 1]


def fit_labels(counts: dict[str, int], rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns. It begins with any bad vote as a sign of a bad text."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    good = np.array([0.05 if "-" in p else 0.95 for p in patterns])
    model = LabelModel(0.95, np.tile([[0.6, 0.4], [0.02, 0.98]], (len(LABELLERS), 1, 1)))
    cast = np.array([list(p) for p in patterns]).reshape(len(patterns), len(LABELLERS))
    for _ in range(rounds if patterns else 0):
        share = float(np.clip((n * good).sum() / n.sum(), 1e-3, 1 - 1e-3))
        chances = np.array([[[w[cast[:, k] == v].sum() + 0.5 for v in "-+"] for w in (n * (1 - good), n * good)]
                            for k in range(len(LABELLERS))])
        model = LabelModel(share, chances / chances.sum(axis=2, keepdims=True))
        before, good = good, np.array([model.posterior(p) for p in patterns])
        if np.abs(good - before).max() < 1e-6:
            break
    return model


def features(w: dict[str, np.ndarray], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Two feature numbers for each word: its hash, and its shape with whether it repeats the word before."""
    top = np.uint64((1 << bits) - 1)
    return (w["hash"] & top).astype(np.int64), (1 << bits) + w["shape"] * 2 + w["again"]


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float
    labels: LabelModel

    def scores(self, parts: Iterable[dict[str, np.ndarray]], n: int) -> np.ndarray:
        """Probability that each of ``n`` texts is good. A text without words gets the bias alone."""
        sums, many = np.zeros(n), np.zeros(n)
        for w in parts:
            for at in features(w):
                sums += np.bincount(w["text"], self.weights[at], n)
            many += np.bincount(w["text"], None, n)
        return 1 / (1 + np.exp(-(self.bias + sums / np.maximum(1, 2 * many))))


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, bits: int = BITS, rounds: int = 300,
               rate: float = 2.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets, full gradients with per-weight step sizes. rows: (feature numbers, shares)."""
    width = (1 << bits) + 2 * SHAPES
    weights, bias = np.zeros(width), 0.0
    if not rows:
        return weights, bias
    sizes = np.array([len(r[0]) for r in rows])
    which, at, value = np.repeat(np.arange(len(rows)), sizes), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    squares, bias_squares = np.full(width, 1e-8), 1e-8
    for _ in range(rounds):
        margin = bias + np.bincount(which, weights[at] * value, len(rows))
        off = (1 / (1 + np.exp(-margin)) - target) / len(rows)
        step = np.bincount(at, off[which] * value, width) + decay * weights
        squares += step ** 2
        weights -= rate * step / np.sqrt(squares) * 0.1
        bias_squares += off.sum() ** 2
        bias -= rate * off.sum() / np.sqrt(bias_squares) * 0.1
    return weights, bias


def drawn_by(key: Column, share: float) -> Column:
    """Whether a row with this 64-bit hash is among the ``share`` drawn: the whole hash is compared, so no share comes to nothing."""
    if share >= 1:
        return F.lit(True)
    return key < F.lit(int(share * 2 ** 64) - 2 ** 63)


def fit_scorer(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Votes of all documents, label model, and a scorer fitted on at most ``sample_rows`` of them."""
    def cast(texts: pd.Series) -> pd.Series:
        return pd.Series(votes(measures(map(words, pieces(texts)), len(texts))), dtype=object)

    cast = F.pandas_udf(cast, "string")
    text = col(text_col).cast("string")
    counted = {r["votes"]: r["count"] for r in docs.select(cast(text).alias("votes")).groupBy("votes").count().collect()}
    labels = fit_labels(counted)
    total = sum(counted.values())
    share = min(1.0, 0.9 * sample_rows / max(1, total)) if total > sample_rows else 1.0

    def gather(batches):
        for batch in batches:
            rows = []
            for key, one in zip(batch["key"], batch["text"]):
                parts = list(map(words, pieces([one])))
                at, times = np.unique(np.concatenate([f for w in parts for f in features(w)]), return_counts=True)
                rows.append((key, votes(measures(parts, 1))[0], at.astype(np.int32).tobytes(),
                             (times / max(1, times.sum())).astype(np.float32).tobytes()))
            yield pd.DataFrame(rows, columns=["key", "votes", "at", "value"])

    key = F.xxhash64(col(id_col), text)
    drawn = docs.select(key.alias("key"), text.alias("text")).filter(drawn_by(F.col("key"), share))
    sample = drawn.mapInPandas(gather, "key long, votes string, at binary, value binary").limit(sample_rows).toPandas()
    sample = sample.sort_values(["key", "votes"])
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v in zip(sample["at"], sample["value"])]
    target = np.array([labels.posterior(v) for v in sample["votes"]])
    return Scorer(*fit_linear(rows, target), labels)


def scored(docs: DataFrame, scorer: Scorer, text_col: str = "text", name: str = "score", with_votes: bool = False) -> DataFrame:
    """``docs`` with the probability that each whole text is good, and on request its votes (``name``_votes).

    A null or empty text has no words: all labellers abstain and its score is the model's bias. Every row gets a
    score; repeated rows get the same. Names that ``docs`` has already are prefixed.
    """
    def run(texts: pd.Series) -> pd.DataFrame:
        n, parts = len(texts), map(words, pieces(texts))
        if not with_votes:
            return pd.DataFrame({"score": scorer.scores(parts, n), "votes": ""}, index=range(n))
        cast = votes(measures(map(words, pieces(texts)), n))
        return pd.DataFrame({"score": scorer.scores(parts, n), "votes": cast}, index=range(n))

    both = free_name(docs, "_scored")
    out = docs.withColumn(both, F.pandas_udf(run, "score double, votes string")(col(text_col).cast("string")))
    out = out.withColumn(free_name(docs, name), F.col(both)["score"])
    if with_votes:
        out = out.withColumn(free_name(docs, f"{name}_votes"), F.col(both)["votes"])
    return out.drop(both)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents whose score is a half or more, with their columns as they were."""
    name = free_name(docs, "_score")
    return scored(docs, fit_scorer(docs, id_col, text_col, sample_rows), text_col, name).filter(F.col(name) >= 0.5).drop(name)


def op5_weak_labels(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(docs, fit_scorer(docs), with_votes=True)
    return out.select("doc_id", F.round("score", 6).alias("score"), F.col("score_votes").alias("votes"),
                      (F.col("score") >= 0.5).alias("kept"))
