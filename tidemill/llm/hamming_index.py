"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

Vectors are centred, rotated by rotations learned on a bounded sample (alternating between signs and the orthogonal map that
fits them best) and cut to their signs: ``BITS`` bits. A code is split into substrings of 16 bits and each substring is
indexed. By the pigeonhole principle two codes within Hamming radius r agree in some substring up to r // m bits (in
the last substrings even one bit less), so probing each substring's buckets up to that distance retrieves every code within the
radius; full codes are compared, and what is within the radius is reranked by the distance of the original vectors in
double precision. The radius is the one that holds ``SHARE`` of the neighbours of sample queries within the sample. The
sample is sparser than the whole, so its neighbours lie farther away and the radius errs on the wide side. A
query that finds fewer than k goes on with a wider radius, up to all bits, so every query gets its k.

Queries are probed in blocks of ``QUERY_BLOCK`` (a broadcast of bounded size) against all rows, and each task sends on its k
best for each query; a very common vector therefore costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemill.functions.columns import col, free_name
from tidemill.functions.durable import release, stage

BITS, SUBSTRING = 128, 16
SAMPLE_ROWS, SAMPLE_QUERIES = 10_000, 300
SHARE = 0.98
WIDER = 8
QUERY_BLOCK = 512
NEAR = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Codes:
    """A learned map from vectors to codes, and the radius learned with it."""
    centre: np.ndarray
    rotations: np.ndarray  # dimensions x bits
    radius: int

    def substrings(self, vectors: np.ndarray) -> np.ndarray:
        """rows x substrings of 16 bits."""
        bits = (vectors - self.centre) @ self.rotations > 0
        return np.packbits(bits, axis=1).view(np.uint16)


def learn_rotation(vectors: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """An orthogonal map under which the vectors lie close to the corners of a cube."""
    turn = np.linalg.qr(rng.normal(size=(vectors.shape[1],) * 2))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.sign(vectors @ turn).T @ vectors)
        turn = (left @ right).T
    return turn


def nearest(queries: np.ndarray, vectors: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances of the pairs (queries[at], vectors[rows]) in double precision, in stretches of bounded size."""
    out = np.empty(len(at))
    for k in range(0, len(at), 100_000):
        part = slice(k, k + 100_000)
        out[part] = np.sqrt(((queries[at[part]] - vectors[rows[part]]) ** 2).sum(axis=1))
    return out


def fit_codes(sample: np.ndarray, k: int, bits: int = BITS, share: float = SHARE, seed: int = 7) -> Codes:
    """Rotations and radius from a sample (rows x dimensions)."""
    rng = np.random.default_rng(seed)
    centre = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
    dims = max(1, sample.shape[1])
    turns = [learn_rotation(sample - centre, rng) for _ in range(-(-bits // dims))] if len(sample) else [np.zeros((dims, bits))]
    codes = Codes(centre, np.hstack(turns)[:, :bits], bits)
    if len(sample) <= k + 1:
        return codes
    subs, asked, found = codes.substrings(sample), rng.permutation(len(sample))[:SAMPLE_QUERIES], []
    for q in asked:
        apart = ((sample - sample[q]) ** 2).sum(axis=1)
        apart[q] = np.inf
        near = np.argpartition(apart, k)[:k]
        found.append(np.bitwise_count(subs[near] ^ subs[q]).sum(axis=1))
    return Codes(centre, codes.rotations, int(np.quantile(np.concatenate(found), share, method="higher")))


def probe_radii(radius: int, parts: int) -> list[int]:
    """How far each substring must be probed so that no code within ``radius`` is missed; -1: not at all.

    If substring i were farther than its radius for every i, the sum would exceed ``radius``.
    """
    each, over = divmod(radius, parts)
    return [each if i <= over else each - 1 for i in range(parts)]


def probe(rows: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all pairs of codes within ``radius``: buckets of each substring are probed, then whole codes compared."""
    met = np.zeros((len(rows), len(queries)), bool)
    for i, reach in enumerate(probe_radii(radius, rows.shape[1])):
        if reach >= 0:
            keys, bucket = np.unique(rows[:, i], return_inverse=True)
            met |= (np.bitwise_count(keys[:, None] ^ queries[None, :, i]) <= reach)[bucket]
    row, query = np.nonzero(met)
    out_q, out_r = [], []
    for k in range(0, len(row), 1_000_000):
        r, q = row[k:k + 1_000_000], query[k:k + 1_000_000]
        near = np.bitwise_count(rows[r] ^ queries[q]).sum(axis=1) <= radius
        out_q.append(q[near])
        out_r.append(r[near])
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *out_q]), np.concatenate([empty, *out_r])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components finite, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~odd, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["query_id", "score", "vec_id"]).drop_duplicates(["query_id", "vec_id"])
    return found[found.groupby("query_id").cumcount() < k]


def _search(rows: DataFrame, codes: Codes, ids: np.ndarray, queries: np.ndarray, k: int, radius: int) -> DataFrame:
    """The k best within ``radius`` of each query that each task finds."""
    asked = rows.sparkSession.sparkContext.broadcast((ids, queries, codes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, wanted, how = asked.value
        targets, best = how.substrings(wanted), pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at:at + 4096]
                vectors = np.stack(part["vector"]).astype(np.float64)
                q, r = probe(how.substrings(vectors), targets, radius)
                found = pd.DataFrame({"query_id": own[q], "vec_id": part["id"].to_numpy()[r], "score": nearest(wanted, vectors, q, r)})
                best = _best(pd.concat([best, found[found["query_id"] != found["vec_id"]]]), k)
        yield best.astype({"query_id": "int64", "vec_id": "int64"})

    return rows.mapInPandas(run, NEAR)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           sample_rows: int = SAMPLE_ROWS, codes: Codes | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of ``vectors`` that ``is_query`` holds for.

    Every usable row but the query's own is a candidate. Ties go to the smaller id. Vectors that are null, zero,
    hold nulls or numbers that are not finite, or have not the most common length, and rows without an id take
    no part. Rows that repeat an id count once. With fewer candidates than k all are returned.
    """
    spark = vectors.sparkSession
    mark = free_name(vectors, "_query")
    valid = vectors.withColumn(mark, is_query).filter(usable(col(vector_col)) & col(id_col).isNotNull()) \
        .select(col(id_col).cast("bigint").alias("id"), col(vector_col).cast("array<double>").alias("vector"),
                F.coalesce(F.col(mark), F.lit(False)).alias("asked"))
    sizes = valid.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), F.count_if("asked").alias("q"))
    usual = sizes.orderBy(F.desc("n"), "size").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if usual is None:
        return empty
    rows = stage(valid.filter(F.size("vector") == usual["size"]).groupBy("id").agg(
        F.min("vector").alias("vector"), F.max("asked").alias("asked")), "vectors")
    total = rows.count()
    if codes is None:
        share = min(1.0, 0.9 * sample_rows / total) if total > sample_rows else 1.0
        drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(sample_rows)
        sample = drawn.select("id", "vector").toPandas().sort_values("id")["vector"]
        codes = fit_codes(np.stack(sample) if len(sample) else np.zeros((0, usual["size"])), k)
    out = []
    queries = rows.filter("asked")
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    for block in range(blocks if n_queries else 0):
        own = queries.filter(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)) == block).select("id", "vector").toPandas()
        radius, step = codes.radius, WIDER
        while len(own):
            found = stage(_search(rows, codes, own["id"].to_numpy(), np.stack(own["vector"]), k, radius), "near")
            order = Window.partitionBy("query_id").orderBy("score", "vec_id")
            best = stage(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "nearest")
            release(found)
            counts = {r["query_id"]: r["count"] for r in best.groupBy("query_id").count().collect()}  # a block's queries
            short = own["id"].map(lambda i: counts.get(i, 0) < min(k, total - 1))
            if radius >= BITS:
                short[:] = False
            done = [int(i) for i in own["id"][~short]]
            if done:
                out.append(best if not short.any() else best.filter(F.col("query_id").isin(done)))
            own, radius, step = own[short], min(BITS, radius + step), step * 2
    return reduce(DataFrame.unionByName, [d.select("query_id", "rank", "vec_id", "score") for d in out], empty)


def op7_hamming_index(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("vec_id") % 100 == 0)
