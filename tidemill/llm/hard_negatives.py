"""Hard negatives from candidate blocks on a Hilbert curve, chosen by interval arithmetic on zone maps.

1. Vectors become whole numbers, floor(``SCALE`` x). Rows are sorted by label and by their place on a Hilbert curve through
   the ``CURVE_DIMS`` widest dimensions (fitted on at most ``SAMPLE_ROWS`` rows; it decides the layout alone, never a
   result) and written as Parquet, one row for each block of ``BLOCK_ROWS`` candidates with its zone map: smallest and
   largest value of each dimension and of the label. ``UNIT_BLOCKS`` blocks in a row are a unit.
2. For an anchor a, sum(max(a, 0) hi + min(a, 0) lo) bounds the scores of a block from above, and with lo and hi exchanged
   from below. A window (floor, ceiling) needs the blocks whose bounds meet it and whose labels can fit.
3. Positives: the blocks with the highest bounds give a first floor, the score of the last positive found there; all
   blocks that reach the floor are then read. Negatives: each positive's score gives a window; again the most promising
   blocks raise its floor and the blocks that meet what is left are read.

Bounds are worked out where zone maps (pages of ``PAGE``) meet anchors (parts of ``PART``), on columns that hold no
vectors; then anchors, with a bit for each block to read, meet the units. Both are joins by number with tasks of bounded
size: anchors are a stated set of queries, and no list of zones or anchors reaches the driver. Where bounds exclude
nothing, the work is that of all anchors against all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemill.functions.columns import col
from tidemill.functions.durable import release, stage
from tidemill.llm.hilbert_shards import curve_index
from tidemill.llm.weak_labels import drawn_by

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
LOW, HIGH = 30, 90  # a negative's score lies between these per cents of the positive's
CURVE_DIMS, CURVE_BITS, SAMPLE_ROWS = 4, 4, 10_000
BLOCK_ROWS, UNIT_BLOCKS = 256, 63
PAGE, PART = 16_384, 16_384
FIRST_READ = 2  # blocks that give a window its first floor
AT_ONCE = 64  # anchors whose scores with a whole unit are held at once
NONE, ALL = -(1 << 62), 1 << 62
ASKS = "anchor long, dims int, label long, vector binary, same boolean, floors array<bigint>, ceilings array<bigint>"


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, dims, vector): rows that take part, one for each id, components as whole numbers."""
    v = col(vector_col).cast("array<double>")
    cells = F.transform(v, lambda x: F.floor(x * SCALE))
    rows = vectors.select(col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), v.alias("v"), cells.alias("cells")) \
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(~F.exists(
            "v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)))
    # products of two rows must fit in 56 bits, so that windows do in 63
    most = F.floor(F.sqrt(F.lit(float(1 << 56)) / F.greatest(F.size("cells"), F.lit(1))))
    fits = ~F.exists("cells", lambda x: F.abs(x) > F.least(most, F.lit(2 ** 31 - 1)))
    rows = rows.filter(fits).select("id", "label", F.size("cells").alias("dims"), F.col("cells").cast("array<int>").alias("vector"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "dims", "vector")).alias("r")).select("id", "r.*")


def curve_place(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Column:
    """The place on a Hilbert curve through the widest dimensions of a bounded sample, each cut into bins of equal counts."""
    total = rows.count()
    share = 1.0 if total <= sample_rows else 0.9 * sample_rows / total
    sample = rows.filter(drawn_by(F.xxhash64("id"), share)).select("vector").limit(sample_rows).toPandas()["vector"]
    usual = sample.map(len).mode()
    if not len(usual) or usual[0] == 0:
        return F.lit(0).cast("bigint")
    values = np.stack(sample[sample.map(len) == usual[0]])
    widest = np.argsort(-values.var(axis=0), kind="stable")[:CURVE_DIMS]
    places = []
    for d in widest:
        cuts = sorted({float(x) for x in np.quantile(values[:, d], np.arange(1, 1 << CURVE_BITS) / (1 << CURVE_BITS))})
        value = F.coalesce(F.get("vector", F.lit(int(d))), F.lit(0))
        places.append(sum(((value >= F.lit(c)).cast("int") for c in cuts), F.lit(0)))
    return curve_index(places, CURVE_BITS)


def candidate_blocks(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The candidates as a staged table with one row a block: unit, bit, dims, n, ids, labels, vectors, and the zone map."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = [], 0
        first_unit = TaskContext.get().partitionId() << 32

        def block(part: list) -> tuple:
            ids, labels = (np.array([r[k] for r in part], np.int64) for k in (0, 1))
            values = np.array([r[3] for r in part], np.int32).reshape(len(part), -1)
            return (first_unit + at // UNIT_BLOCKS, at % UNIT_BLOCKS, part[0][2], len(part), ids.tobytes(), labels.tobytes(),
                    values.tobytes(), int(labels.min()), int(labels.max()), values.min(axis=0).tobytes(), values.max(axis=0).tobytes())

        def full(last: bool) -> bool:
            return bool(held) and (last or len(held) > BLOCK_ROWS or held[0][2] != held[-1][2])

        for batch in batches:
            out = []
            for row in zip(batch["id"], batch["label"], batch["dims"], batch["vector"]):
                held.append(row)
                if full(False):
                    out.append(block(held[:-1]))
                    held, at = held[-1:], at + 1
            yield pd.DataFrame(out, columns=BLOCK_NAMES)
        if held:
            yield pd.DataFrame([block(held)], columns=BLOCK_NAMES)

    kept = stage(rows.withColumn("curve", curve_place(rows, sample_rows)), "curve")
    ordered = kept.repartitionByRange("dims", "label", "curve", "id").sortWithinPartitions("dims", "label", "curve", "id")
    blocks = stage(ordered.select("id", "label", "dims", "vector").mapInPandas(pack, BLOCKS), "candidate-blocks")
    release(kept)
    return blocks


BLOCKS = ("unit long, bit int, dims int, n int, ids binary, labels binary, vectors binary, low_label long, high_label long, "
          "low binary, high binary")
BLOCK_NAMES = [f.split()[0] for f in BLOCKS.split(", ")]


def matrix(cells: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.int32).reshape(len(cells) if dims else -1, dims) if dims else np.zeros((len(cells), 0), np.int32)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly: in double precision where no sum can leave 53 bits, else in 64-bit integers."""
    most = float(np.abs(a.astype(np.int64)).max(initial=0)) * float(np.abs(b.astype(np.int64)).max(initial=0)) * max(1, a.shape[1])
    if most < 2 ** 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(np.int64) @ b.astype(np.int64).T


def _bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest scores that anchors (rows of a) can have with blocks between low and high."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def choose(asks: DataFrame, blocks: DataFrame, best: int = 0) -> DataFrame:
    """``asks`` with unit and bits, once for each unit that holds a block to read; bits says which of its blocks.

    A block is read for a window that its bounds and labels meet; with ``best``, only that many of them, those that
    reach highest into the window, in each page.
    """
    zones = blocks.select("unit", "bit", F.col("dims").alias("z_dims"), "low_label", "high_label", "low", "high")
    counts = zones.count(), asks.count()
    pages, parts = (max(1, -(-n // size)) for n, size in zip(counts, (PAGE, PART)))
    key = F.pmod(F.xxhash64("unit"), F.lit(pages)).cast("int").alias("page")
    zones = zones.select("*", key, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    dealt = asks.withColumn("a_part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int")) \
        .withColumn("a_page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))

    def meet(asked: pd.DataFrame, zone: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(zone):
            dims = int(zone["z_dims"].iat[0])
            low, high = matrix(zone["low"], dims), matrix(zone["high"], dims)
            zone_low, zone_high = zone["low_label"].to_numpy(), zone["high_label"].to_numpy()
            units, unit_of = np.unique(zone["unit"].to_numpy(), return_inverse=True)
            weight = np.left_shift(np.int64(1), zone["bit"].to_numpy().astype(np.int64))
            for at in range(0, len(asked), 256):
                part = asked.iloc[at:at + 256]
                least, most = _bounds(matrix(part["vector"], dims), low, high)
                label, same = part["label"].to_numpy()[:, None], part["same"].to_numpy()[:, None]
                fits = np.where(same, (zone_low <= label) & (label <= zone_high), (zone_low != label) | (zone_high != label))
                read = np.zeros_like(fits)
                floors, ceilings = (np.stack(part[c]) for c in ("floors", "ceilings"))
                for w in range(floors.shape[1]):
                    met = fits & (most >= floors[:, w:w + 1]) & (least <= ceilings[:, w:w + 1])
                    if best and met.shape[1] > best:
                        reach = np.where(met, np.minimum(most, ceilings[:, w:w + 1]), -np.inf)
                        # of the blocks that reach the ceiling, those whose lowest score is highest
                        order = np.lexsort((-least.astype(np.float64), -reach.astype(np.float64)), axis=1)[:, :best]
                        few = np.zeros_like(met)
                        np.put_along_axis(few, order, True, axis=1)
                        met &= few
                    read |= met
                row, zone_at = np.nonzero(read)
                if len(row):
                    pair = row * len(units) + unit_of[zone_at]
                    pairs, where = np.unique(pair, return_inverse=True)
                    bits = np.zeros(len(pairs), np.int64)
                    np.bitwise_or.at(bits, where, weight[zone_at])
                    chosen = part.iloc[pairs // len(units)][ASK_NAMES].reset_index(drop=True)
                    out.append(chosen.assign(unit=units[pairs % len(units)], bits=bits))
        return pd.concat(out) if out else pd.DataFrame(columns=[*ASK_NAMES, "unit", "bits"])

    both = dealt.groupBy("dims", "a_page", "a_part").cogroup(zones.groupBy("z_dims", "page", "part"))
    return stage(both.applyInPandas(meet, f"{ASKS}, unit long, bits long"), "blocks-to-read")


ASK_NAMES = [f.split()[0] for f in ASKS.split(", ")]


def read(chosen: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(anchor, window, rank, id, score): the first k rows of each window among the chosen blocks, ranks from 1."""
    parts = max(1, -(-chosen.select("anchor").distinct().count() // PART))
    dealt = chosen.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int"))
    needed = stage(dealt.select(F.col("unit").alias("unit"), "part").distinct(), "units-to-read")
    held = blocks.select("unit", "bit", "n", F.col("dims").alias("b_dims"), "ids", "labels", "vectors").join(needed, "unit")
    held = held.select(F.col("unit").alias("b_unit"), F.col("part").alias("b_part"), "b_dims", "bit", "n", "ids", "labels", "vectors")

    def scan(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(block):
            dims = int(block["b_dims"].iat[0])
            ids, labels = (np.frombuffer(b"".join(block[c]), np.int64) for c in ("ids", "labels"))
            values = np.frombuffer(b"".join(block["vectors"]), np.int32).reshape(len(ids), dims)
            order = np.argsort(ids, kind="stable")
            bit = np.repeat(block["bit"].to_numpy().astype(np.int64), block["n"].to_numpy())[order]
            ids, labels, values = ids[order], labels[order], values[order]
            for at in range(0, len(asked), AT_ONCE):
                part = asked.iloc[at:at + AT_ONCE]
                anchor, label = part["anchor"].to_numpy(), part["label"].to_numpy()
                scores = product(matrix(part["vector"], dims), values)
                usable = ((part["bits"].to_numpy()[:, None] >> bit) & 1).astype(bool) & (ids != anchor[:, None])
                usable &= (labels == label[:, None]) == part["same"].to_numpy()[:, None]
                floors, ceilings = (np.stack(part[c]) for c in ("floors", "ceilings"))
                for w in range(floors.shape[1]):
                    met = usable & (scores >= floors[:, w:w + 1]) & (scores <= ceilings[:, w:w + 1])
                    for r in np.flatnonzero(met.any(axis=1)):
                        found = np.flatnonzero(met[r])
                        own = scores[r, found]
                        if len(found) > k:
                            last = np.partition(own, len(own) - k)[len(own) - k]
                            # all above the k-th score, and of those that have it the smallest ids
                            keep = own > last
                            ties = np.flatnonzero(own == last)[:k - int(keep.sum())]
                            keep[ties] = True
                            found, own = found[keep], own[keep]
                        out.append(np.column_stack([np.full(len(found), anchor[r]), np.full(len(found), w), ids[found], own.astype(np.int64)]))
        return pd.DataFrame(np.concatenate([np.empty((0, 4), np.int64), *out]), columns=["anchor", "window", "id", "score"])

    both = dealt.groupBy("dims", "unit", "part").cogroup(held.groupBy("b_dims", "b_unit", "b_part"))
    found = both.applyInPandas(scan, "anchor long, window int, id long, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return stage(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "found")


def _floors(asks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``asks`` with the floor of each window raised to the score of its k-th row, where one was found."""
    last = found.filter(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("last"))
    raised = F.transform("floors", lambda floor, w: F.greatest(floor, F.coalesce(F.try_element_at("last", w), floor)))
    return asks.join(last, "anchor", "left").withColumn("floors", raised).select(*ASK_NAMES)


def _first(asks: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The first k rows of each window of each ask."""
    asks = stage(asks, "asks")
    chosen = choose(asks, blocks, FIRST_READ)
    found = read(chosen, blocks, k)
    raised = stage(_floors(asks, found, k), "asks")
    release(chosen, found)
    chosen = choose(raised, blocks)
    found = read(chosen, blocks, k)
    release(asks, raised, chosen)
    return found


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``is_anchor`` (of id) holds for.

    Scores are inner products of whole numbers. The positives of an anchor are its first other rows of the same label, and a
    positive's negatives the first rows of another label whose score lies in its window; higher scores first, ties to the
    smaller id. A positive whose window is empty (all with a negative score) has no rows. Rows with a null id or label, a null
    vector, or a null or non-finite component take no part, nor do rows whose products could leave 56 bits (components
    of about 131,000 in 64 dimensions). Vectors meet those of their own length. Of rows that repeat an id, the one with the
    smallest label (then length and vector) counts. Other columns are not looked at; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = stage(whole_vectors(vectors, id_col, vector_col, label), "whole-vectors")
    blocks = candidate_blocks(rows, sample_rows)

    @F.pandas_udf("binary")
    def packed(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: np.asarray(c, np.int32).tobytes())

    anchors = stage(rows.filter(is_anchor).select(F.col("id").alias("anchor"), "dims", "label", packed("vector").alias("vector")), "anchors")
    wide = F.array(F.lit(NONE).cast("bigint")), F.array(F.lit(ALL).cast("bigint"))
    near = _first(anchors.select("*", F.lit(True).alias("same"), wide[0].alias("floors"), wide[1].alias("ceilings")), blocks, positives)
    # windows of whole scores; those of negative scores hold nothing
    score = F.col("score")
    near = stage(near.filter(score >= 0).select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"),
                                                score.alias("positive_score"), F.expr(f"(score * {LOW} + 99) DIV 100").alias("floor"),
                                                F.expr(f"(score * {HIGH}) DIV 100").alias("ceiling")), "positives")
    windows = near.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", F.struct("floor", "ceiling")))).alias("of"))
    number = F.sequence(F.lit(0), F.lit(positives - 1))
    bound = lambda name, none: F.transform(number, lambda w: F.coalesce(F.try_element_at("of", w)[name], F.lit(none).cast("bigint")))
    asks = anchors.join(windows, "anchor").select("anchor", "dims", "label", "vector", F.lit(False).alias("same"),
                                                  bound("floor", ALL).alias("floors"), bound("ceiling", NONE).alias("ceilings"))
    found = _first(asks, blocks, negatives)
    return found.join(near, ["anchor", "window"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("id") % 100 == 0, label)


OP12_SQL = """WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
        CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.positive_score,
        s.score AS negative_score
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
    QUALIFY row_number() OVER w <= 10"""
