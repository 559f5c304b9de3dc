"""Near duplicates: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

1. Each whole text becomes its set of distinct word shingles and a signature of 360 lanes. Equal sets are
   collapsed to one representative first, so copies never meet as pairs.
2. 60 bands of 6 lanes put representatives into buckets. Two sets of similarity 0.75 share no bucket with a probability of
   8e-6; sets that share a passage but little else hardly ever meet.
3. Within a bucket members are compared with a leader, not with each other; at first each member meets one leader only,
   the smallest of those of its buckets. Pairs whose set sizes alone rule the threshold out go; signatures are compared batch
   by batch, and a pair goes when the posterior (uniform prior, binomial matches) leaves a similarity of the threshold or
   more a probability below ``MISS``. Survivors of all lanes are confirmed on the full sets.
4. After each turn the links found so far are joined to components, and a leader, compared with all, leaves its buckets.
   A bucket whose members are in one component is done. What is left goes another turn, with leaders from all components
   of the bucket but the largest, more of them each turn; from the second turn on a bucket that one task can hold has all
   of them lead, which ends it. The turns end when no bucket holds two components, so every candidate pair is compared or
   already in one component. There is no cap on buckets or partners.
5. Links are joined to components.

Buckets are never gathered in one task: leaders come from partial aggregation, members meet them in joins whose
skewed side the adaptive planner splits, or in parts that hold a bounded number of members and of leaders. Small buckets
share a task's call, as a call costs more than most buckets do.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.columns import col, free_name
from tidemill.functions.durable import release, stage
from tidemill.llm.components import components
from tidemill.llm.shingles import LANES, MinHasher, WordHashes, common, shingle_set

BANDS, ROWS = 60, 6
MISS = 1e-6
COMPONENTS, MORE = 2, 4
PART, BATCH = 2000, 24  # members or leaders of a part; lanes that verification looks at at a time
BLOCK = 500_000  # shingles of the full sets that are held together
BROADCAST_IDS = 1_000_000


def posterior_bounds(threshold: float, miss: float, lanes: int = LANES, batch: int = BATCH) -> np.ndarray:
    """For batch k and m matches: the similarity that the posterior exceeds with probability ``miss``.

    With a uniform prior, P(similarity >= t) after m matches in n lanes is P(Binomial(n + 1, t) <= m).
    """
    table = np.ones((lanes // batch, lanes + 1))
    for k in range(lanes // batch):
        n = (k + 1) * batch
        choose = [comb(n + 1, i) for i in range(n + 2)]
        for m in range(n + 1):
            low, high = 0.0, 1.0
            for _ in range(24):
                t = (low + high) / 2
                tail = sum(choose[i] * t ** i * (1 - t) ** (n + 1 - i) for i in range(m + 1))
                low, high = (t, high) if tail >= miss else (low, t)
            table[k, m] = high
    return table


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        hashes, hasher = WordHashes(), MinHasher()
        for batch in batches:
            rows = []
            for one, text in zip(batch["id"], batch["text"]):
                found = shingle_set(text, hashes)
                key = xxhash.xxh3_128_digest(found.tobytes())
                f1, f2 = np.frombuffer(key, np.int64)
                rows.append((one, len(found), f1, f2, hasher.signature(found).tobytes() if len(found) else b""))
            yield pd.DataFrame(rows, columns=["id", "n", "f1", "f2", "sig"])

    plain = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).cast("string").alias("text"))
    # ids go through as text: pandas would turn a column with nulls into floats
    out = plain.select(F.col("id").cast("string").alias("id"), "text") \
        .mapInPandas(run, "id string, n long, f1 long, f2 long, sig binary")
    return stage(out.withColumn("id", F.col("id").cast("bigint")), "sets")


def _sizes_fit(a: str, b: str, threshold: float) -> Column:
    """Whether sets of these sizes can reach the threshold: the smaller one cannot share more than all it has."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * round(100 * threshold)


def _screen(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(a, b, keep): whether the posterior, batch after batch, leaves the pair a chance."""
    bounds = posterior_bounds(threshold, miss)

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(-1, LANES) for c in ("sa", "sb"))
            open_, matches = np.arange(len(batch)), np.zeros(len(batch), int)
            for k in range(LANES // BATCH):
                lanes = slice(k * BATCH, (k + 1) * BATCH)
                matches[open_] += (a[open_, lanes] == b[open_, lanes]).sum(axis=1)
                open_ = open_[bounds[k, matches[open_]] >= threshold]
            keep = np.zeros(len(batch), bool)
            keep[open_] = True
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "keep": keep})

    left, right = (sigs.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
    sized = pairs.join(right, "b").join(left, "a").filter(_sizes_fit("na", "nb", threshold))
    return stage(sized.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long, keep boolean"), "screened")


def _confirmed(asks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the near pairs among ``asks`` (a, block, bs): a's full set against those of the ids bs, all of one block.

    Sets lie in blocks of bounded size, so a set moves once to its block, not once a pair; many asks for one block are cut into
    parts. The nearest texts count where ids have several.
    """
    def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        own, out = {}, []
        for one, found in zip(held["id"], held["set"]):
            own.setdefault(one, []).append(np.frombuffer(found, np.uint64))
        for a, found, bs in zip(asked["a"], asked["a_set"], asked["bs"]) if own else ():
            left = np.frombuffer(found, np.uint64)
            for b in np.frombuffer(bs, np.int64):
                for right in own[b]:
                    inter = common(left, right)
                    if 100 * inter >= percent * (len(left) + len(right) - inter):
                        out.append((a, b))
                        break
        return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)

    asks = stage(asks, "asks")
    parts = stage(asks.groupBy("block").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "ask-parts")
    heads = asks.join(parts, "block").join(sets.select(F.col("id").alias("a"), F.col("set").alias("a_set")), "a") \
        .select(F.col("block").alias("a_block"), F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("a_part"), "a", "a_set", "bs")
    held = sets.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = heads.groupBy("a_block", "a_part").cogroup(held.select("block", "part", "id", "set").groupBy("block", "part"))
    return stage(both.applyInPandas(compare, "u long, v long").distinct(), "near")


def _members(sigs: DataFrame) -> DataFrame:
    """(band, place, rep) of buckets with two members or more; place is the band's number."""
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", k * ROWS * 2 + 1, ROWS * 2)) for k in range(BANDS)])
    banded = sigs.select("rep", F.posexplode(keys).alias("place", "band"))
    shared = stage(banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1").select("band"), "shared")
    return stage(banded.join(shared, "band"), "buckets")


def _blocks(own: DataFrame, sigs: DataFrame) -> DataFrame:
    """(rep, block): blocks of about ``BLOCK`` shingles; members with one first leader share few blocks, however many they are."""
    sized = stage(own.join(sigs.select("rep", "n"), "rep"), "sized")
    groups = stage(sized.groupBy("own").agg(F.ceil(F.sum("n") / BLOCK).alias("parts")), "group-parts")
    blocks = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // BLOCK))
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    return stage(sized.join(groups, "own").select("rep", F.pmod(F.xxhash64("own", part), F.lit(blocks)).alias("block")), "blocks")


def _candidate_sets(docs: DataFrame, id_col: str, text_col: str, blocks: DataFrame) -> DataFrame:
    """(id, block, set) of the ids that share a bucket with another; a table of ids beyond a checked size is not broadcast."""
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "block": batch["block"],
                                "set": [shingle_set(text, hashes).tobytes() for text in batch["text"]]})

    ids = blocks.withColumnRenamed("rep", "id")
    plain = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).cast("string").alias("text"))
    few = ids.count() <= BROADCAST_IDS
    return stage(plain.join(F.broadcast(ids) if few else ids, "id").mapInPandas(run, "id long, block long, set binary"), "full-sets")


def _leaders(placed: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Of (band, place, rep, comp): the rows of buckets that hold several components, and those of them that lead.

    Every pair still to be judged has a member outside its bucket's largest component, so leaders come from the others: of
    each a few members, more each turn; and where a bucket holds very many components, of some, more each turn. After the
    first turn all of them lead in buckets of at most ``PART`` members, which are done with that.
    """
    parts = placed.groupBy("band", "comp").agg(F.count("*").alias("size"), F.min("rep").alias("first"))
    by_size, by_hash = F.struct("size", "comp"), F.struct(F.xxhash64(F.lit(turn), "comp"), "comp")
    buckets = parts.groupBy("band").agg(F.max_by("comp", by_size).alias("main"), F.min_by("comp", by_hash).alias("early"),
                                        F.max_by("comp", by_hash).alias("late"), F.count("*").alias("comps"),
                                        (F.lit(turn > 1) & (F.sum("size") <= PART)).alias("all_lead"))
    # the two ends are different components, so a bucket always has one that leads
    buckets = stage(buckets.filter("comps > 1").withColumn("drawn", F.when(F.col("early") != F.col("main"), F.col("early"))
                                                           .otherwise(F.col("late"))), "open-buckets")
    left = stage(placed.join(buckets.select("band"), "band"), "open-members")
    some = F.pmod(F.xxhash64(F.lit(turn), "comp"), F.lit(1 << 40)) < F.lit(float(1 << 40)) * COMPONENTS * MORE ** (turn - 1) / F.col("comps")
    others = stage(parts.join(buckets, "band").filter(F.col("comp") != F.col("main"))
                   .filter(some | (F.col("comp") == F.col("drawn")) | F.col("all_lead"))
                   .select("band", "comp", "size", "first", "all_lead"), "led")
    drawn = F.pmod(F.xxhash64(F.lit(turn), "rep"), F.lit(1 << 40)) < F.lit(float(1 << 40)) * MORE ** (turn - 1) / F.col("size")
    names = stage(left.join(others, ["band", "comp"]).filter(drawn | (F.col("rep") == F.col("first")) | F.col("all_lead"))
                  .select("band", "place", "rep", "comp"), "leaders")
    return left, names


def _by_leaders(left: DataFrame, names: DataFrame, known: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(a, block, bs) of a leader and those members of a block that share a bucket with it, are in another component and that
    the posterior does not drop.

    Buckets are cut into parts of about ``PART`` members, and so are their leaders; each part meets each part of leaders
    in one task, which sends on only what is left. Parts are packed into bins of about ``PART`` members for one call each.
    A pair that shares several buckets is looked at in the first of its bands: where it is not there any more, it was judged in
    an earlier turn or is in one component. Of two that both lead there, the smaller one leads.
    """
    bounds, least = posterior_bounds(threshold, miss, LANES, BATCH), round(100 * threshold)
    keys = ["band", "part", "lead_part"]

    def compare(members: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        found = []
        parts = heads.groupby([f"l_{k}" for k in keys]).indices if len(members) and len(heads) else {}
        for key, own in members.groupby(keys).indices.items() if parts else ():
            own, lead_rows = members.iloc[own], heads.iloc[parts.get(key, [])]
            rows = np.frombuffer(b"".join(own["sig"]), np.uint16).reshape(-1, LANES)
            reps, comps, sizes, blocks = (own[c].to_numpy() for c in ("rep", "comp", "n", "block"))
            place, also = own["place"].iat[0], np.isin(reps, lead_rows["l_rep"].to_numpy())
            for lead, comp, size, sig, bands in zip(*(lead_rows[f"l_{c}"] for c in ("rep", "comp", "n", "sig", "bands"))):
                fits = 100 * np.minimum(sizes, size) >= least * np.maximum(sizes, size)
                open_ = np.flatnonzero((comps != comp) & fits & ~(also & (reps < lead)))
                same = rows[open_] == np.frombuffer(sig, np.uint16)
                shared = reduce(np.logical_and, (same[:, k::ROWS] for k in range(ROWS)))
                first = (shared & ((bands >> np.arange(BANDS)) & 1 > 0)).argmax(axis=1) == place
                open_, same = open_[first], same[first]
                matches = np.zeros(len(open_), int)
                for k in range(LANES // BATCH):
                    if not len(open_):
                        break
                    matches += same[:, k * BATCH:(k + 1) * BATCH].sum(axis=1)
                    left_ = bounds[k, matches] >= threshold
                    open_, same, matches = open_[left_], same[left_], matches[left_]
                found += [(lead, block, reps[open_[blocks[open_] == block]].tobytes()) for block in np.unique(blocks[open_])]
        return pd.DataFrame(found, columns=["a", "block", "bs"]).astype({"a": "int64", "block": "int64"})

    bands = names.groupBy("rep").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bands"))
    led = stage(names.select("band", "rep", "comp").join(bands, "rep"), "led")
    lead_parts = led.groupBy("band").agg(F.ceil(F.count("*") / PART).cast("int").alias("lead_parts"))
    parts = stage(left.groupBy("band").agg(F.count("*").alias("size"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
                  .join(lead_parts, "band"), "bucket-parts")
    bins = max(1, -(-(parts.agg(F.sum(F.col("size") * F.col("lead_parts"))).first()[0] or 0) // PART))

    def number(count: str) -> Column:
        return F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    bin_ = F.pmod(F.xxhash64(*keys), F.lit(bins))
    members = left.join(parts, "band").join(known, "rep").withColumn("part", number("parts")).withColumn("lead_part", each("lead_parts"))
    heads = led.join(parts, "band").join(known, "rep").withColumn("lead_part", number("lead_parts")).withColumn("part", each("parts"))
    members = members.select(bin_.alias("bin"), *keys, "place", "rep", "comp", "n", "sig", "block")
    heads = heads.select(*[c.alias(f"l_{name}") for name, c in (("bin", bin_), *((k, F.col(k)) for k in (*keys, "rep", "comp", "n", "sig", "bands")))])
    both = members.groupBy("bin").cogroup(heads.groupBy("l_bin"))
    return both.applyInPandas(compare, "a long, block long, bs binary")


def near_components(docs: DataFrame, sigs: DataFrame, given: DataFrame, percent: int = 75, miss: float = MISS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, root) of the components of the ``given`` links (u, v) and of all confirmed links between bucket members."""
    threshold = percent / 100
    members = _members(sigs)
    comps = stage(components(given), "components")
    # the first turn: one leader for each member, the smallest member of all its buckets
    first = stage(members.groupBy("band").agg(F.min("rep").alias("a")), "leaders")
    led = stage(members.select("band", "rep").join(first, "band"), "led")
    own = stage(led.groupBy("rep").agg(F.min("a").alias("own")), "own-leaders")
    pairs = stage(own.filter("rep <> own").select(F.col("own").alias("a"), F.col("rep").alias("b")), "pairs")
    # a leader has left a bucket if all members there met it; else the bucket keeps it for later turns
    met_all = led.join(own, "rep").groupBy("band").agg(F.max("a").alias("rep"), F.bool_and((F.col("own") == F.col("a")) | (F.col("rep") == F.col("a"))).alias("all"))
    first = stage(met_all.filter("all").select("band", "rep"), "settled")
    blocks = _blocks(own, sigs)
    sets = _candidate_sets(docs, id_col, text_col, blocks)
    known = stage(sigs.select("rep", "n", "sig").join(blocks, "rep"), "known")

    @F.pandas_udf("binary")
    def packed(ids: pd.Series) -> pd.Series:
        return ids.map(lambda found: np.asarray(found, np.int64).tobytes())

    kept = _screen(pairs, sigs, threshold, miss).filter("keep").join(blocks.withColumnRenamed("rep", "b"), "b")
    asks = kept.groupBy("a", "block").agg(F.collect_list("b").alias("found")).select("a", "block", packed("found").alias("bs"))
    links, turn = _confirmed(asks, sets, percent), 0
    settled = first
    while True:
        if not links.isEmpty():
            comps = stage(components(links.unionByName(comps.select(F.col("id").alias("u"), F.col("root").alias("v")))), "components")
        rest = members.select("band", "place", "rep").join(settled, ["band", "rep"], "left_anti")
        placed = stage(rest.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(
            "band", "place", "rep", F.coalesce("root", "rep").alias("comp")), "placed")
        turn += 1
        members, settled = _leaders(placed, turn)
        if settled.isEmpty():
            break
        links = _confirmed(_by_leaders(members, settled, known, threshold, miss), sets, percent)
    release(sets, known)
    return comps


def near_groups(docs: DataFrame, percent: int = 75, miss: float = MISS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id.

    ``component_id`` is the smallest id that links of similarity ``percent`` or more lead to, the row's own included.
    Texts with fewer than five words have their whole word sequence as one shingle; a null or empty text, or one of
    blanks alone, has no shingle and is linked with nothing. Rows that repeat an id are one document: linked to
    whatever any of their texts is linked to. A row without an id takes part in no link and has a null component.
    Other columns of ``docs`` are not looked at.
    """
    sets = _sets(docs, id_col, text_col)
    own = sets.filter("n > 0 AND id IS NOT NULL")
    sigs = stage(own.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "signatures")
    reps = stage(own.select("id", "f1", "f2").join(sigs.select("f1", "f2", "rep"), ["f1", "f2"]), "representatives")
    # an id with several texts connects their sets
    several = reps.groupBy("id").agg(F.min("rep").alias("v"), F.max("rep").alias("most"), F.collect_set("rep").alias("all")) \
        .filter("v < most").select(F.explode("all").alias("u"), "v")
    roots = near_components(docs, sigs, several, percent, miss, id_col, text_col)
    named = reps.join(roots.withColumnRenamed("id", "rep"), "rep", "left") \
        .groupBy("id").agg(F.min(F.coalesce("root", "rep")).alias("root"))
    out = sets.select("id", "n").join(named, "id", "left")
    release(sigs)
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id, with all its columns.

    Of rows that repeat an id one stays; rows without an id all stay.
    """
    groups = stage(near_groups(docs, percent, id_col=id_col, text_col=text_col), "groups")
    copy = free_name(docs, "_copy")
    copies = stage(groups.filter("id <> component_id").select(F.col("id").alias(copy)).distinct(), "copies")
    few = copies.count() <= BROADCAST_IDS  # of one number each; beyond that both sides are shuffled by id
    copies = F.broadcast(copies) if few else copies
    again = stage(groups.filter("id = component_id").groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1")
                  .select(F.col("id").alias(copy)), "repeated-ids")
    left = docs.join(copies, docs[id_col] == copies[copy], "left_anti")
    if again.isEmpty():
        return left
    once = left.join(again, left[id_col] == again[copy], "left_semi").dropDuplicates([id_col])
    return left.join(again, left[id_col] == again[copy], "left_anti").unionByName(once)


def op8_near_dups(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                                    (F.col("id") == F.col("component_id")).alias("kept"))
