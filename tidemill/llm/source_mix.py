"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then a seeded choice of blocks.

1. Sizes are summed by source. Sources share all words by their weights; a target stops at ``REPEATS`` times its
   source's size and the excess is shared anew by weight, until none is above.
2. The documents of a source, in seeded order, form one line of words, which is cut into blocks of near ``BLOCK`` words,
   equal but for one word. Blocks are numbers, not rows: a word's place gives its block.
3. The seats, as many as the targets hold blocks, go to the sources by the highest quotients target / (2 k + 1); a
   source's seats go to its shards (runs of ``SHARD`` blocks) in the same way. Each shard so knows its integer quota.
4. A shard takes all its blocks as often as the quota allows and, for the rest, those whose seeded hash comes first. A
   document's taken words follow from the blocks it lies in.

Rounding the shares gives nearly all seats at once; only the few that are then over or missing are found by sorting
quotients, a bounded number for each source or shard. Sorting is by range with running totals (`in_order`), so
neither a hot source nor the list of sources is ever in one task, and only totals reach the driver.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.columns import col
from tidemill.functions.durable import release, stage
from tidemill.functions.lookup import lookup_join
from tidemill.llm.columns import BLANKS, whole
from tidemill.llm.hilbert_shards import in_order

WEIGHTS, REPEATS = (5, 2, 1), 3
BLOCK, SHARD = 32, 4096  # words of a block; blocks of a shard, a power of two
SEED = 11


def div(a: Column, b: Column) -> Column:
    """The whole part of a quotient of whole numbers."""
    return F.call_function("div", a, b)


def word_count(text: Column) -> Column:
    """Runs between ASCII blanks: each, with the blanks behind it, becomes one letter. No array of words is made."""
    return F.char_length(F.regexp_replace(F.ltrim(text, F.lit(BLANKS)), "[^ \t-\r]++[ \t-\r]*+", "x")).cast("bigint")


def apportion(votes: DataFrame, seed: int = SEED) -> DataFrame:
    """Sainte-Laguë: ``votes`` with ``quota``, for each group g its ``seats`` by the highest votes / (2 k + 1).

    ``votes`` has g, k, votes (above 0), total (the group's votes), seats and cap; no key takes more than its cap, so
    a group whose caps are used up leaves seats over. Keys of equal quotients follow each other by seeded hash. Rounded
    shares are the seats whose quotient reaches total / (2 seats); the seats that are missing, or too many, are the next
    quotients below, or above. How many of them one key can have is bounded by its share of the difference; where that
    proves too few, the search is repeated with more.
    """
    share = F.floor(F.col("votes") * F.col("seats") / F.col("total") + 0.5).cast("bigint")
    first = stage(votes.withColumn("base", F.least("cap", share)), "votes")
    can_move = F.when(F.col("over") < 0, F.col("cap") - F.col("base")).otherwise(F.col("base"))
    over = first.groupBy("g").agg((F.sum("base") - F.max("seats")).alias("over"), F.count("*").alias("keys"),
                                  *[F.sum(F.when(ok, F.col("votes"))).alias(f"votes_{n}") for n, ok in
                                    (("add", F.col("base") < F.col("cap")), ("take", F.col("base") > 0))])
    over = stage(over.select("g", "over", "keys", F.when(F.col("over") < 0, F.col("votes_add")).otherwise(F.col("votes_take"))
                             .alias("movable")).filter("over <> 0 AND movable > 0"), "over")
    slack = 1
    while not over.isEmpty():
        some = F.ceil(slack * (F.abs("over") + F.col("keys")) * F.col("votes") / F.col("movable")).cast("bigint") + 1
        near = lookup_join(first, over.withColumn("n", F.col("keys")), "g", "n")
        near = near.filter(F.col("over").isNotNull()).withColumn("room", can_move).withColumn("tried", F.least("room", some)) \
            .filter("tried > 0").withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tried") - 1)))
        seat = F.when(F.col("over") < 0, F.col("base") + F.col("j")).otherwise(F.col("base") - 1 - F.col("j"))
        quotient = F.col("votes") / (2 * seat + 1)
        tie = F.xxhash64(F.lit(seed), "g", "k")
        line = near.select("g", "k", "over", "room", "tried", F.when(F.col("over") < 0, -quotient).otherwise(quotient).alias("by"),
                           F.when(F.col("over") < 0, tie).otherwise(F.bitwise_not(tie)).alias("tie"))
        placed = stage(in_order(line, "g", "by", "tie", "k"), "quotients")
        starts = stage(placed.groupBy("g").agg(F.min("position").alias("start"), F.count("*").alias("n")), "starts")
        moved = lookup_join(placed, starts, "g", "n").filter(F.col("position") - F.col("start") < F.abs("over"))
        moved = stage(moved.groupBy("g", "k").agg((F.count("*") * -F.signum(F.max("over"))).cast("bigint").alias("moved"),
                                                  F.max("tried").alias("tried"), F.max("room").alias("room")), "moved")
        release(placed, starts)
        if moved.filter("abs(moved) = tried AND tried < room").isEmpty():
            quota = F.col("base") + F.coalesce(F.col("moved"), F.lit(0))
            return first.join(moved.select("g", "k", "moved"), ["g", "k"], "left").withColumn("quota", quota).drop("base", "moved")
        slack *= 8
    return first.withColumnRenamed("base", "quota")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``sizes`` (source, source_size, rows) with source_no, before (words of earlier sources), target and full.

    Sources in order of code points, null last, have the weights in turn. ``full`` marks targets that stop at
    ``repeats`` times the size. Whole numbers decide what is full, so the outcome is the same every time.
    """
    ordered = in_order(sizes, F.col("source").asc_nulls_last(), weight="source_size")
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    common = lcm(*weights)
    ordered = stage(ordered.withColumn("weight", weight).withColumn("level", F.expr(f"source_size * ({common} DIV weight)")), "sources")
    total = ordered.agg(F.sum("source_size")).first()[0] or 0
    limit, used, left = -1, 0, 0
    while True:
        full = F.col("level") <= limit
        used, left = (x or 0 for x in ordered.agg(F.sum(F.when(full, F.col("source_size") * repeats)),
                                                  F.sum(F.when(~full, F.col("weight")))).first())
        # level <= this number: repeats x size does not exceed what the weight would get
        following = (total - used) * common // (repeats * left) if left else limit
        if following <= limit:
            break
        limit = following
    full = F.col("level") <= limit
    target = F.when(full, (F.col("source_size") * repeats).cast("double")) \
        .otherwise(F.lit(float(total - used)) * F.col("weight") / F.lit(float(left or 1)))
    return ordered.select("source", "source_size", "rows", F.col("position").alias("source_no"), "before",
                          target.alias("target"), full.alias("full"))


def _block_keys(block: Column, seed: int) -> Column:
    """The seeded order of a shard's blocks: a hash whose last bits are the block's own number, so no two are equal."""
    in_shard = block % SHARD
    return F.xxhash64(F.lit(seed), F.col("source_no"), F.col("shard"), in_shard).bitwiseAND(F.lit(-SHARD)).bitwiseOR(in_shard)


def source_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK,
               seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, mark, size, source, source_size, target, taken, spans.

    ``size`` counts the words of the whole text, none for null or an empty text. ``spans`` lists the words taken as
    (from, to, times), counted from 0 with the end exclusive, and ``taken`` sums them up with their repeats: at most
    ``repeats`` times the size. A source's taken words miss its target by a few blocks at most. A null source is a
    source, the last. A source without words has the target 0. Weights are whole numbers above 0. Rows that repeat an id are rows
    of their own; ``mark``, a hash of the text, tells them apart where texts differ, and equal rows are interchangeable. An
    empty table gives no rows. Other columns of ``docs`` are not looked at.
    """
    source = col(source_col).cast("string")
    narrow = stage(docs.select(col(id_col).alias("id"), F.xxhash64(whole(docs, text_col)).alias("mark"), source.alias("source"),
                               F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("key"),
                               word_count(whole(docs, text_col)).alias("size")), "sizes")
    sizes = stage(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "source-sizes")
    targets = source_targets(sizes, weights, repeats)
    # equal blocks: the first `odd` blocks of a source have one word more than the others
    blocks = F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.round(F.col("source_size") / block))).otherwise(0).cast("bigint")
    share = F.when(F.col("full"), F.col("blocks") * repeats).otherwise(F.col("target") * F.col("blocks") / F.col("source_size"))
    targets = targets.withColumn("blocks", blocks).withColumn("votes", F.when(F.col("blocks") > 0, share).cast("double"))
    targets = stage(targets.withColumn("cap", F.col("blocks") * repeats), "targets")
    total = targets.agg(F.sum(F.col("votes").cast("decimal(38,6)"))).first()[0] or 0
    seats = apportion(targets.filter("votes > 0").select(
        F.lit(0).alias("g"), F.col("source_no").alias("k"), "votes", F.lit(float(total)).alias("total"),
        F.lit(int(total + type(total)("0.5")) if total else 0).cast("bigint").alias("seats"), "cap"), seed)
    given = targets.join(seats.select(F.col("k").alias("source_no"), "quota"), "source_no", "left")
    length, odd = F.expr("source_size DIV blocks"), F.expr("source_size % blocks")
    given = stage(given.select(F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("key"),
                               "rows", "source_no", "source_size", F.col("before").alias("source_start"), "target", "blocks",
                               F.coalesce("quota", F.lit(0)).alias("quota"),
                               *[F.when(F.col("blocks") > 0, c).alias(n) for n, c in (("length", length), ("odd", odd))]), "quotas")
    shuffled = lookup_join(narrow, given, "key", "rows").withColumn("place", F.xxhash64(F.lit(seed), "id", "mark"))
    line = in_order(shuffled, "source_no", "place", "mark", "id", "size", weight="size")
    at = F.col("before") - F.col("source_start")

    def block_of(word: Column) -> Column:
        long_part = F.col("odd") * (F.col("length") + 1)
        return F.when(word < long_part, div(word, F.col("length") + 1)).otherwise(F.col("odd") + div(word - long_part, F.col("length")))

    has = F.col("size") > 0
    line = line.withColumn("start", at).withColumn("b0", F.when(has, block_of(F.col("start")))) \
        .withColumn("b1", F.when(has, block_of(F.col("start") + F.col("size") - 1)))
    own = ["id", "mark", "size", "source", "source_size", "target"]
    line = stage(line.select(*own, F.col("position").alias("row"), "source_no", "blocks", "quota", "length", "odd", "start", "b0", "b1",
                             div(F.col("b0"), F.lit(SHARD)).alias("s0"),
                             div(F.col("b1"), F.lit(SHARD)).alias("s1")), "line")
    in_shard = F.least(F.lit(SHARD), F.col("blocks") - F.col("shard") * SHARD)
    shards = line.filter(has).withColumn("shard", F.explode(F.sequence("s0", "s1"))) \
        .groupBy("source_no", "shard").agg(F.max("blocks").alias("blocks"), F.max("quota").alias("quota"))
    shards = apportion(shards.select(
        F.col("source_no").alias("g"), F.col("shard").alias("k"), in_shard.cast("double").alias("votes"),
        F.col("blocks").cast("double").alias("total"), F.col("quota").alias("seats"),
        (in_shard * repeats).alias("cap")), seed)
    shards = shards.select(F.col("g").alias("source_no"), F.col("k").alias("shard"), F.col("votes").cast("bigint").alias("m"), "quota")
    keys = F.array_sort(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1), lambda b: _block_keys(b, seed)))
    extra = (F.col("quota") % F.col("m")).cast("int")
    shards = stage(shards.select("source_no", "shard", div(F.col("quota"), F.col("m")).alias("every"),
                                 F.when(extra > 0, F.element_at(keys, extra)).alias("upto")), "shard-quotas")

    def begin(b: Column) -> Column:
        return b * F.col("length") + F.least(b, F.col("odd"))

    def span(b: Column) -> Column:
        low = F.greatest(begin(b), F.col("start")) - F.col("start")
        high = F.least(begin(b + 1), F.col("start") + F.col("size")) - F.col("start")
        times = F.col("every") + F.coalesce((_block_keys(b, seed) <= F.col("upto")).cast("bigint"), F.lit(0))
        return F.struct(low.alias("from"), high.alias("to"), times.alias("times"))

    def with_spans(rows: DataFrame) -> DataFrame:
        low, high = F.greatest("b0", F.col("shard") * SHARD), F.least("b1", F.col("shard") * SHARD + SHARD - 1)
        spans = F.filter(F.transform(F.sequence(low, high), span), lambda s: s["times"] > 0)
        words = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["to"] - s["from"]) * s["times"])
        return rows.join(shards, ["source_no", "shard"]).withColumn("spans", spans).withColumn("taken", words)

    inside, across = F.col("s0") == F.col("s1"), F.col("s0") < F.col("s1")
    single = with_spans(line.filter(inside).withColumn("shard", F.col("s0"))).select(*own, "taken", "spans")
    # a document that lies in several shards is put together from its parts
    several = with_spans(line.filter(across).withColumn("shard", F.explode(F.sequence("s0", "s1")))) \
        .groupBy("row").agg(*[F.first(c).alias(c) for c in own], F.sum("taken").alias("taken"),
                            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("shard", "spans"))), lambda p: p["spans"])).alias("spans"))
    nothing = line.filter(~has).select(*own, F.lit(0).cast("bigint").alias("taken"), F.array().cast(single.schema["spans"].dataType).alias("spans"))
    return single.unionByName(several.select(*own, "taken", "spans")).unionByName(nothing)


def mixed_texts(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, from, to, copy, text): each span that the mix takes, once for each time, its words joined by blanks."""
    text = docs.select(col(id_col).alias("own"), F.xxhash64(whole(docs, text_col)).alias("own_mark"), whole(docs, text_col).alias("text")) \
        .dropDuplicates(["own", "own_mark"])
    spans = mix.select("id", "mark", "source", F.explode("spans").alias("span")).select("id", "mark", "source", "span.*") \
        .groupBy("id", "mark", "source", "from", "to").agg(F.sum("times").alias("times"))
    spans = spans.groupBy("id", "mark", "source").agg(F.collect_list(F.struct("from", "to", "times")).alias("spans"))
    both = text.join(spans, text["own"].eqNullSafe(spans["id"]) & (text["own_mark"] == spans["mark"]))
    words = F.filter(F.split("text", "[ \t-\r]+", -1), lambda w: w != "")
    pieces = both.select("id", "source", words.alias("words"), F.explode("spans").alias("span"))
    return pieces.select("id", "source", "span.from", "span.to", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("span.times"))).alias("copy"),
                         F.array_join(F.slice("words", (F.col("span.from") + 1).cast("int"), (F.col("span.to") - F.col("span.from")).cast("int")), " ").alias("text"))


def op11_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return source_mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
