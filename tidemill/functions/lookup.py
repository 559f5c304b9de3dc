"""Join a fitted value map back to the rows without a skewed shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemill.functions.columns import free_name, q

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_VALUES = 2000
SPREAD = 512


def lookup_join(df: DataFrame, mapping: DataFrame, key: str, weight: str | None = None,
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left join ``mapping`` (unique on ``key``) to ``df``; NULL keys get NULL payloads.

    ``mapping`` must be staged: it is measured first. A map below ``broadcast_bytes`` is broadcast.
    A larger one is shuffled, with the at most ``HOT_VALUES`` values that hold a share of at least
    1/``HOT_VALUES`` of ``weight`` broadcast instead, and hot and missing keys spread by a salt, so
    that no task receives a hot key.
    """
    payload = [c for c in mapping.columns if c not in (key, weight)]
    value = F.col(q(key))
    # count(DISTINCT) is not needed here: keys are unique, so rows x width bounds the size
    width = F.sum(F.coalesce(F.octet_length(value.cast("string")), F.lit(0)) + 24 + 16 * len(payload))
    total = F.sum(weight) if weight else F.lit(0)
    size, total = mapping.agg(width, total).first()
    if (size or 0) <= broadcast_bytes:
        return df.join(F.broadcast(mapping.select(key, *map(q, payload))), key, "left") \
            .select(*map(q, df.columns), *map(q, payload))

    hot_flag, salt, cold_key = (free_name(df, n) for n in ("_hot", "_salt", "_cold_key"))
    small = mapping.limit(0) if not weight else mapping.filter(
        F.col(weight) >= F.lit(total) / F.lit(HOT_VALUES))
    hot = small.select(q(key), F.lit(True).alias(hot_flag),
                       *[F.col(q(p)).alias(f"_hot_{p}") for p in payload])
    cold = mapping.select(value.alias(cold_key), F.lit(0).alias(salt),
                          *[F.col(q(p)).alias(f"_cold_{p}") for p in payload])
    marked = df.join(F.broadcast(hot), key, "left")
    apart = F.col(hot_flag).isNotNull() | F.col(q(key)).isNull()
    spread = F.pmod(F.xxhash64(*[F.col(q(c)) for c in df.columns]), F.lit(SPREAD)).cast("int") + 1
    marked = marked.withColumn(cold_key, F.when(~apart, F.col(q(key)))) \
        .withColumn(salt, F.when(apart, spread).otherwise(F.lit(0)))
    joined = marked.join(cold, [cold_key, salt], "left")
    return joined.select(*map(q, df.columns), *[
        F.when(F.col(hot_flag).isNotNull(), F.col(q(f"_hot_{p}")))
        .otherwise(F.col(q(f"_cold_{p}"))).alias(p) for p in payload])
