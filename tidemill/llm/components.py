"""Connected components of a graph given as a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemill.functions.durable import release, stage


def _stars(links: DataFrame) -> bool:
    """Whether every id has one link, and to an id that has none: then each is linked with its component's smallest."""
    rows, ids = links.agg(F.count("*"), F.count_distinct("u")).first()
    centres = links.select(F.col("v").alias("centre")).distinct()
    return rows == ids and links.join(centres, links["u"] == centres["centre"], "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (u, v): root is the smallest id it is connected with.

    Each round every id hands the smallest id it knows to its neighbours, and the links are written anew, so a lost
    executor costs one round at most. The smallest neighbour is found with partial aggregation; the join back spreads
    an id with very many links over several tasks (adaptive skew join). Only counts reach the driver.
    """
    links = stage(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # staged, so that the join's skewed side can be split
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stage(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .distinct(), "large-star")
        release(least)
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        release(links, large, least)
        links = following
    roots = links.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
