"""Connected components of a link table by alternating large-star and small-star steps (joins and minimum aggregates only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node in edges (u, v: both long). Loops are ignored.

    Neighbours are only ever reduced to their minimum, with partial aggregates, so a hub with any number of links is
    never collected; the join that hands the minimum back is one that adaptive execution can split.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not n or (n, total) == before:
            break
        before = (n, total)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = cut(small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").union(least).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
