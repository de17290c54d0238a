"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, of every node of ``edges`` (``u``, ``v``, both long).

    Each round moves links towards smaller nodes and is written to the shared folder;
    rounds grow with the logarithm of the longest path. Groups are aggregated to their
    minimum before the shuffle, and the join back on a node with very many links is one
    that Spark splits. Loops and repeated links do no harm.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        # Large star: every larger neighbour of a node is linked to the smallest of its neighbours and itself.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["n"]).where("v > n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stored(large.distinct(), "links")
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        joined = large.join(low, large["u"] == low["n"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("n").alias("u"), F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), "links")
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
    else:
        raise RuntimeError("links did not settle")
    stars = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return stars.union(stars.select("root").distinct().select(F.col("root").alias("node"), "root"))
