"""Connected components of a graph of longs, by alternating large-star and small-star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import reliable


def _least(links: DataFrame) -> DataFrame:
    """With each link (u, v) the least of u and all its v. The minimum is combined before the shuffle, so that a hub is no hot task; AQE splits the skewed side of the join."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return links.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least(down)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v), root the least node that it reaches.

    Loops and repeated links are allowed; null ends are dropped; an empty table gives an empty one. The number of
    rounds grows with the logarithm of the longest chain, each round is one pass over the links, and each is
    checkpointed. Neither links nor roots come to the driver, only their number and a checksum.
    """
    edges = reliable(edges.select("u", "v").where("u <> v").distinct())
    seen = None
    while True:
        edges = reliable(_small(_large(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
