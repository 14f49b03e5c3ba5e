"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import checkpointed


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b longs); the label is the smallest node reachable.

    Each round hangs the larger neighbours of a node, then the smaller ones, on the smallest of them,
    until nothing changes; the number of rounds grows with the logarithm of the diameter.  Minima are
    taken before the shuffle, and adaptive joins split the neighbours of a hub.  Lineage is cut each
    round by a checkpoint.  Edges with a null end, and those of a node with itself, join nothing and name no
    node; repeated edges count once; without edges there are no nodes.
    """

    def starred(e: DataFrame, of: DataFrame) -> DataFrame:
        least = of.groupBy("u").agg(F.min("v").alias("m"))
        return e.join(least, "u")

    stars = checkpointed(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            starred(both, both)
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        hung = starred(large, large)
        stars = checkpointed(
            hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(hung.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
