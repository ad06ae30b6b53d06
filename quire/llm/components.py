"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, released_shuffles, stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) that is not its component's smallest node; root is that one.

    A large star links a node's larger neighbours to its smallest one, a small star the smaller ones.  Both need a
    minimum per node (aggregated before the shuffle) and a join back to the links, so a node with very many links is
    no single task's work.  Rounds are written and read back; nothing but whether a row is left reaches the driver.
    """
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v"), "links")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = stored(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        dropped(before, large)
        # Settled when no node has two links and no root a link of its own.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        loose = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where(
            "out > 1 or (out = 1 and into > 0)")
        with released_shuffles(edges.sparkSession):
            settled = loose.isEmpty()
        if settled:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise ValueError(f"components not settled after {max_rounds} rounds")
