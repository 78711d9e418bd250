"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import Scratch

#: A node with more neighbours than this, and than a ten-thousandth of all edge ends, is a hub.
HUB_DEGREE, MOST_HUBS = 32, 10_000


def _hung(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """v on the m of its u, for edges (u, v). least: u, m, n, one row per node.

    Hubs, at most MOST_HUBS as their neighbours are counted, come by broadcast, and their edges
    are spread over all tasks of the join that serves the other nodes.
    """
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", F.col("m").alias("__hub")))
    told = edges.join(hubs, "u", "left").withColumn("__far", F.col("__hub").isNull())
    told = told.withColumn("__key", F.when(F.col("__far"), F.col("u")).otherwise(F.xxhash64("v")))
    side = least.select(F.col("u").alias("__u"), F.col("m").alias("__m"))
    joined = told.join(side, (F.col("__key") == F.col("__u")) & F.col("__far"), "left")
    return joined.select(F.col("v").alias("u"), F.coalesce("__hub", "__m").alias("v"))


def large_star(edges: DataFrame, hub: int) -> DataFrame:
    """Every larger neighbour of u is hung on the smallest of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _hung(both.where("v > u"), least, hub).where("u != v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are hung on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node it reaches.

    Each round is written to the scratch folder; it ends when a round changes no edge, which
    count and sum of the edges' hashes tell.
    """
    now = scratch.save(edges.where("u != v").select("u", "v").distinct(), f"{name}_0")
    mark, i = None, 0
    while True:
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == mark or row[0] == 0:
            break
        mark, i = (row[0], row[1]), i + 1
        hub = max(HUB_DEGREE, 2 * row[0] // MOST_HUBS)  # so at most MOST_HUBS nodes have more
        # both stars are written: a plan of the two together would hold each input many times
        turned = scratch.save(large_star(now, hub), f"{name}_{i}_large")
        now = scratch.save(small_star(turned), f"{name}_{i}")
        scratch.drop(f"{name}_{i - 1}", f"{name}_{i}_large")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
