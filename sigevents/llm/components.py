"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigevents.llm.common import stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. ``edges``: u, v with u > v.

    Every node's neighbours are linked to the least of them. The least neighbour is an aggregate
    joined back, so that a node with very many neighbours is nowhere gathered in one row.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.union(edges.join(least, "u").where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the least node of its component) for each node that has a link.

    ``links``: columns a, b of longs. Rounds grow with the logarithm of the longest path; each is
    written to the shared folder, which cuts the lineage.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    for _ in range(max_rounds):
        new = stored(_stars(edges), "stars")
        # settled: the same edges, and each node has one (smaller) neighbour that has none itself
        sums = [e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20)")).alias("s"), F.countDistinct("u").alias("d")).first() for e in (edges, new)]
        settled = sums[0] == sums[1]
        edges = new
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
