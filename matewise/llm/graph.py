"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, discard, stash


def meet(edges: DataFrame, low: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the smallest node that its end u knows."""
    known = low.select(apart(F.col("u")).alias("__u"), "m")
    return edges.withColumn("__u", apart(F.col("u"))).join(known, "__u").drop("__u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b; long): the smallest node reachable.

    Alternating large-star and small-star steps: each node links its larger, then its
    smaller, neighbours to the smallest node it knows.  Every step is one aggregation
    with map-side partial minima and one join, whose sides are shuffled for it alone, so the
    part of a node with a third of all edges can be split; the number of rounds grows with the logarithm of the longest chain.
    Each round is written to the shared folder, and nothing but its check sum reaches the
    driver.  Edges of a node to itself are ignored, repeated edges count once, an edge with a
    null end is no edge, and no edges give no rows.
    """
    tree = stash(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = None
    while True:
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = meet(both, low).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = meet(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, tree = tree, stash(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(last)
        now = tree.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = tree.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return tree.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
