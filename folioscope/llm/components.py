"""Connected components: the smallest label that each node reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def smallest_reachable(nodes: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """nodes(node, label), links(a, b) undirected -> (node, label): the least label of its component.

    Rounds of large-star and small-star (Kiveris et al., 2014) turn each component into a star
    about its smallest node; their number grows as the square of the logarithm of the component.
    A node's links are never gathered: each round groups by node for the least neighbour and joins
    it back.  Links that lead nowhere new vanish in the distinct.
    """
    edges = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    for _ in range(rounds):
        old, edges = edges, staged(_small_star(_large_star(edges)), "links")
        discard(old)
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)).cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    # Each node that is not a centre has one link, to its centre; a centre has none upward.
    star = nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("centre")), "node", "left")
    star = staged(star.withColumn("centre", F.coalesce("centre", "node")), "stars")
    least = staged(star.groupBy("centre").agg(F.min("label").alias("label")), "centres")
    return star.select("node", "centre").join(least, "centre").select("node", "label")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of u to the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and each of its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return out.union(least.select("u", F.col("m").alias("v"))).distinct()
