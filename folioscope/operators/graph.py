"""Connected components of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import shared_folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that driver and executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that each node of any pair reaches.

    Each round every node takes the least label among its neighbours and itself, and then the
    label of its label, which doubles the reach; labels are grouped, never gathered.
    """
    links = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    links = cut_lineage(links.union(links.select("y", "x")).distinct())
    labels = links.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label"))
    labels = cut_lineage(labels)
    for _ in range(rounds):
        offered = links.join(labels, links.y == labels.node).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("offer"))
        lower = labels.join(offered, "node").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = lower.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        new = cut_lineage(new)
        moved = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components have not settled after {rounds} rounds")
