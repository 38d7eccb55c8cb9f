"""Connected components: small graphs by broadcast labels, large ones with hot labels and hot nodes spread over tasks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import spread_join

SMALL = 1_000_000  # nodes whose labels may be broadcast (16 bytes each)


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); the smallest node names a component.

    A round takes the smallest label among a node and its neighbours (grouped with partial sums, so a star's centre costs one
    row per task) and then the label's own label. Up to `small` nodes labels are broadcast, and a round shuffles only the
    grouped minima; beyond that labels are joined by shuffle, and rows that meet at one node, or that carry one label, are
    dealt over many tasks once they are more than a thousandth of all. Rounds are checkpointed; the loop ends when no
    label changes."""
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    few = labels.count() <= small
    tasks = edges.sparkSession.sparkContext.defaultParallelism
    pack = (lambda df: df.coalesce(tasks)) if few else (lambda df: df)
    both, labels = pack(both), pack(labels)
    degree = None if few else durable(both.groupBy("b").agg(F.count("*").alias("n")))
    while True:
        known = labels.select(F.col("node").alias("b"), "component")
        met = both.join(F.broadcast(known), "b") if few else spread_join(both, known, "b", degree, "a")
        seen = met.select(F.col("a").alias("node"), "component", F.lit(None).cast("long").alias("old")).union(labels.select("node", "component", F.col("component").alias("old")))
        lowered = pack(durable(seen.groupBy("node").agg(F.min("component").alias("component"), F.max("old").alias("old"))))
        up = lowered.select(F.col("node").alias("component"), F.col("component").alias("up"))
        if few:
            followed = lowered.join(F.broadcast(up), "component")
        else:
            followed = spread_join(lowered, up, "component", lowered.groupBy("component").agg(F.count("*").alias("n")), "node")
        jumped = durable(followed.select("node", "old", F.col("up").alias("component")))
        labels = jumped.select("node", "component")
        if jumped.where("component <> old").isEmpty():
            return labels
