"""Connected components by minimum label with pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b); a component is named by its smallest node.

    Every round takes the smallest label among a node's neighbours (grouped, with partial aggregation, so
    the centre of a huge star costs one combined row per task) and then follows the label's own label, which
    halves long chains. Rounds are checkpointed; the loop ends when no label changes.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        lowered = labels.join(seen, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("component"))
        parents = lowered.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        jumped = durable(lowered.join(parents, "component", "left").select(
            "node", "_old", F.least(F.col("component"), F.coalesce("_up", "component")).alias("component")))
        labels = jumped.select("node", "component")
        if jumped.where("component <> _old").isEmpty():
            return labels
