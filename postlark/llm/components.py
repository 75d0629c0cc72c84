"""Connected components of a graph given by its edges, as joins and sums in Spark."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node with an edge ``a, b``; the root is the least node.

    Each round a node takes the least label around it and then that label's own label,
    so paths halve. A round shuffles edges and labels; its result is a stored table.
    Nothing is collected but whether a label changed.
    """
    both = stored(
        edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct(),
        "edges",
    )
    labels = both.groupBy("node").agg(F.min("other").alias("root"))
    labels = stored(labels.select("node", F.least("node", "root").alias("root")), "labels")
    while True:
        around = (
            both.join(labels.toDF("other", "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        )
        lower = labels.join(around, "node").select(
            "node", F.least("root", "near").alias("root"), F.col("root").alias("old")
        )
        lower = stored(lower, "labels")
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("further"))
        labels = stored(
            lower.join(jump, "root").select("node", F.col("further").alias("root"), "old"), "labels"
        )
        changed = not labels.where(F.col("root") != F.col("old")).isEmpty()
        labels = labels.select("node", "root")
        if not changed:
            return labels
