"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each node of the edges (a, b) the smallest node of its component.

    Minimum labels with pointer jumping; every round is a table in the shared folder, so lineage stays short and a lost executor costs
    one round. Edges are never collected. Self-loops give a node of its own; repeated edges count once.
    """
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        from_next = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(from_next, "node").select("node", "label", F.least("label", "near").alias("new"))
        far = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step = step.join(far, "new", "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new"))
        step = written(step, "labels")
        if step.where("new < label").isEmpty():
            return labels
        labels = step.select("node", F.col("new").alias("label"))
