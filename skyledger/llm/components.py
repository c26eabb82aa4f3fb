"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.shared import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node.

    Each round a node takes the smallest component among its own and its neighbours', then its component's component, so
    chains shrink by halves; every round is written to the shared folder. Self-loops, repeated and null edges do no harm.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        step = labels.join(near, "node").select("node", F.least("component", "_near").alias("component"), F.col("component").alias("_old"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        step = written(step.join(up, "component", "left").select("node", F.least("component", "_up").alias("component"), "_old"), "labels")
        changed = step.where(F.col("component") != F.col("_old")).limit(1).count()
        labels = step.drop("_old")
        if not changed:
            return labels
