"""Connected components of edge tables, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm._store import drop, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge; label is the smallest node of its component.

    Labels start at the smallest neighbour. Each round takes the smallest label among neighbours and then the label of
    that label, so the distance to go falls fast on the star-shaped graphs that blocking makes. Each round is
    written to the shared folder; nothing but a count reaches the driver.
    """
    both = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).where("x <> y").distinct(), "edges")
    labels = written(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", F.least("label", "m").alias("to"), "label")
        up = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        new = written(step.join(up, "to").select("node", F.least("to", "far").alias("label"), (F.least("to", "far") != F.col("label")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        drop(labels)
        labels = new.drop("moved")
        if not moved:
            return labels
