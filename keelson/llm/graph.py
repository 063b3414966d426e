"""Connected components of an edge table, by least labels and pointer jumping, all in joins and grouped minima.

Rows of a round are two or three numbers wide. Where many nodes share a label or a neighbour, grouped minima combine
before the shuffle, and the joins on that key are left to Spark's splitting of skewed partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import written


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node and comp (the least node of its component) for every node of edges (a, b).

    A round takes the least label among a node's neighbours and then that label's own label, so that labels travel
    twice as far each round. Loops and repeated edges do no harm; no edges give no rows."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "graph-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), "graph-labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("_near"))
        closer = labels.join(near, "node").select("node", F.least("comp", "_near").alias("_new"), F.col("comp").alias("_old"))
        jump = labels.select(F.col("node").alias("_new"), F.col("comp").alias("_far"))
        new = written(closer.join(jump, "_new").select("node", F.least("_new", "_far").alias("comp"), (F.least("_new", "_far") < F.col("_old")).alias("_moved")), "graph-labels")
        labels = new.select("node", "comp")
        if not new.where("_moved").take(1):
            break
    else:
        raise RuntimeError("components did not settle")
    return labels
