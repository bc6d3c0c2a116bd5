"""Connected components of an edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenova.llm.common import cut


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label) of every node of ``edges`` (two longs): label is the smallest node it is connected with.

    In each round every node points to its smallest neighbour, if that is
    smaller (the minimum is taken before the shuffle, so a hub is no single
    task's); pointers are doubled until they end, which takes the logarithm of
    the longest chain; then the edges are rewritten to what their ends point
    to, and those that became loops or copies vanish. It ends when no edge is
    left. Nothing leaves the executors but whether there is one.
    """
    left = cut(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a != b").distinct())
    labels = None
    while True:
        # A node that is nowhere the larger end points to itself.
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(left.select(F.col("b").alias("node"), F.col("b").alias("to")))
        step = ends.groupBy("node").agg(F.min("to").alias("to"))
        step = cut(step)
        while True:
            up = step.select(F.col("node").alias("to"), F.col("to").alias("up"))
            step = cut(step.join(up, "to").select("node", "to", "up"))
            ended = not step.where("up != to").limit(1).count()
            step = step.select("node", F.col("up").alias("to"))
            if ended:
                break
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            moved = step.select(F.col("node").alias("label"), "to")
            labels = cut(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        for end in "ab":
            left = left.join(step.select(F.col("node").alias(end), F.col("to").alias(f"{end}2")), end).drop(end).withColumnRenamed(f"{end}2", end)
        left = cut(left.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
        if not left.limit(1).count():
            return labels
