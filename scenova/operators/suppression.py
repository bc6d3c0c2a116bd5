"""Greedy suppression of overlapping boxes as joins and rounds.

A box beats another of its frame if they overlap by more than ``most`` and its
score is higher (ties by id). Those pairs are edges. In each round the boxes
that nothing beats any more are kept, and what they beat goes, with its edges;
that ends after as many rounds as the longest chain of beaten winners. It is the
result of a walk down the scores, without a task that holds a frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenova.functions import geometry as G
from scenova.operators import matching as M
from scenova.sources.sinks import written


def beaten_pairs(rows: DataFrame, keys: list[str], most: float, own_area: bool) -> DataFrame:
    """Edges (winner, loser) of rows with a number n, an object_id, a score and a box."""
    met = M.overlapping(rows, rows, keys)
    inter = F.lit(1.0)
    for c, s in zip("xyz", "lwh"):
        inter = inter * G.overlap(F.col(f"g_{c}"), F.col(f"g_{s}"), F.col(f"t_{c}"), F.col(f"t_{s}"))
    size = lambda at: F.col(f"{at}_l") * F.col(f"{at}_w") * F.col(f"{at}_h")
    share = inter / (size("t") if own_area else size("g") + size("t") - inter)
    order = lambda at: F.struct(-F.col(f"{at}_score"), f"{at}_object_id", f"{at}_x", f"{at}_y", f"{at}_n")
    return met.where((share > most) & (order("g") < order("t"))).select(F.col("g_n").alias("winner"), F.col("t_n").alias("loser"))


def survivors(objs: DataFrame, keys: list[str], *, most: float = 0.25, own_area: bool = False, flat: bool = False) -> DataFrame:
    """Rows of ``objs`` that survive suppression among those of equal ``keys``. ``own_area`` divides by the suppressed box; ``flat`` compares areas in the plane."""
    spark = objs.sparkSession
    held = written(objs.withColumn("n", F.monotonically_increasing_id()), "boxes")
    boxes = held.select(*keys, "n", "object_id", "score", "x", "y", F.lit(0.0).alias("z") if flat else F.col("z"), "l", "w", F.lit(1.0).alias("h") if flat else F.col("h"), F.lit(0.0).alias("yaw"))
    edges = written(beaten_pairs(boxes, keys, most, own_area), "edges")
    gone = spark.createDataFrame([], "n bigint")
    while edges.limit(1).count():
        beaten = edges.select(F.col("loser").alias("winner")).distinct()
        losers = written(edges.join(beaten, "winner", "left_anti").select(F.col("loser").alias("n")).distinct(), "losers")
        gone = gone.unionByName(losers)
        for end in ("winner", "loser"):
            edges = edges.join(losers.select(F.col("n").alias(end)), end, "left_anti")
        edges = written(edges.select("winner", "loser"), "edges")
    return held.join(gone, "n", "left_anti").drop("n")
