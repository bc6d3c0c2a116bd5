"""Scene questions over a stream of scene documents: the batch chain unchanged, since it needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenova.functions import geometry as G
from scenova.sources.readers import SCENE


def scene_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCENE).json(path)


def questions(scenes: DataFrame) -> DataFrame:
    """Ordered pairs inside each scene document and their relation, where it is clear. Works on batches and streams alike."""
    rows = scenes.select("scene_id", "objects", F.explode("objects").alias("a")).select("scene_id", "a", F.explode("objects").alias("b")).where("a.object_id <> b.object_id")
    dx, dy = (F.col("a.gt_box.center")[i] - F.col("b.gt_box.center")[i] for i in (0, 1))
    found = rows.select("scene_id", F.col("a.object_id").alias("a_id"), F.col("b.object_id").alias("b_id"), G.margin_relation(dx, dy).alias("relation"), G.planar(dx, dy).alias("distance"))
    return found.where("relation is not null")
