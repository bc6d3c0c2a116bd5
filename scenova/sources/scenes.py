"""The scene model over the driver's relational tables, and its SQL twin.

An order is a scene and its lines are the scene's objects: centre, size and
yaw come from line and part columns, the caption is the part's name, and the
predicted box is the true one shifted by a multiple of 0.25 m. Real scene
documents come through ``scenova.sources.readers`` and have the same columns.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers of a session that was started elsewhere find this package too.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A total order of objects. Ids may repeat with other places and scores; rows equal in all of these are equal.
ORDER = ["object_id", "x", "y", "z", "score"]
ORDER_SQL = ", ".join(ORDER)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each object of each scene."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    met = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    shift = F.pmod("l_suppkey", F.lit(7)) * F.lit(0.25)
    return met.select(
        F.col("l_orderkey").alias("scene_id"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("object_id"),
        F.col("o_custkey").alias("cloud"),
        F.concat(F.lit("seq"), F.pmod("o_custkey", F.lit(40)).cast("string")).alias("sequence"),
        F.concat(F.lit("platform"), F.pmod("o_custkey", F.lit(3)).cast("string")).alias("platform"),
        F.when(F.col("o_orderstatus") == "O", "train").when(F.col("o_orderstatus") == "F", "val").otherwise("test").alias("split"),
        F.pmod(F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int"), F.lit(6)).alias("category"),
        F.col("p_name").alias("caption"),
        (F.col("l_quantity") - 25.5).alias("x"),
        ((F.col("l_discount") + 0.0) * 317.0 + F.col("l_linenumber") * F.lit(1.13)).alias("y"),
        ((F.col("l_tax") + 0.0) * 25).alias("z"),
        (1.5 + F.pmod("p_size", F.lit(7)) * F.lit(0.5)).alias("l"),
        (1.0 + F.pmod("p_size", F.lit(5)) * F.lit(0.25)).alias("w"),
        (1.25 + F.pmod("p_size", F.lit(3)) * F.lit(0.5)).alias("h"),
        (F.pmod("l_partkey", F.lit(628)) / F.lit(100) - 3.14).alias("yaw"),
        shift.alias("shift"),
        F.col("l_extendedprice").alias("score"),
    )


#: The same view in SQL, as the head of a WITH list.
OBJECTS_SQL = """
objects AS (
    SELECT l_orderkey AS scene_id,
        concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS object_id,
        o_custkey AS cloud,
        'seq' || CAST(o_custkey % 40 AS VARCHAR) AS sequence,
        'platform' || CAST(o_custkey % 3 AS VARCHAR) AS platform,
        CASE o_orderstatus WHEN 'O' THEN 'train' WHEN 'F' THEN 'val' ELSE 'test' END AS split,
        CAST(split_part(p_brand, '#', 2) AS INTEGER) % 6 AS category,
        p_name AS caption,
        l_quantity - 25.5 AS x,
        (l_discount + 0.0::DOUBLE) * 317.0::DOUBLE + l_linenumber * 1.13::DOUBLE AS y,
        (l_tax + 0.0::DOUBLE) * 25 AS z,
        1.5::DOUBLE + (p_size % 7) * 0.5::DOUBLE AS l,
        1.0::DOUBLE + (p_size % 5) * 0.25::DOUBLE AS w,
        1.25::DOUBLE + (p_size % 3) * 0.5::DOUBLE AS h,
        (l_partkey % 628) / 100.0::DOUBLE - 3.14::DOUBLE AS yaw,
        (l_suppkey % 7) * 0.25::DOUBLE AS shift,
        l_extendedprice AS score
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
)"""


def pairs(objs: DataFrame, *, ordered: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Pairs of objects of a scene, with a_ and b_ before each column: all a != b, or a.object_id < b.object_id.

    Both sides hash on the scene, so one exchange of ``objs`` serves both.
    """
    cols = [c for c in objs.columns if c != "scene_id" and (keep is None or c in keep or c == "object_id")]
    a = objs.select("scene_id", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = objs.select("scene_id", *[F.col(c).alias(f"b_{c}") for c in cols])
    met = a.join(b, "scene_id")
    return met.where(F.col("a_object_id") != F.col("b_object_id") if ordered else F.col("a_object_id") < F.col("b_object_id"))


PAIRS_SQL = """
pairs AS (
    SELECT a.scene_id, a.split, a.platform, a.object_id AS a_id, b.object_id AS b_id, a.category AS a_category, b.category AS b_category,
        a.caption AS a_caption, b.caption AS b_caption, a.x AS x1, a.y AS y1, a.z AS z1, b.x AS x2, b.y AS y2, b.z AS z2,
        a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz
    FROM objects a JOIN objects b ON a.scene_id = b.scene_id AND a.object_id <> b.object_id
)"""
