"""Indoor scans: vertices (PLY), segments of vertices and objects of segments, in three files of a folder for each scan.

A vertex belongs to a segment by its place, a segment to objects by their lists.
A scan's files are read whole by one task, which meets them there; scans are
dealt over the tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenova.functions.ids import hash_order
from scenova.sources.readers import folders, ply_points

#: How many points a scan keeps, and the seed of the draw.
KEPT_POINTS, SEED = 50_000, "1184"


def scan_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def sampled(points: DataFrame, keep: int = KEPT_POINTS) -> DataFrame:
    """``keep`` vertices of each scan by a hash of scan and place (all, if there are fewer): two levels, so that a scan is not one task."""
    rows = points.withColumn("_h", hash_order(SEED, F.col("scan"), F.col("vertex")))
    rows = rows.withColumn("_b", F.substr("_h", F.lit(1), F.lit(2)))
    sizes = rows.groupBy("scan", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("scan").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sizes.select("scan", "_b", before.alias("_before")).where(F.col("_before") < keep)
    inside = F.row_number().over(Window.partitionBy("scan", "_b").orderBy("_h"))
    met = rows.join(cut.hint("merge"), ["scan", "_b"]).withColumn("_r", inside)
    return met.where(F.col("_before") + F.col("_r") <= keep).drop("_h", "_b", "_r", "_before")


def drawn_places(scan: str, n: int, keep: int) -> np.ndarray:
    """Places of the vertices that ``sampled`` keeps of a scan of ``n``, in order."""
    if n <= keep:
        return np.arange(n)
    begin = hashlib.sha1(f"{SEED}|{scan}|".encode())
    digests = []
    for k in range(n):
        h = begin.copy()
        h.update(b"%d" % k)
        digests.append(h.digest())
    return np.sort(np.array(sorted(range(n), key=digests.__getitem__)[:keep]))


def group_boxes(xyz: np.ndarray, segment: np.ndarray, groups: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(place, points, low, high) of the groups (place, segments) that hold points, the first of those with the same points. ``segment`` is each point's, -1 for none."""
    order = np.argsort(segment, kind="stable")
    held, found, seen = segment[order], [], set()
    for place, parts in groups:
        parts = np.unique(parts[parts >= 0])
        ranges = zip(np.searchsorted(held, parts, "left"), np.searchsorted(held, parts, "right"))
        points = np.sort(np.concatenate([order[:0], *[order[a:b] for a, b in ranges]]))
        if len(points) and (key := points.tobytes()) not in seen:
            seen.add(key)
            found.append((place, len(points), np.fmin.reduce(xyz[points]), np.maximum.reduce(xyz[points])))
    return found


def object_boxes(spark: SparkSession, root: str, keep: int = KEPT_POINTS) -> DataFrame:
    """(scan, object_id, label, points, box): objects of the scans below ``root`` with their points among ``keep`` drawn ones, and the box about them.

    Of objects with the same points the first by place stays. A scan's three
    files are read together, so no vertex travels.
    """
    files = folders(spark, root, ply="*_clean_2.ply", segs="*.segs.json", groups="*.aggregation.json")
    parsed = lambda c, schema: F.from_json(F.col(c).cast("string"), schema)
    group = "struct<objectId:int,label:string,segments:array<int>>"
    rows = files.select(F.substring_index("folder", "/", -1).alias("scan"), "ply", parsed("segs", "segIndices array<int>")["segIndices"].alias("segs"), parsed("groups", f"segGroups array<{group}>")["segGroups"].alias("groups"))

    @F.arrow_udf("array<struct<place:int,points:bigint,box:array<double>>>")
    def boxes(scan: pa.Array, ply: pa.Array, segs: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for name, content, segment, held in zip(scan.to_pylist(), ply, segs, parts):
            xyz = ply_points(content.as_py()).astype(float)
            numbers = lambda v: pc.fill_null(v, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            segment = numbers(segment.values) if segment.is_valid else np.zeros(0, np.int64)
            places = drawn_places(name, len(xyz), keep)
            of = np.full(len(places), -1, np.int64)
            of[places < len(segment)] = segment[places[places < len(segment)]]
            found = group_boxes(xyz[places], of, [(k, numbers(p.values)) for k, p in enumerate(held) if p.is_valid])
            out.append([{"place": place, "points": n, "box": [*((low + high) / 2), *(high - low)]} for place, n, low, high in found])
        return pa.array(out, pa.list_(pa.struct([("place", pa.int32()), ("points", pa.int64()), ("box", pa.list_(pa.float64()))])))

    segments = F.transform(F.coalesce("groups", F.array().cast(f"array<{group}>")), lambda g: g["segments"])
    rows = rows.select("scan", "groups", F.explode(boxes("scan", "ply", "segs", segments)).alias("b"))
    own = F.get("groups", F.col("b.place"))
    return rows.select("scan", own["objectId"].alias("object_id"), own["label"].alias("label"), F.col("b.points").alias("points"), F.col("b.box").alias("box"))
