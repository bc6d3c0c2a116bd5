"""Suppression in the plane, assignment by several costs and samplers, against plain loops."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenova.operators import neighbours as N
from scenova.operators.suppression import survivors
from scenova.plans import points, scoring
from scenova.plans.registry import QUERIES
from scenova.sources import readers as R
from scenova.sources.scenes import objects

SF = "/root/testdata/sf0.001"


def distinct(rows):
    """Rows of the scenes whose object ids differ; the smallest tables repeat one."""
    return rows[~rows["scene_id"].isin(rows[rows.duplicated("object_id")]["scene_id"])]


def test_nms_in_the_plane(spark):
    rows = distinct(objects(spark, SF).toPandas())
    want = set()
    for _, g in rows.groupby("scene_id"):
        left = g.sort_values(["score", "object_id"], ascending=[False, True]).to_dict("records")
        while left:
            a, *left = left
            want.add(a["object_id"])
            share = []
            for b in left:
                wide = max(0, min(a["x"] + a["l"] / 2, b["x"] + b["l"] / 2) - max(a["x"] - a["l"] / 2, b["x"] - b["l"] / 2))
                deep = max(0, min(a["y"] + a["w"] / 2, b["y"] + b["w"] / 2) - max(a["y"] - a["w"] / 2, b["y"] - b["w"] / 2))
                share.append(wide * deep / (a["l"] * a["w"] + b["l"] * b["w"] - wide * deep))
            left = [b for b, s in zip(left, share) if s <= 0.25]
    got = scoring.nms2d(spark, SF).toPandas()
    got = list(got[got["scene_id"].isin(rows["scene_id"])]["object_id"])
    assert len(got) == len(set(got)) and set(got) == want


def test_suppression_in_rounds(spark):
    rng = np.random.default_rng(6)
    # A row of boxes, each over its neighbours, with falling scores is a chain of many rounds; the rest is random.
    rows = [(0, f"c{k:02}", 50.0 - k, 1.2 * k, 0.0, 0.0, 2.0, 2.0, 2.0) for k in range(25)]
    rows += [(f, f"b{k:02}", float(rng.integers(0, 12)), *rng.uniform(-4, 4, 3).round(2).tolist(), *rng.uniform(1, 4, 3).round(2).tolist()) for f in range(1, 9) for k in range(25)]
    held = spark.createDataFrame(rows, "frame long, object_id string, score double, x double, y double, z double, l double, w double, h double").repartition(3)
    for own_area, flat in ((False, False), (True, False), (False, True)):
        axes = 2 if flat else 3
        want = set()
        for f in range(9):
            left = sorted((r for r in rows if r[0] == f), key=lambda r: (-r[2], r[1]))
            while left:
                a, *left = left
                want.add((f, a[1]))
                keep = []
                for b in left:
                    inter = np.prod([max(0.0, min(a[3 + k] + a[6 + k] / 2, b[3 + k] + b[6 + k] / 2) - max(a[3 + k] - a[6 + k] / 2, b[3 + k] - b[6 + k] / 2)) for k in range(axes)])
                    size = [np.prod(r[6 : 6 + axes]) for r in (a, b)]
                    if inter / (size[1] if own_area else sum(size) - inter) <= 0.25:
                        keep.append(b)
                left = keep
        got = survivors(held, ["frame"], own_area=own_area, flat=flat).select("frame", "object_id").collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
    assert survivors(held.where("false"), ["frame"]).count() == 0


def test_assignment_by_class_and_giou(spark):
    rows = distinct(objects(spark, SF).toPandas())
    found = scoring.assign_by_cost(spark, SF).toPandas()
    found = found[found["scene_id"].isin(rows["scene_id"])]
    assert sorted(found["truth"]) == sorted(found["guess"]) == sorted(rows["object_id"])

    def cost(a, b):
        low = [(a["x"], a["l"], b["x"] + b["shift"], b["l"]), (a["y"], a["w"], b["y"], b["w"]), (a["z"], a["h"], b["z"], b["h"])]
        inter = np.prod([max(0, min(p + s / 2, q + t / 2) - max(p - s / 2, q - t / 2)) for p, s, q, t in low])
        around = np.prod([max(p + s / 2, q + t / 2) - min(p - s / 2, q - t / 2) for p, s, q, t in low])
        union = a["l"] * a["w"] * a["h"] + b["l"] * b["w"] * b["h"] - inter
        return -1 / (1 + abs(a["category"] - b["category"])) - 2 * (inter / union - (around - union) / around)

    known = {r["object_id"]: r for r in rows.to_dict("records")}
    for scene, g in found.groupby("scene_id"):
        ids = sorted(rows[rows["scene_id"] == scene]["object_id"])
        if len(ids) <= 5:
            best = min(sum(cost(known[a], known[b]) for a, b in zip(ids, p)) for p in permutations(ids))
            assert abs(sum(cost(known[a], known[b]) for a, b in zip(g["truth"], g["guess"])) - best) < 1e-9


def test_farthest_points_with_features_and_strata(spark):
    cloud = points.cloud(spark, SF).toPandas().sort_values(["scene_id", "idx"])
    found = points.feature_farthest_points(spark, SF).toPandas()
    for kind, cols in (("features", ["x", "y", "z", "f"]), ("coordinates", ["x", "y", "z"])):
        held = {s: list(g.sort_values("place")["point_id"]) for s, g in found[found["kind"] == kind].groupby("scene_id")}
        for scene, g in cloud.groupby("scene_id"):
            x = g.assign(f=g["f"] / 1000)[cols].to_numpy(float)
            picked = [0]
            while len(picked) < min(4, len(x)):
                picked.append(int(np.argmax([min(((p - x[i]) ** 2).sum() for i in picked) for p in x])))
            assert held[scene] == list(g["point_id"].iloc[picked])
    strata = points.angle_strata(spark, SF).toPandas().merge(cloud, on=["scene_id", "point_id"])
    sampled = points.angle_farthest_points(spark, SF).toPandas()
    key = strata["scene_id"] * 4 + strata["stratum"] - 1
    assert sampled.groupby("scene_id").size().to_dict() == key.value_counts().clip(upper=2).to_dict()


def test_proposals_survive_both_steps(spark):
    full = scoring.occupied(spark, SF).toPandas()
    assert (full["n"] >= 5).all()
    alive = survivors(scoring.occupied(spark, SF), ["scene_id"]).toPandas()["object_id"]
    got = scoring.class_proposals(spark, SF).toPandas()
    assert got.groupby("object_id").size().eq(6).all() and set(got["object_id"]) == set(alive) <= set(full["object_id"])


def test_ordinals_of_ties_and_empty_tables(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(500)], "a int, b int").repartition(7)
    got = R.with_ordinal(rows, ["a", "b"]).toPandas().sort_values("bank_index")
    assert list(got["bank_index"]) == list(range(500)) and got[["a", "b"]].apply(tuple, axis=1).is_monotonic_increasing
    assert R.with_ordinal(rows.where("a > 5"), ["a", "b"]).count() == 0


@pytest.mark.parametrize("name", ["occupied_boxes", "class_proposals"])
def test_points_are_counted_in_their_cloud(spark, name, monkeypatch):
    """Before, boxes and points were joined on all cells that a box touches. Larger clouds still are, with the same results, and boxes that repeat are one."""
    boxes = QUERIES[name](spark, SF)
    plan = scoring.occupied(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "lineitem" not in plan
    want = sorted(map(str, boxes.collect()))
    monkeypatch.setattr(N, "WHOLE", 30)
    assert sorted(map(str, QUERIES[name](spark, SF).collect())) == want and want


def test_boxes_that_repeat_are_one(spark, monkeypatch):
    objs = objects(spark, SF).where("cloud % 3 = 0")
    row = objs.orderBy("object_id").limit(40).localCheckpoint()
    rows = objs.unionByName(row).unionByName(row.withColumn("x", F.col("x") + 0.5)).unionByName(row.withColumn("score", F.lit(None).cast("double"))).localCheckpoint()
    monkeypatch.setattr(scoring, "objects", lambda *_: rows)
    for alike in (scoring.NAMED[:3], scoring.NAMED[:-1]):
        told = lambda df: sorted(map(str, df.select("scene_id", *alike, "n").collect()))
        want = told(scoring.counted(rows.withColumn("scene_id", F.col("cloud")), alike))
        assert told(scoring.occupied(spark, SF, alike)) == want and want
