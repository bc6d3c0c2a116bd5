"""Queries that answer for every row, not for a share of them."""

import pytest

from scenova.plans.joins import numbered
from scenova.plans.points import cloud
from scenova.plans.registry import QUERIES
from scenova.sources.scenes import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["ball_query", "annulus_query", "voxel_query", "whole_voxel_query", "group_points", "three_nn", "idw_interpolate"])
def test_every_point_is_a_centre(spark, name):
    points = cloud(spark, SF)
    if name in ("three_nn", "idw_interpolate"):  # a lone point has no other
        points = points.join(points.groupBy("scene_id").count().where("count > 1"), "scene_id")
    want = {(r["scene_id"], r["idx"], r["point_id"]) for r in points.collect()}
    assert want and {(r["scene_id"], r["idx"], r["point_id"]) for r in QUERIES[name](spark, SF).collect()} == want


def test_joins_count_every_row(spark):
    count = lambda name: sum(r["n"] for r in QUERIES[name](spark, SF).collect())
    assert count("token_scene_join") == table(spark, SF, "lineitem").count()
    keys = {r[0] for r in table(spark, SF, "orders").select("o_custkey").collect()} | {r[0] for r in table(spark, SF, "customer").select("c_custkey").collect()}
    assert count("roster_diff") == len(keys)


def test_repeated_ids_have_one_order(spark):
    """Rows that share an id but not a place are numbered alike, whatever order they arrive in."""
    held = [(1, "a", 5.0, 0.0, 0.0, 9.0), (1, "a", -5.0, 0.0, 0.0, 3.0), (1, "a", -5.0, 2.0, 0.0, 1.0), (1, "b", 0.0, 0.0, 0.0, 1.0)]
    schema = "scene_id long, object_id string, x double, y double, z double, score double"
    runs = [sorted((r.ord, r.x, r.y) for r in numbered(spark.createDataFrame(rows, schema)).collect()) for rows in (held, held[::-1], held[1:] + held[:1])]
    assert runs[0] == runs[1] == runs[2] == [(0, -5.0, 0.0), (1, -5.0, 2.0), (2, 5.0, 0.0), (3, 0.0, 0.0)]
