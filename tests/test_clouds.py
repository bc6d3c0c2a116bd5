"""Clouds as one row each: no copies travel, and clouds that are larger take the way over grids and rounds with the same results."""

import random

import pytest

from scenova.operators import neighbours as N
from scenova.operators.ranks import score_rank
from scenova.plans import annotations
from scenova.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
NEAR = ["ball_query", "annulus_query", "whole_voxel_query", "voxel_query", "group_points", "resampled_groups", "three_nn", "three_nn_filled", "idw_interpolate", "local_grid_pool", "local_grid_first", "local_three_nn", "multi_scale_pool", "box_pool"]
FAR = ["farthest_points", "feature_farthest_points", "matrix_farthest_points"]


@pytest.mark.parametrize("name", NEAR + FAR)
def test_small_clouds_stay_where_they_are(spark, name, monkeypatch):
    """Before, each point went to the 27 cells about it (box_pool: to all cells of its box), and each round computed the points anew."""
    found = QUERIES[name](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "cx#" not in plan
    assert "Exchange" not in plan or name in ("three_nn_filled", "idw_interpolate")  # these add up three rows of each point
    want = sorted(map(str, found.collect()))
    monkeypatch.setattr(N, "WHOLE", 3 if name == "matrix_farthest_points" else 30)
    assert sorted(map(str, QUERIES[name](spark, SF).collect())) == want


def test_ranks_in_buckets(spark):
    """No window holds a whole group: places over many buckets are those of one sort; equal scores go by the tie."""
    rows = [(g, float(i * 7 % 50 // 2), f"o{i:03d}") for g in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "platform string, score double, object_id string")
    got = score_rank(df, ["platform"], "score", "object_id", 20)
    found = {(r["platform"], r["object_id"]): (r["pos"], r["n"]) for r in got.collect()}
    for g in "ab":
        want = sorted((s, o) for k, s, o in rows if k == g)
        assert [found[g, o] for _, o in want] == [(i, 200) for i in range(200)]


def picked(rows):
    """Best, median and worst of a group's rows (score, id, file), by a walk over all places."""
    line = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    used, out = [], []
    for to in (0, len(line) // 2, len(line) - 1):
        free = [(abs(k - to), k) for k, r in enumerate(line) if r[2] not in used]
        out.append(line[min(free)[1]] if free else None)
        used.append(out[-1] and out[-1][2])
    return tuple(r and r[1] for r in out)


def test_picks_without_ranks(spark, monkeypatch):
    """Before, every row was ranked behind an exchange. Groups with one file, ties, repeated rows, nulls and few rows give what a walk does."""
    rng, rows = random.Random(8), []
    for g in range(60):
        n, most = rng.randrange(1, 30), rng.choice([1, 2, 3, 8])
        held = [(f"g{g}", f"s{rng.choice([0, 0, rng.randrange(most)])}", f"o{k:02}", rng.choice([None, *map(float, range(6))]) if g % 3 else float(k)) for k in range(n)]
        rows += held + held[: n // 3]
    rows += [("wide", f"s{0 if 1_500 < k < 6_400 else k % 3}", f"o{k:05}", float(k // 3)) for k in range(7_000)]
    df = spark.createDataFrame([*rows, (None, None, "o", 1.0)], "platform string, sequence string, object_id string, score double").repartition(5).localCheckpoint()
    monkeypatch.setattr(annotations, "objects", lambda *_: df)
    found = annotations.distinct_picks(spark, SF)
    got = {r["platform"]: (r["best"], r["median"], r["worst"]) for r in found.collect()}
    assert got.pop(None) == ("o", None, None)
    # Rows of one id lie in one file.
    assert got == {g: picked([(s, o, f) for p, f, o, s in rows if p == g]) for g in {r[0] for r in rows}}
