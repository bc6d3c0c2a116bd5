"""Local grids, voxels of boxes and given distances on small made clouds, and the probe against a plain fit."""

import numpy as np
import pytest

from scenova.operators import neighbours as N
from scenova.operators import sampling
from scenova.plans import pooling

SF = "/root/testdata/sf0.001"
CLOUD = "scene_id long, idx int, point_id string, x double, y double, z double, f double"


def test_lone_and_empty_clouds(spark):
    one = spark.createDataFrame([(1, 0, "a", 0.5, 0.5, 0.5, 7.0)], CLOUD)
    assert [tuple(r)[3:] for r in N.local_grid_pool(one, one, 4.0, 2, ["f"], fold=1).collect()] == [(7, 1, 7.0, 0.0, 0.0, 0.0)]
    found = N.local_three_nearest(one, one, 4.0, 2).collect()
    assert len(found) == 8 and all((r["first"], r["second"], r["third"]) == (0, 0, 0) for r in found)
    none = spark.createDataFrame([], CLOUD)
    assert N.local_grid_pool(none, none, 4.0, 2, ["f"], fold=1).count() == N.local_three_nearest(none, none, 4.0, 2).count() == 0


def test_local_list_ends_at_its_size(spark):
    rows = [(1, i, str(i), 0.1 * i, 0.0, 0.0, float(i)) for i in range(30)]
    cloud = spark.createDataFrame(rows, CLOUD)
    for r in N.local_three_nearest(cloud, cloud, 4.0, 2, most=5).collect():
        assert max(r["first"], r["second"], r["third"]) < 5


def test_packed_cell_is_clamped(spark):
    """A point on the upper face of a lower cell goes on to the next packed cell; one beyond the last stays in it."""
    rows = [(1, 0, "a", 0.0, 0.0, 0.0, 1.0), (1, 1, "b", -1.0, -1.0, 4.0, 1.0), (1, 2, "c", 4.0, 4.0, 4.0, 1.0)]
    cloud = spark.createDataFrame(rows, CLOUD)
    met = N.local_neighbours(cloud.where("idx = 0"), cloud, 4.0, cube=True).withColumn("cell", N.local_cell(4.0, 2))
    assert {r["p_idx"]: r["cell"] for r in met.collect()} == {0: 7, 1: 2, 2: 7}


def test_voxels_take_their_first_points(spark):
    boxes = spark.createDataFrame([(1, 0, "box", 0.0, 0.0, 0.0, 4.0, 2.0, 2.0, np.pi / 2)], "scene_id long, idx int, point_id string, x double, y double, z double, l double, w double, h double, yaw double")
    points = spark.createDataFrame([(1, i, str(i), 0.5, 1.5, 0.5, float(i)) for i in range(5)] + [(1, 9, "out", 1.5, 0.5, 0.5, 99.0)], CLOUD)
    got = {r["code"]: (r["n"], r["most"], r["mean"]) for r in N.box_pool(boxes, points, 2, "f", width=1.0, slots=4).collect()}
    # Turned by a quarter, the box is long in y: the points are ahead (1), to the right (0) and above (1).
    assert len(got) == 8 and got.pop((1 << 16) + 1) == (3, 2.0, 1.0) and set(got.values()) == {(0, 0.0, 0.0)}


@pytest.mark.parametrize("n", [1, 3, 9])
def test_given_distances(spark, n):
    rng = np.random.default_rng(n)
    rows, want = [], {}
    for scene, size in ((1, 1), (2, 5), (3, 7)):
        d = rng.integers(0, 5, (size, size)).astype(float)
        rows += [(scene, i, j, float(d[i, j])) for i in range(size) for j in range(size)]
        picked = [0]
        while len(picked) < min(n, size):
            least = [min(d[p, j] for p in picked) for j in range(size)]
            picked.append(least.index(max(least)))
        want[scene] = picked
    got = sampling.farthest_by_distance(spark.createDataFrame(rows, "scene_id long, i long, j long, d double"), n).orderBy("scene_id", "place").collect()
    assert {s: [r["pick"] for r in got if r["scene_id"] == s] for s in want} == want


def test_probe_against_a_plain_fit(spark):
    """The two-class probe, fitted by Newton steps on the same weighted and penalised loss."""
    told = {r["split"]: r["accuracy"] for r in pooling.logistic_probe(spark, SF).where("scenario = 'larger_of_two'").collect()}
    rows = pooling.token_features(spark, SF)["larger_of_two"].toPandas()
    x, y, split = np.stack(rows["v"]), rows["y"].to_numpy(), rows["split"].to_numpy()
    train = split == "train"
    x = (x - x[train].mean(0)) / x[train].std(0, ddof=1)
    a, t = np.column_stack([x[train], np.ones(train.sum())]), y[train]
    s = np.where(t == 1, len(t) / 2 / t.sum(), len(t) / 2 / (len(t) - t.sum()))
    penalty, w = np.diag([1.0] * x.shape[1] + [0.0]), np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (s * p * (1 - p))[:, None]) + penalty, a.T @ (s * (p - t)) + penalty @ w)
    right = (np.column_stack([x, np.ones(len(x))]) @ w > 0) == (y == 1)
    for part in ("train", "val", "test"):
        assert abs(right[split == part].mean() - told[part]) < 0.015
