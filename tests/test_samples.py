"""Sample records, lens, augmentation, profiles, eligibility and functions called from SQL."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenova.functions import annotations as A
from scenova.functions import geometry as G
from scenova.functions import sql as SQL
from scenova.functions.draws import normal, uniform
from scenova.operators import augment
from scenova.operators import matching as M
from scenova.operators import sequential as S
from scenova.plans import samples as P

BOXES = "frame long, k int, x double, y double, z double, l double, w double, h double, yaw double"


def test_sample_table(spark):
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 20.0, 4.0, 2.0, math.pi / 2), (1, 1, 0.0, 8.0, 0.0, 2.0, 2.0, 2.0, 0.0), (2, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0)], BOXES)
    points = spark.createDataFrame([(1, 0, 0.0, -9.0, 0.0), (1, 1, 0.0, 8.5, 0.0), (1, 2, 9.0, 0.0, 0.0), (1, 3, 1.9, 9.9, 0.9)], "frame long, idx int, x double, y double, z double")
    rows = {r["frame"]: r for r in P.sample_table(boxes, P.instance_labels(boxes, points)).collect()}
    assert rows[1]["labels"] == [0, 1, -1, 0] and rows[2]["labels"] is None
    assert sum(rows[1]["mask"]) == 2 and len(rows[1]["boxes"]) == len(rows[1]["mask"]) == P.MOST_BOXES
    assert rows[1]["boxes"][2:] == [[0.0] * 7] * (P.MOST_BOXES - 2) and rows[1]["boxes"][1] == [0.0, 8.0, 0.0, 2.0, 2.0, 2.0, 0.0]


def test_subword_offsets(spark):
    text = "a carpet, aaa aaaaaa . x"
    got = spark.range(1).select(A.subword_offsets(F.lit(text), 3).alias("t")).first()["t"]
    assert [text[t["start"] : t["end"]] for t in got] == [t["word"] for t in got] == ["a", "car", "pet", ",", "aaa", "aaa", "aaa", ".", "x"]
    assert [t["start"] for t in got] == sorted({t["start"] for t in got})


def test_lens_and_back(spark):
    rows = [(random.Random(i).uniform(-0.6, 0.6), random.Random(i + 99).uniform(-0.4, 0.4)) for i in range(50)]
    held = spark.createDataFrame(rows, "x double, y double")
    bent = held.withColumns(dict(zip("uv", G.distort(F.col("x"), F.col("y"), **P.LENS))))
    back = bent.withColumn("b", G.undistort(F.col("u"), F.col("v"), **P.LENS, steps=30)).collect()
    assert all(abs(r["b"]["x"] - r["x"]) < 1e-9 and abs(r["b"]["y"] - r["y"]) < 1e-9 for r in back)
    assert max(abs(r["u"] - r["x"]) for r in back) > 0.02
    flat = held.select(*G.distort(F.col("x"), F.col("y"), (0.0, 0.0, 0.0), (0.0, 0.0))).collect()
    assert [tuple(r) for r in flat] == rows


def test_draws_do_not_depend_on_partitions(spark):
    held = spark.range(20_000).select("id", uniform("s", F.col("id")).alias("u"), normal("s", F.col("id")).alias("n"))
    u, n = (np.array([r[c] for r in held.collect()]) for c in "un")
    assert 0 < u.min() < u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs(n.mean()) < 0.03 and abs(n.std() - 1) < 0.02
    again = held.repartition(7).select("id", uniform("s", F.col("id")).alias("u")).orderBy("id").collect()
    assert [r["u"] for r in again] == u.tolist()


def test_augmentation_keeps_what_boxes_hold(spark):
    rng = random.Random(3)
    boxes = [(f, k, *(rng.uniform(-r, r) for r in (4, 4, 1)), rng.uniform(1, 6), rng.uniform(1, 4), rng.uniform(1, 3), rng.uniform(-3, 3)) for f in range(12) for k in range(6)]
    points = [(f, i, *(rng.uniform(-r, r) for r in (6, 6, 3))) for f in range(12) for i in range(300)]
    held, cloud = spark.createDataFrame(boxes, BOXES), spark.createDataFrame(points, "frame long, idx int, x double, y double, z double")
    moved, stirred = augment.moved(held, "t", ["frame"], box=True), augment.moved(cloud, "t", ["frame"])

    def inside(b, p):
        met = b.join(p.select("frame", "idx", *[F.col(c).alias(f"p{c}") for c in "xyz"]), "frame")
        return sorted((r["frame"], r["k"], r["idx"]) for r in met.where(G.in_box(F.col("px"), F.col("py"), F.col("pz"), tuple(F.col(c) for c in M.BOX))).collect())

    assert len(inside(held, cloud)) > 40 and inside(held, cloud) == inside(moved, stirred)

    def ious(b):
        rows = {(r["frame"], r["k"]): [r[c] for c in M.BOX] for r in b.collect()}
        left, right = zip(*((rows[f, 0], rows[f, k]) for f in range(12) for k in range(1, 6)))
        return S.rotated_ious(np.array(left), np.array(right))

    assert ious(held).max() > 0.05 and np.allclose(ious(held), ious(moved), atol=1e-9)
    turns = {round(r["t"], 6) for r in held.select(augment.drawn("t", F.col("frame"))["turn"].alias("t")).collect()}
    assert len(turns) == 12
    noisy = augment.moved(cloud, "t", ["frame"], noise=["idx"]).join(stirred.selectExpr("frame", "idx", "x as x0"), ["frame", "idx"])
    gaps = np.array([r["x"] - r["x0"] for r in noisy.collect()])
    assert abs(gaps.std() - augment.NOISE) < 0.0005


def test_profile_of_documents(spark):
    docs = ['{"a": 1, "b": [{"c": null}, {"c": "x"}]}', '{"a": "t", "b": []}', '{"a": {"d": true}}', "[1]", "3"]
    rows = {r["path"]: r for r in P.path_profile(spark.createDataFrame([(d,) for d in docs], "doc string"), "doc").collect()}
    assert rows["$"]["n"] == 5 and rows["$"]["kinds"] == "array,number,object"
    assert rows["$.a"]["kinds"] == "number,object,string" and rows["$.b[*].c"]["null_rate"] == 0.5
    assert rows["$.a.d"]["kinds"] == "boolean" and rows["$[*]"]["n"] == 1 and rows["$.b"]["rate"] == 0.4
    deep = json.dumps({"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}})
    assert max(len(r["path"].split(".")) for r in P.path_profile(spark.createDataFrame([(deep,)], "doc string"), "doc", 3).collect()) == 4


def test_reasons_add_up(spark):
    counts = P.eligibility_chain(spark, "/root/testdata/sf0.001").orderBy("place").collect()
    assert [r["reason"] for r in counts] == P.REASONS
    assert counts[0]["reached"] == sum(r["n"] for r in counts) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert all(a["reached"] - a["n"] == b["reached"] for a, b in zip(counts, counts[1:]))


def test_functions_from_sql(spark):
    SQL.register(spark)
    got = spark.sql("SELECT c.id, m.* FROM VALUES (1, 'a fire truck and a truck'), (2, 'carpet'), (3, NULL) c(id, caption), LATERAL mentions_of(c.caption, array('truck', 'fire truck')) m ORDER BY id, nth").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 12, "fire truck"), (1, 2, 19, 24, "truck")]
    assert spark.sql("SELECT mentions('a truck', array('truck'))[0].start AS s").first()["s"] == 2
    iou = spark.sql("SELECT rotated_iou(array(0d, 0d, 0d, 2d, 2d, 2d, 0d), array(1d, 0d, 0d, 2d, 2d, 2d, 0d)) AS a, rotated_iou(array(0d, 0d, 0d, 2d, 2d, 2d, 0d), array(0d)) AS b").first()
    assert iou["a"] == pytest.approx(1 / 3) and iou["b"] == 0.0
