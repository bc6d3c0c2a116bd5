"""Readers, writers, scene algorithms and text rules on small fixtures."""

import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenova.functions import geometry as G
from scenova.functions import text as T
from scenova.operators import neighbours as N
from scenova.operators import sampling
from scenova.operators import sequential as S
from scenova.operators.ranks import area_under, hash_rank, precision_recall
from scenova.plans.registry import QUERIES
from scenova.sources import readers as R
from scenova.sources import sinks as K
from scenova.streaming import questions as Q


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def iou(a, b):
    return S.rotated_ious(np.array([a], float), np.array([b], float))[0]


def test_unit_cubes():
    cube = lambda x, s: [x, 0, 0, s, s, s, 0.0]
    assert iou(cube(0, 1), cube(0, 2)) == pytest.approx(1 / 8)
    assert iou(cube(0, 1), cube(5, 1)) == 0
    assert iou(cube(0, 1), cube(0, 1)) == pytest.approx(1) and iou(cube(0, 1), cube(1, 1)) == pytest.approx(0)
    assert iou(cube(0, 1), [0, 0, 0, 1, 1, 1, np.pi / 2]) == pytest.approx(1)
    turned = iou(cube(0, 1), [0, 0, 0, 1, 1, 1, np.pi / 4])
    both = 2 * (np.sqrt(2) - 1)
    assert turned == pytest.approx(both / (2 - both))
    assert iou(cube(0, 0), cube(0, 1)) == 0 and iou(np.full(7, np.nan), cube(0, 1)) == 0


def clipped(subject, window):
    """The part of a convex polygon inside another one, edge by edge."""
    out = list(subject)
    for a, b in zip(window, np.roll(window, -1, axis=0)):
        held, out = out, []
        side = [float(np.cross([*(b - a), 0], [*(p - a), 0])[2]) for p in held]
        for k, p in enumerate(held):
            if (side[k] >= 0) != (side[k - 1] >= 0):
                out.append(held[k - 1] + (p - held[k - 1]) * (side[k - 1] / (side[k - 1] - side[k])))
            if side[k] >= 0:
                out.append(p)
    x, y = np.array(out).T if len(out) > 2 else np.zeros((2, 1))
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def test_shared_areas_are_those_of_clipping(spark):
    rng = np.random.default_rng(5)
    boxes = np.column_stack([rng.normal(size=(400, 3)), rng.uniform(0.3, 3, (400, 3)), rng.choice([*rng.uniform(-4, 4, 30), 0, np.pi / 2, np.pi / 4], 400)])
    p, q = S.footprints(boxes[:200]), S.footprints(np.where(rng.random((200, 1)) < 0.2, boxes[:200] + [0.25, 0, 0, 0, 0, 0, 0], boxes[200:]))
    assert np.allclose(S.shared_areas(p, q), [clipped(a, b) for a, b in zip(p, q)], atol=1e-6)
    rows = [(boxes[0].tolist(), boxes[0].tolist()), (None, boxes[1].tolist()), ([1.0, 2.0], boxes[1].tolist()), (boxes[2].tolist(), boxes[2].tolist())]
    found = spark.createDataFrame(rows, "a array<double>, b array<double>").select(S.rotated_iou(F.col("a"), F.col("b")).alias("v")).collect()
    assert [round(r["v"], 9) for r in found] == [1, 0, 0, 1]


def test_nearest_in_large_clouds(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, n in enumerate((1, 3, 90, 200)):
        x = np.concatenate([rng.normal(size=(n // 2, 3)), rng.normal(size=(n - n // 2, 3)) * 1e-3 + 5])
        x[: n // 6] = x[0]
        rows += [(k, i, f"{k}-{i}", *map(float, v)) for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, "scene_id long, idx int, point_id string, x double, y double, z double")
    want = set()
    for k, i, _, *v in rows:
        others = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for q, j, _, *w in rows if q == k and j != i)
        want |= {(k, i, rank, j) for rank, (_, j) in enumerate(others[:3], 1)}
    for whole in (512, 3):
        assert {(r["scene_id"], r["idx"], r["rank"], r["p_idx"]) for r in N.three_nearest(points, whole=whole).collect()} == want


def test_curves_in_buckets_are_the_curves(spark):
    rng = random.Random(2)
    rows = [(c, float(rng.randint(0, 60)), f"o{i}", int(rng.random() < 0.4)) for c in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "category int, score double, object_id string, tp int")
    told = [sorted(map(tuple, area_under(precision_recall(df, n)).collect())) for n in (10**9, 7)]
    assert told[0] == told[1]
    ranked = hash_rank(df, ["category"], F.sha1("object_id"), "rn").collect()
    by = {c: sorted((r for r in ranked if r["category"] == c), key=lambda r: r["rn"]) for c in range(3)}
    assert all([r["rn"] for r in v] == list(range(1, 201)) and [r["object_id"] for r in v] == sorted((r["object_id"] for r in v), key=lambda o: hashlib.sha1(o.encode()).hexdigest()) for v in by.values())


def test_short_passages_are_found(spark, tmp_path):
    passages = ["one two", "a, b c d", "the quick brown fox jumps", "alone", "x y z u v w and more words here", "never there at all"]
    texts = ["so one two-step", "(a, b c d)", "see:the quick brown fox jumps.", "standalone", "ax y z u v w and more words hereby", "x y z u v w", None, ""]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["item_id"]: r["docs"] for r in QUERIES["benchmark_leaks"](spark, str(tmp_path)).collect()}
    assert found == {i: n for i, p in enumerate(passages) if (n := sum(p in (t or "") for t in texts))}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 3), st.integers(0, 10_000))
def test_assignment_is_cheapest(n, more, seed):
    cost = np.random.default_rng(seed).integers(0, 20, (n, n + more)).astype(float)
    found = S.assignment(cost)
    best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n + more), n))
    assert len(set(found)) == n and sum(cost[i, j] for i, j in enumerate(found)) == best


def test_farthest_points_by_brute_force(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(60, 3))
    held = spark.createDataFrame([(7, f"p{i}", i, *map(float, p)) for i, p in enumerate(points)], "scene_id long, point_id string, idx int, x double, y double, z double")
    out = [0]
    while len(out) < 10:
        out.append(max(range(60), key=lambda i: (min(((points[i] - points[j]) ** 2).sum() for j in out), -i)))
    assert [int(r["point_id"][1:]) for r in sampling.farthest_points(held, 10).orderBy("place").collect()] == out
    near = held.withColumns({c: F.when(F.col("idx") == 5, 0.01).otherwise(F.col(c)) for c in "xyz"})
    assert 5 not in [int(r["point_id"][1:]) for r in sampling.farthest_points(near, 30, skip_origin=True).collect()]


def test_farthest_points_of_many_scenes(spark):
    rows = [(s, f"p{i}", i, float(i), float((i * 7) % 5), 0.0) for s in range(30) for i in range(10)]
    df = spark.createDataFrame(rows, "scene_id long, point_id string, idx int, x double, y double, z double")
    found = sampling.farthest_points(df, 3).collect()
    assert len(found) == 90 and {r["point_id"] for r in found if r["place"] == 0} == {"p0"}
    assert sampling.farthest_points(df.where("false"), 3).count() == 0


def test_local_plan(spark):
    box = lambda x, y, w, k: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), F.lit(k).alias("ord"))
    assert value(spark, G.local_plan(F.array(box(30.0, 0.0, 2.0, 0)))) is None
    blocked = value(spark, G.local_plan(F.array(box(10.0, 0.0, 2.0, 0))))
    assert (blocked["steer"], blocked["pass_side"], blocked["blocker"]) == ("left", "left", 0)
    wall = [box(12.0, float(y), 2.0, y + 6) for y in range(-6, 7, 2)]
    assert value(spark, G.local_plan(F.array(*wall)))["steer"] == "stop"


@pytest.mark.parametrize("dx, dy, sector, zone, dominant", [(4.0, 4.0, "front", "left_front", "front"), (-4.0, 4.0, "left", "left_behind", "behind"), (0.0, -4.0, "right", "right", "right"), (-4.0, -4.0, "right", "right_behind", "behind"), (0.5, 0.5, "front", None, None), (4.0, 0.5, "front", "front", "front")])
def test_relation_families(spark, dx, dy, sector, zone, dominant):
    x, y = F.lit(dx), F.lit(dy)
    assert value(spark, G.sector(x, y)) == sector
    assert value(spark, G.dead_zone_relation(x, y)) == zone
    assert value(spark, G.dominant_relation(x, y)) == dominant


def test_answers(spark):
    read = lambda s: value(spark, T.parse_answer(F.lit(s))).asDict()
    assert read("It is to the left and in front of it, 3.2 m away.") == {"lateral": "left", "longitudinal": "front", "distance": 3.2, "format_ok": True}
    assert read("left or right, behind")["lateral"] is None and not read("")["format_ok"]
    assert value(spark, T.one_sentence(F.lit("It is 3.5 meters away."))) and not value(spark, T.one_sentence(F.lit("One. Two.")))
    assert value(spark, T.in_order(F.lit("The red car is behind the blue van."), F.array(F.lit("the red car"), F.lit("the blue van"))))
    assert not value(spark, T.in_order(F.lit("The blue van is behind the red car."), F.array(F.lit("the red car"), F.lit("the blue van"))))
    none, far = F.lit(None).cast("string"), F.lit(3.2)
    metric = lambda s: value(spark, T.triple_ok(F.lit(s), F.lit("metric_distance"), F.lit("the car"), F.lit("distance_from"), F.lit("the van"), none, far, none))
    assert metric("The car is 3.2 meters from the van.") and not metric("The car is 3.4 meters from the van.") and not metric("The van is 3.2 meters from the car.")
    assert value(spark, T.extract_triples(F.lit("Object A is to the left of and behind Object B."))) == ["A behind B", "A left B"]
    assert value(spark, T.parsed_key(F.lit("ego_near_far"), F.lit("It is far away."))) == "far"
    assert value(spark, T.short_expression(F.lit("This is a red car, located near the gate."))) == "a red car"
    assert value(spark, T.short_expression(F.lit("Object type: Truck, appearance features: white cab; tall"))) == "truck white cab"
    assert value(spark, T.half_even(F.lit(0.25))) == "0.2" and value(spark, T.half_even(F.lit(0.35))) == "0.3"


def test_mentions():
    assert T.find_mentions("a fire truck and a truck", ["truck", "fire truck"]) == [(2, 12, "fire truck"), (19, 24, "truck")]
    assert T.find_mentions(None, ["car"]) == [] and T.find_mentions("carpet", ["car"]) == []


def test_secondary_mentions(spark):
    text = "a red truck is parked; the truck is tall. There is a small white truck. It stands behind the truck."
    main = T.find_mentions(text, ["truck"])[0]
    found = value(spark, T.secondary_mentions(F.lit(text), T.category_mentions(F.lit(text), F.array(F.lit("truck"))), F.lit(main[1])))
    assert [text[m["start"] - 6 : m["end"]] for m in found] == ["white truck"]
    for clause, yes in ((" and a big", True), (" a guardrail is behind the", False), ("", False), (" with one two three four five six seven", True), (" with one two three four five six seven eight", False), (" near ", True), (" near the left", False), ("Relationship with the surrounding environment : big", True)):
        assert value(spark, T.introduced(F.lit(clause))) == yes, clause


def test_plan_phrases(spark):
    none = F.lit(None).cast("string")
    ok = lambda s, kind, safe, steer, side, blocker: value(spark, T.plan_phrase_ok(F.lit(s), F.lit(kind), F.lit(safe), F.lit(steer), F.lit(side) if side else none, F.lit(blocker) if blocker else none))
    assert ok("The ego should stop.", "plan", None, "stop", None, None)
    assert ok("Steer left and continue forward, passing to the left of Object B.", "plan", None, "left", "left", "B")
    assert not ok("Steer left and continue forward, passing to the right of Object B.", "plan", None, "left", "left", "B")
    assert ok("It is safe.", "candidate_maneuver_safety", True, "left", None, None) and not ok("It is safe.", "candidate_maneuver_safety", False, "left", None, None)
    assert value(spark, T.summary_part(F.lit("x Summary: a car "))) == "a car"


def frame(root, platform, sequence, name, held):
    path = root / platform / sequence / name
    path.mkdir(parents=True)
    (path / "meta_info.json").write_text(held if isinstance(held, str) else json.dumps(held))


def test_raw_frames(spark, tmp_path):
    box = [1.0, 2, 3, 4, 2, 1.5, 0.1, 0, 0]
    frame(tmp_path, "car", "s1", "f_0", {"ground_info": [{"class": "Car", "caption": "a car", "bbox_3d": box, "others": [{"class_other": "Bus", "bbox_3d_other": box}], "others_num": 1}, {"class": "Bus", "caption": "b", "bbox_3d": [1, 2]}]})
    frame(tmp_path, "car", "s1", "f_1", {"ground_info": []})
    frame(tmp_path, "drone", "s2", "f_0", "{broken")
    frames = R.raw_frames(spark, str(tmp_path)).cache()
    assert {(r["platform"], r["frame"], r["status"]) for r in frames.collect()} == {("car", "f_0", "ok"), ("car", "f_1", "empty"), ("drone", "f_0", "unreadable")}
    objects = R.frame_objects(frames).orderBy("ord").collect()
    assert [r["reason"] for r in objects] == ["ok", "short_box"] and objects[0]["box"] == box[:7]
    assert R.nested_boxes(R.frame_objects(frames)).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "splits").mkdir()
    (tmp_path / "splits" / "train.txt").write_text("a\nb\n\n")
    (tmp_path / "splits" / "val.txt").write_text("b\nc\n")
    assert {r["sequence"]: r["split"] for r in R.split_map(spark, str(tmp_path / "splits")).collect()} == {"a": "train", "b": "val", "c": "val"}
    points = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "p.bin").write_bytes(points.tobytes())
    assert [(r["x"], r["intensity"]) for r in R.lidar(spark, str(tmp_path)).orderBy("point_idx").collect()] == [(0.0, 3.0), (4.0, 7.0), (8.0, 11.0)]
    np.savez(tmp_path / "a.npz", token=np.ones((2, 3), np.float32), query=np.array([5, 6]))
    rows = R.npz_rows(spark, str(tmp_path), {"token": "array<float>", "query": "long"}).orderBy("row").collect()
    assert [(r["row"], r["query"], r["token"]) for r in rows] == [(0, 5, [1.0] * 3), (1, 6, [1.0] * 3)]
    (tmp_path / "r.json").write_text('{"rows": [{"qa_id": "1", "prediction": "x"}]}')
    (tmp_path / "l.json").write_text('{"qa_id": "2", "prediction": "y"}\n\n{"qa_id": "3", "prediction": "z"}\n')
    assert {r["qa_id"] for f in "rl" for r in R.predictions_any(spark, str(tmp_path / f"{f}.json")).collect()} == {"1", "2", "3"}
    (tmp_path / "log.txt").write_text("head\nEPOCH 1 \x1b[32macc=0.5\x1b[0m\rmiou=0.4\nEPOCH 2 acc=0.7\n")
    found = {(r["epoch"], r["name"]): r["value"] for r in R.log_metrics(spark, str(tmp_path / "log.txt"), "EPOCH", r"(\w+)=([0-9.]+)").collect()}
    assert found == {(1, "acc"): 0.5, (1, "miou"): 0.4, (2, "acc"): 0.7}
    (tmp_path / "c.csv").write_text("scan_id,mentions_target_class,tokens\ns1,True,\"['a', 'b']\"\ns2,True,[]\ns1,False,[]\n")
    rows = R.csv_annotations(spark, str(tmp_path / "c.csv"), spark.createDataFrame([("s1",)], "scan_id string")).collect()
    assert [r["tokens"] for r in rows] == [["a", "b"]]
    wide = R.wide_to_array(spark.createDataFrame([(1, "a", None, "c")], "id int, w_1 string, w_2 string, w_3 string"), "w")
    assert wide.first()["w"] == ["a", "c"]
    words = R.synonyms(spark, {"t": {"car": ["car", "sedan"]}})
    assert words.count() == 2


def test_ordinals(spark):
    keys = random.Random(1).sample(range(10_000), 500)
    rows = R.with_ordinal(spark.createDataFrame([(k,) for k in keys], "k int"), ["k"]).orderBy("k").collect()
    assert [r["bank_index"] for r in rows] == list(range(500))


SCENE = {"scene_id": "s", "split": "train", "platform": "p", "sequence": "q", "objects": [{"object_id": f"s#{i}", "role": "referred", "category": "car", "referring_expressions": [{"text": t, "source": "x", "language": "en"}], "gt_box": {"center": [4.0, y, 0.0], "size": [4.0, 2.0, 1.5], "yaw_rad": 0.0, "frame": "f"}} for i, (t, y) in enumerate((("The  red car", -3.2), ("the red car", 0.0)))]}


def test_scene_stream_is_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(SCENE) + "\n")
    batch = R.scenes(spark, str(tmp_path / "in"))
    assert {r["caption"]: r["object_id"] for r in R.caption_index(R.scene_objects(batch)).collect()} == {"the red car": "s#1"}
    want = {(r["a_id"], r["relation"], round(r["distance"], 1)) for r in Q.questions(batch).collect()}
    assert want == {("s#0", "right", 3.2), ("s#1", "left", 3.2)}
    run = Q.questions(Q.scene_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("asked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {(r["a_id"], r["relation"], round(r["distance"], 1)) for r in spark.table("asked").collect()} == want


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "text", 1.0, "train"), ("q2", "more", 2.0, "val")], "qa_id string, question string, dx double, split string")
    K.write_public_private(rows, str(tmp_path / "t"), ["qa_id", "question"])
    assert spark.read.parquet(str(tmp_path / "t/public")).columns == ["qa_id", "question"]
    with pytest.raises(ValueError):
        K.write_public_private(rows, str(tmp_path / "u"), ["qa_id", "dx"])
    with pytest.raises(ValueError):
        K.write_public_private(rows.unionByName(rows), str(tmp_path / "u"), ["qa_id"])
    K.write_variants({"joint": rows, "shuffled": rows}, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).where("variant = 'shuffled'").count() == 2
    K.write_split(rows, str(tmp_path / "s"))
    assert K.write_checked(rows, str(tmp_path / "w")) == 2
    K.write_jsonl(rows, str(tmp_path / "j"), ["qa_id"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert K.markdown(rows.select("qa_id").orderBy("qa_id")).endswith("| q2 |")
