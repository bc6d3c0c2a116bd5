"""Readers of layouts that Spark's own writers don't make, on small files."""

import gzip
import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenova.functions.ids import hash_order
from scenova.operators.ranks import next_in_order
from scenova.plans import files
from scenova.sources import readers as R
from scenova.sources import scans as V
from scenova.sources import sinks as K


def test_json_array_and_its_target(spark, tmp_path):
    rows = [{"scene_id": "s1", "object_id": "4", "object_name": "office_chair", "token": ["the", "chair"]}, {"scene_id": "s2", "object_id": "5", "token": []}]
    rows += [{"scene_id": "s3", "object_id": "6", "object_name": "trash_can", "token": ["blue,", "box"]}, {"scene_id": "s4", "object_id": "7", "object_name": "trash_can", "token": ["a", "trash", "can"]}]
    path = tmp_path / "all.json"
    path.write_text(json.dumps(rows, indent=1))
    told = lambda **how: [(r["scene_id"], r["utterance"], r["target"]) for r in R.json_array(spark, str(path), **how).orderBy("scene_id").collect()]
    # The whole name where it is said, else its last word; rows that say neither go, or take their first word.
    assert told() == [("s1", "the chair", "chair"), ("s4", "a trash can", "trash can")]
    assert told(keep_all=True) == [("s1", "the chair", "chair"), ("s2", "", ""), ("s3", "blue, box", "blue"), ("s4", "a trash can", "trash can")]
    known = spark.createDataFrame([("s4",), ("s4",), ("s9",)], "scene_id string")
    assert told(known=known) == [("s4", "a trash can", "trash can")]


def test_prediction_folders(spark, tmp_path):
    for name, iou in (("a", 0.5), ("b", 0.75)):
        (tmp_path / "deep" / name).mkdir(parents=True)
        (tmp_path / "deep" / name / "prediction.json").write_text(json.dumps({"id": name, "iou": iou}, indent=1))
        (tmp_path / "deep" / name / "other.json").write_text("{}")
    got = R.predictions(spark, str(tmp_path), "id string, iou double").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", 0.5), ("b", 0.75)]


def test_ply_vertices():
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 0\nproperty list uchar int vertex_indices\nend_header\n"
    body = struct.pack("<fffB", 1, 2, 3, 9) + struct.pack("<fffB", 4, 5, 6, 9)
    assert np.array_equal(R.ply_points(head + body), np.array([[1, 2, 3], [4, 5, 6]], np.float32))


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    for k in range(7):
        (tmp_path / f"p{k % 2}" / "seq" / str(k)).mkdir(parents=True)
        (tmp_path / f"p{k % 2}" / "seq" / str(k) / "meta_info.json").write_text('{"ground_info": [{"class": "Car"}]}' if k else '{"ground_info": [')
        (tmp_path / f"p{k % 2}" / "seq" / str(k) / "cloud.bin").write_bytes(struct.pack("<4f", k, 1, 2, 3) * k)
    (tmp_path / "_log.bin").write_bytes(b"x")
    frames = R.raw_frames(spark, str(tmp_path))
    assert not frames.inputFiles() or all("listing" in f for f in frames.inputFiles())  # no file of the layout is known to the driver
    assert sorted((r["platform"], r["sequence"], r["frame"], r["status"]) for r in frames.collect()) == sorted((f"p{k % 2}", "seq", str(k), "ok" if k else "unreadable") for k in range(7))
    points = R.lidar(spark, str(tmp_path)).collect()
    assert sorted((r["x"], r["point_idx"], r["intensity"]) for r in points) == sorted((float(k), i, 3.0) for k in range(7) for i in range(k))
    assert R.lidar(spark, str(tmp_path / "p1" / "seq" / "3" / "cloud.bin")).count() == 3


def test_next_in_order_of_a_hash(spark):
    rows = [(g, f"a{i % 40}", f"b{i}") for g, n in (("left", 90), ("right", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "answer string, a string, b string")
    for digits in (1, 3):
        found = next_in_order(df, ["answer"], lambda: hash_order("s", F.col("a")), ["a", "b"], digits).collect()
        assert len(found) == len(rows)
        for g in ("left", "right"):
            line = sorted((r for r in rows if r[0] == g), key=lambda r: (hashlib.sha1(f"s|{r[1]}".encode()).hexdigest(), r[1], r[2]))
            want = {r[1:]: line[(k + 1) % len(line)][1:] for k, r in enumerate(line)}
            assert {(r["a"], r["b"]): tuple(r["_next"]) for r in found if r["answer"] == g} == want


def test_variants_are_exchanged_once(spark, monkeypatch):
    """Three numbered exchanges of questions before: the order is found with one, the buckets' first rows apart."""
    seen = []
    monkeypatch.setattr(files.K, "write_variants", lambda v, path: (seen.append(v), spark.createDataFrame([("a", ["x", "y"], "left")], "variant string, refs array<string>, answer string").write.parquet(path)))
    files.variant_files(spark, "/root/testdata/sf0.001")
    plans = {name: df._jdf.queryExecution().executedPlan().toString() for name, df in seen[0].items()}
    assert all("lineitem" not in p and "l_orderkey" not in p for p in plans.values())
    assert "Exchange" not in plans["original"] + plans["swap_eval"] + plans["joint"] and plans["shuffled"].count("REPARTITION_BY_COL") == 1


def scan_files(folder, xyz, segs, groups):
    folder.mkdir(parents=True)
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(xyz)}\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    (folder / "a_clean_2.ply").write_bytes(head.encode() + np.array(xyz, "<f4").tobytes())
    (folder / "a.segs.json").write_text(json.dumps({"segIndices": segs}))
    (folder / "a.aggregation.json").write_text(json.dumps({"segGroups": [{"objectId": i, "label": w, "segments": s} for i, w, s in groups]}))


def test_scans_meet_their_files_in_one_task(spark, tmp_path):
    xyz = [(k, -k, 2 * k) for k in range(6)]
    # A vertex without a segment, a segment twice in a list, one that two objects share, an object listed again and one without points.
    scan_files(tmp_path / "s1", xyz, [0, 0, 1, None, 2], [(7, "one", [0, 0]), (8, "both", [0, 1]), (9, "again", [1, 0]), (10, None, [5]), (11, "none", None)])
    scan_files(tmp_path / "deep" / "s2", xyz, [3] * 6, [(1, "all", [3])])
    (tmp_path / "s3").mkdir()
    (tmp_path / "s3" / "a.segs.json").write_text("{}")  # no points: no scan
    got = {(r["scan"], r["object_id"], r["label"], r["points"]): r["box"] for r in V.object_boxes(spark, str(tmp_path)).collect()}
    assert got == {("s1", 7, "one", 2): [0.5, -0.5, 1.0, 1.0, 1.0, 2.0], ("s1", 8, "both", 3): [1.0, -1.0, 2.0, 2.0, 2.0, 4.0], ("s2", 1, "all", 6): [2.5, -2.5, 5.0, 5.0, 5.0, 10.0]}
    rows = spark.createDataFrame([("s2", k) for k in range(6)], "scan string, vertex int")
    kept = sorted(r["vertex"] for r in V.sampled(rows, 4).collect())
    assert V.drawn_places("s2", 6, 4).tolist() == kept
    few = V.object_boxes(spark, str(tmp_path / "deep"), 4).first()
    assert (few["points"], few["box"][3]) == (4, kept[-1] - kept[0])


def test_no_vertex_travels(spark):
    """Before, vertices, segments and objects of all scans were exchanged for two joins, and objects were joined once for each file."""
    plan = files.indoor_scans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "lineitem" not in plan


def test_variants_are_added_up_without_a_sort(spark):
    """Before, the least and largest donors were aggregated behind a sort of all written rows, which spilled."""
    plan = files.variant_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan and "Sort [" not in plan


def test_scene_documents_are_made_where_they_are_written(spark, tmp_path):
    """Before, whole documents were put in order and written unpacked: their names and constants were most of what was exchanged and written."""
    df = files.scene_documents(files.objects(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("rangepartitioning", 1)
    assert "referred" in above and "referred" not in below and "catalogue" not in below
    K.write_lines(df, str(tmp_path / "scenes"))
    parts = sorted((tmp_path / "scenes").glob("part-*"))
    lines = [json.loads(line) for p in parts for line in gzip.decompress(p.read_bytes()).decode().splitlines()]
    ids = [r["scene_id"] for r in lines]
    assert ids == sorted(ids) and len(ids) == len(set(ids)) > 100
    for r in lines:
        assert [o["object_id"] for o in r["objects"]] == sorted(o["object_id"] for o in r["objects"]) and r["frame"]["units"] == "metre"
    assert R.scene_objects(R.scenes(spark, str(tmp_path / "scenes"))).count() == files.objects(spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("name", ["scene_jsonl", "scene_caption_index"])
def test_scenes_are_written_packed(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(K, "shared_folder", lambda spark, name: str(tmp_path / name))
    found = getattr(files, name)(spark, "/root/testdata/sf0.001")
    parts = list((tmp_path / "scenes").glob("part-*"))
    assert parts and all(p.name.endswith(".json.gz") for p in parts) and found.count() > 1_000
    assert sum(p.stat().st_size for p in parts) * 5 < sum(len(gzip.decompress(p.read_bytes())) for p in parts)
