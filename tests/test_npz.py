"""Array shards: round trips, pruning, foreign shards and failed jobs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenova.sources import npz

SCHEMA = "id long, score double, flag boolean, name string, vec array<float>, boxes array<array<double>>, tags array<string>"


@pytest.fixture(scope="module")
def source(spark):
    npz.register(spark)
    return spark


def rows():
    return [
        (1, 0.5, True, "a", [1.0, 2.0], [[1.0, 2.0, 3.0]], ["x", "yy"]),
        (2, None, None, None, None, None, None),
        (3, float("nan"), False, "", [], [], []),
        (4, -1.0, True, "日本語", [3.0], [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], ["z"]),
    ]


def test_round_trip(source, tmp_path):
    held = source.createDataFrame(rows() * 5, SCHEMA).repartition(3)
    held.write.format("npz").option("rows", 4).mode("append").save(str(tmp_path))
    back = source.read.format("npz").schema(SCHEMA).load(str(tmp_path))
    assert sorted(map(str, back.collect())) == sorted(map(str, held.collect()))
    assert back.rdd.getNumPartitions() == len([f for f in os.listdir(tmp_path) if f.endswith(".npz")]) >= 5
    pruned = source.read.format("npz").schema("file string, row int, id long").load(str(tmp_path))
    assert pruned.select("id").groupBy("id").count().orderBy("id").collect() == [(i, 5) for i in (1, 2, 3, 4)]
    assert pruned.where("row = 0").count() == back.rdd.getNumPartitions() and pruned.select("file").distinct().count() == back.rdd.getNumPartitions()
    held.write.format("npz").mode("overwrite").save(str(tmp_path))
    assert source.read.format("npz").schema("id long").load(str(tmp_path)).count() == 20


def test_foreign_shards(source, tmp_path):
    os.makedirs(tmp_path / "rank00")
    np.savez_compressed(tmp_path / "rank00/batch000001.npz", target_count=np.array([1, 1], np.int32), object_token=np.ones((2, 4), np.float32), meta_path=np.array(["p", "q"]), unread=np.array([object()], object))
    np.savez_compressed(tmp_path / "rank00/batch000000.npz", target_count=np.array([2], np.int32), object_token=np.full((1, 2, 4), 2, np.float32), meta_path=np.array(["r"]))
    got = source.read.format("npz").schema("row int, target_count int, object_token array<array<float>>, meta_path string").load(str(tmp_path)).collect()
    assert [(r["meta_path"], r["row"], len(r["object_token"])) for r in got] == [("r", 0, 2), ("p", 0, 1), ("q", 1, 1)]


def test_a_failed_job_leaves_nothing(source, tmp_path):
    ok = source.range(10).select("id")
    ok.write.format("npz").mode("append").save(str(tmp_path))
    before = sorted(os.listdir(tmp_path))
    ragged = source.range(40, numPartitions=4).select("id", F.when(F.col("id") == 39, F.array(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).otherwise(F.array(F.array(F.lit(1.0)))).alias("boxes"))
    with pytest.raises(Exception, match="one length"):
        ragged.write.format("npz").option("rows", 2).mode("append").save(str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == before
    np.savez(tmp_path / "part-of-a-lost-task.npz", id=np.arange(5))
    assert source.read.format("npz").schema("id long").load(str(tmp_path)).count() == 10
