"""Matching of predicted and true boxes against a walk over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenova.operators import matching as M
from scenova.operators import neighbours as N
from scenova.operators import sequential as S
from scenova.operators.ranks import area_under, precision_recall
from scenova.plans import detection as D
from scenova.plans.registry import QUERIES


def plain_iou(a, b):
    inter = 1.0
    for k in range(3):
        inter *= max(0.0, min(a[k] + a[k + 3] / 2, b[k] + b[k + 3] / 2) - max(a[k] - a[k + 3] / 2, b[k] - b[k + 3] / 2))
    return inter / (a[3] * a[4] * a[5] + b[3] * b[4] * b[5] - inter)


def turned(a, b):
    p, q = np.array([a]), np.array([b])
    high = max(0.0, min(a[2] + a[5] / 2, b[2] + b[5] / 2) - max(a[2] - a[5] / 2, b[2] - b[5] / 2))
    inter = float(S.shared_areas(S.footprints(p), S.footprints(q))[0]) * high
    return inter / (a[3] * a[4] * a[5] + b[3] * b[4] * b[5] - inter)


def walk(guesses, truths, iou, threshold):
    """AP and last recall of one class, prediction by prediction."""
    taken, tps = set(), []
    for frame, gid, score, box in sorted(guesses, key=lambda g: (-g[2], g[1])):
        scored = [(iou(box, t), tid) for f, tid, t in truths if f == frame]
        best, tid = max(scored, key=lambda s: (s[0], [-ord(c) for c in s[1]])) if scored else (0, None)
        tps.append(best > threshold and (frame, tid) not in taken)
        if best > threshold:
            taken.add((frame, tid))
    tp = np.cumsum(tps)
    recall, precision = tp / (len(truths) + 1e-8), tp / np.arange(1, len(tp) + 1)
    envelope = np.maximum.accumulate(precision[::-1])[::-1]
    return round(float((np.diff(np.r_[0, recall]) * envelope).sum()), 6), round(float(recall[-1]), 6)


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(4)
    near = lambda c, r: c + rng.choice([0, 0, rng.uniform(-r, r)])
    truths, guesses = [], []
    for frame in range(6):
        for k in range(12):
            box = [rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(-1, 1), rng.uniform(1, 30 if k == 0 else 6), rng.uniform(1, 4), rng.uniform(1, 3), rng.uniform(-3, 3)]
            truths.append((frame, k % 2, f"t{k:02}", *box))
        for k, t in enumerate(rng.choices([t for t in truths if t[0] == frame], k=25)):
            guesses.append((frame, t[1], f"g{k:02}", float(rng.randrange(20)), *[near(v, 1.0) if i < 3 else v for i, v in enumerate(t[3:])]))
    guesses.append((99, 0, "g00", 5.0, *[0.0] * 3, 1.0, 1.0, 1.0, 0.0))  # a frame without truths
    cols = ", ".join(f"{c} double" for c in M.BOX)
    return guesses, truths, spark.createDataFrame(guesses, f"frame long, category int, guess_id string, score double, {cols}"), spark.createDataFrame(truths, f"frame long, category int, truth_id string, {cols}")


@pytest.mark.parametrize("is_turned", [False, True])
def test_average_precision(boxes, is_turned):
    guesses, truths, g, t = boxes
    iou = turned if is_turned else plain_iou
    best = M.best_overlaps(g, t, ["frame", "category"], turned=is_turned, iou=D.turned_iou if is_turned else M.aligned)
    hits = M.greedy_hits(best, ["frame", "category"], [0.25, 0.5]).withColumnRenamed("guess_id", "object_id")
    keys = ["threshold", "category"]
    for rows_in_bucket in (200_000, 5):
        found = area_under(precision_recall(hits, rows_in_bucket, keys=keys, positives=t.groupBy("category").agg(F.count("*").alias("npos"))), keys).collect()
        assert len(found) == 4
        for r in found:
            mine = [(f, i, s, b) for f, c, i, s, *b in guesses if c == r["category"]]
            assert (r["ap"], r["recall"]) == pytest.approx(walk(mine, [(f, i, b) for f, c, i, *b in truths if c == r["category"]], iou, r["threshold"]), abs=2e-6)
            assert r["n"] == len(mine)


def test_best_overlap_is_another_objects(spark):
    cols = "frame long, category int, {} string, x double, y double, z double, l double, w double, h double, yaw double"
    truths = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0), (1, 0, "b", 10.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0), (1, 0, "c", 10.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0)], cols.format("truth_id"))
    guesses = spark.createDataFrame([(1, 0, "a", 10.5, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0), (1, 0, "b", 0.0, 0.5, 0.0, 2.0, 2.0, 2.0, 0.0), (1, 0, "n", 50.0, 50.0, 0.0, 2.0, 2.0, 2.0, 0.0), (2, 0, "m", 0.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0)], cols.format("guess_id"))
    best = {(r["frame"], r["guess_id"]): (r["truth_id"], r["iou"]) for r in M.best_overlaps(guesses, truths, ["frame", "category"]).collect()}
    assert best[1, "a"] == ("b", pytest.approx(0.6)) and best[1, "b"] == ("a", pytest.approx(0.6))
    assert best[1, "n"] == best[2, "m"] == (None, None)


def test_any_match(boxes):
    guesses, truths, g, t = boxes
    for r in M.any_match(g, t, ["frame"], thresholds=[0.25, 0.5], confidence=7.0).collect():
        sure = [(f, b) for f, _, _, s, *b in guesses if s > 7]
        reach = [[plain_iou(b, u) >= r["threshold"] if f == k else False for k, _, _, *u in truths] for f, b in sure]
        tp, fn = sum(map(any, reach)), len(truths) - sum(map(any, zip(*reach)))
        assert (r["tp"], r["fp"], r["fn"]) == (tp, len(sure) - tp, fn) and r["recall"] == round(tp / (tp + fn), 6)
    none = M.any_match(g.where("false"), t, ["frame"], thresholds=[0.5], confidence=0.0).collect()[0]
    assert (none["tp"], none["fp"], none["fn"], none["precision"]) == (0, 0, len(truths), 0.0)


@pytest.mark.parametrize("is_turned", [False, True])
def test_frames_in_rows_match_as_the_join_does(boxes, is_turned):
    _, _, g, t = boxes
    keys, cuts = ["frame", "category"], [0.25, 0.5]
    best = M.best_overlaps(g, t, keys, turned=is_turned, iou=D.turned_iou if is_turned else M.aligned)
    hits = {(r["frame"], r["category"], r["guess_id"], r["threshold"]): r["tp"] for r in M.greedy_hits(best, keys, cuts).collect()}
    listed = lambda df, *c: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(c[0]).alias("idx"), *c[1:], *M.BOX))).alias(c[0][0]))
    rows = listed(g, "guess_id", "score").join(listed(t, "truth_id"), keys, "left")
    masks = rows.withColumn("tp", M.masks_in_rows(F.col("g"), F.col("t"), cuts, turned=is_turned)).collect()
    found = {(r["frame"], r["category"], v["idx"], c): m >> k & 1 for r in masks for v, m in zip(r["g"], r["tp"]) for k, c in enumerate(cuts)}
    assert found == hits and sum(hits.values()) > 20
    assert {(*[r[c] for c in (*keys, "guess_id")], r["tp"]) for r in M.greedy_masks(best, keys, cuts).collect()} == {(r["frame"], r["category"], v["idx"], m) for r in masks for v, m in zip(r["g"], r["tp"])}


def test_large_frames_and_many_buckets_give_the_same(spark, monkeypatch):
    plain = D.detection_ap(spark, "/root/testdata/sf0.001").orderBy("threshold", "category").collect()
    monkeypatch.setattr(D.N, "WHOLE", 6)
    whole = D.areas_of_masks
    monkeypatch.setattr(D, "areas_of_masks", lambda *a: whole(*a, rows_in_bucket=90))
    assert D.detection_ap(spark, "/root/testdata/sf0.001").orderBy("threshold", "category").collect() == plain and len(plain) > 4


def test_objects_are_read_once(spark):
    """Files read for all steps of one call: objects are joined once, not once for each use."""
    plan = D.detection_ap(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan


@pytest.mark.parametrize("name", ["best_overlap", "match_precision"])
def test_frames_are_matched_in_their_row(spark, name, monkeypatch):
    """Before, both sides were joined anew, spread over grid cells and exchanged. Larger frames still are, with the same results."""
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "lineitem" not in plan and plan.count("Exchange") <= 1
    want = sorted(map(str, found.collect()))
    monkeypatch.setattr(N, "WHOLE", 6)
    assert sorted(map(str, QUERIES[name](spark, "/root/testdata/sf0.001").collect())) == want and want


def test_rows_reach_as_the_join_does(boxes):
    _, _, g, t = boxes
    cuts = [0.25, 0.5]
    listed = lambda df, *c: df.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct(F.col(c[0]).alias("idx"), *c[1:], *M.BOX))).alias(c[0][0]))
    for one in (g, g.unionByName(g.withColumn("x", F.col("x") + 0.5))):  # ids that repeat count once
        rows = listed(one, "guess_id", "score").join(listed(t, "truth_id"), "frame", "left")
        got = [sum(r["n"][k] for r in rows.select(M.reached_in_rows(F.col("g"), F.col("t"), cuts).alias("n")).collect()) for k in range(4)]
        want = M.any_counts(one, t, ["frame"], thresholds=cuts, confidence=-1.0).first()
        assert got == [*want["by_guess"], *want["by_truth"]] and min(got) > 5
