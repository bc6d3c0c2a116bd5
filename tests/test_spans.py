"""Assignment by columns against all permutations."""

import itertools
import math
import random

import pyarrow as pa
import pytest

from scenova.operators import assignment as A
from scenova.operators import neighbours as N
from scenova.plans import spans
from scenova.plans.registry import QUERIES


def test_contested_candidates(spark):
    rows = [("r", 0, 1, 0.9), ("r", 0, 2, 0.8), ("r", 1, 1, 0.7), ("r", 1, 3, 0.1), ("s", 0, 5, 0.4), ("s", 0, 4, 0.4)]
    held = spark.createDataFrame(rows, "frame string, target int, candidate long, score double")
    won = {(r["frame"], r["target"]): r["candidate"] for r in A.assigned(held, ["frame"]).collect()}
    assert won == {("r", 0): 2, ("r", 1): 1, ("s", 0): 4}
    top = sorted((r["frame"], r["target"], r["rank"], r["candidate"]) for r in A.top_with_assigned(held, ["frame"], 2).collect())
    # The assigned candidate stands first, and again where its score puts it.
    assert top == [("r", 0, 0, 2), ("r", 0, 1, 2), ("r", 1, 0, 1), ("r", 1, 1, 3), ("s", 0, 0, 4), ("s", 0, 1, 5)]


def test_largest_sums(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for frame in range(60):
        n, q = rng.randrange(1, 6), rng.randrange(5, 9)
        score = [[rng.randrange(6) / 8 for _ in range(q)] for _ in range(n)]
        rows += [(frame, t, c, score[t][c]) for t in range(n) for c in range(q)]
        want[frame] = min(itertools.permutations(range(q), n), key=lambda p: (-sum(score[t][c] for t, c in enumerate(p)), p))
    held = spark.createDataFrame(rows, "frame long, target int, candidate long, score double").repartition(3)
    found: dict = {}
    for r in A.assigned(held, ["frame"]).collect():
        found.setdefault(r["frame"], {})[r["target"]] = r["candidate"]
    assert {f: tuple(p[t] for t in sorted(p)) for f, p in found.items()} == want
    few = held.where("frame = 0 and candidate = 0 and target < 2")
    assert A.assigned(few.where("target = 0").unionByName(few.where("target = 0").selectExpr("frame", "1 as target", "candidate", "score")), ["frame"]).count() == 0
    assert A.assigned(held.where("false"), ["frame"]).count() == 0


@pytest.mark.parametrize("name", ["span_evaluator", "span_assignment"])
def test_records_are_judged_in_their_row(spark, name, monkeypatch):
    """Before, objects were joined anew for targets, words, candidates and boxes, and every score was exchanged. Larger records still take that way, with the same results."""
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange") <= 1
    want = sorted(map(str, found.collect()))
    monkeypatch.setattr(N, "WHOLE", 30)
    assert sorted(map(str, QUERIES[name](spark, "/root/testdata/sf0.001").collect())) == want and want


def test_shares_of_spans_without_words_or_draws():
    words, said = pa.array([[["a", "b"], ["c"], []], [["z"]]]), pa.array([[["a", "x"], None], [["y"]]], pa.list_(pa.list_(pa.string())))
    powers = [[math.exp(met * 2.0 + k * 0.2) for met in (0, 1) for k in range(-4, 5)]] * 2
    got = spans.span_shares(words, said, pa.array([[7, -3], [None]], pa.list_(pa.int64())), pa.array(powers)).to_pylist()
    p = lambda draw, at, met: math.exp(met * 2.0 + math.fmod(draw + at * 3, 5) * 0.2)
    rows = [[p(7, 0, 1), p(7, 1, 0), p(7, 2, 0)], [p(-3, 0, 0), p(-3, 1, 0), p(-3, 2, 0)]]
    assert got[0][0] == pytest.approx([(r[0] + r[1]) / sum(r) / 2 for r in rows]) and got[0][1] == pytest.approx([r[2] / sum(r) for r in rows])
    assert got[0][2] == [] and got[1] == [[None]]
