"""Spans, masks, descriptions, prompts and poses on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenova.functions import annotations as A
from scenova.functions import geometry as G
from scenova.operators.annotations import assign_spans, unambiguous_targets


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, noun, category, told",
    [
        ("There is a big red truck with a white cab, parked", "truck", "truck", "big red truck with a white cab"),
        ("the left truck in the front lane", "truck", "truck", "truck"),
        ("one two three four five six truck wearing blue and tall", "truck", "truck", "two three four five six truck wearing blue"),
        ("red, small van", "van", "van", "small van"),
        ("a north othervehicle", "north", "OtherVehicle", "othervehicle"),
        ("car", "car", "car", "car"),
        ("", "", "othervehicle", "special vehicle"),
    ],
)
def test_safe_description(spark, text, noun, category, told):
    at = text.find(noun)
    assert value(spark, A.safe_description(F.lit(text), F.lit(at), F.lit(at + len(noun)), F.lit(category))) == told


@pytest.mark.parametrize("name, span, tokens, mask", [("car", (6, 9), (3, 3), [0, 0, 0, 1, 0]), ("red cars", (2, 10), None, None), ("ed", (3, 6), (2, 2), [0, 0, 1, 0, 0]), ("a red", (0, 5), (1, 2), [0, 0.5, 0.5, 0, 0]), ("ca", (6, 9), (3, 3), [0, 0, 0, 1, 0]), ("bus", None, None, [0] * 5)])
def test_spans_and_masks(spark, name, span, tokens, mask):
    said = F.lit(" a red car ")
    found = value(spark, A.target_span(said, F.lit(name)))
    if name == "red cars":
        assert found is None
        return
    assert (found and tuple(found)) == span
    at = A.target_span(said, F.lit(name))
    covered = A.span_tokens(A.word_offsets(said), at["start"], at["end"])
    got = value(spark, covered)
    assert (got and tuple(got)) == tokens
    assert np.allclose(value(spark, A.token_mask(covered, 5)), mask)


def test_assigned_spans(spark):
    said = spark.createDataFrame([(1, "car", 0, 3), (1, "car", 9, 12), (1, "bus", 4, 7), (2, "car", 0, 3), (3, "car", 0, 3), (3, "van", 0, 3)], "e int, class string, start int, end int")
    want = spark.createDataFrame([(1, "car", 0), (1, "bus", 1), (1, "car", 2), (2, "car", 0), (2, "car", 1), (3, "car", 0), (3, "van", 1), (4, "car", 0)], "e int, class string, ord int")
    assert [(r["e"], [tuple(s) for s in r["spans"]]) for r in assign_spans(said, want, "e").collect()] == [(1, [(0, 3), (4, 7), (9, 12)])]
    assert assign_spans(said.limit(0), want, "e").count() == 0 and assign_spans(said, want.limit(0), "e").count() == 0


def test_unambiguous_targets(spark):
    said = [(1, "car", 0, 3), (1, "bus", 4, 7), (1, "van", 9, 12), (1, "van", 14, 17), (2, "car", 5, 8), (2, "bus", 0, 3), (3, "bus", 0, 3)]
    mentions = spark.createDataFrame(said, "e int, class string, start int, end int")
    main = spark.createDataFrame([(1, "car", "m1"), (2, "car", "m2"), (3, "car", "m3")], "e int, class string, object_id string")
    others = spark.createDataFrame([(1, "bus", "b1"), (1, "van", "v1"), (2, "bus", "b2"), (3, "bus", "b3")], "e int, class string, object_id string")
    found = unambiguous_targets(mentions, main, others, "e").collect()
    assert [(r["e"], [t["object_id"] for t in r["targets"]]) for r in found] == [(1, ["m1", "b1"])]
    two = others.unionByName(spark.createDataFrame([(1, "bus", "b9")], others.schema))
    assert unambiguous_targets(mentions, main, two, "e").count() == 0


def test_prompts(spark):
    plus, bare, implicit = ("natural_descriptions_plus_implicit_grounding_tokens", "natural_descriptions_and_implicit_tokens", "implicit_grounding_tokens_only")
    refs = lambda **held: F.array(F.struct(*[F.lit(v).alias(k) for k, v in held.items()]))
    broken = lambda q, policy, **held: value(spark, A.prompt_violation(F.lit(q), refs(**held), list(held), policy))
    assert value(spark, A.prompt(F.lit("Q?"), refs(role="A"), implicit, head="<", tail=">")) == "<Q?\nObject A token: <token>>"
    assert value(spark, A.prompt(F.lit("Q?"), refs(description="a car"), bare)) == "Q?\nGrounding token for the a car: <token>"
    assert broken("Q", implicit, role="A") is None and broken("Q", implicit, role="A", description="x") == "description_in_refs"
    assert broken("Q", plus, description="x", view="v") is None and broken("Q", plus, description="x") == "no_view"
    assert broken("Q", plus, description="", view="v") == "no_description" and broken("Q", plus, description="x", view="v", bbox=1.0) == "geometry_in_refs"
    assert broken("In this View", bare, description="x") == "view_in_question" and broken("Q", bare, description="x", view="v") == "view_in_refs"


def test_poses(spark):
    turn = np.linalg.qr(np.random.default_rng(3).normal(size=(3, 3)))[0]
    pose = np.eye(4)
    pose[:3, :3], pose[:3, 3] = turn, [1.0, -2.0, 5.0]
    inverse = value(spark, G.inverse_pose(F.array(*map(F.lit, pose.ravel().tolist()))))
    assert np.allclose(np.reshape(inverse, (4, 4)), np.linalg.inv(pose))
