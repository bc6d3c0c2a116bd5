"""Evaluators: boxes, texts and assignments scored."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenova.functions import geometry as G
from scenova.functions import text as T
from scenova.functions.ids import hash_order
from scenova.operators import matching as M
from scenova.operators import neighbours as N
from scenova.operators import sequential as S
from scenova.operators.suppression import survivors
from scenova.plans.aggregates import rate
from scenova.plans.base import query
from scenova.plans.generators import directed
from scenova.sources.scenes import objects, pairs, table


@query()
def rotated_iou(spark, sf_dir) -> DataFrame:
    """IoU of each turned box and its shifted prediction, by clipping footprints; tests hold it against closed forms."""
    rows = objects(spark, sf_dir)
    return rows.select("object_id", F.round(S.rotated_iou(S.box_array(), S.box_array(shift=F.col("shift"))), 6).alias("iou"))


def survivors_sql(source: str, keys: str, share: str, select: str, *, head: str = "") -> str:
    """A walk down the scores of each group with a list of what is kept."""
    return (
        f"WITH RECURSIVE {head}r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, object_id, x, y) AS rn, dense_rank() OVER (ORDER BY {keys}) AS grp FROM {source}), "
        "k(grp, rn, kept) AS (SELECT grp, 1, [{'n': rn, 'x': x, 'y': y, 'z': z, 'l': l, 'w': w, 'h': h}] FROM r WHERE rn = 1 UNION ALL "
        f"SELECT r.grp, r.rn::INTEGER, CASE WHEN len(list_filter(k.kept, lambda b: {share} > 0.25)) = 0 THEN list_append(k.kept, {{'n': r.rn, 'x': r.x, 'y': r.y, 'z': r.z, 'l': r.l, 'w': r.w, 'h': r.h}}) ELSE k.kept END FROM k JOIN r ON r.grp = k.grp AND r.rn = k.rn + 1), "
        "e AS (SELECT grp, unnest(kept).n AS n FROM k QUALIFY rn = max(rn) OVER (PARTITION BY grp)), "
        f"s AS (SELECT r.* FROM r JOIN e ON r.grp = e.grp AND r.rn = e.n) {select}"
    )


def shared_sql(axes: str) -> str:
    return " * ".join(f"greatest(0.0::DOUBLE, least(b.{c} + b.{s} / 2, r.{c} + r.{s} / 2) - greatest(b.{c} - b.{s} / 2, r.{c} - r.{s} / 2))" for c, s in zip("xyz", "lwh") if c in axes)


INTER_3D, INTER_2D = shared_sql("xyz"), shared_sql("xy")
IOU_3D = f"{INTER_3D} / (b.l * b.w * b.h + r.l * r.w * r.h - {INTER_3D})"
KEPT = "SELECT scene_id, object_id FROM s"


@query(survivors_sql("objects", "scene_id", IOU_3D, KEPT), heads="o")
def nms3d(spark, sf_dir) -> DataFrame:
    """Greedy suppression inside each scene."""
    return survivors(objects(spark, sf_dir), ["scene_id"]).select("scene_id", "object_id")


@query(survivors_sql("objects", "scene_id, category", f"{INTER_3D} / (r.l * r.w * r.h)", KEPT), heads="o")
def nms3d_by_class(spark, sf_dir) -> DataFrame:
    """Suppression among the boxes of a class, by the share of the suppressed box."""
    return survivors(objects(spark, sf_dir), ["scene_id", "category"], own_area=True).select("scene_id", "object_id")


@query(survivors_sql("objects", "scene_id", f"{INTER_2D} / (b.l * b.w + r.l * r.w - {INTER_2D})", KEPT), heads="o")
def nms2d(spark, sf_dir) -> DataFrame:
    """Greedy suppression by areas in the plane."""
    return survivors(objects(spark, sf_dir), ["scene_id"], flat=True).select("scene_id", "object_id")


OCCUPIED_SQL = """o AS (
    SELECT b.cloud AS scene_id, b.object_id, b.category, b.score, b.x, b.y, b.z, b.l, b.w, b.h FROM objects b JOIN objects p ON b.cloud = p.cloud WHERE abs((p.x - b.x) * cos(b.yaw) + (p.y - b.y) * sin(b.yaw)) < b.l * 2 + 1e-5 AND abs((p.y - b.y) * cos(b.yaw) - (p.x - b.x) * sin(b.yaw)) < b.w * 2 + 1e-5 AND abs(p.z - b.z) <= b.h / 2
    GROUP BY ALL HAVING count(*) >= 5)"""


def points_in_rows(clouds: Column, margin: float = 1e-5) -> Column:
    """For each box (x, y, z, l, w, h, cos, sin, fresh) of a cloud that is one row how many of the cloud's centres lie in it, at four times its size in the plane.

    Boxes that aren't fresh count for the one before, and have 0.
    """

    @F.arrow_udf("array<bigint>")
    def held(rows: pa.Array) -> pa.Array:
        fields, box, n, _ = M.row_boxes(rows, ("x", "y", "z", "l", "w", "h", "cos", "sin"))
        count = np.zeros(len(box), np.int64)
        for i, j in M.row_pairs(n, n):
            b, p = box[i], box[j]
            dx, dy = p[:, 0] - b[:, 0], p[:, 1] - b[:, 1]
            inside = (np.abs(dx * b[:, 6] + dy * b[:, 7]) < b[:, 3] * 2 + margin) & (np.abs(dy * b[:, 6] - dx * b[:, 7]) < b[:, 4] * 2 + margin) & (np.abs(p[:, 2] - b[:, 2]) <= b[:, 5] / 2)
            count += np.bincount(i[inside], minlength=len(box))
        first = np.flatnonzero(fields["fresh"].to_numpy(zero_copy_only=False))
        full = np.zeros(len(box), np.int64)
        if len(first):
            full[first] = np.add.reduceat(count, first)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype("i4")), pa.array(full))

    return held(clouds)


NAMED = ["object_id", "category", "score", "x", "y", "z", "l", "w", "h", "yaw"]


def occupied(spark, sf_dir, alike: list[str] = NAMED[:-1]) -> DataFrame:
    """Boxes of four times the size in the plane that hold five points of their cloud or more, counted in the cloud's row; those of larger clouds meet the points of the cells that they touch.

    Boxes equal in ``alike``, the first names of a box, are one.
    """
    few, many = N.clouds(objects(spark, sf_dir).where("cloud IS NOT NULL").select(F.col("cloud").alias("scene_id"), F.col("object_id").alias("idx"), *NAMED[1:]))
    key = lambda p: F.struct(*[p["idx" if c == "object_id" else c].alias(c) for c in alike])
    fresh = lambda p, i: ~key(p).eqNullSafe(key(F.get("_cloud", i - 1)))
    one = lambda p, i: F.struct(*[p[c].alias(c) for c in "xyzlwh"], F.cos(p["yaw"]).alias("cos"), F.sin(p["yaw"]).alias("sin"), fresh(p, i).alias("fresh"))
    rows = few.select("scene_id", "_cloud", points_in_rows(F.transform("_cloud", one)).alias("_n"))
    box = lambda p, n: F.struct(p["idx"].alias("object_id"), *[p[c].alias(c) for c in NAMED[1:]], n.alias("n"))
    rows = rows.select("scene_id", F.explode(F.filter(F.zip_with("_cloud", "_n", box), lambda v: v["n"] >= 5)).alias("_v")).select("scene_id", "_v.*")
    return rows if many is None else rows.unionByName(counted(many.withColumnRenamed("idx", "object_id"), alike))


def counted(boxes: DataFrame, alike: list[str]) -> DataFrame:
    """``occupied`` of clouds of any size, over grid cells."""
    wide = boxes.select("scene_id", "object_id", "category", "score", "x", "y", "z", (F.col("l") * 4).alias("l"), (F.col("w") * 4).alias("w"), "h", "yaw", F.col("l").alias("own_l"), F.col("w").alias("own_w"))
    cell = lambda c: F.floor(F.col(c) / F.lit(8.0))
    points = boxes.select("scene_id", *[F.col(c).alias(f"p{c}") for c in "xyz"], cell("x").alias("_cx"), cell("y").alias("_cy"))
    met = points.join(M.spread(wide, ["scene_id"], "t", True, 8.0), ["scene_id", "_cx", "_cy"]).where(G.in_box(F.col("px"), F.col("py"), F.col("pz"), M.of("t")))
    own = {"l": "own_l", "w": "own_w"}
    of = lambda c: F.col(f"t_{own.get(c, c)}").alias(c)
    held = met.groupBy("scene_id", *map(of, alike)).agg(F.min(F.struct(*[of(c) for c in NAMED if c not in alike])).alias("_rest"), F.count("*").alias("n"))
    return held.where("n >= 5").select("scene_id", *alike, "_rest.*", "n")


def by_class(boxes: DataFrame) -> DataFrame:
    """One proposal for each class: the further a class from the box's own, the lower the score."""
    rows = boxes.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return rows.select("object_id", "class", F.round(F.col("score") / (1 + F.abs(F.col("category") - F.col("class"))), 4).alias("score"))


@query(
    """SELECT object_id, unnest(range(6))::INTEGER AS class, round(score / (1 + abs(category - unnest(range(6)))), 4) AS score FROM (
    SELECT b.object_id, b.category, b.score FROM objects b JOIN objects p ON b.cloud = p.cloud WHERE abs((p.x - b.x) * cos(b.yaw) + (p.y - b.y) * sin(b.yaw)) < b.l * 2 + 1e-5 AND abs((p.y - b.y) * cos(b.yaw) - (p.x - b.x) * sin(b.yaw)) < b.w * 2 + 1e-5 AND abs(p.z - b.z) <= b.h / 2
    GROUP BY ALL HAVING count(*) >= 5)""",
    heads="o",
)
def occupied_boxes(spark, sf_dir) -> DataFrame:
    """Proposals by class of the boxes that aren't nearly empty."""
    return by_class(occupied(spark, sf_dir, NAMED[:3]))


@query(survivors_sql("o", "scene_id", IOU_3D, "SELECT object_id, unnest(range(6))::INTEGER AS class, round(score / (1 + abs(category - unnest(range(6)))), 4) AS score FROM s", head=f"{OCCUPIED_SQL}, "), heads="o")
def class_proposals(spark, sf_dir) -> DataFrame:
    """Proposals by class of the boxes that aren't nearly empty and survive suppression in their cloud."""
    return by_class(survivors(occupied(spark, sf_dir), ["scene_id"]))


@query()
def assign_by_cost(spark, sf_dir) -> DataFrame:
    """Cheapest one-to-one assignment by class and generalised IoU (weights 1 and 2, 0 for L1)."""
    objs = objects(spark, sf_dir)
    sides = {"truth": "t", "guess": "g"}
    left, right = (objs.select("scene_id", F.col("object_id").alias(name), *[F.col(c).alias(f"{at}_{c}") for c in ("category", *"xyzlwh", "shift")]) for name, at in sides.items())
    met = left.join(right, "scene_id")
    t, g = (tuple(F.col(f"{at}_{c}") for c in "xyzlwh") for at in "tg")
    g = (g[0] + F.col("g_shift"), *g[1:])
    weights = {"class": 1.0, "box": 0.0, "giou": 2.0}
    likely = 1 / (1 + F.abs(F.col("t_category") - F.col("g_category")))
    cost = -weights["class"] * likely + weights["box"] * sum(F.abs(a - b) for a, b in zip(t, g)) - weights["giou"] * G.aligned_iou(t, g)[1]
    return S.assign(met.withColumn("cost", cost), "cost", "truth", "guess")


@query()
def assign_queries(spark, sf_dir) -> DataFrame:
    """Cheapest one-to-one assignment of objects to shifted predictions by L1 distance."""
    objs = objects(spark, sf_dir).select("scene_id", "object_id", "x", "y", "z", "shift")
    left = objs.select("scene_id", F.col("object_id").alias("truth"), *[F.col(c).alias(f"t{c}") for c in "xyz"])
    right = objs.select("scene_id", F.col("object_id").alias("guess"), (F.col("x") + F.col("shift")).alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz"))
    cost = sum(F.abs(F.col(f"t{c}") - F.col(f"g{c}")) for c in "xyz")
    return S.assign(left.join(right, "scene_id").withColumn("cost", cost), "cost", "truth", "guess")


def side_phrase(relation: Column) -> Column:
    return F.when(relation == "front", "in front of").when(relation == "behind", "behind").otherwise(F.concat(F.lit("to the "), relation, F.lit(" of")))


def replay(spark, sf_dir) -> DataFrame:
    """Questions with their keys and the oracle's own sentences."""
    rows = directed(spark, sf_dir).withColumn("r", G.dominant_relation(F.col("dx"), F.col("dy"))).where("r is not null")
    a, b = (F.concat(F.lit("the "), F.col(c), F.lit(" in the front view")) for c in ("a_caption", "b_caption"))
    return rows.select("scene_id", "a_id", "b_id", "r", a.alias("subject"), b.alias("object"), F.concat(T.capital(a), F.lit(" is "), side_phrase(F.col("r")), F.lit(" "), b, F.lit(".")).alias("said"))


#: What a drawn digit makes of an answer: right, inverted, hedged, missing, empty or doubled.
DRAW_SQL = "('0x' || substr(sha1('answer|' || a_id || '|' || b_id), 1, 4))::INTEGER % 6"
DRAWN = ("right", "inverted", "hedged", "missing", "empty", "doubled")


def drawn(rows: DataFrame) -> DataFrame:
    """``rows`` of pairs with a drawn kind of answer."""
    digit = F.conv(F.substr(hash_order("answer", F.col("a_id"), F.col("b_id")), F.lit(1), F.lit(4)), 16, 10).cast("int") % 6
    return rows.withColumn("kind", F.element_at(F.array(*map(F.lit, DRAWN)), digit + 1))


@query(
    f"SELECT kind, count(*) AS n, CASE WHEN kind IN ('right', 'doubled') THEN 1.0 ELSE 0.0 END::DOUBLE AS svo, CASE WHEN kind IN ('right', 'inverted') THEN 1.0 ELSE 0.0 END::DOUBLE AS sentence FROM (SELECT ['right', 'inverted', 'hedged', 'missing', 'empty', 'doubled'][{DRAW_SQL} + 1] AS kind FROM pairs WHERE greatest(abs(dx), abs(dy)) >= 1) GROUP BY kind",
    heads="p",
)
def oracle_replay(spark, sf_dir) -> DataFrame:
    """Strict scores of the oracle's sentences and of spoilt ones: inverted, holding both relations, missing, empty, or said twice."""
    rows = drawn(replay(spark, sf_dir))
    back = G.inverse_relation(F.col("r"))
    opposite = F.concat(T.capital(F.col("subject")), F.lit(" is "), side_phrase(back), F.lit(" "), F.col("object"), F.lit("."))
    hedge = F.concat(T.capital(F.col("subject")), F.lit(" is "), side_phrase(F.col("r")), F.lit(" or "), side_phrase(back), F.lit(" "), F.col("object"))
    said = F.when(F.col("kind") == "right", F.col("said")).when(F.col("kind") == "inverted", opposite).when(F.col("kind") == "hedged", hedge).when(F.col("kind") == "empty", F.lit("")).when(F.col("kind") == "doubled", F.concat("said", F.lit(" "), F.col("said")))
    rows = rows.withColumn("said", F.coalesce(said, F.lit("")))
    rows = rows.withColumn("held", T.norm_decimal(F.col("said")))
    none = F.lit(None).cast("string")
    ok = T.triple_ok(F.col("said"), F.lit("spatial_triple"), F.col("subject"), F.col("r"), F.col("object"), none, F.lit(None).cast("double"), none, F.col("held"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), rate(ok).alias("svo"), rate(T.one_sentence(F.col("said"))).alias("sentence"))


@query(
    f"SELECT scenario, kind, count(*) AS n, round(avg(CASE WHEN kind IN ('right', 'doubled') OR kind = 'hedged' AND first_read THEN 1.0 ELSE 0 END), 6) AS accuracy FROM (SELECT ['right', 'inverted', 'hedged', 'missing', 'empty', 'doubled'][{DRAW_SQL} + 1] AS kind, scenario, first_read FROM (SELECT a_id, b_id, 'which_is_left' AS scenario, dy > 0 AS first_read FROM pairs WHERE a_id < b_id AND abs(dy) >= 2 UNION ALL SELECT a_id, b_id, 'relative_location', dy > 0 AND dx < 0 FROM pairs WHERE a_id < b_id AND abs(dx) >= 3 AND abs(dy) >= 1.5)) GROUP BY ALL",
    heads="p",
)
def scenario_scores(spark, sf_dir) -> DataFrame:
    """Keys read back from sentences by scenario: right ones, inverted ones, ones that name both (the first counts), none, empty ones and repeated ones."""
    rows = drawn(directed(spark, sf_dir).where("a_id < b_id"))
    first = F.col("dy") > 0
    wins = lambda a: F.when(a, "Object A is further left.").otherwise("Object B is further left.")
    left = rows.where(F.abs("dy") >= 2).select("kind", F.lit("which_is_left").alias("scenario"), F.when(first, "A").otherwise("B").alias("key"), wins(first).alias("right"), wins(~first).alias("inverted"), F.lit("Object A and object B are further left.").alias("hedged"))
    place = rows.withColumn("key", G.dead_zone_relation(F.col("dx"), F.col("dy"))).where(F.col("key").contains("_"))
    tell = lambda k: F.concat(F.lit("It is to the "), F.split_part(k, F.lit("_"), F.lit(1)), F.lit(" and "), F.split_part(k, F.lit("_"), F.lit(2)), F.lit("."))
    place = place.select("kind", F.lit("relative_location").alias("scenario"), "key", tell(F.col("key")).alias("right"), tell(G.inverse_relation(F.col("key"))).alias("inverted"), F.lit("It is left or right, front and behind.").alias("hedged"))
    both = left.unionByName(place)
    said = F.when(F.col("kind") == "doubled", F.concat("right", F.lit(" "), F.col("right"))).when(F.col("kind") == "empty", F.lit(""))
    for kind in ("right", "inverted", "hedged"):
        said = said.when(F.col("kind") == kind, F.col(kind))
    right = F.coalesce(T.parsed_key(F.col("scenario"), said) == F.col("key"), F.lit(False))
    return both.groupBy("scenario", "kind").agg(F.count("*").alias("n"), F.round(rate(right), 6).alias("accuracy"))


@query("SELECT count(*) AS groups, count(*) FILTER (WHERE n = 2) AS pairs_n FROM (SELECT least(a_id, b_id) AS l, greatest(a_id, b_id) AS g, count(*) AS n FROM pairs WHERE abs(dy) >= 1.5 AND abs(dx) >= 3 GROUP BY ALL)", heads="p")
def swap_consistency(spark, sf_dir) -> DataFrame:
    """Groups of two whose answers invert each other; other sizes fail."""
    rows = directed(spark, sf_dir).withColumn("key", G.dead_zone_relation(F.col("dx"), F.col("dy"))).where(F.col("key").contains("_"))
    per = rows.groupBy(F.least("a_id", "b_id").alias("l"), F.greatest("a_id", "b_id").alias("g")).agg(F.sort_array(F.collect_list(F.struct("a_id", "key"))).alias("k"))
    ok = (F.size("k") == 2) & (F.col("k")[0]["key"] == G.inverse_relation(F.get("k", F.lit(1))["key"]))
    return per.agg(F.count("*").alias("groups"), F.count_if(F.coalesce(ok, F.lit(False))).alias("pairs_n"))


@query("SELECT CASE WHEN dx > 0 THEN 'front' ELSE 'behind' END AS truth, count(*) AS n, count(*) FILTER (WHERE ('0x' || substr(sha1('base|' || a_id || '|' || b_id), 1, 2))::INTEGER % 2 = CASE WHEN dx > 0 THEN 1 ELSE 0 END) AS hits FROM pairs GROUP BY ALL", heads="p")
def random_baseline(spark, sf_dir) -> DataFrame:
    """Answers drawn from a hash, against the truth."""
    draw = F.conv(F.substr(hash_order("base", F.col("a_id"), F.col("b_id")), F.lit(1), F.lit(2)), 16, 10).cast("int") % 2
    truth = F.when(F.col("dx") > 0, "front").otherwise("behind")
    return directed(spark, sf_dir).groupBy(truth.alias("truth")).agg(F.count("*").alias("n"), F.count_if(draw == F.when(F.col("dx") > 0, 1).otherwise(0)).alias("hits"))


@query()
def ridge_probe(spark, sf_dir) -> DataFrame:
    """Closed-form ridge on standardised token arrays: moments are summed on the executors, a system of as many unknowns as a token is long is solved."""
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("double").alias("y"), (F.col("vec_id") % 7 == 0).alias("held"))
    # Tokens of the commonest length count; others have no place in the system.
    lengths = e.where("v is not null and y is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    e = e.where((F.size("v") == d) & F.col("y").isNotNull())
    train = e.where(~F.col("held"))

    def moments(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.column_stack([np.stack(pdf["v"].to_numpy()), np.ones(len(pdf)), pdf["y"].to_numpy()])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"k": np.arange(total.size), "s": total.ravel()})

    sums = train.mapInPandas(moments, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect()  # (d + 2) squared numbers
    m = np.array([r["s"] for r in sums]).reshape(d + 2, d + 2) if sums else np.eye(d + 2)
    n, mean = m[d, d], m[d, :d] / m[d, d]
    cov = m[:d, :d] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    y_mean = m[d, d + 1] / n
    xy = (m[:d, d + 1] / n - mean * y_mean) / scale
    w = np.linalg.solve(cov / np.outer(scale, scale) + 1.0 / n * np.eye(d), xy) / scale
    guess = G.dot(F.col("v"), F.array(*[F.lit(float(a)) for a in w]).cast("array<double>")) + F.lit(float(y_mean - mean @ w))
    return e.groupBy("held").agg(F.count("*").alias("n"), F.round(1 - F.sum((F.col("y") - guess) ** 2) / (F.var_pop("y") * F.count("*")), 6).alias("r2"))


@query("SELECT CAST(floor(l_discount * 100) AS INTEGER) % 4 AS bucket, count(*) AS n, round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0 END), 6) AS hit FROM lineitem GROUP BY ALL")
def bucket_hit_rate(spark, sf_dir) -> DataFrame:
    """A flag's rate by bucket, empty buckets left out."""
    return table(spark, sf_dir, "lineitem").groupBy((F.floor(F.col("l_discount") * 100).cast("int") % 4).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)), 6).alias("hit"))


@query("SELECT a_id AS object_id, count(*) AS labels FROM (SELECT a_id, row_number() OVER (PARTITION BY a_id ORDER BY dx * dx + dy * dy + dz * dz, b_id) AS rn FROM pairs WHERE a_category = b_category) WHERE rn <= 4 GROUP BY a_id", heads="p")
def hard_topk_labels(spark, sf_dir) -> DataFrame:
    """The four nearest candidates of each target among those of its own class."""
    met = pairs(objects(spark, sf_dir), keep=["category", "x", "y", "z"]).where("a_category = b_category")
    d2 = sum((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in "xyz")
    ranked = met.withColumn("rn", F.row_number().over(Window.partitionBy("a_object_id").orderBy(d2, "b_object_id"))).where("rn <= 4")
    return ranked.groupBy(F.col("a_object_id").alias("object_id")).agg(F.count("*").alias("labels"))
