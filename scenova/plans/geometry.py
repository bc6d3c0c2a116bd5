"""Pairs of objects and what their geometry says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenova.functions import geometry as G
from scenova.functions import text as T
from scenova.functions.ids import hash_order
from scenova.plans.base import query
from scenova.sources.scenes import objects, pairs


def deltas() -> tuple[Column, Column, Column]:
    return tuple(F.col(f"a_{c}") - F.col(f"b_{c}") for c in "xyz")


def box(prefix: str = "", shift: bool = False) -> tuple[Column, ...]:
    move = F.col(f"{prefix}shift") if shift else F.lit(0.0)
    return (F.col(f"{prefix}x") + move, *(F.col(f"{prefix}{c}") for c in ("y", "z", "l", "w", "h")))


SECTOR_SQL = "CASE WHEN abs(dy) <= dx THEN 'front' WHEN dy > 0 AND -dx <= dy THEN 'left' WHEN dy < 0 AND dx >= dy THEN 'right' WHEN dx = 0 AND dy = 0 THEN 'front' ELSE 'behind' END"
IOU_SQL = """iou AS (
    SELECT *, inter / (l * w * h + l * w * h - inter) AS iou, (around - (l * w * h + l * w * h - inter)) / around AS gap
    FROM (SELECT *,
        greatest(0.0::DOUBLE, least(x + l / 2, x + shift + l / 2) - greatest(x - l / 2, x + shift - l / 2))
            * greatest(0.0::DOUBLE, (y + w / 2) - (y - w / 2)) * greatest(0.0::DOUBLE, (z + h / 2) - (z - h / 2)) AS inter,
        (greatest(x + l / 2, x + shift + l / 2) - least(x - l / 2, x + shift - l / 2)) * ((y + w / 2) - (y - w / 2)) * ((z + h / 2) - (z - h / 2)) AS around
        FROM objects)
)"""
BUCKET_SQL = "CASE WHEN iou < 0.1 THEN '<0.1' WHEN iou < 0.25 THEN '0.1-0.25' WHEN iou < 0.5 THEN '0.25-0.5' WHEN iou < 0.75 THEN '0.5-0.75' ELSE '>=0.75' END"


@query("SELECT split, count(*) AS n, count(DISTINCT scene_id) AS scenes FROM pairs GROUP BY split", heads="p")
def scene_pairs(spark, sf_dir) -> DataFrame:
    """Ordered pairs inside scenes (a != b)."""
    return pairs(objects(spark, sf_dir), keep=["split"]).groupBy(F.col("a_split").alias("split")).agg(F.count("*").alias("n"), F.countDistinct("scene_id").alias("scenes"))


@query("SELECT split, CASE WHEN dy > 0 THEN 'left' ELSE 'right' END AS lateral, CASE WHEN dx > 0 THEN 'front' ELSE 'behind' END AS longitudinal, count(*) AS n, round(avg(sqrt(dx * dx + dy * dy)), 6) AS mean_distance, round(avg(sqrt(dx * dx + dy * dy + dz * dz)), 6) AS mean_distance_3d FROM pairs GROUP BY ALL", heads="p")
def pair_relations(spark, sf_dir) -> DataFrame:
    """Strict-sign relations of ordered pairs with mean distances: the flagship chain from tables to counts."""
    dx, dy, dz = deltas()
    said = G.sign_relations(dx, dy)
    met = pairs(objects(spark, sf_dir), keep=["split", "x", "y", "z"])
    rows = met.select(F.col("a_split").alias("split"), said[0].alias("lateral"), said[1].alias("longitudinal"), G.planar(dx, dy).alias("d2"), G.spatial(dx, dy, dz).alias("d3"))
    return rows.groupBy("split", "lateral", "longitudinal").agg(F.count("*").alias("n"), F.round(F.avg("d2"), 6).alias("mean_distance"), F.round(F.avg("d3"), 6).alias("mean_distance_3d"))


@query(f"SELECT {SECTOR_SQL} AS sector, count(*) AS n, round(avg(degrees(atan2(dy, dx))), 5) AS mean_bearing FROM pairs GROUP BY ALL", heads="p")
def bearing_sectors(spark, sf_dir) -> DataFrame:
    """Quadrant of the bearing of each ordered pair."""
    dx, dy, _ = deltas()
    met = pairs(objects(spark, sf_dir), keep=["x", "y"])
    return met.groupBy(G.sector(dx, dy).alias("sector")).agg(F.count("*").alias("n"), F.round(F.avg(G.bearing(dx, dy)), 5).alias("mean_bearing"))


@query("SELECT CASE WHEN abs(dx) >= 3 AND abs(dy) >= 1.5 THEN (CASE WHEN dy > 0 THEN 'left' ELSE 'right' END) || '_' || (CASE WHEN dx > 0 THEN 'front' ELSE 'behind' END) WHEN abs(dx) >= 3 AND abs(dy) <= 0.75 THEN (CASE WHEN dx > 0 THEN 'front' ELSE 'behind' END) WHEN abs(dy) >= 1.5 AND abs(dx) <= 1.5 THEN (CASE WHEN dy > 0 THEN 'left' ELSE 'right' END) END AS relation, count(*) AS n FROM pairs GROUP BY ALL", heads="p")
def relation_deadzone(spark, sf_dir) -> DataFrame:
    dx, dy, _ = deltas()
    return pairs(objects(spark, sf_dir), keep=["x", "y"]).groupBy(G.dead_zone_relation(dx, dy).alias("relation")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN greatest(abs(dx), abs(dy)) < 1 THEN NULL WHEN abs(dx) >= abs(dy) THEN (CASE WHEN dx > 0 THEN 'front' ELSE 'behind' END) ELSE (CASE WHEN dy > 0 THEN 'left' ELSE 'right' END) END AS relation, count(*) AS n FROM pairs GROUP BY ALL", heads="p")
def relation_dominant(spark, sf_dir) -> DataFrame:
    dx, dy, _ = deltas()
    return pairs(objects(spark, sf_dir), keep=["x", "y"]).groupBy(G.dominant_relation(dx, dy).alias("relation")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lat || '+' || lon ELSE coalesce(lat, lon, CASE WHEN dx >= 0 THEN 'front' ELSE 'behind' END) END AS atoms, count(*) AS n FROM (SELECT dx, CASE WHEN abs(dy) >= 1 THEN CASE WHEN dy > 0 THEN 'left' ELSE 'right' END END AS lat, CASE WHEN abs(dx) >= 1 THEN CASE WHEN dx > 0 THEN 'front' ELSE 'behind' END END AS lon FROM pairs) GROUP BY ALL", heads="p")
def relation_atoms(spark, sf_dir) -> DataFrame:
    dx, dy, _ = deltas()
    return pairs(objects(spark, sf_dir), keep=["x", "y"]).groupBy(F.array_join(G.relation_atoms(dx, dy), "+").alias("atoms")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN abs(dx) >= 0.5 AND abs(dx) >= abs(dy) + 0.25 THEN (CASE WHEN dx > 0 THEN 'front' ELSE 'behind' END) WHEN abs(dy) >= 0.5 AND abs(dy) >= abs(dx) + 0.25 THEN (CASE WHEN dy > 0 THEN 'left' ELSE 'right' END) END AS relation, count(*) AS n FROM pairs GROUP BY ALL", heads="p")
def relation_margin(spark, sf_dir) -> DataFrame:
    dx, dy, _ = deltas()
    return pairs(objects(spark, sf_dir), keep=["x", "y"]).groupBy(G.margin_relation(dx, dy).alias("relation")).agg(F.count("*").alias("n"))


@query("SELECT convention, count(*) AS votes, count(*) FILTER (WHERE agree) AS agreed, round(count(*) FILTER (WHERE agree) / count(*), 6) AS rate FROM (SELECT unnest(['+y', '-y', '+x', '-x']) AS convention, unnest([dy > 0, dy < 0, dx > 0, dx < 0]) AS agree FROM pairs WHERE abs(dy) >= 1) GROUP BY ALL", heads="p")
def axis_votes(spark, sf_dir) -> DataFrame:
    """Votes for each axis convention as 'left', unpivoted."""
    dx, dy, _ = deltas()
    met = pairs(objects(spark, sf_dir), keep=["x", "y"]).select(dx.alias("dx"), dy.alias("dy")).where(F.abs("dy") >= 1)
    votes = met.selectExpr("stack(4, '+y', dy > 0, '-y', dy < 0, '+x', dx > 0, '-x', dx < 0) AS (convention, agree)")
    agreed = F.count_if("agree")
    return votes.groupBy("convention").agg(F.count("*").alias("votes"), agreed.alias("agreed"), F.round(F.try_divide(agreed, F.count("*")), 6).alias("rate"))


@query("SELECT object_id, round(x * cos(radians(-45.0)) - y * sin(radians(-45.0)), 6) + 0.0 AS rx, round(x * sin(radians(-45.0)) + y * cos(radians(-45.0)), 6) + 0.0 AS ry, round((yaw - radians(45.0) + pi()) - 2 * pi() * floor((yaw - radians(45.0) + pi()) / (2 * pi())) - pi(), 6) + 0.0 AS ryaw FROM objects", heads="o")
def frame_transform(spark, sf_dir) -> DataFrame:
    """Centres and yaws turned by a view angle, yaw wrapped."""
    rx, ry = G.rotate_xy(F.col("x"), F.col("y"), F.lit(-45.0))
    return objects(spark, sf_dir).select("object_id", *[(F.round(v, 6) + 0.0).alias(n) for v, n in ((rx, "rx"), (ry, "ry"), (G.wrap_angle(F.col("yaw") - F.radians(F.lit(45.0))), "ryaw"))])


@query(f"WITH {IOU_SQL} SELECT object_id, round(iou, 9) + 0.0 AS iou, round(iou - gap, 9) + 0.0 AS giou FROM iou", heads="o")
def aligned_iou(spark, sf_dir) -> DataFrame:
    """IoU and generalised IoU of each true box and its prediction."""
    iou, giou = G.aligned_iou(box(), box(shift=True))
    return objects(spark, sf_dir).select("object_id", (F.round(iou, 9) + 0.0).alias("iou"), (F.round(giou, 9) + 0.0).alias("giou"))


@query(f"WITH {IOU_SQL} SELECT {BUCKET_SQL} AS bucket, count(*) AS n FROM iou GROUP BY ALL", heads="o")
def quality_buckets(spark, sf_dir) -> DataFrame:
    iou, _ = G.aligned_iou(box(), box(shift=True))
    return objects(spark, sf_dir).groupBy(G.quality_bucket(iou).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    """
    SELECT object_id, k, round(x + l * su / 2 * cos(yaw) - w * sv / 2 * sin(yaw), 6) AS cx, round(y + l * su / 2 * sin(yaw) + w * sv / 2 * cos(yaw), 6) AS cy, round(z + h * sz / 2, 6) AS cz
    FROM objects, (VALUES (0, 1, 1, 1), (1, 1, -1, 1), (2, -1, -1, 1), (3, -1, 1, 1), (4, 1, 1, -1), (5, 1, -1, -1), (6, -1, -1, -1), (7, -1, 1, -1)) AS c (k, su, sv, sz)
    """,
    heads="o",
)
def box_corners(spark, sf_dir) -> DataFrame:
    """Eight corners of each box, top face first."""
    found = G.corners(*(F.col(c) for c in ("x", "y", "z", "l", "w", "h", "yaw")))
    rows = objects(spark, sf_dir).select("object_id", F.posexplode(found).alias("k", "c"))
    return rows.select("object_id", "k", *[F.round(f"c.{c}", 6).alias(f"c{c}") for c in "xyz"])


@query("SELECT count(*) AS n, count(*) FILTER (WHERE x > 0) AS ahead, count(*) FILTER (WHERE x > 0 AND 640 - 500 * y / x BETWEEN 0 AND 1280 AND 360 - 500 * z / x BETWEEN 0 AND 720) AS inside FROM objects", heads="o")
def image_projection(spark, sf_dir) -> DataFrame:
    """Pinhole projection with depth and image bounds."""
    u, v, depth = G.project(F.col("x"), F.col("y"), F.col("z"), (500.0, 500.0), (640.0, 360.0))
    inside = (depth > 0) & u.between(0, 1280) & v.between(0, 720)
    return objects(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(depth > 0).alias("ahead"), F.count_if(inside).alias("inside"))


PLAN_SQL = """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY object_id, x, y) - 1 AS ord FROM objects),
    a AS (SELECT * FROM r WHERE x > 1.0 AND x < 22.0),
    c AS (SELECT scene_id,
            min(abs(y) - greatest(w / 2, 0.3) - 1.2) AS s,
            min(abs(y - 3.0 * least(greatest(x / 10.0, 0.0), 1.0)) - greatest(w / 2, 0.3) - 1.2) AS l,
            min(abs(y + 3.0 * least(greatest(x / 10.0, 0.0), 1.0)) - greatest(w / 2, 0.3) - 1.2) AS r,
            arg_min({'ord': ord, 'y': y}, {'d': sqrt(x * x + y * y), 'ord': ord}) AS b
          FROM a GROUP BY scene_id),
    d AS (SELECT *, greatest(s, l, r) AS best FROM c)
    SELECT scene_id, CASE WHEN best < -0.5 THEN 'stop' WHEN s = best THEN 'straight' WHEN l = best THEN 'left' ELSE 'right' END AS steer,
        CASE WHEN best >= -0.5 THEN CASE WHEN CASE WHEN s = best THEN 0.0 WHEN l = best THEN 3.0 ELSE -3.0 END > b.y THEN 'left' ELSE 'right' END END AS pass_side,
        CAST(b.ord AS INTEGER) AS blocker, round(best, 6) AS clearance
    FROM d
    """


@query(PLAN_SQL, heads="o")
def local_plan(spark, sf_dir) -> DataFrame:
    """Corridor choice per scene: three paths against all boxes ahead."""
    boxes = objects(spark, sf_dir).groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("object_id", "x", "y", "w"))).alias("b"))
    numbered = F.transform("b", lambda b, i: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), i.alias("ord")))
    plan = boxes.select("scene_id", G.local_plan(numbered).alias("p")).where("p is not null")
    return plan.select("scene_id", "p.steer", "p.pass_side", "p.blocker", F.round("p.clearance", 6).alias("clearance"))


SPOILT = ("right", "turned", "short", "empty", "both")


@query(
    f"""WITH p AS ({PLAN_SQL.strip()}), k AS (SELECT *, ['right', 'turned', 'short', 'empty', 'both'][('0x' || substr(sha1('plan|' || scene_id), 1, 4))::INTEGER % 5 + 1] AS answer FROM p)
    SELECT 'local_plan' AS kind, answer, steer, count(*) AS n, CASE WHEN answer = 'right' OR answer = 'both' THEN 1.0 ELSE 0.0 END::DOUBLE AS rate FROM k GROUP BY ALL
    UNION ALL SELECT 'candidate_maneuver_safety', answer, CASE WHEN clearance >= 0 THEN 'safe' ELSE 'unsafe' END, count(*), CASE WHEN answer = 'right' OR answer = 'both' AND clearance < 0 THEN 1.0 ELSE 0.0 END::DOUBLE FROM k GROUP BY ALL""",
    heads="o",
)
def plan_answers(spark, sf_dir) -> DataFrame:
    """Answers about plans, right and spoilt, scored by the words that their plan asks for: steer, going on and the passing side, a stop, or a verdict on safety."""
    digit = F.conv(F.substr(hash_order("plan", F.col("scene_id")), F.lit(1), F.lit(4)), 16, 10).cast("int") % 5
    rows = local_plan(spark, sf_dir).withColumns({"answer": F.element_at(F.array(*map(F.lit, SPOILT)), digit + 1), "role": F.char(F.col("blocker") + 65)})
    safe = F.col("clearance") >= 0
    other = F.when(F.col("pass_side") == "left", "right").otherwise("left")
    passing = lambda side: F.concat(F.lit("Steer "), "steer", F.lit(" and continue forward, passing to the "), side, F.lit(" of Object "), "role", F.lit("."))
    stop = F.col("steer") == "stop"
    move = {
        "right": F.when(stop, "The ego should stop.").otherwise(passing(F.col("pass_side"))),
        "turned": F.when(stop, "The ego should stoop.").otherwise(passing(other)),
        "short": F.when(stop, "Stop.").otherwise(F.concat(F.lit("Steer "), "steer", F.lit("."))),
        "both": F.when(stop, "It should not wait, it should stop!").otherwise(F.concat(passing(other), F.lit(" "), passing(F.col("pass_side")))),
    }
    verdict = {
        "right": F.when(safe, "It is safe.").otherwise("It is unsafe."),
        "turned": F.when(safe, "It is unsafe.").otherwise("It is safe."),
        "short": F.lit("Safe."),
        "both": F.lit("It is safe, or it is unsafe."),
    }

    def told(texts: dict[str, Column]) -> Column:
        return F.coalesce(*[F.when(F.col("answer") == name, text) for name, text in texts.items()], F.lit(""))

    moves = rows.select(F.lit("local_plan").alias("kind"), "answer", "steer", "pass_side", "role", safe.alias("safe"), told(move).alias("said"))
    verdicts = rows.select(F.lit("candidate_maneuver_safety").alias("kind"), "answer", F.when(safe, "safe").otherwise("unsafe").alias("steer"), "pass_side", "role", safe.alias("safe"), told(verdict).alias("said"))
    ok = T.plan_phrase_ok(F.col("said"), F.col("kind"), F.col("safe"), F.col("steer"), F.col("pass_side"), F.col("role"))
    scored = moves.unionByName(verdicts).withColumn("ok", ok)
    return scored.groupBy("kind", "answer", "steer").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("rate"))


@query(
    """
    SELECT direction, closer, count(*) AS n FROM (
        SELECT direction, sqrt((x + mx) * (x + mx) + (y + my) * (y + my)) < sqrt(x * x + y * y) AS closer
        FROM objects, (VALUES ('forward', 5.0, 0.0), ('backward', -5.0, 0.0), ('left', 0.0, 5.0), ('right', 0.0, -5.0)) AS m (direction, mx, my)
    ) GROUP BY ALL
    """,
    heads="o",
)
def motion_counterfactual(spark, sf_dir) -> DataFrame:
    """Whether a 5 m move of the object in each of four directions brings it strictly closer."""
    moves = F.array(*[F.struct(F.lit(n).alias("direction"), F.lit(a).alias("mx"), F.lit(b).alias("my")) for n, a, b in (("forward", 5.0, 0.0), ("backward", -5.0, 0.0), ("left", 0.0, 5.0), ("right", 0.0, -5.0))])
    rows = objects(spark, sf_dir).select("x", "y", F.explode(moves).alias("m"))
    closer = G.planar(F.col("x") + F.col("m.mx"), F.col("y") + F.col("m.my")) < G.planar(F.col("x"), F.col("y"))
    return rows.groupBy(F.col("m.direction").alias("direction"), closer.alias("closer")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) = 64) AS ok, round(sum(CASE WHEN label % 2 = 0 THEN embedding[1]::DOUBLE ELSE 0 END), 5) AS s, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings")
def vector_norms(spark, sf_dir) -> DataFrame:
    """Dot products of token arrays."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    norm = F.sqrt(G.dot(F.col("embedding"), F.col("embedding")))
    return e.agg(F.count("*").alias("n"), F.count_if(F.size("embedding") == 64).alias("ok"), F.round(F.sum(F.when(F.col("label") % 2 == 0, F.col("embedding")[0].cast("double")).otherwise(0.0)), 5).alias("s"), F.round(F.avg(norm), 6).alias("mean_norm"))


@query("SELECT vec_id, round(exp(embedding[1]::DOUBLE - m) / t, 9) AS first_share FROM (SELECT vec_id, embedding, list_max(embedding)::DOUBLE AS m, list_sum([exp(v::DOUBLE - list_max(embedding)::DOUBLE) FOR v IN embedding]) AS t FROM embeddings)")
def token_softmax(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("v", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", F.round(G.softmax(F.col("v"))[0], 9).alias("first_share"))


@query(
    "WITH s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM objects WHERE split = 'train') SELECT split, count(*) AS n, round(avg((x - mx) / CASE WHEN sx < 1e-6 THEN 1 ELSE sx END), 6) + 0.0 AS zx, round(avg((y - my) / CASE WHEN sy < 1e-6 THEN 1 ELSE sy END), 6) + 0.0 AS zy FROM objects, s GROUP BY split",
    heads="o",
)
def geometry_standardize(spark, sf_dir) -> DataFrame:
    """Standardisation by the training split's moments alone."""
    objs = objects(spark, sf_dir)
    # One row, so it can be sent to every task.
    stats = objs.where("split = 'train'").agg(*[F.avg(c).alias(f"m{c}") for c in "xy"], *[F.stddev_pop(c).alias(f"s{c}") for c in "xy"])
    scale = lambda c: F.when(F.col(f"s{c}") < 1e-6, 1.0).otherwise(F.col(f"s{c}"))
    met = objs.join(F.broadcast(stats))
    return met.groupBy("split").agg(F.count("*").alias("n"), *[(F.round(F.avg((F.col(c) - F.col(f"m{c}")) / scale(c)), 6) + 0.0).alias(f"z{c}") for c in "xy"])


@query("SELECT split, category, count(*) AS n, round(avg(sx), 6) AS mean_sx, round(avg(dx), 6) AS mean_dx, round(avg(px), 6) AS mean_px FROM (SELECT split, a_category AS category, x1 AS sx, dx, x1 * x2 AS px FROM pairs) GROUP BY ALL", heads="p")
def directed_pair_features(spark, sf_dir) -> DataFrame:
    """Directed pair features [s, t, s - t, s * t] as arrays, averaged."""
    met = pairs(objects(spark, sf_dir), keep=["split", "category", "x", "y", "z"])
    s, t = (F.array(*[F.col(f"{p}_{c}") for c in "xyz"]) for p in "ab")
    features = F.concat(s, t, F.zip_with(s, t, lambda a, b: a - b), F.zip_with(s, t, lambda a, b: a * b))
    rows = met.select(F.col("a_split").alias("split"), F.col("a_category").alias("category"), features.alias("f"))
    return rows.groupBy("split", "category").agg(F.count("*").alias("n"), F.round(F.avg(F.col("f")[0]), 6).alias("mean_sx"), F.round(F.avg(F.col("f")[6]), 6).alias("mean_dx"), F.round(F.avg(F.col("f")[9]), 6).alias("mean_px"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE abs(x) >= abs(y)) AS along, count(*) FILTER (WHERE x BETWEEN -10 AND 10 AND y BETWEEN 0 AND 20) AS inside FROM objects", heads="o")
def box_containment_2d(spark, sf_dir) -> DataFrame:
    """Two-dimensional containment (xyxy) and the axis a vector follows."""
    inside = F.col("x").between(-10, 10) & F.col("y").between(0, 20)
    return objects(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.abs("x") >= F.abs("y")).alias("along"), F.count_if(inside).alias("inside"))


@query("SELECT scene_id, round(max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))), 6) AS radius, round(max(x) - min(x), 6) AS extent_x, count(*) AS n FROM (SELECT *, avg(x) OVER s AS mx, avg(y) OVER s AS my, avg(z) OVER s AS mz FROM objects WINDOW s AS (PARTITION BY scene_id)) GROUP BY scene_id", heads="o")
def unit_sphere(spark, sf_dir) -> DataFrame:
    """Axis-aligned extent and radius about the mean centre of each scene."""
    objs = objects(spark, sf_dir).select("scene_id", "x", "y", "z")
    centres = objs.groupBy("scene_id").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    met = objs.join(centres, "scene_id")
    d = G.spatial(*[F.col(c) - F.col(f"m{c}") for c in "xyz"])
    return met.groupBy("scene_id").agg(F.round(F.max(d), 6).alias("radius"), F.round(F.max("x") - F.min("x"), 6).alias("extent_x"), F.count("*").alias("n"))
