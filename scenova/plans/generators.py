"""Row generators: questions and answers from scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenova.functions import geometry as G
from scenova.functions.ids import stable_id
from scenova.plans.base import query
from scenova.plans.joins import NUMBERED_SQL, numbered
from scenova.sources.scenes import objects, pairs


def directed(spark, sf_dir) -> DataFrame:
    """Ordered pairs with their differences."""
    met = pairs(objects(spark, sf_dir), keep=["split", "caption", "x", "y", "z"])
    return met.select("scene_id", F.col("a_split").alias("split"), F.col("a_object_id").alias("a_id"), F.col("b_object_id").alias("b_id"), "a_caption", "b_caption", F.col("a_x").alias("ax"), F.col("a_y").alias("ay"), F.col("b_x").alias("bx"), F.col("b_y").alias("by"), *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"d{c}") for c in "xyz"])


DOMINANT_SQL = "CASE WHEN greatest(abs(dx), abs(dy)) < 1 THEN NULL WHEN abs(dx) >= abs(dy) THEN (CASE WHEN dx > 0 THEN 'front' ELSE 'behind' END) ELSE (CASE WHEN dy > 0 THEN 'left' ELSE 'right' END) END"
PHRASE_SQL = "CASE r WHEN 'front' THEN 'in front of' WHEN 'behind' THEN 'behind' ELSE 'to the ' || r || ' of' END"


@query(f"SELECT substr(sha1(scene_id || '|cardinal|' || a_id || '|' || b_id), 1, 16) AS qa_id, 'The ' || a_caption || ' is ' || {PHRASE_SQL} || ' the ' || b_caption || '.' AS answer FROM (SELECT *, {DOMINANT_SQL} AS r FROM pairs) WHERE r IS NOT NULL AND a_caption <> b_caption", heads="p")
def native_qa(spark, sf_dir) -> DataFrame:
    """A cardinal-relation answer for each ordered pair of different captions."""
    rows = directed(spark, sf_dir).withColumn("r", G.dominant_relation(F.col("dx"), F.col("dy"))).where("r is not null and a_caption <> b_caption")
    phrase = F.when(F.col("r") == "front", "in front of").when(F.col("r") == "behind", "behind").otherwise(F.concat(F.lit("to the "), F.col("r"), F.lit(" of")))
    return rows.select(stable_id(F.col("scene_id"), F.lit("cardinal"), F.col("a_id"), F.col("b_id")).alias("qa_id"), F.concat(F.lit("The "), F.col("a_caption"), F.lit(" is "), phrase, F.lit(" the "), F.col("b_caption"), F.lit(".")).alias("answer"))


@query("SELECT scenario, split, count(*) AS n FROM (SELECT 'cardinal' AS scenario, split FROM pairs WHERE greatest(abs(dx), abs(dy)) >= 1 UNION ALL SELECT 'ego_distance', split FROM objects UNION ALL SELECT 'pair_distance', split FROM pairs WHERE a_id < b_id UNION ALL SELECT 'ego_relative', split FROM pairs WHERE a_id < b_id AND abs(sqrt(x1 * x1 + y1 * y1) - sqrt(x2 * x2 + y2 * y2)) >= 0.5 UNION ALL SELECT 'ego_motion', split FROM objects, range(4) UNION ALL SELECT 'object_motion', split FROM pairs, range(4)) GROUP BY ALL", heads="p")
def native_qa_counts(spark, sf_dir) -> DataFrame:
    """Rows of each scenario: one frame for each, put together, counted."""
    met, objs = directed(spark, sf_dir), objects(spark, sf_dir)
    four = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("m")
    low = F.col("a_id") < F.col("b_id")
    gap = F.abs(G.planar(F.col("ax"), F.col("ay")) - G.planar(F.col("bx"), F.col("by")))
    parts = [
        ("cardinal", met.where(F.greatest(F.abs("dx"), F.abs("dy")) >= 1).select("split")),
        ("ego_distance", objs.select("split")),
        ("pair_distance", met.where(low).select("split")),
        ("ego_relative", met.where(low & (gap >= 0.5)).select("split")),
        ("ego_motion", objs.select("split", four).select("split")),
        ("object_motion", met.select("split", four).select("split")),
    ]
    rows = None
    for name, part in parts:
        part = part.groupBy("split").agg(F.count("*").alias("n")).select(F.lit(name).alias("scenario"), "split", "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("SELECT scenario, key, count(*) AS n FROM (SELECT 'ego_side' AS scenario, CASE WHEN y > 0 THEN 'left' ELSE 'right' END AS key FROM objects WHERE abs(y) >= 2 UNION ALL SELECT 'ego_near_far', CASE WHEN sqrt(x * x + y * y) <= 15 THEN 'near' ELSE 'far' END FROM objects WHERE sqrt(x * x + y * y) <= 15 OR sqrt(x * x + y * y) >= 30 UNION ALL SELECT 'which_is_left', CASE WHEN dy > 0 THEN 'A' ELSE 'B' END FROM pairs WHERE a_id < b_id AND abs(dy) >= 2 UNION ALL SELECT 'closer_to_ego', CASE WHEN da < db THEN 'A' ELSE 'B' END FROM (SELECT sqrt(x1 * x1 + y1 * y1) AS da, sqrt(x2 * x2 + y2 * y2) AS db FROM pairs WHERE a_id < b_id) WHERE abs(da - db) >= greatest(3.0, 0.15 * least(da, db))) GROUP BY ALL", heads="p")
def scenario_qa_keys(spark, sf_dir) -> DataFrame:
    """Keys of four scenarios with their ambiguity rules."""
    objs, met = objects(spark, sf_dir), directed(spark, sf_dir).where("a_id < b_id")
    d = G.planar(F.col("x"), F.col("y"))
    side = objs.where(F.abs("y") >= 2).select(F.lit("ego_side").alias("scenario"), F.when(F.col("y") > 0, "left").otherwise("right").alias("key"))
    range_ = objs.where((d <= 15) | (d >= 30)).select(F.lit("ego_near_far").alias("scenario"), F.when(d <= 15, "near").otherwise("far").alias("key"))
    left = met.where(F.abs("dy") >= 2).select(F.lit("which_is_left").alias("scenario"), F.when(F.col("dy") > 0, "A").otherwise("B").alias("key"))
    a, b = G.planar(F.col("ax"), F.col("ay")), G.planar(F.col("bx"), F.col("by"))
    close = met.where(F.abs(a - b) >= F.greatest(F.lit(3.0), 0.15 * F.least(a, b))).select(F.lit("closer_to_ego").alias("scenario"), F.when(a < b, "A").otherwise("B").alias("key"))
    return side.unionByName(range_).unionByName(left).unionByName(close).groupBy("scenario", "key").agg(F.count("*").alias("n"))


@query("SELECT split, count(*) AS n FROM (SELECT a.split, abs(a.d - b.d) >= greatest(3.0, 0.15 * least(a.d, b.d)) AS ok FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY d, ord) AS rn FROM (SELECT *, sqrt(x * x + y * y) AS d FROM numbered)) a JOIN (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY d, ord) AS rn FROM (SELECT *, sqrt(x * x + y * y) AS d FROM numbered)) b ON a.scene_id = b.scene_id AND a.rn = 1 AND b.rn = 2 JOIN (SELECT scene_id FROM objects GROUP BY scene_id HAVING count(*) >= 3) c ON c.scene_id = a.scene_id) WHERE ok GROUP BY split".join([f"WITH {NUMBERED_SQL} ", ""]), heads="o")
def closest_of_three(spark, sf_dir) -> DataFrame:
    """Scenes of three objects or more whose closest one leads clearly."""
    from pyspark.sql import Window

    rows = numbered(objects(spark, sf_dir)).withColumn("d", G.planar(F.col("x"), F.col("y")))
    w = Window.partitionBy("scene_id").orderBy("d", "ord")
    rows = rows.select("split", F.row_number().over(w).alias("rn"), "d", F.lead("d").over(w).alias("e"), F.count("*").over(Window.partitionBy("scene_id")).alias("n"))
    ok = F.abs(F.col("d") - F.col("e")) >= F.greatest(F.lit(3.0), 0.15 * F.least("d", "e"))
    return rows.where("rn = 1 and n >= 3").where(ok).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT variant, count(*) AS n FROM (SELECT unnest(range(CASE c WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 2 END)) AS variant FROM pairs p JOIN (SELECT scene_id, count(*) AS c FROM objects GROUP BY scene_id) s ON p.scene_id = s.scene_id) GROUP BY variant", heads="p")
def paraphrase_variants(spark, sf_dir) -> DataFrame:
    """One question for each template of a pair; how many depends on the scene's size."""
    met = directed(spark, sf_dir).select("scene_id")
    sizes = objects(spark, sf_dir).groupBy("scene_id").agg(F.count("*").alias("c"))
    count = F.when(F.col("c") == 2, 1).when(F.col("c") == 3, 3).otherwise(2)
    rows = met.join(sizes, "scene_id").select(F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))).alias("variant"))
    return rows.groupBy("variant").agg(F.count("*").alias("n"))


@query("SELECT a_id, b_id, lat || '_' || lon AS relation, CASE lat WHEN 'left' THEN 'right' ELSE 'left' END || '_' || CASE lon WHEN 'front' THEN 'behind' ELSE 'front' END AS swapped FROM (SELECT a_id, b_id, CASE WHEN dy >= 1.5 THEN 'left' WHEN dy <= -1.5 THEN 'right' END AS lat, CASE WHEN dx >= 3 THEN 'front' WHEN dx <= -3 THEN 'behind' END AS lon FROM pairs WHERE a_id < b_id) WHERE lat IS NOT NULL AND lon IS NOT NULL", heads="p")
def physical_swap(spark, sf_dir) -> DataFrame:
    """Two-word relations and the relation after the objects change places."""
    rows = directed(spark, sf_dir).where("a_id < b_id").withColumn("relation", G.dead_zone_relation(F.col("dx"), F.col("dy"))).where(F.col("relation").contains("_"))
    return rows.select("a_id", "b_id", "relation", G.inverse_relation(F.col("relation")).alias("swapped"))


@query("SELECT scene_id, string_agg(caption, ' ; ' ORDER BY object_id) AS composed, CAST(sum(length(caption) + 3) - 3 AS BIGINT) AS total FROM objects GROUP BY scene_id", heads="o")
def composed_captions(spark, sf_dir) -> DataFrame:
    """Captions of a scene in one text, with offsets of the pieces as a running sum."""
    rows = objects(spark, sf_dir).groupBy("scene_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("object_id", "caption"))), lambda o: o["caption"]).alias("c"))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda n, c: n + F.length(c) + 3) - 3
    return rows.select("scene_id", F.array_join("c", " ; ").alias("composed"), total.alias("total"))


@query("SELECT scene_id, CASE WHEN n = 2 THEN 'pair' ELSE 'triple' END AS kind, n FROM (SELECT scene_id, count(DISTINCT caption) AS n FROM objects GROUP BY scene_id) WHERE n BETWEEN 2 AND 3", heads="o")
def scene_records(spark, sf_dir) -> DataFrame:
    """Scenes with two or three distinct captions, as records."""
    rows = objects(spark, sf_dir).groupBy("scene_id").agg(F.countDistinct("caption").alias("n")).where("n between 2 and 3")
    return rows.select("scene_id", F.when(F.col("n") == 2, "pair").otherwise("triple").alias("kind"), "n")


@query("SELECT lat, lon, count(*) AS n FROM (SELECT CASE WHEN abs(dy) < 1 THEN 'none' WHEN dy > 0 THEN 'left' ELSE 'right' END AS lat, CASE WHEN abs(dx) < 1 THEN 'none' WHEN dx > 0 THEN 'front' ELSE 'behind' END AS lon FROM pairs) GROUP BY ALL", heads="p")
def auxiliary_labels(spark, sf_dir) -> DataFrame:
    """Three-way lateral and longitudinal labels of ordered pairs."""
    lat = F.when(F.abs("dy") < 1, "none").when(F.col("dy") > 0, "left").otherwise("right")
    lon = F.when(F.abs("dx") < 1, "none").when(F.col("dx") > 0, "front").otherwise("behind")
    return directed(spark, sf_dir).groupBy(lat.alias("lat"), lon.alias("lon")).agg(F.count("*").alias("n"))


@query("SELECT phrase, count(*) AS n FROM (SELECT 'Where is the ' || a_caption || ' relative to the ' || b_caption || '?' AS phrase FROM pairs WHERE dx > 20) GROUP BY phrase", heads="p")
def pair_questions(spark, sf_dir) -> DataFrame:
    rows = directed(spark, sf_dir).where("dx > 20")
    return rows.groupBy(F.concat(F.lit("Where is the "), F.col("a_caption"), F.lit(" relative to the "), F.col("b_caption"), F.lit("?")).alias("phrase")).agg(F.count("*").alias("n"))


@query("SELECT scene_id, a_id, b_id, CASE WHEN abs(dx) >= 0.5 AND abs(dx) >= abs(dy) + 0.25 THEN (CASE WHEN dx > 0 THEN 'front' ELSE 'behind' END) ELSE (CASE WHEN dy > 0 THEN 'left' ELSE 'right' END) END AS answer FROM pairs WHERE sqrt(dx * dx + dy * dy) >= 1 AND ((abs(dx) >= 0.5 AND abs(dx) >= abs(dy) + 0.25) OR (abs(dy) >= 0.5 AND abs(dy) >= abs(dx) + 0.25))", heads="p")
def scene_questions(spark, sf_dir) -> DataFrame:
    """All clear ordered pairs of a scene with their answer: 0 to n(n-1) rows for each scene."""
    rows = directed(spark, sf_dir).where(G.planar(F.col("dx"), F.col("dy")) >= 1)
    return rows.select("scene_id", "a_id", "b_id", G.margin_relation(F.col("dx"), F.col("dy")).alias("answer")).where("answer is not null")


