"""Annotation records of grounding sets in their three layouts: linked pairs, whole scenes and native captions.

A record has a caption, its targets in the caption's order, a character span
and the word of each target's noun, object ids, classes and boxes. Pairs and
scenes index the caption as it stands; native captions index it with a blank
before and behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenova.functions import annotations as A
from scenova.functions.ids import role
from scenova.plans.base import query
from scenova.sources.scenes import objects

BOX = ("x", "y", "z", "l", "w", "h", "yaw")
MOST_TARGETS, TOLERANCE = 5, 0.05
NUMBERED_SQL = "numbered AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY object_id, x, y) - 1 AS ord FROM objects)"


def members(spark, sf_dir) -> DataFrame:
    """Objects of a scene with their place, noun (the caption's second word) and box."""
    order = Window.partitionBy("scene_id").orderBy("object_id", "x", "y")
    rows = objects(spark, sf_dir).withColumn("ord", F.row_number().over(order) - 1)
    return rows.select("scene_id", F.col("ord").cast("int").alias("ord"), "object_id", "caption", F.split_part("caption", F.lit(" "), F.lit(2)).alias("class"), F.array(*BOX).alias("box"))


def composed(held: Column) -> Column:
    """Struct (caption, targets) of an array of members: captions in one text behind their letters, and each noun's span in it."""
    part = lambda m, i: F.concat(F.lit("Object "), role(i), F.lit(": "), m["caption"], F.lit("."))
    parts = F.transform(held, part)
    starts = F.aggregate(parts, F.array(F.lit(0)), lambda s, p: F.array_append(s, F.element_at(s, F.lit(-1)) + F.length(p) + 1))

    def target(m: Column, i: Column) -> Column:
        start = F.get(starts, i) + 10 + F.position(m["class"], m["caption"]) - 1
        return F.struct(m["object_id"].alias("object_id"), m["class"].alias("class"), start.alias("start"), (start + F.length(m["class"])).alias("end"), m["box"].alias("box"))

    return F.struct(F.array_join(parts, " ").alias("caption"), F.transform(held, target).alias("targets"))


def shown(rows: DataFrame, *keys: str) -> DataFrame:
    """Records with their nested parts as text: spans, classes and ids in order, and the sum of all boxes."""
    join = lambda f: F.array_join(F.transform("targets", f), ",")
    boxes = F.aggregate(F.flatten(F.transform("targets", lambda t: t["box"])), F.lit(0.0), lambda s, v: s + v)
    return rows.select(*keys, "caption", F.size("targets").alias("n"), join(lambda t: F.concat_ws("-", t["start"].cast("string"), t["end"].cast("string"))).alias("spans"), join(lambda t: t["class"]).alias("classes"), join(lambda t: t["object_id"]).alias("ids"), F.round(boxes, 4).alias("boxes"))


COMPOSED_SQL = """p AS (SELECT *, 'Object ' || chr(65 + CAST(i AS INTEGER)) || ': ' || caption || '.' AS part FROM m),
q AS (SELECT *, coalesce(sum(length(part) + 1) OVER (PARTITION BY record ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 10 + instr(caption, class) - 1 AS start FROM p)"""


def shown_sql(caption: str = "string_agg(part, ' ' ORDER BY i)") -> str:
    spans = "string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(class) AS BIGINT), ',' ORDER BY i) AS spans"
    return f"{caption} AS caption, CAST(count(*) AS INTEGER) AS n, {spans}, string_agg(class, ',' ORDER BY i) AS classes, string_agg(object_id, ',' ORDER BY i) AS ids, round(sum(x + y + z + l + w + h + yaw), 4) AS boxes"


CLASS_SQL = "split_part(caption, ' ', 2) AS class"


@query(f"WITH {NUMBERED_SQL}, m AS (SELECT scene_id AS record, ord AS i, *, {CLASS_SQL} FROM numbered QUALIFY count(*) OVER (PARTITION BY scene_id) <= {MOST_TARGETS}), {COMPOSED_SQL} SELECT record AS scene_id, {shown_sql()} FROM q GROUP BY record", heads="o")
def whole_scene_records(spark, sf_dir) -> DataFrame:
    """Scenes of one to five objects as one record each, all objects its targets."""
    one = F.struct("ord", "object_id", "caption", "class", "box")
    held = members(spark, sf_dir).groupBy("scene_id").agg(F.sort_array(F.collect_list(one)).alias("held"), F.count("*").alias("size")).where(F.col("size") <= MOST_TARGETS)
    rows = held.select("scene_id", composed(F.col("held")).alias("r")).select("scene_id", "r.*")
    return shown(rows, "scene_id")


#: Each object lists the next one of its scene as another, a little off; those of even place list the one before as well.
@query(
    f"WITH {NUMBERED_SQL}, c AS (SELECT *, {CLASS_SQL} FROM numbered), "
    "o AS (SELECT a.scene_id, a.ord AS source, b.class AS other_class, b.x + 0.01::DOUBLE AS ox, b.y AS oy, b.z AS oz FROM c a JOIN c b ON a.scene_id = b.scene_id AND (b.ord = a.ord + 1 OR (a.ord % 2 = 0 AND b.ord = a.ord - 1)) WHERE (a.ord + b.ord) % 5 <> 4), "
    f"k AS (SELECT o.scene_id, source, min(c.ord) AS matched FROM o JOIN c ON c.scene_id = o.scene_id AND c.ord <> source AND c.class = other_class AND abs(c.x - ox) <= {TOLERANCE} AND abs(c.y - oy) <= {TOLERANCE} AND abs(c.z - oz) <= {TOLERANCE} GROUP BY o.scene_id, source, other_class, ox, oy, oz), "
    "u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY scene_id, least(source, matched), greatest(source, matched) ORDER BY source, matched) = 1), "
    "m AS (SELECT u.scene_id || ':' || u.source || ':' || u.matched AS record, u.scene_id AS scene, source, matched, s.i, c.* FROM u, (SELECT unnest([0, 1]) AS i) s, c WHERE c.scene_id = u.scene_id AND c.ord = CASE s.i WHEN 0 THEN source ELSE matched END), "
    f"{COMPOSED_SQL} SELECT scene AS scene_id, CAST(source AS INTEGER) AS source, CAST(matched AS INTEGER) AS matched, {shown_sql()} FROM q GROUP BY record, scene, source, matched",
    heads="o",
)
def linked_pair_records(spark, sf_dir) -> DataFrame:
    """Pairs of objects of which one lists the other's box: matched by class within a tolerance, reverse links once, composed in the order of the link."""
    held = members(spark, sf_dir)
    a, b = (held.select("scene_id", F.struct(*[c for c in held.columns if c != "scene_id"]).alias(k)) for k in "ab")
    near = (F.col("b.ord") == F.col("a.ord") + 1) | ((F.col("a.ord") % 2 == 0) & (F.col("b.ord") == F.col("a.ord") - 1))
    links = a.join(b, "scene_id").where(near & ((F.col("a.ord") + F.col("b.ord")) % 5 != 4))
    other = F.struct(F.col("b.class").alias("class"), (F.col("b.box")[0] + 0.01).alias("x"), F.col("b.box")[1].alias("y"), F.col("b.box")[2].alias("z"))
    links = links.select("scene_id", F.col("a").alias("source"), other.alias("other"))
    found = links.join(held.select("scene_id", F.struct(*[c for c in held.columns if c != "scene_id"]).alias("m")), "scene_id")
    close = [F.abs(F.col("m.box")[i] - F.col(f"other.{c}")) <= TOLERANCE for i, c in enumerate("xyz")]
    found = found.where((F.col("m.ord") != F.col("source.ord")) & (F.col("m.class") == F.col("other.class")) & close[0] & close[1] & close[2])
    matched = found.groupBy("scene_id", "source", "other").agg(F.min("m").alias("m"))
    key = [F.least("source.ord", "m.ord").alias("first"), F.greatest("source.ord", "m.ord").alias("second")]
    once = matched.groupBy("scene_id", *key).agg(F.min(F.struct(F.col("source.ord").alias("s"), F.col("m.ord").alias("t"), "source", "m")).alias("p"))
    rows = once.select("scene_id", F.col("p.s").alias("source"), F.col("p.t").alias("matched"), composed(F.array("p.source", "p.m")).alias("r"))
    return shown(rows.select("scene_id", "source", "matched", "r.*"), "scene_id", "source", "matched")


@query(
    f"WITH {NUMBERED_SQL}, c AS (SELECT *, {CLASS_SQL}, count(*) OVER (PARTITION BY scene_id, split_part(caption, ' ', 2)) AS alike FROM numbered WHERE ord < 3), "
    "t AS (SELECT scene_id, ' ' || string_agg(CASE ord WHEN 0 THEN '' WHEN 1 THEN 'near the ' ELSE 'and the ' END || caption, ' ' ORDER BY ord) || ' ' AS part FROM c GROUP BY scene_id HAVING count(*) = 3), "
    "w AS (SELECT scene_id, unnest(string_split(part, ' ')) AS word, unnest(range(len(string_split(part, ' ')))) AS k, string_split(part, ' ') AS l FROM t), "
    "s AS (SELECT scene_id, word, min(list_sum(list_transform(l[: k], lambda v: length(v) + 1))) AS start FROM w WHERE word <> '' GROUP BY scene_id, word HAVING count(*) = 1), "
    "m AS (SELECT c.*, t.part, s.start, row_number() OVER (PARTITION BY c.scene_id ORDER BY s.start) - 1 AS i FROM c JOIN t ON c.scene_id = t.scene_id JOIN s ON s.scene_id = c.scene_id AND s.word = c.class WHERE alike = 1), "
    "g AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY scene_id) >= 2 AND min(ord) OVER (PARTITION BY scene_id) = 0) "
    f"SELECT scene_id, {shown_sql('min(part)')} FROM g GROUP BY scene_id",
    heads="o",
)
def native_caption_records(spark, sf_dir) -> DataFrame:
    """Captions that name two or three objects beyond doubt, the main one among them: one object and one mention of each class, spans over the padded caption."""
    held = members(spark, sf_dir).where("ord < 3").groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("ord", "object_id", "caption", "class", "box"))).alias("held")).where(F.size("held") == 3)
    lead = F.array(F.lit(""), F.lit("near the "), F.lit("and the "))
    said = F.concat(F.lit(" "), F.array_join(F.transform("held", lambda m, i: F.concat(F.get(lead, i), m["caption"])), " "), F.lit(" "))
    rows = held.withColumn("caption", said).withColumn("words", A.word_offsets(F.col("caption")))
    mentions = lambda m: F.filter("words", lambda w: w["word"] == m["class"])
    clear = F.filter("held", lambda m: (F.size(mentions(m)) == 1) & (F.size(F.filter("held", lambda o: o["class"] == m["class"])) == 1))
    target = lambda m: F.struct(mentions(m)[0]["start"].alias("start"), mentions(m)[0]["end"].alias("end"), m["ord"].alias("ord"), m["object_id"].alias("object_id"), m["class"].alias("class"), m["box"].alias("box"))
    rows = rows.select("scene_id", "caption", F.sort_array(F.transform(clear, target)).alias("targets"))
    return shown(rows.where((F.size("targets") >= 2) & F.exists("targets", lambda t: t["ord"] == 0)), "scene_id")
