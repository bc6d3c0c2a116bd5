"""Joins: equality, tolerance, nearest, set keys, rosters, donors, ranges; and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenova.functions import geometry as G
from scenova.functions.ids import hash_order
from scenova.plans.base import query
from scenova.sources.scenes import ORDER, ORDER_SQL, objects, pairs, table


def numbered(objs: DataFrame) -> DataFrame:
    """``objs`` with ord: place in its scene by id, from 0; repeated ids go by place and score, as far as ``objs`` has them."""
    order = [c for c in ORDER if c in objs.columns]
    return objs.withColumn("ord", F.row_number().over(Window.partitionBy("scene_id").orderBy(*order)) - 1)


NUMBERED_SQL = f"numbered AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {ORDER_SQL}) - 1 AS ord FROM objects)"


@query(
    "SELECT CASE WHEN o_orderkey IS NULL THEN 'no_scene' WHEN p_partkey IS NULL THEN 'no_caption' ELSE 'joined' END AS outcome, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL"
)
def token_scene_join(spark, sf_dir) -> DataFrame:
    """Two-step equality join, counting what is lost at either step: what the tables lack."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    scenes, captions = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "part").select("p_partkey")
    met = line.join(scenes, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(captions, F.col("l_partkey") == F.col("p_partkey"), "left")
    outcome = F.when(F.col("o_orderkey").isNull(), "no_scene").when(F.col("p_partkey").isNull(), "no_caption").otherwise("joined")
    return met.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS match, count(*) AS n_rows FROM (SELECT count(*) OVER (PARTITION BY scene_id, category) AS n FROM objects) GROUP BY ALL", heads="o")
def match_ambiguity(spark, sf_dir) -> DataFrame:
    """Whether a (scene, category) key finds one row or several."""
    n = F.count("*").over(Window.partitionBy("scene_id", "category"))
    rows = objects(spark, sf_dir).select("scene_id", "category").withColumn("n", n)
    return rows.groupBy(F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("match")).agg(F.count("*").alias("n_rows"))


@query("SELECT split, count(*) AS n FROM pairs WHERE a_id < b_id GROUP BY split", heads="p")
def unordered_pairs(spark, sf_dir) -> DataFrame:
    return pairs(objects(spark, sf_dir), ordered=False, keep=["split"]).groupBy(F.col("a_split").alias("split")).agg(F.count("*").alias("n"))


@query("SELECT a.split, count(*) AS n FROM objects a JOIN objects b ON a.scene_id = b.scene_id AND a.object_id < b.object_id JOIN objects c ON a.scene_id = c.scene_id AND b.object_id < c.object_id GROUP BY ALL", heads="o")
def unordered_triples(spark, sf_dir) -> DataFrame:
    objs = objects(spark, sf_dir).select("scene_id", "object_id", "split")
    two = pairs(objs, ordered=False)
    third = objs.select("scene_id", F.col("object_id").alias("c_object_id"))
    return two.join(third, "scene_id").where("b_object_id < c_object_id").groupBy(F.col("a_split").alias("split")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE abs((t.x - r.x) - p.dx) > 1e-9) AS mismatched FROM pairs p JOIN objects t ON t.object_id = p.a_id JOIN objects r ON r.object_id = p.b_id", heads="p")
def double_lookup(spark, sf_dir) -> DataFrame:
    """One dimension looked up twice (target and reference) and the stored difference checked again."""
    objs = objects(spark, sf_dir)
    stored = pairs(objs, keep=["x"]).select("a_object_id", "b_object_id", (F.col("a_x") - F.col("b_x")).alias("dx"))
    bank = objs.select("object_id", "x")
    target = bank.select(F.col("object_id").alias("a_object_id"), F.col("x").alias("tx"))
    reference = bank.select(F.col("object_id").alias("b_object_id"), F.col("x").alias("rx"))
    met = stored.join(target, "a_object_id").join(reference, "b_object_id")
    return met.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("tx") - F.col("rx") - F.col("dx")) > 1e-9).alias("mismatched"))


@query(
    f"WITH {NUMBERED_SQL}, c AS (SELECT a.object_id, count(*) OVER (PARTITION BY a.object_id) AS n, b.object_id AS other FROM numbered a JOIN numbered b ON a.scene_id = b.scene_id AND a.category <> b.category WHERE abs(a.x - b.x) <= 4 AND abs(a.y - b.y) <= 4 AND abs(a.z - b.z) <= 4 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 4) SELECT object_id, other FROM c WHERE n = 1",
    heads="o",
)
def tolerance_match(spark, sf_dir) -> DataFrame:
    """Boxes of another class within a tolerance, taken only when there is exactly one."""
    met = pairs(objects(spark, sf_dir), keep=["category", "x", "y", "z"]).where("a_category <> b_category")
    d = [F.col(f"a_{c}") - F.col(f"b_{c}") for c in "xyz"]
    near = met.where((F.greatest(*[F.abs(v) for v in d]) <= 4) & (G.spatial(*d) <= 4))
    found = near.groupBy("a_object_id").agg(F.count("*").alias("n"), F.min("b_object_id").alias("other"))
    return found.where("n = 1").select(F.col("a_object_id").alias("object_id"), "other")


@query(
    f"WITH {NUMBERED_SQL} SELECT c.object_id, arg_min(r.object_id, {{'d': sqrt((c.x - r.x) * (c.x - r.x) + (c.y - r.y) * (c.y - r.y)), 'ord': r.ord}}) AS nearest, round(min(sqrt((c.x - r.x) * (c.x - r.x) + (c.y - r.y) * (c.y - r.y))), 6) AS distance FROM numbered c JOIN numbered r ON c.scene_id = r.scene_id AND c.category = r.category AND c.ord % 2 = 1 AND r.ord % 2 = 0 WHERE sqrt((c.x - r.x) * (c.x - r.x) + (c.y - r.y) * (c.y - r.y)) < 8 GROUP BY c.object_id",
    heads="o",
)
def nearest_context(spark, sf_dir) -> DataFrame:
    """Each context object's nearest referred object of its class within a radius, the first on ties."""
    rows = numbered(objects(spark, sf_dir)).select("scene_id", "category", "object_id", "x", "y", "ord")
    context = rows.where("ord % 2 = 1").select("scene_id", "category", F.col("object_id").alias("c_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    met = context.join(rows.where("ord % 2 = 0"), ["scene_id", "category"])
    met = met.withColumn("d", G.planar(F.col("cx") - F.col("x"), F.col("cy") - F.col("y"))).where("d < 8")
    best = met.groupBy("c_id").agg(F.min_by("object_id", F.struct("d", "ord")).alias("nearest"), F.round(F.min("d"), 6).alias("distance"))
    return best.withColumnRenamed("c_id", "object_id")


@query(
    "WITH s AS (SELECT scene_id, list_sort(list(DISTINCT category)) AS key FROM objects GROUP BY scene_id) SELECT a.key::VARCHAR AS key, count(*) AS n FROM s a JOIN (SELECT key FROM s GROUP BY key HAVING count(*) > 1) b ON a.key = b.key GROUP BY ALL",
    heads="o",
)
def set_key_join(spark, sf_dir) -> DataFrame:
    """Join on equality of sets."""
    sets = objects(spark, sf_dir).groupBy("scene_id").agg(F.array_sort(F.collect_set("category")).alias("key"))
    shared = sets.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    n = sets.join(shared, "key").groupBy("key").agg(F.count("*").alias("n"))
    return n.select(F.concat(F.lit("["), F.array_join("key", ", "), F.lit("]")).alias("key"), "n")


@query("SELECT side, count(*) AS n FROM (SELECT CASE WHEN o_custkey IS NULL THEN 'right_only' WHEN c_custkey IS NULL THEN 'left_only' ELSE 'both' END AS side FROM (SELECT DISTINCT o_custkey FROM orders) a FULL JOIN customer ON o_custkey = c_custkey) GROUP BY ALL")
def roster_diff(spark, sf_dir) -> DataFrame:
    """Full outer roster check: both, left only and right only. Customers without orders are the missing keys."""
    a = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    met = a.join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "full_outer")
    side = F.when(F.col("o_custkey").isNull(), "right_only").when(F.col("c_custkey").isNull(), "left_only").otherwise("both")
    return met.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@query("SELECT object_id, donor FROM (SELECT a.object_id, a.n, list_extract(a.ids, CAST((a.i * 17 + 42) % a.n + 1 AS INTEGER)) AS donor FROM (SELECT object_id, i, list_filter(ids, lambda o: o <> object_id) AS ids, len(ids) - 1 AS n FROM (SELECT object_id, row_number() OVER (PARTITION BY scene_id ORDER BY object_id) - 1 AS i, list(object_id ORDER BY object_id) OVER (PARTITION BY scene_id) AS ids FROM (SELECT DISTINCT scene_id, object_id FROM objects))) a WHERE n > 0)", heads="o")
def donor_tokens(spark, sf_dir) -> DataFrame:
    """A donor of the same group for each object, never itself, chosen by (place * 17 + 42) mod the others."""
    groups = objects(spark, sf_dir).groupBy("scene_id").agg(F.sort_array(F.collect_set("object_id")).alias("ids")).where(F.size("ids") > 1)
    rows = groups.select("ids", F.posexplode("ids").alias("i", "object_id"))
    others = F.filter("ids", lambda o: o != F.col("object_id"))
    return rows.select("object_id", F.element_at(others, ((F.col("i") * 17 + 42) % F.size(others) + 1).cast("int")).alias("donor"))


@query("SELECT object_id, coalesce(lead(object_id) OVER w, first_value(object_id) OVER w) AS donor FROM objects WINDOW w AS (PARTITION BY scene_id ORDER BY sha1('42|' || object_id) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", heads="o")
def derangement(spark, sf_dir) -> DataFrame:
    """Next one in hash order, the last one taking the first: no one keeps its own when there are two."""
    w = Window.partitionBy("scene_id").orderBy(hash_order("42", F.col("object_id")))
    first = F.first("object_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return objects(spark, sf_dir).select("scene_id", "object_id").select("object_id", F.coalesce(F.lead("object_id").over(w), first).alias("donor"))


@query("SELECT b.object_id, count(*) AS n FROM objects b JOIN objects p ON b.scene_id = p.scene_id WHERE abs((p.x - b.x) * cos(b.yaw) + (p.y - b.y) * sin(b.yaw)) < b.l * 2 + 1e-5 AND abs((p.y - b.y) * cos(b.yaw) - (p.x - b.x) * sin(b.yaw)) < b.w * 2 + 1e-5 AND abs(p.z - b.z) <= b.h / 2 GROUP BY b.object_id", heads="o")
def points_in_boxes(spark, sf_dir) -> DataFrame:
    """Points (centres) inside turned boxes of four times the size in the plane, counted per box."""
    objs = objects(spark, sf_dir)
    points = objs.select("scene_id", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    boxes = objs.select("scene_id", "object_id", "x", "y", "z", (F.col("l") * 4).alias("l"), (F.col("w") * 4).alias("w"), "h", "yaw")
    met = boxes.join(points, "scene_id").where(G.in_box(F.col("px"), F.col("py"), F.col("pz"), tuple(F.col(c) for c in ("x", "y", "z", "l", "w", "h", "yaw"))))
    return met.groupBy("object_id").agg(F.count("*").alias("n"))


@query("SELECT p.object_id, coalesce(max(CASE WHEN abs(p.x - b.x) <= b.l / 2 AND abs(p.y - b.y) <= b.w / 2 AND abs(p.z - b.z) <= b.h / 2 AND p.object_id <> b.object_id THEN b.ord END), -1) AS label FROM numbered p JOIN numbered b ON p.scene_id = b.scene_id GROUP BY p.object_id".join([f"WITH {NUMBERED_SQL} ", ""]), heads="o")
def point_labels(spark, sf_dir) -> DataFrame:
    """Instance label of each point: the highest box that holds it, -1 for none."""
    rows = numbered(objects(spark, sf_dir))
    points = rows.select("scene_id", F.col("object_id").alias("p_id"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    met = points.join(rows, "scene_id")
    inside = (F.abs(F.col("px") - F.col("x")) <= F.col("l") / 2) & (F.abs(F.col("py") - F.col("y")) <= F.col("w") / 2) & (F.abs(F.col("pz") - F.col("z")) <= F.col("h") / 2) & (F.col("p_id") != F.col("object_id"))
    return met.groupBy(F.col("p_id").alias("object_id")).agg(F.coalesce(F.max(F.when(inside, F.col("ord"))), F.lit(-1)).cast("long").alias("label"))


@query("SELECT s_name, coalesce(n + 1, 0) AS others FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY l_suppkey) ON s_suppkey = l_suppkey")
def lookup_with_fallback(spark, sf_dir) -> DataFrame:
    """A looked-up count plus one, with a default where the key is missing."""
    n = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    met = table(spark, sf_dir, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return met.select("s_name", F.coalesce(F.col("n") + 1, F.lit(0)).alias("others"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_anti(spark, sf_dir) -> DataFrame:
    """Semi join on one list, anti join on another."""
    orders = table(spark, sf_dir, "orders")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    open_ = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_semi").join(open_, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT count(*) AS links, count(DISTINCT least(a_id, b_id) || '|' || greatest(a_id, b_id)) AS edges, count(*) - count(DISTINCT least(a_id, b_id) || '|' || greatest(a_id, b_id)) AS reversed FROM pairs WHERE abs(dx) < 2", heads="p")
def edge_dedup(spark, sf_dir) -> DataFrame:
    """Undirected edges of a directed list, with the reversed copies counted."""
    near = pairs(objects(spark, sf_dir), keep=["x"]).where(F.abs(F.col("a_x") - F.col("b_x")) < 2)
    key = F.array_sort(F.array("a_object_id", "b_object_id"))
    edges = near.groupBy(key.alias("k")).agg(F.count("*").alias("c"))
    return edges.agg(F.sum("c").alias("links"), F.count("*").alias("edges"), (F.sum("c") - F.count("*")).alias("reversed"))


@query("SELECT scene_id, category, round(x, 2) AS rx, round(y, 2) AS ry, min(object_id) AS first_id, count(*) AS n_refs FROM objects GROUP BY ALL", heads="o")
def context_dedup(spark, sf_dir) -> DataFrame:
    """Boxes equal in class and centimetre centre as one, with the references kept."""
    key = ["scene_id", "category", F.round("x", 2).alias("rx"), F.round("y", 2).alias("ry")]
    return objects(spark, sf_dir).groupBy(*key).agg(F.min("object_id").alias("first_id"), F.size(F.collect_list("object_id")).cast("long").alias("n_refs"))


@query("SELECT scene_id FROM objects WHERE category = 0 INTERSECT SELECT scene_id FROM objects WHERE category = 1", heads="o")
def scenes_with_both(spark, sf_dir) -> DataFrame:
    objs = objects(spark, sf_dir)
    return objs.where("category = 0").select("scene_id").intersect(objs.where("category = 1").select("scene_id"))


@query("SELECT side, count(*) AS n FROM (SELECT 'left' AS side, scene_id FROM (SELECT scene_id FROM objects WHERE category = 0 EXCEPT SELECT scene_id FROM objects WHERE category = 1) UNION ALL SELECT 'right', scene_id FROM (SELECT scene_id FROM objects WHERE category = 1 EXCEPT SELECT scene_id FROM objects WHERE category = 0)) GROUP BY side", heads="o")
def id_difference(spark, sf_dir) -> DataFrame:
    """Left-only and right-only ids."""
    objs = objects(spark, sf_dir)
    a, b = (objs.where(f"category = {k}").select("scene_id") for k in (0, 1))
    both = a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))
    return both.groupBy("side").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS added FROM (SELECT b_id AS s, a_id AS o FROM pairs WHERE dx > 5 AND split = 'train' EXCEPT SELECT a_id, b_id FROM pairs WHERE dx < -20)", heads="p")
def missing_swaps(spark, sf_dir) -> DataFrame:
    """Reversed rows whose signature isn't there yet."""
    met = pairs(objects(spark, sf_dir), keep=["split", "x"]).withColumn("dx", F.col("a_x") - F.col("b_x"))
    reversed_ = met.where("dx > 5 and a_split = 'train'").select(F.col("b_object_id").alias("s"), F.col("a_object_id").alias("o"))
    present = met.where("dx < -20").select(F.col("a_object_id").alias("s"), F.col("b_object_id").alias("o"))
    return reversed_.join(present, ["s", "o"], "left_anti").agg(F.count("*").alias("added"))


@query("SELECT split, min(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS single_split, count(*) AS sequences FROM (SELECT sequence, count(DISTINCT split) AS n, min(split) AS split FROM objects GROUP BY sequence) GROUP BY split", heads="o")
def split_conflicts(spark, sf_dir) -> DataFrame:
    """Whether a sequence occurs in one split only."""
    per = objects(spark, sf_dir).groupBy("sequence").agg(F.countDistinct("split").alias("n"), F.min("split").alias("split"))
    return per.groupBy("split").agg(F.min(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single_split"), F.count("*").alias("sequences"))
