"""Ranking, running totals, top-k, samples, quotas and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenova.functions import geometry as G
from scenova.functions.ids import hash_order, odd_digest, stable_id
from scenova.operators.neighbours import clouds
from scenova.operators.ranks import area_under, hash_rank, precision_recall
from scenova.plans.aggregates import scored
from scenova.plans.base import query
from scenova.plans.geometry import IOU_SQL
from scenova.plans.joins import NUMBERED_SQL, numbered
from scenova.sources.scenes import objects, pairs, table


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group in an order, numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


@query(f"WITH {NUMBERED_SQL} SELECT object_id, row_number() OVER (PARTITION BY scene_id ORDER BY sqrt(x * x + y * y), ord) AS rank FROM numbered", heads="o")
def rank_distance(spark, sf_dir) -> DataFrame:
    """Place of each object by planar distance, by number on ties."""
    w = Window.partitionBy("scene_id").orderBy("d", "ord")
    rows = numbered(objects(spark, sf_dir)).withColumn("d", G.planar(F.col("x"), F.col("y")))
    return rows.select("object_id", F.row_number().over(w).cast("long").alias("rank"))


@query(f"WITH {NUMBERED_SQL} SELECT a.object_id, arg_min(b.object_id, {{'d': sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 'ord': b.ord}}) AS nearest, arg_max(b.object_id, {{'d': sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 'ord': b.ord}}) AS farthest FROM numbered a JOIN numbered b ON a.scene_id = b.scene_id AND a.ord <> b.ord GROUP BY a.object_id", heads="o")
def anchor_extremes(spark, sf_dir) -> DataFrame:
    """Nearest (first on ties) and farthest (last on ties) other object of each anchor."""
    met = pairs(numbered(objects(spark, sf_dir)), keep=["x", "y", "ord"])
    key = F.struct(G.planar(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")).alias("d"), F.col("b_ord").alias("ord"))
    return met.groupBy(F.col("a_object_id").alias("object_id")).agg(F.min_by("b_object_id", key).alias("nearest"), F.max_by("b_object_id", key).alias("farthest"))


@query(f"WITH {NUMBERED_SQL} SELECT scene_id, gap >= 3.0 AS clear FROM (SELECT scene_id, row_number() OVER w AS rn, lead(d) OVER w - d AS gap FROM (SELECT *, sqrt(x * x + y * y) AS d FROM numbered) WINDOW w AS (PARTITION BY scene_id ORDER BY d, ord)) WHERE rn = 1 AND gap IS NOT NULL", heads="o")
def runner_up_gap(spark, sf_dir) -> DataFrame:
    """Whether the nearest object leads the runner-up by 3 m."""
    w = Window.partitionBy("scene_id").orderBy("d", "ord")
    rows = numbered(objects(spark, sf_dir)).withColumn("d", G.planar(F.col("x"), F.col("y")))
    rows = rows.select("scene_id", F.row_number().over(w).alias("rn"), (F.lead("d").over(w) - F.col("d")).alias("gap"))
    return rows.where("rn = 1 and gap is not null").select("scene_id", (F.col("gap") >= 3.0).alias("clear"))


CURVE_SQL = """n AS (SELECT category, count(*) AS npos FROM d GROUP BY category),
c AS (SELECT category, row_number() OVER w AS pos, sum(tp) OVER w AS ctp FROM d WINDOW w AS (PARTITION BY category ORDER BY score DESC, object_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT c.category, pos, ctp / (npos + 1e-8) AS recall, ctp / pos AS precision FROM c JOIN n ON c.category = n.category),
e AS (SELECT category, pos, recall, max(precision) OVER (PARTITION BY category ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM r)"""
AP_SQL = f"WITH {IOU_SQL}, d AS (SELECT category, score, object_id, CASE WHEN iou > 0.5 THEN 1 ELSE 0 END AS tp FROM iou), {CURVE_SQL}"
AREA_SQL = " SELECT category, count(*) AS n, round(sum((recall - prev) * envelope), 6) AS ap FROM (SELECT *, coalesce(lag(recall) OVER (PARTITION BY category ORDER BY pos), 0) AS prev FROM e) GROUP BY category"


def ap_curve_rows(spark, sf_dir) -> DataFrame:
    """Recall and precision envelope by class, predictions in order of their score."""
    return precision_recall(scored(spark, sf_dir).select("category", "score", "object_id", F.when(F.col("iou") > 0.5, 1).otherwise(0).alias("tp")))


@query(AP_SQL + AREA_SQL, heads="o")
def ap_curve(spark, sf_dir) -> DataFrame:
    """Area under the precision envelope."""
    return area_under(ap_curve_rows(spark, sf_dir)).select("category", "n", "ap")


@query(AP_SQL + ", t AS (SELECT unnest(range(11)) / 10.0::DOUBLE AS t) SELECT category, round(avg(p), 6) AS ap11 FROM (SELECT c.category, t, coalesce(max(CASE WHEN recall >= t THEN precision END), 0) AS p FROM r c, t GROUP BY ALL) GROUP BY category", heads="o")
def ap_eleven_points(spark, sf_dir) -> DataFrame:
    """Mean of the best precision at 11 recall points."""
    rows = ap_curve_rows(spark, sf_dir).withColumn("t", F.explode(F.array(*[F.lit(k / 10.0) for k in range(11)])))
    best = rows.groupBy("category", "t").agg(F.coalesce(F.max(F.when(F.col("recall") >= F.col("t"), F.col("precision"))), F.lit(0.0)).alias("p"))
    return best.groupBy("category").agg(F.round(F.avg("p"), 6).alias("ap11"))


@query(f"WITH {IOU_SQL} SELECT split, round(avg(CASE WHEN r1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN r3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN r5 THEN 1.0 ELSE 0 END), 6) AS recall_5 FROM (SELECT scene_id, split, bool_or(rn <= 1 AND iou >= 0.5) AS r1, bool_or(rn <= 3 AND iou >= 0.5) AS r3, bool_or(rn <= 5 AND iou >= 0.5) AS r5 FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, object_id) AS rn FROM iou) GROUP BY ALL) GROUP BY split", heads="o")
def recall_at_k(spark, sf_dir) -> DataFrame:
    """Whether one of the k best-scored candidates of a scene is right."""
    ranked = first_rows(scored(spark, sf_dir), ["scene_id"], [F.desc("score"), F.col("object_id")], 5)
    per = ranked.groupBy("scene_id", "split").agg(*[F.bool_or((F.col("rn") <= k) & (F.col("iou") >= 0.5)).alias(f"r{k}") for k in (1, 3, 5)])
    return per.groupBy("split").agg(*[F.round(F.avg(F.when(F.col(f"r{k}"), 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in (1, 3, 5)])


@query("SELECT scene_id, object_id, rn FROM (SELECT scene_id, object_id, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, object_id) AS rn FROM objects) WHERE rn <= 5", heads="o")
def topk_candidates(spark, sf_dir) -> DataFrame:
    rows = first_rows(objects(spark, sf_dir).select("scene_id", "object_id", "score"), ["scene_id"], [F.desc("score"), F.col("object_id")], 5)
    return rows.select("scene_id", "object_id", F.col("rn").cast("long").alias("rn"))


@query("SELECT a_id AS object_id, round(max(b_iou), 6) AS best FROM (SELECT a.object_id AS a_id, (b.score % 100) / 100 AS b_iou, row_number() OVER (PARTITION BY a.object_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), b.object_id) AS rn FROM objects a JOIN objects b ON a.scene_id = b.scene_id AND a.object_id <> b.object_id) WHERE rn <= 3 GROUP BY a_id", heads="o")
def nearest_k_best(spark, sf_dir) -> DataFrame:
    """Best score among an object's three nearest others."""
    met = pairs(objects(spark, sf_dir), keep=["x", "y", "z", "score"])
    met = met.withColumn("d", G.spatial(*[F.col(f"a_{c}") - F.col(f"b_{c}") for c in "xyz"]))
    near = first_rows(met, ["a_object_id"], [F.col("d"), F.col("b_object_id")], 3)
    return near.groupBy(F.col("a_object_id").alias("object_id")).agg(F.round(F.max((F.col("b_score") % 100) / 100), 6).alias("best"))


@query("SELECT split, category, object_id FROM (SELECT *, row_number() OVER (PARTITION BY split, category ORDER BY sha1('balance|' || object_id)) AS rn, min(c) OVER (PARTITION BY split) AS quota FROM (SELECT split, category, object_id, count(*) OVER (PARTITION BY split, category) AS c FROM objects)) WHERE rn <= quota", heads="o")
def category_quota(spark, sf_dir) -> DataFrame:
    """As many rows of each class as the smallest class of the split has, in hash order."""
    rows = objects(spark, sf_dir).select("split", "category", "object_id")
    counts = rows.groupBy("split", "category").agg(F.count("*").alias("c"))
    quota = counts.groupBy("split").agg(F.min("c").alias("quota"))
    ranked = hash_rank(rows, ["split", "category"], hash_order("balance", F.col("object_id")), "rn")
    return ranked.join(quota, "split").where("rn <= quota").select("split", "category", "object_id")


#: Pairs of scenes of up to so many objects are made and sorted inside the scene's row.
PAIRED = 64


def first_pairs(objs: DataFrame, n: int, whole: int = PAIRED) -> DataFrame:
    """The first ``n`` ordered pairs (scene_id, a_id, b_id) of each scene in hash order; pairs of scenes of more than ``whole`` objects meet in a join."""
    place = F.row_number().over(Window.partitionBy("scene_id").orderBy("object_id"))
    few, many = clouds(objs.select("scene_id", "object_id", place.alias("idx")), whole)
    one = lambda a, b: F.struct(hash_order("pairs", a, b).alias("h"), a.alias("a_id"), b.alias("b_id"))
    of = lambda a: F.transform(F.filter("_ids", lambda b: b != a), lambda b: one(a, b))
    rows = few.select("scene_id", F.transform("_cloud", lambda o: o["object_id"]).alias("_ids"))
    rows = rows.select("scene_id", F.explode(F.slice(F.sort_array(F.flatten(F.transform("_ids", of))), 1, n)).alias("p")).select("scene_id", "p.a_id", "p.b_id")
    if many is None:
        return rows
    met = first_rows(pairs(many.select("scene_id", "object_id")), ["scene_id"], [hash_order("pairs", F.col("a_object_id"), F.col("b_object_id"))], n)
    return rows.unionByName(met.select("scene_id", F.col("a_object_id").alias("a_id"), F.col("b_object_id").alias("b_id")))


@query("SELECT scene_id, a_id, b_id FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY sha1('pairs|' || a_id || '|' || b_id)) AS rn FROM pairs) WHERE rn <= 30", heads="p")
def pair_cap(spark, sf_dir) -> DataFrame:
    """Thirty ordered pairs of each scene at most, in hash order: a sampling operator."""
    return first_pairs(objects(spark, sf_dir).select("scene_id", "object_id"), 30)



@query("SELECT scene_id, caption, min(object_id) AS object_id FROM objects GROUP BY ALL", heads="o")
def first_per_caption(spark, sf_dir) -> DataFrame:
    """The first object of each caption of a scene."""
    return objects(spark, sf_dir).groupBy("scene_id", "caption").agg(F.min("object_id").alias("object_id"))


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS first_part, count(DISTINCT l_partkey) > 1 AS conflict FROM lineitem GROUP BY ALL")
def dedup_first_wins(spark, sf_dir) -> DataFrame:
    """One row for each id, the first winning, with a flag where copies disagree."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("first_part"), (F.countDistinct("l_partkey") > 1).alias("conflict"))


@query("SELECT platform, arg_max(sequence, {'a': macro, 'b': joint, 's': sequence}) AS best FROM (SELECT platform, sequence, round(avg(score), 4) AS macro, count(*) AS joint FROM objects GROUP BY ALL) GROUP BY platform", heads="o")
def best_checkpoint(spark, sf_dir) -> DataFrame:
    """The run with the highest (macro, joint) score."""
    runs = objects(spark, sf_dir).groupBy("platform", "sequence").agg(F.round(F.avg("score"), 4).alias("macro"), F.count("*").alias("joint"))
    return runs.groupBy("platform").agg(F.max_by("sequence", F.struct("macro", "joint", "sequence")).alias("best"))


@query("SELECT category, bool_and(prev IS NULL OR m > prev) AS rising FROM (SELECT category, k, m, lag(m) OVER (PARTITION BY category ORDER BY k) AS prev FROM (SELECT category, CAST(floor((x + 25.5) / 10) AS INTEGER) AS k, avg(y) AS m FROM objects GROUP BY ALL)) GROUP BY category", heads="o")
def bin_monotonicity(spark, sf_dir) -> DataFrame:
    """Whether the means of ordered bins rise strictly."""
    bins = objects(spark, sf_dir).groupBy("category", F.floor((F.col("x") + 25.5) / 10).alias("k")).agg(F.avg("y").alias("m"))
    rows = bins.withColumn("prev", F.lag("m").over(Window.partitionBy("category").orderBy("k")))
    return rows.groupBy("category").agg(F.bool_and(F.col("prev").isNull() | (F.col("m") > F.col("prev"))).alias("rising"))


@query("SELECT scene_id, CASE WHEN h < 0.70 THEN 'train' WHEN h < 0.85 THEN 'val' ELSE 'test' END AS part FROM (SELECT scene_id, (('0x' || substr(sha1('42|' || scene_id), 1, 8))::BIGINT) / 4294967296.0::DOUBLE AS h FROM (SELECT DISTINCT scene_id FROM objects))", heads="o")
def scene_split(spark, sf_dir) -> DataFrame:
    """70/15/15 split by a hash of the scene, so that no scene crosses and no global order is needed."""
    scenes = objects(spark, sf_dir).select("scene_id").distinct()
    h = F.conv(F.substr(hash_order("42", F.col("scene_id")), F.lit(1), F.lit(8)), 16, 10).cast("long") / F.lit(4294967296.0)
    return scenes.select("scene_id", F.when(h < 0.70, "train").when(h < 0.85, "val").otherwise("test").alias("part"))


@query("SELECT sequence, CASE WHEN ntile(2) OVER (ORDER BY sha1('42|' || sequence)) = 1 THEN 'val' ELSE 'test' END AS part FROM (SELECT DISTINCT sequence FROM objects WHERE split <> 'train')", heads="o")
def sequence_split(spark, sf_dir) -> DataFrame:
    """Held-out sequences in two halves of a hash order, the first one the larger."""
    rows = objects(spark, sf_dir).where("split <> 'train'").select("sequence").distinct()
    total = rows.agg(F.count("*").alias("total"))
    ranked = hash_rank(rows.withColumn("all", F.lit(1)), ["all"], hash_order("42", F.col("sequence")), "rn").join(F.broadcast(total))  # one row
    return ranked.select("sequence", F.when(F.col("rn") <= F.ceil(F.col("total") / 2), "val").otherwise("test").alias("part"))


@query("WITH c AS (SELECT category, count(*) AS n FROM objects GROUP BY category), q AS (SELECT max(n) AS quota FROM c) SELECT category, object_id, count(*) AS times FROM (SELECT o.category, object_id, row_number() OVER (PARTITION BY o.category ORDER BY g, sha1('over|' || g || '|' || object_id)) AS rn, quota FROM objects o JOIN c ON o.category = c.category, q, range(5) t(g) WHERE g < ceil(quota / n)) WHERE rn <= quota GROUP BY ALL", heads="o")
def oversample_quota(spark, sf_dir) -> DataFrame:
    """Whole permutations of a class in hash order, until it has as many rows as the largest one."""
    rows = objects(spark, sf_dir).select("category", "object_id")
    counts = rows.groupBy("category").agg(F.count("*").alias("n"))
    quota = counts.agg(F.max("n").alias("quota"))
    need = counts.join(F.broadcast(quota)).withColumn("cycles", F.ceil(F.col("quota") / F.col("n")).cast("int"))
    cycled = rows.join(need, "category").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("cycles") - 1)))
    # All rows of a class are in each whole cycle, so only places inside a cycle need an order.
    ranked = hash_rank(cycled, ["category", "g"], hash_order("over", F.col("g"), F.col("object_id")), "rn")
    return ranked.where("g * n + rn <= quota").groupBy("category", "object_id").agg(F.count("*").alias("times"))


@query("SELECT sequence, object_id FROM (SELECT sequence, object_id, row_number() OVER (PARTITION BY sequence ORDER BY sha1('pick|' || object_id)) AS rn FROM objects) WHERE rn <= 3", heads="o")
def sequence_caps(spark, sf_dir) -> DataFrame:
    """Three rows of each sequence in hash order: a sampling operator."""
    return first_rows(objects(spark, sf_dir).select("sequence", "object_id"), ["sequence"], [hash_order("pick", F.col("object_id"))], 3).select("sequence", "object_id")


@query("SELECT object_id FROM (SELECT object_id, count(*) OVER (PARTITION BY scene_id) AS n, row_number() OVER (PARTITION BY scene_id ORDER BY object_id) - 1 AS i FROM objects) WHERE n <= 4 OR i % CAST(ceil(n / 4.0) AS BIGINT) = 0", heads="o")
def stride_subsample(spark, sf_dir) -> DataFrame:
    """Every so many points of clouds above a size."""
    rows = numbered(objects(spark, sf_dir).select("scene_id", "object_id")).withColumn("n", F.count("*").over(Window.partitionBy("scene_id")))
    return rows.where((F.col("n") <= 4) | (F.col("ord") % F.ceil(F.col("n") / 4.0) == 0)).select("object_id")


@query("SELECT scene_id, object_id, row_number() OVER (PARTITION BY scene_id ORDER BY sha1(scene_id || '|' || object_id)) AS place FROM objects", heads="o")
def scene_permutation(spark, sf_dir) -> DataFrame:
    """A fixed permutation of each scene."""
    w = Window.partitionBy("scene_id").orderBy(F.sha1(F.concat_ws("|", F.col("scene_id").cast("string"), "object_id")))
    return objects(spark, sf_dir).select("scene_id", "object_id").withColumn("place", F.row_number().over(w).cast("long"))


@query("SELECT a_id, b_id, CASE WHEN substr(sha1(a_id || '|' || b_id), 40, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN b_id ELSE a_id END AS first_id FROM pairs WHERE a_id < b_id", heads="p")
def parity_swap(spark, sf_dir) -> DataFrame:
    """A pair's order by the parity of its hash."""
    met = pairs(objects(spark, sf_dir).select("scene_id", "object_id"), ordered=False)
    swap = odd_digest(F.col("a_object_id"), F.col("b_object_id"))
    return met.select(F.col("a_object_id").alias("a_id"), F.col("b_object_id").alias("b_id"), F.when(swap, F.col("b_object_id")).otherwise(F.col("a_object_id")).alias("first_id"))


@query("SELECT object_id FROM objects WHERE split = 'val' ORDER BY sha1('7|' || object_id) LIMIT 20", heads="o")
def fixed_samples(spark, sf_dir) -> DataFrame:
    """Twenty validation ids in hash order: a top-k report."""
    return objects(spark, sf_dir).where("split = 'val'").select("object_id").orderBy(hash_order("7", F.col("object_id"))).limit(20)


@query("SELECT scene_id, ord // 2 AS batch, count(*) AS n FROM numbered GROUP BY ALL".join([f"WITH {NUMBERED_SQL} ", ""]), heads="o")
def fixed_batches(spark, sf_dir) -> DataFrame:
    """Batches of two objects within a scene."""
    rows = numbered(objects(spark, sf_dir).select("scene_id", "object_id"))
    return rows.groupBy("scene_id", F.floor(F.col("ord") / 2).cast("long").alias("batch")).agg(F.count("*").alias("n"))


@query("SELECT substr(sha1(scene_id || '|pair|' || a_id || '|' || b_id), 1, 16) AS qa_id, a_id, b_id FROM pairs", heads="p")
def stable_qa_ids(spark, sf_dir) -> DataFrame:
    """Ids that depend on what a row says and not on when it was made."""
    met = pairs(objects(spark, sf_dir).select("scene_id", "object_id"))
    return met.select(stable_id(F.col("scene_id"), F.lit("pair"), F.col("a_object_id"), F.col("b_object_id")).alias("qa_id"), F.col("a_object_id").alias("a_id"), F.col("b_object_id").alias("b_id"))
