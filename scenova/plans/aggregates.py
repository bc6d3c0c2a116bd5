"""Aggregations: statistics, rates, cubes and paired comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenova.functions import geometry as G
from scenova.plans.base import query
from scenova.plans.geometry import BUCKET_SQL, IOU_SQL, box
from scenova.sources.scenes import objects, pairs, table


def scored(spark, sf_dir) -> DataFrame:
    """Objects with the IoU of their prediction."""
    iou, _ = G.aligned_iou(box(), box(shift=True))
    return objects(spark, sf_dir).withColumn("iou", iou)


def rate(flag: Column) -> Column:
    """Share of true rows; 0 when there are none."""
    return F.coalesce(F.try_divide(F.count_if(flag), F.greatest(F.count("*"), F.lit(1))), F.lit(0.0))


RANGE = "CASE WHEN n <= 3 THEN '1-3' WHEN n <= 6 THEN '4-6' WHEN n <= 9 THEN '7-9' WHEN n <= 12 THEN '10-12' ELSE '13+' END"
SIZES_SQL = "sizes AS (SELECT scene_id, platform, split, count(*) AS n FROM objects GROUP BY ALL)"


def sizes(spark, sf_dir) -> DataFrame:
    return objects(spark, sf_dir).groupBy("scene_id", "platform", "split").agg(F.count("*").alias("n"))


@query("SELECT round(min(d), 4) AS min, round(quantile_cont(d, 0.05), 4) AS p05, round(quantile_cont(d, 0.5), 4) AS median, round(quantile_cont(d, 0.95), 4) AS p95, round(max(d), 4) AS max FROM (SELECT sqrt(dx * dx + dy * dy) AS d FROM pairs)", heads="p")
def pair_quantiles(spark, sf_dir) -> DataFrame:
    """Exact interpolated quantiles of planar distances.

    Distances are counted by value before the quantile is taken.
    """
    d = pairs(objects(spark, sf_dir), keep=["x", "y"]).select(G.planar(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")).alias("d"))
    q = F.expr("percentile(d, array(0.05, 0.5, 0.95))")
    held = d.agg(F.min("d").alias("min"), q.alias("q"), F.max("d").alias("max"))
    return held.select(F.round("min", 4).alias("min"), *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p05", "median", "p95"))], F.round("max", 4).alias("max"))


@query(f"WITH {IOU_SQL} SELECT count(*) AS n, count(DISTINCT scene_id) AS scenes, round(avg(iou), 6) AS mean_iou, round(count(*) FILTER (WHERE iou >= 0.5) / count(*), 6) AS rate_50, round(quantile_cont(iou, 0.5), 6) AS median_iou FROM iou", heads="o")
def global_stats(spark, sf_dir) -> DataFrame:
    return scored(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("scene_id").alias("scenes"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(rate(F.col("iou") >= 0.5), 6).alias("rate_50"), F.round(F.expr("percentile(iou, 0.5)"), 6).alias("median_iou"))


@query("SELECT split, count(DISTINCT scene_id) AS scenes, count(*) FILTER (WHERE dy > 0) AS left_n, count(*) FILTER (WHERE NOT dy > 0) AS right_n, round(quantile_cont(abs(dx), 0.5), 4) AS median_dx FROM pairs GROUP BY split", heads="p")
def split_stats(spark, sf_dir) -> DataFrame:
    met = pairs(objects(spark, sf_dir), keep=["split", "x", "y"]).select("scene_id", F.col("a_split").alias("split"), (F.col("a_x") - F.col("b_x")).alias("dx"), (F.col("a_y") - F.col("b_y")).alias("dy"))
    return met.groupBy("split").agg(F.countDistinct("scene_id").alias("scenes"), F.count_if(F.col("dy") > 0).alias("left_n"), F.count_if(~(F.col("dy") > 0)).alias("right_n"), F.round(F.expr("percentile(abs(dx), 0.5)"), 4).alias("median_dx"))


@query("SELECT split, string_agg(category || '=' || n, ',' ORDER BY category) AS counts FROM (SELECT split, category, count(*) AS n FROM objects GROUP BY ALL) GROUP BY split", heads="o")
def nested_counts(spark, sf_dir) -> DataFrame:
    """Two-level count map."""
    n = objects(spark, sf_dir).groupBy("split", "category").agg(F.count("*").alias("n"))
    held = n.groupBy("split").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("m"))
    return held.select("split", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("counts"))


@query(f"WITH {IOU_SQL} SELECT split, {BUCKET_SQL} AS bucket, count(*) AS n, round(avg(CASE WHEN iou >= 0.25 THEN 1.0 ELSE 0 END), 6) AS acc, round(avg(shift), 6) AS mae, round(quantile_cont(shift, 0.5), 6) AS med FROM iou GROUP BY GROUPING SETS ((), (split), (bucket))", heads="o")
def grounding_breakdown(spark, sf_dir) -> DataFrame:
    """Rates and errors over all rows, by split and by bucket, in one pass of grouping sets."""
    rows = scored(spark, sf_dir).withColumn("bucket", G.quality_bucket(F.col("iou")))
    return rows.groupingSets([[], ["split"], ["bucket"]], "split", "bucket").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("iou") >= 0.25, 1.0).otherwise(0.0)), 6).alias("acc"), F.round(F.avg("shift"), 6).alias("mae"), F.round(F.expr("percentile(shift, 0.5)"), 6).alias("med"))


@query(f"WITH {SIZES_SQL} SELECT coalesce(platform, 'all') AS platform, coalesce(split, 'all') AS split, count(*) AS scenes, sum(n)::BIGINT AS objects, round(avg(n), 6) AS mean, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.75) AS p75, round(stddev_pop(n), 6) AS std FROM sizes GROUP BY CUBE (platform, split)", heads="o")
def object_count_cube(spark, sf_dir) -> DataFrame:
    """Objects per scene over the cube of platform and split."""
    cube = sizes(spark, sf_dir).cube("platform", "split").agg(F.count("*").alias("scenes"), F.sum("n").alias("objects"), F.round(F.avg("n"), 6).alias("mean"), F.expr("percentile(n, 0.25)").alias("p25"), F.expr("percentile(n, 0.75)").alias("p75"), F.round(F.stddev_pop("n"), 6).alias("std"))
    return cube.withColumns({"platform": F.coalesce("platform", F.lit("all")), "split": F.coalesce("split", F.lit("all"))})


@query(f"WITH {SIZES_SQL} SELECT {RANGE} AS bin, count(*) AS scenes FROM sizes GROUP BY ALL", heads="o")
def object_count_bins(spark, sf_dir) -> DataFrame:
    return sizes(spark, sf_dir).groupBy(F.expr(RANGE).alias("bin")).agg(F.count("*").alias("scenes"))


@query(f"WITH {SIZES_SQL}, bins AS (SELECT * FROM (VALUES ('platform0', 1, 3), ('platform0', 3, 100), ('platform1', 1, 5), ('platform1', 5, 100), ('platform2', 1, 100)) AS b (platform, lo, hi)) SELECT s.platform, lo, hi, count(*) AS scenes FROM sizes s JOIN bins b ON s.platform = b.platform AND s.n >= lo AND s.n < hi GROUP BY ALL", heads="o")
def platform_bins(spark, sf_dir) -> DataFrame:
    """Half-open bins that differ by platform, as a range join with a bin table of fixed size."""
    bins = spark.createDataFrame([("platform0", 1, 3), ("platform0", 3, 100), ("platform1", 1, 5), ("platform1", 5, 100), ("platform2", 1, 100)], "platform string, lo int, hi int")
    met = sizes(spark, sf_dir).join(F.broadcast(bins), "platform").where("n >= lo and n < hi")
    return met.groupBy("platform", "lo", "hi").agg(F.count("*").alias("scenes"))


@query(f"WITH {IOU_SQL} SELECT platform, category, count(*) AS n, round(avg(iou), 6) AS miou, round(avg(CASE WHEN iou >= 0.25 THEN 1.0 ELSE 0 END), 6) AS acc25, round(avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0 END), 6) AS acc50 FROM iou GROUP BY ROLLUP (platform, category)", heads="o")
def platform_rollup(spark, sf_dir) -> DataFrame:
    """Mean IoU and accuracies by platform and class, rolled up."""
    at = lambda t: F.round(F.avg(F.when(F.col("iou") >= t, 1.0).otherwise(0.0)), 6)
    return scored(spark, sf_dir).rollup("platform", "category").agg(F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("miou"), at(0.25).alias("acc25"), at(0.5).alias("acc50"))


@query(f"WITH {IOU_SQL}, t AS (SELECT scene_id, platform, threshold, strict, bool_and(CASE WHEN strict THEN iou > threshold ELSE iou >= threshold END) AS all_ok, avg(CASE WHEN CASE WHEN strict THEN iou > threshold ELSE iou >= threshold END THEN 1.0 ELSE 0 END) AS per FROM iou, (VALUES (0.25, true), (0.5, true), (0.25, false), (0.5, false)) AS v (threshold, strict) GROUP BY ALL) SELECT platform, threshold::DOUBLE AS threshold, strict, count(*) AS scenes, round(avg(CASE WHEN all_ok THEN 1.0 ELSE 0 END), 6) AS joint, round(avg(per), 6) AS per_target FROM t GROUP BY ALL", heads="o")
def threshold_counters(spark, sf_dir) -> DataFrame:
    """Per-target and all-target rates over thresholds, strict and not: thresholds are exploded, scenes collapse first."""
    points = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(s).alias("strict")) for t in (0.25, 0.5) for s in (True, False)])
    rows = scored(spark, sf_dir).select("scene_id", "platform", "iou", F.explode(points).alias("v")).select("scene_id", "platform", "iou", "v.*")
    ok = F.when(F.col("strict"), F.col("iou") > F.col("threshold")).otherwise(F.col("iou") >= F.col("threshold"))
    per = rows.groupBy("scene_id", "platform", "threshold", "strict").agg(F.bool_and(ok).alias("all_ok"), F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("per"))
    return per.groupBy("platform", "threshold", "strict").agg(F.count("*").alias("scenes"), F.round(F.avg(F.when(F.col("all_ok"), 1.0).otherwise(0.0)), 6).alias("joint"), F.round(F.avg("per"), 6).alias("per_target"))


@query("SELECT sum(n)::BIGINT AS n, sum(m)::BIGINT AS majority, round(sum(m) / sum(n), 6) AS baseline FROM (SELECT split, sum(c) AS n, max(c) AS m FROM (SELECT split, category, count(*) AS c FROM objects GROUP BY ALL) GROUP BY split)", heads="o")
def majority_baseline(spark, sf_dir) -> DataFrame:
    """Sum of each scenario's largest label count over all rows."""
    c = objects(spark, sf_dir).groupBy("split", "category").agg(F.count("*").alias("c"))
    per = c.groupBy("split").agg(F.sum("c").alias("n"), F.max("c").alias("m"))
    return per.agg(F.sum("n").alias("n"), F.sum("m").alias("majority"), F.round(F.sum("m") / F.sum("n"), 6).alias("baseline"))


@query("WITH prior AS (SELECT category, arg_max(caption, {'c': c, 'k': caption}) AS top FROM (SELECT category, caption, count(*) AS c FROM objects WHERE split = 'train' GROUP BY ALL) GROUP BY category) SELECT o.category, count(*) AS n, round(avg(CASE WHEN o.caption = top THEN 1.0 ELSE 0 END), 6) AS prior_accuracy FROM objects o JOIN prior p ON o.category = p.category WHERE o.split <> 'train' GROUP BY o.category", heads="o")
def train_prior(spark, sf_dir) -> DataFrame:
    """The majority label of the training rows as a baseline for the others."""
    objs = objects(spark, sf_dir).select("split", "category", "caption")
    c = objs.where("split = 'train'").groupBy("category", "caption").agg(F.count("*").alias("c"))
    prior = c.groupBy("category").agg(F.max_by("caption", F.struct("c", "caption")).alias("top"))
    met = objs.where("split <> 'train'").join(prior, "category")
    return met.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("caption") == F.col("top"), 1.0).otherwise(0.0)), 6).alias("prior_accuracy"))


@query(f"WITH {IOU_SQL} SELECT round(sum(ok) / sum(n), 6) AS micro, round(avg(ok / n), 6) AS macro FROM (SELECT scene_id, count(*) AS n, count(*) FILTER (WHERE iou >= 0.5) AS ok FROM iou GROUP BY scene_id)", heads="o")
def scene_macro_accuracy(spark, sf_dir) -> DataFrame:
    per = scored(spark, sf_dir).groupBy("scene_id").agg(F.count("*").alias("n"), F.count_if(F.col("iou") >= 0.5).alias("ok"))
    return per.agg(F.round(F.sum("ok") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("ok") / F.col("n")), 6).alias("macro"))


@query("SELECT bin, count(*) AS n, round(avg(p - t), 6) AS bias, round(corr(p, t), 6) AS r, round(stddev_pop(p) / stddev_pop(t), 6) AS std_ratio FROM (SELECT CASE WHEN t < 5 THEN '0-5' WHEN t < 10 THEN '5-10' WHEN t < 20 THEN '10-20' ELSE '20+' END AS bin, t, p FROM (SELECT sqrt(x * x + y * y) AS t, sqrt((x + shift) * (x + shift) + y * y) AS p FROM objects)) GROUP BY bin HAVING count(*) >= 3", heads="o")
def distance_bins(spark, sf_dir) -> DataFrame:
    """Bias, correlation and spread ratio of predicted distances by bin of the true one."""
    rows = objects(spark, sf_dir).select(G.planar(F.col("x"), F.col("y")).alias("t"), G.planar(F.col("x") + F.col("shift"), F.col("y")).alias("p"))
    bin_ = F.when(F.col("t") < 5, "0-5").when(F.col("t") < 10, "5-10").when(F.col("t") < 20, "10-20").otherwise("20+")
    out = rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("p") - F.col("t")), 6).alias("bias"), F.round(F.corr("p", "t"), 6).alias("r"), F.round(F.stddev_pop("p") / F.stddev_pop("t"), 6).alias("std_ratio"))
    return out.where("n >= 3")


@query("SELECT pos::INTEGER AS pos, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(v), 6) AS mean FROM (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings) WHERE isfinite(v) GROUP BY pos")
def position_stats(spark, sf_dir) -> DataFrame:
    """Least, largest and mean value of each array position, non-finite values aside."""
    rows = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("pos", "f")).select("pos", F.col("f").cast("double").alias("v"))
    finite = rows.where(~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))))
    return finite.groupBy("pos").agg(F.round(F.min("v"), 6).alias("lo"), F.round(F.max("v"), 6).alias("hi"), F.round(F.avg("v"), 6).alias("mean"))


@query("SELECT caption, count(*) AS n FROM objects GROUP BY caption ORDER BY n DESC, min(object_id) LIMIT 20", heads="o")
def top_captions(spark, sf_dir) -> DataFrame:
    """The 20 commonest values, first seen first on ties."""
    n = objects(spark, sf_dir).groupBy("caption").agg(F.count("*").alias("n"), F.min("object_id").alias("first"))
    return n.orderBy(F.desc("n"), "first").limit(20).select("caption", "n")


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def json_keys(spark, sf_dir) -> DataFrame:
    """How often each key occurs in JSON documents."""
    keys = table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k, round(corr(value, CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS r FROM events GROUP BY event_type HAVING count(*) >= 3")
def guarded_pearson(spark, sf_dir) -> DataFrame:
    """Correlation where there are enough rows and both sides vary."""
    rows = table(spark, sf_dir, "events").select("event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    enough = (F.count("*") >= 3) & (F.stddev_pop("value") >= 1e-9) & (F.stddev_pop("k") >= 1e-9)
    out = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("k"), 6).alias("mean_k"), F.round(F.when(enough, F.corr("value", "k")), 6).alias("r"))
    return out.where("n >= 3")


@query("WITH r AS (SELECT doc_id, quality = 1 AS a_ok, toxic = 0 AS b_ok FROM labels) SELECT a_ok, b_ok, count(*) AS n FROM r GROUP BY ALL")
def paired_contingency(spark, sf_dir) -> DataFrame:
    """Contingency counts of two runs joined on the question."""
    rows = table(spark, sf_dir, "labels")
    a, b = rows.select("doc_id", (F.col("quality") == 1).alias("a_ok")), rows.select("doc_id", (F.col("toxic") == 0).alias("b_ok"))
    return a.join(b, "doc_id", "full_outer").groupBy("a_ok", "b_ok").agg(F.count("*").alias("n"))


@query("SELECT n, round(delta, 6) AS delta, round(se, 6) AS se, round(delta - 1.96 * se, 6) AS lo, round(delta + 1.96 * se, 6) AS hi, round(delta / se, 6) AS z FROM (SELECT n, (p - q) / n AS delta, sqrt(greatest((p + q) / n - ((p - q) / n) * ((p - q) / n), 0) / n) AS se FROM (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS p, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS q FROM labels))")
def paired_delta(spark, sf_dir) -> DataFrame:
    """Paired difference of two runs, its standard error, interval and z."""
    c = table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("p"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("q"))
    delta = (F.col("p") - F.col("q")) / F.col("n")
    se = F.sqrt(F.greatest((F.col("p") + F.col("q")) / F.col("n") - delta * delta, F.lit(0.0)) / F.col("n"))
    held = c.select("n", delta.alias("delta"), se.alias("se"))
    return held.select("n", F.round("delta", 6).alias("delta"), F.round("se", 6).alias("se"), F.round(F.expr("delta - 1.96 * se"), 6).alias("lo"), F.round(F.expr("delta + 1.96 * se"), 6).alias("hi"), F.round(F.expr("delta / se"), 6).alias("z"))


@query("SELECT split, round(sum(acc * n) / sum(n), 6) AS weighted FROM (SELECT split, category, count(*) AS n, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END) AS acc FROM objects WHERE category IN (0, 1, 2) GROUP BY ALL) GROUP BY split", heads="o")
def weighted_accuracy(spark, sf_dir) -> DataFrame:
    """Accuracy over some scenarios, weighted by their rows."""
    per = objects(spark, sf_dir).where("category in (0, 1, 2)").groupBy("split", "category").agg(F.count("*").alias("n"), F.avg(F.when(F.col("x") > 0, 1.0).otherwise(0.0)).alias("acc"))
    return per.groupBy("split").agg(F.round(F.sum(F.col("acc") * F.col("n")) / F.sum("n"), 6).alias("weighted"))


@query("SELECT count(*) AS pairs_n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 6) AS consistent FROM (SELECT l_orderkey, bool_and(l_returnflag = 'N') AS ok FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2)")
def group_consistency(spark, sf_dir) -> DataFrame:
    """Groups of exactly two, all members right; groups of other sizes don't count."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("c"), F.bool_and(F.col("l_returnflag") == "N").alias("ok")).where("c = 2")
    return per.agg(F.count("*").alias("pairs_n"), F.round(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)), 6).alias("consistent"))


@query("SELECT split, side, count(*) AS n FROM (SELECT split, CASE WHEN y > 12 THEN 'left' ELSE 'right' END AS side FROM objects) GROUP BY ALL", heads="o")
def unpivoted_sides(spark, sf_dir) -> DataFrame:
    """Counts pivoted to columns and back to rows."""
    sides = objects(spark, sf_dir).select("split", F.when(F.col("y") > 12, "left").otherwise("right").alias("side"))
    wide = sides.groupBy("split").pivot("side", ["left", "right"]).count()
    return wide.unpivot("split", ["left", "right"], "side", "n").where("n is not null")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE len([v FOR v IN embedding IF isnan(v)]) > 0) AS with_nan, round(min(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS least_norm, max(c) AS most_per_label FROM embeddings JOIN (SELECT label AS l, count(*) AS c FROM embeddings GROUP BY label) ON label = l")
def token_stats(spark, sf_dir) -> DataFrame:
    """Row, NaN and norm statistics of a token table."""
    norm = F.sqrt(G.dot(F.col("embedding"), F.col("embedding")))
    per = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("c"), F.count_if(F.exists("embedding", lambda v: F.isnan(v))).alias("bad"), F.min(norm).alias("norm")).where("label is not null")
    return per.agg(F.sum("c").alias("n"), F.sum("bad").alias("with_nan"), F.round(F.min("norm"), 6).alias("least_norm"), F.max("c").alias("most_per_label"))


@query("SELECT word_id, round(sum(score), 6) AS score FROM (SELECT l_orderkey * 8 + l_linenumber // 2 AS word_id, l_extendedprice / 1000 AS score FROM lineitem) GROUP BY word_id")
def token_word_scores(spark, sf_dir) -> DataFrame:
    """Scores of tokens summed by the word they belong to."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.floor(F.col("l_linenumber") / 2).cast("long")).alias("word_id"), (F.col("l_extendedprice") / 1000).alias("score"))
    return rows.groupBy("word_id").agg(F.round(F.sum("score"), 6).alias("score"))
