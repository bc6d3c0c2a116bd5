"""Annotation records, token masks, prompts, soft-token scores, run reports and poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenova.functions import annotations as A
from scenova.functions import geometry as G
from scenova.functions import text as T
from scenova.operators.annotations import assign_spans, unambiguous_targets
from scenova.operators.ranks import row_at
from scenova.plans.base import query
from scenova.plans.joins import NUMBERED_SQL, numbered
from scenova.plans.ranking import first_rows
from scenova.sources.scenes import objects, table
from scenova.sources.sinks import written

#: A scene's caption is those of its first three objects; an object's class is its caption's second word.
MENTIONS_SQL = f"""{NUMBERED_SQL}, c AS (SELECT scene_id, split_part(caption, ' ', 2) AS class, object_id, ord FROM numbered),
w AS (SELECT scene_id, unnest(string_split(said, ' ')) AS class, unnest(range(len(string_split(said, ' ')))) AS start FROM (SELECT scene_id, string_agg(caption, ' ' ORDER BY ord) AS said FROM numbered WHERE ord < 3 GROUP BY scene_id))"""


def mentioned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Words of each scene's caption as mentions, and the scene's objects with their class."""
    rows = numbered(objects(spark, sf_dir).select("scene_id", "object_id", "caption"))
    said = rows.where("ord < 3").groupBy("scene_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "caption"))), lambda o: o["caption"]), " ").alias("said"))
    words = said.select("scene_id", F.posexplode(F.split("said", " ")).alias("start", "class")).withColumn("end", F.col("start") + 1)
    return words, rows.select("scene_id", F.split_part("caption", F.lit(" "), F.lit(2)).alias("class"), "object_id", "ord")


@query(
    f"WITH {MENTIONS_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY scene_id, class ORDER BY start) AS nth FROM w), o AS (SELECT *, row_number() OVER (PARTITION BY scene_id, class ORDER BY ord) AS nth FROM c WHERE ord < 4) SELECT o.scene_id, string_agg(start, ' ' ORDER BY ord) AS places FROM o LEFT JOIN m ON o.scene_id = m.scene_id AND o.class = m.class AND o.nth = m.nth GROUP BY o.scene_id HAVING count(start) = count(*) AND count(DISTINCT start) = count(*)",
    heads="o",
)
def mention_assignment(spark, sf_dir) -> DataFrame:
    """The nth mention of a class for its nth object; scenes where one runs out are left out."""
    words, rows = mentioned(spark, sf_dir)
    found = assign_spans(words, rows.where("ord < 4"), "scene_id")
    return found.select("scene_id", F.array_join(F.transform("spans", lambda s: s["start"].cast("string")), " ").alias("places"))


@query(
    f"WITH {MENTIONS_SQL}, main AS (SELECT c.scene_id, c.class, min(start) AS start FROM c JOIN w ON c.scene_id = w.scene_id AND c.class = w.class WHERE ord = 0 GROUP BY ALL), alone AS (SELECT scene_id, class FROM c WHERE ord > 0 GROUP BY ALL HAVING count(*) = 1), later AS (SELECT w.scene_id, w.class, min(w.start) AS start FROM w JOIN main ON w.scene_id = main.scene_id AND w.start > main.start GROUP BY ALL HAVING count(*) = 1), t AS (SELECT * FROM main UNION ALL SELECT later.scene_id, later.class, later.start FROM later JOIN alone ON later.scene_id = alone.scene_id AND later.class = alone.class) SELECT scene_id, string_agg(class || '@' || start, ' ' ORDER BY start) AS targets FROM t GROUP BY scene_id HAVING count(*) >= 2 AND count(DISTINCT start) = count(*)",
    heads="o",
)
def caption_targets(spark, sf_dir) -> DataFrame:
    """Records of a main object and others that the caption names beyond doubt."""
    words, rows = mentioned(spark, sf_dir)
    found = unambiguous_targets(words, rows.where("ord = 0"), rows.where("ord > 0"), "scene_id")
    return found.select("scene_id", F.array_join(F.transform("targets", lambda t: F.concat(t["class"], F.lit("@"), t["place"]["start"].cast("string"))), " ").alias("targets"))


TAIL_SQL = "CASE category WHEN 0 THEN ' with a red roof and more' WHEN 1 THEN ' in the left lane' WHEN 2 THEN ' wearing blue, parked' ELSE ' stands' END"


@query(f"SELECT said, 'big ' || w1 || ' ' || w2 || CASE category WHEN 0 THEN ' with a red roof' WHEN 2 THEN ' wearing blue' ELSE '' END AS told, count(*) AS n FROM (SELECT category, split_part(caption, ' ', 1) AS w1, split_part(caption, ' ', 2) AS w2, 'Far ahead, a big ' || split_part(caption, ' ', 1) || ' ' || split_part(caption, ' ', 2) || {TAIL_SQL} AS said FROM objects) GROUP BY ALL", heads="o")
def safe_descriptions(spark, sf_dir) -> DataFrame:
    """Descriptions of a noun without words of place."""
    w1, w2 = (F.split_part("caption", F.lit(" "), F.lit(k)) for k in (1, 2))
    tail = F.when(F.col("category") == 0, " with a red roof and more").when(F.col("category") == 1, " in the left lane").when(F.col("category") == 2, " wearing blue, parked").otherwise(" stands")
    start = F.length(w1) + 18
    rows = objects(spark, sf_dir).select(F.concat(F.lit("Far ahead, a big "), w1, F.lit(" "), w2, tail).alias("said"), start.alias("start"), (start + F.length(w2)).alias("end"), w2.alias("class"))
    return rows.groupBy("said", A.safe_description(F.col("said"), F.col("start"), F.col("end"), F.col("class")).alias("told")).agg(F.count("*").alias("n"))


@query("SELECT object_id, 2 AS first, 1 + n AS last, 1.0::DOUBLE / n AS weight, n::DOUBLE AS plain_sum FROM (SELECT object_id, least(len(string_split(caption, ' ')) - 1, 2) AS n FROM objects)", heads="o")
def token_masks(spark, sf_dir) -> DataFrame:
    """Token masks of the span of a caption's second and third word, as shares and as ones."""
    words = F.slice(F.split("caption", " "), 2, 2)
    rows = objects(spark, sf_dir).select("object_id", T.format_caption(F.col("caption")).alias("said"), F.array_join(words, " ").alias("name"))
    rows = rows.select("object_id", A.word_offsets(F.col("said")).alias("tokens"), A.target_span(F.col("said"), F.col("name")).alias("span"))
    rows = rows.select("object_id", A.span_tokens(F.col("tokens"), F.col("span.start"), F.col("span.end")).alias("covered"))
    plain = F.aggregate(A.token_mask(F.col("covered"), 16, normalised=False), F.lit(0.0), lambda s, v: s + v)
    return rows.select("object_id", "covered.first", "covered.last", F.get(A.token_mask(F.col("covered"), 16), F.col("covered.first")).alias("weight"), plain.alias("plain_sum"))


@query(f"WITH {NUMBERED_SQL} SELECT scene_id, 'Which is closer?' || string_agg(chr(10) || 'Grounding token for the ' || caption || ' in the front view: <token>', '' ORDER BY ord) AS prompt, NULL::VARCHAR AS plus, 'view_in_refs' AS natural, 'description_in_refs' AS implicit FROM numbered WHERE ord < 3 GROUP BY scene_id", heads="o")
def prompt_assembly(spark, sf_dir) -> DataFrame:
    """Prompts from public references, and what each input policy finds wrong with them."""
    rows = numbered(objects(spark, sf_dir).select("scene_id", "object_id", "caption")).where("ord < 3")
    refs = F.sort_array(F.collect_list(F.struct("ord", F.col("caption").alias("description"), F.lit("front view").alias("view"))))
    rows = rows.groupBy("scene_id").agg(refs.alias("refs"))
    asked, held = F.lit("Which is closer?"), F.col("refs")
    names = {"plus": "natural_descriptions_plus_implicit_grounding_tokens", "natural": "natural_descriptions_and_implicit_tokens", "implicit": "implicit_grounding_tokens_only"}
    found = [A.prompt_violation(asked, held, ["ord", "description", "view"], p).alias(c) for c, p in names.items()]
    return rows.select("scene_id", A.prompt(asked, held, names["plus"]).alias("prompt"), *found)


@query(
    """WITH t AS (SELECT vec_id AS j, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 8),
s AS (SELECT q.vec_id, q.label, j, list_inner_product(q.embedding::DOUBLE[], e) / 0.07 AS s FROM embeddings q, t WHERE q.vec_id >= 8),
x AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS x FROM s),
p AS (SELECT *, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM x)
SELECT label, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (SELECT label, vec_id, round(sum(CASE WHEN j % 5 = label % 5 THEN p ELSE 0 END) / CASE WHEN label % 2 = 1 THEN greatest(count(*) FILTER (WHERE j % 5 = label % 5), 1) ELSE 1 END, 6) AS score FROM p GROUP BY label, vec_id)) WHERE rank <= 10"""
)
def contrastive_scores(spark, sf_dir) -> DataFrame:
    """Candidates by the softmax of their similarity to text tokens (temperature 0.07) over a mask: its sum for single targets, its mean for several; ten best of each label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    tokens = e.where("vec_id < 8").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("tokens"))  # one row of eight vectors
    rows = e.where("vec_id >= 8").join(F.broadcast(tokens))
    rows = rows.withColumn("p", G.softmax(F.transform("tokens", lambda t: G.dot(F.col("v"), t["v"]) / 0.07)))
    rows = rows.select("label", "vec_id", F.zip_with("p", "tokens", lambda p, t: F.when(t["vec_id"] % 5 == F.col("label") % 5, p)).alias("m"))
    held = F.array_compact("m")
    total = F.aggregate(held, F.lit(0.0), lambda s, p: s + p)
    score = F.round(total / F.when(F.col("label") % 2 == 1, F.greatest(F.size(held), F.lit(1))).otherwise(1), 6)
    ranked = first_rows(rows.select("label", "vec_id", score.alias("score")), ["label"], [F.desc("score"), F.col("vec_id")], 10, "rank")
    return ranked.select("label", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


RUNS_SQL = """m AS (SELECT platform, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END)::DOUBLE AS front, avg(CASE WHEN y > 15 THEN 1.0 ELSE 0 END)::DOUBLE AS exact, avg(shift) AS mae, corr(p, t) AS r FROM (SELECT platform, x, y, shift, sqrt(x * x + y * y) AS t, sqrt((x + shift) * (x + shift) + y * y) AS p FROM objects) GROUP BY platform),
b AS (SELECT platform, k, avg(p) AS p, avg(t) AS t FROM (SELECT platform, floor(sqrt(x * x + y * y) / 10) AS k, sqrt(x * x + y * y) AS t, sqrt((x + shift) * (x + shift) + y * y) AS p FROM objects) GROUP BY ALL),
s AS (SELECT platform, bool_and(prev IS NULL OR p > prev) AS rising, (max(p) - min(p)) / nullif(max(t) - min(t), 0) AS spread FROM (SELECT *, lag(p) OVER (PARTITION BY platform ORDER BY k) AS prev FROM b) GROUP BY platform)"""


@query(
    f"WITH {RUNS_SQL}, c AS (SELECT m.platform, m.front - o.front >= 0.05 AS front_up, m.exact - o.exact >= 0.05 AS exact_up, m.mae <= 0.8 * o.mae AS mae_down, coalesce(m.r >= 0.5, false) AS r_high, rising AND coalesce(spread >= 0.5, false) AS bins_good FROM m JOIN s ON m.platform = s.platform, (SELECT * FROM m WHERE platform = 'platform0') o) SELECT *, front_up::INT + exact_up::INT + mae_down::INT + r_high::INT + bins_good::INT >= 2 AS success FROM c",
    heads="o",
)
def success_criteria(spark, sf_dir) -> DataFrame:
    """Five criteria of each run against a baseline run, success from two on."""
    rows = objects(spark, sf_dir).select("platform", "x", "y", "shift", G.planar(F.col("x"), F.col("y")).alias("t"), G.planar(F.col("x") + F.col("shift"), F.col("y")).alias("p"))
    share = lambda ok: F.avg(F.when(ok, 1.0).otherwise(0.0))
    runs = rows.groupBy("platform").agg(share(F.col("x") > 0).alias("front"), share(F.col("y") > 15).alias("exact"), F.avg("shift").alias("mae"), F.corr("p", "t").alias("r"))
    bins = rows.groupBy("platform", F.floor(F.col("t") / 10).alias("k")).agg(F.avg("p").alias("p"), F.avg("t").alias("t"))
    bins = bins.withColumn("prev", F.lag("p").over(Window.partitionBy("platform").orderBy("k")))
    spread = F.try_divide(F.max("p") - F.min("p"), F.max("t") - F.min("t"))
    runs = runs.join(bins.groupBy("platform").agg(F.bool_and(F.col("prev").isNull() | (F.col("p") > F.col("prev"))).alias("rising"), spread.alias("spread")), "platform")
    base = runs.where("platform = 'platform0'").select(*[F.col(c).alias(f"o_{c}") for c in ("front", "exact", "mae")])
    false = F.lit(False)
    checks = {
        "front_up": F.col("front") - F.col("o_front") >= 0.05,
        "exact_up": F.col("exact") - F.col("o_exact") >= 0.05,
        "mae_down": F.col("mae") <= 0.8 * F.col("o_mae"),
        "r_high": F.coalesce(F.col("r") >= 0.5, false),
        "bins_good": F.col("rising") & F.coalesce(F.col("spread") >= 0.5, false),
    }
    told = runs.join(F.broadcast(base)).select("platform", *[c.alias(n) for n, c in checks.items()])
    return told.withColumn("success", sum((F.col(n).cast("int") for n in checks), F.lit(0)) >= 2)


@query(
    f"WITH {NUMBERED_SQL}, r AS (SELECT sequence, score, row_number() OVER (PARTITION BY sequence ORDER BY object_id, score) AS i, row_number() OVER (PARTITION BY sequence ORDER BY object_id DESC, score DESC) AS j FROM objects) SELECT sequence, round(first, 4) AS first, round(last, 4) AS last, round((first - last) / first, 4) AS drop_share FROM (SELECT sequence, avg(CASE WHEN i <= 3 THEN score END) AS first, avg(CASE WHEN j <= 3 THEN score END) AS last FROM r GROUP BY sequence)",
    heads="o",
)
def loss_drop(spark, sf_dir) -> DataFrame:
    """Mean of the first and of the last three points of each series, and the drop between them."""
    rows = objects(spark, sf_dir).select("sequence", "object_id", "score")
    ends = [first_rows(rows, ["sequence"], [order(c) for c in ("object_id", "score")], 3).groupBy("sequence").agg(F.avg("score").alias(name)) for order, name in ((F.asc, "first"), (F.desc, "last"))]
    drop = F.try_divide(F.col("first") - F.col("last"), F.col("first"))
    return ends[0].join(ends[1], "sequence").select("sequence", F.round("first", 4).alias("first"), F.round("last", 4).alias("last"), F.round(drop, 4).alias("drop_share"))


PICK_SQL = """e AS (SELECT platform, sequence, object_id, row_number() OVER (PARTITION BY platform ORDER BY score, object_id) - 1 AS pos, count(*) OVER (PARTITION BY platform) AS n FROM objects),
p1 AS (SELECT platform, arg_min(object_id, pos) AS best, arg_min(sequence, pos) AS s1 FROM e GROUP BY platform),
p2 AS (SELECT e.platform, arg_min(object_id, {'d': abs(pos - n // 2), 'p': pos}) AS median, arg_min(sequence, {'d': abs(pos - n // 2), 'p': pos}) AS s2 FROM e JOIN p1 ON e.platform = p1.platform AND sequence <> s1 GROUP BY e.platform),
p3 AS (SELECT e.platform, arg_max(object_id, pos) AS worst FROM e JOIN p1 ON e.platform = p1.platform JOIN p2 ON e.platform = p2.platform WHERE sequence <> s1 AND sequence <> s2 GROUP BY e.platform)"""


@query(f"WITH {PICK_SQL} SELECT p1.platform, best, median, worst FROM p1 LEFT JOIN p2 ON p1.platform = p2.platform LEFT JOIN p3 ON p1.platform = p3.platform", heads="o")
def distinct_picks(spark, sf_dir) -> DataFrame:
    """Best, median and worst row of each group, each of a file that has none yet.

    Ends come from files' least and greatest rows, the median from the row that
    stands there; only where that is the best one's file are the nearest rows of
    other files looked for. So rows are counted in place and never exchanged.
    """
    row = F.struct(F.col("score").isNull().alias("none"), "score", "object_id").alias("row")
    rows = written(objects(spark, sf_dir).select("platform", "sequence", row), "picks")
    keys = ["platform"]
    files = written(rows.groupBy(*keys, "sequence").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count("*").alias("n")), "files")
    best = files.groupBy(*keys).agg(F.min(F.struct("low", "sequence")).alias("b"), F.sum("n").alias("n"))
    best = best.select(*keys, "n", F.col("b.low.object_id").alias("best"), F.col("b.sequence").alias("s1"))

    middle = written(row_at(rows, keys, best.select(*keys, F.floor(F.col("n") / 2).alias("at"))), "middle")
    # Groups are few: what goes to all tasks is a row for each.
    met = rows.join(F.broadcast(best.select(*keys, "s1").join(middle, keys).where("sequence = s1").select(*keys, "s1", F.col("row").alias("m"))), keys)
    other = F.col("sequence") != F.col("s1")
    near = written(met.where(other).groupBy(*keys).agg(F.max(F.when(F.col("row") < F.col("m"), F.struct("row", "sequence"))).alias("before"), F.min(F.when(F.col("row") > F.col("m"), F.struct("row", "sequence"))).alias("after")), "near")
    met = met.join(F.broadcast(near), keys)
    # Places of the two, by counts of the rows up to one and before the other; of equal steps the earlier row's wins.
    counts = met.groupBy(*keys).agg(F.count_if(F.col("row") <= F.col("before.row")).alias("upto"), F.count_if(F.col("row") < F.col("after.row")).alias("under"))
    counts = counts.join(best, keys).withColumn("at", F.floor(F.col("n") / 2))
    down = F.col("after").isNull() | (F.col("at") - F.col("upto") + 1 <= F.col("under") - F.col("at"))
    nearest = near.join(counts, keys).select(*keys, F.when(F.col("before").isNotNull() & down, F.col("before")).otherwise(F.col("after")).alias("_p"))
    own = middle.select(*keys, F.struct("row", "sequence").alias("_own"))
    chosen = best.join(own, keys, "left").join(nearest, keys, "left")
    chosen = chosen.withColumn("_m", F.when(F.col("_own.sequence") != F.col("s1"), F.col("_own")).otherwise(F.col("_p")))
    chosen = chosen.select(*keys, "best", "s1", F.col("_m.row.object_id").alias("median"), F.col("_m.sequence").alias("s2"))
    last = files.join(chosen, keys).where("sequence <> s1 AND sequence <> s2").groupBy(*keys).agg(F.max("high").alias("_w"))
    return chosen.join(last, keys, "left").select(*keys, "best", "median", F.col("_w.object_id").alias("worst"))


@query("SELECT object_id, round(cos(yaw) - 2 * sin(yaw) + x, 6) + 0.0 AS px, round(sin(yaw) + 2 * cos(yaw) + y, 6) + 0.0 AS py, round(3 + z, 6) + 0.0 AS pz, 1.0::DOUBLE AS bx, 2.0::DOUBLE AS back_y, 3.0::DOUBLE AS bz FROM objects", heads="o")
def pose_round_trip(spark, sf_dir) -> DataFrame:
    """A point taken through a rigid pose and back through its inverse."""
    cos, sin, zero, one = F.cos("yaw"), F.sin("yaw"), F.lit(0.0), F.lit(1.0)
    pose = F.array(cos, -sin, zero, F.col("x"), sin, cos, zero, F.col("y"), zero, zero, one, F.col("z"), zero, zero, zero, one)
    rows = objects(spark, sf_dir).select("object_id", pose.alias("m"))
    rows = rows.select("object_id", G.inverse_pose(F.col("m")).alias("inverse"), *[c.alias(n) for n, c in zip(("px", "py", "pz"), G.apply_pose(F.col("m"), *map(F.lit, (1.0, 2.0, 3.0))))])
    back = G.apply_pose(F.col("inverse"), F.col("px"), F.col("py"), F.col("pz"))
    return rows.select("object_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("px", "py", "pz")], *[F.round(c, 6).alias(n) for n, c in zip(("bx", "back_y", "bz"), back)])
