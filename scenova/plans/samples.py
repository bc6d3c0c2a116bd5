"""Sample records, positive maps, secondary mentions, lens projection, augmentation, eligibility and profiles of documents."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenova.functions import annotations as A
from scenova.functions import geometry as G
from scenova.functions import sql as SQL
from scenova.functions import text as T
from scenova.functions.draws import normal_sql, uniform_sql
from scenova.functions.ids import hash_order
from scenova.operators import augment
from scenova.operators import matching as M
from scenova.operators import neighbours as N
from scenova.plans.base import query
from scenova.plans.points import CLOUD_SQL, D2, cloud
from scenova.sources.scans import sampled
from scenova.sources.scenes import objects, table

#: Boxes of a sample, points of a sample, tokens of a map.
MOST_BOXES, MOST_POINTS, MAP_WIDTH = 132, 16_384, 256

NUMBERED_SQL = "numbered AS (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY object_id, x, y) - 1 AS k FROM objects)"


def numbered(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("cloud").orderBy("object_id", "x", "y")
    return objects(spark, sf_dir).withColumn("k", F.row_number().over(order) - 1).withColumnRenamed("cloud", "frame")


def instance_labels(boxes: DataFrame, points: DataFrame, *, width: float = 8.0) -> DataFrame:
    """(frame, idx, label): the highest k of the boxes that hold a point, -1 for none. Boxes meet points of the cells that they touch."""
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    spread = M.spread(boxes.select("frame", "k", *M.BOX), ["frame"], "t", True, width)
    held = points.select("frame", "idx", *[F.col(c).alias(f"p{c}") for c in "xyz"], cell("x").alias("_cx"), cell("y").alias("_cy"))
    met = held.join(spread, ["frame", "_cx", "_cy"]).where(G.in_box(F.col("px"), F.col("py"), F.col("pz"), M.of("t")))
    best = met.groupBy("frame", "idx").agg(F.max("t_k").alias("label"))
    return points.select("frame", "idx").join(best, ["frame", "idx"], "left").select("frame", "idx", F.coalesce("label", F.lit(-1)).alias("label"))


def sample_table(boxes: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each frame: MOST_BOXES boxes padded with zeros, their mask, and the label of each point by its number.

    ``boxes`` have k from 0 up to MOST_BOXES - 1, ``labels`` at most MOST_POINTS rows a frame, so a row has a bounded size.
    """
    one = F.struct("k", F.array(*M.BOX).alias("box"))
    held = boxes.groupBy("frame").agg(F.transform(F.sort_array(F.collect_list(one)), lambda b: b["box"]).alias("real"))
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), len(M.BOX)), MOST_BOXES)
    held = held.withColumns({"boxes": F.slice(F.concat("real", zero), 1, MOST_BOXES), "mask": F.transform(F.sequence(F.lit(0), F.lit(MOST_BOXES - 1)), lambda i: (i < F.size("real")).cast("int"))}).drop("real")
    told = labels.groupBy("frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "label"))), lambda p: p["label"]).alias("labels"))
    return held.join(told, "frame", "left")


@query(
    f"WITH {NUMBERED_SQL}, b AS (SELECT * FROM numbered WHERE k < {MOST_BOXES}), l AS (SELECT p.cloud, p.k, coalesce(max(b.k), -1) AS label FROM numbered p LEFT JOIN b ON p.cloud = b.cloud "
    "AND abs((p.x - b.x) * cos(b.yaw) + (p.y - b.y) * sin(b.yaw)) < b.l / 2 + 1e-5 AND abs((p.y - b.y) * cos(b.yaw) - (p.x - b.x) * sin(b.yaw)) < b.w / 2 + 1e-5 AND abs(p.z - b.z) <= b.h / 2 GROUP BY p.cloud, p.k) "
    f"SELECT cloud AS frame, least(count(*), {MOST_BOXES}) AS n_boxes, {MOST_BOXES} AS width, 0.0::DOUBLE AS padding, (SELECT round(sum(x), 4) FROM b WHERE b.cloud = l.cloud) AS sum_x, count(*) AS n_points, sum(label)::BIGINT AS label_sum, count_if(label <> k)::BIGINT AS moved FROM l GROUP BY cloud",
    heads="o",
)
def sample_records(spark, sf_dir) -> DataFrame:
    """Padded sample records: the mask adds up to the number of boxes, and nothing stands beyond it."""
    rows = numbered(spark, sf_dir)
    boxes = rows.where(F.col("k") < MOST_BOXES)
    points = sampled(rows.select(F.col("frame").alias("scan"), F.col("k").alias("vertex"), "x", "y", "z"), MOST_POINTS)
    points = points.withColumnsRenamed({"scan": "frame", "vertex": "idx"})
    held = sample_table(boxes, instance_labels(boxes, points))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    beyond = F.transform(F.arrays_zip("boxes", "mask"), lambda r: F.when(r["mask"] == 0, F.aggregate(r["boxes"], F.lit(0.0), lambda s, v: s + F.abs(v))).otherwise(0.0))
    summed = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    moved = F.size(F.filter(F.transform("labels", lambda v, i: v != i), lambda b: b))
    return held.select("frame", total("mask").alias("n_boxes"), F.size("boxes").alias("width"), summed(beyond).alias("padding"), F.round(summed(F.transform("boxes", lambda b: b[0])), 4).alias("sum_x"), F.size("labels").cast("long").alias("n_points"), total("labels").alias("label_sum"), moved.cast("long").alias("moved"))


#: Tokens of a frame's text, the captions of its first three objects with a full stop between them: pieces of three letters.
@query(
    f"WITH {NUMBERED_SQL}, w AS (SELECT cloud, k, unnest(string_split(caption, ' ')) AS word, unnest(range(len(string_split(caption, ' ')))) AS i, len(string_split(caption, ' ')) AS n FROM numbered WHERE k < 3), "
    "p AS (SELECT *, (length(word) + 2) // 3 AS pieces FROM w), "
    "s AS (SELECT *, sum(pieces) OVER (PARTITION BY cloud ORDER BY k, i) - pieces + k AS first FROM p) "
    "SELECT cloud AS frame, CAST(k AS INTEGER) AS target, CAST(first AS INTEGER) AS first, CAST(first + pieces - 1 AS INTEGER) AS last, round(1.0::DOUBLE / (pieces + 1e-6), 6) AS weight, round(pieces / (pieces + 1e-6), 6) AS mass FROM s WHERE i = n - 1",
    heads="o",
)
def positive_maps(spark, sf_dir) -> DataFrame:
    """Maps of each target's noun over the sub-word tokens of the frame's text, MAP_WIDTH wide and normalised."""
    rows = numbered(spark, sf_dir).where("k < 3").groupBy("frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "caption"))), lambda o: o["caption"]).alias("said"))
    text = F.array_join("said", " . ")
    ends = F.aggregate("said", F.array(F.lit(-3)), lambda done, c: F.array_append(done, F.element_at(done, F.lit(-1)) + F.length(c) + 3))
    rows = rows.select("frame", A.subword_offsets(text).alias("tokens"), ends.alias("ends"), F.posexplode("said").alias("target", "caption"))
    end = F.element_at("ends", F.col("target") + 2)
    covered = A.span_tokens(F.col("tokens"), end - F.length(F.substring_index("caption", " ", -1)), end)
    share = F.when(F.col("c").isNotNull(), 1.0 / (F.col("c.last") - F.col("c.first") + 1 + 1e-6)).otherwise(0.0)
    rows = rows.select("frame", "target", covered.alias("c")).withColumn("map", F.transform(F.sequence(F.lit(0), F.lit(MAP_WIDTH - 1)), lambda i: F.when((i >= F.col("c.first")) & (i <= F.col("c.last")), share).otherwise(0.0)))
    mass = F.aggregate("map", F.lit(0.0), lambda s, v: s + v)
    return rows.select("frame", "target", "c.first", "c.last", F.round(F.get("map", F.col("c.first")), 6).alias("weight"), F.round(mass, 6).alias("mass"))


TAILS = [" and a big white {}", " while the {} stands", " near one {} there", " . There is a long {}", " ; a wall is behind the {}", " with one two three four five six seven eight {}"]


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(
    "WITH t AS (SELECT object_id, 'a ' || caption || ' drives' || replace(CASE category " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TAILS)) + " END, '{}', split_part(caption, ' ', 2)) AS said, split_part(caption, ' ', 2) AS noun, length(caption) + 2 AS main_end FROM objects), "
    "p AS (SELECT *, main_end + instr(substr(said, main_end + 1), ' ' || noun) AS start FROM t), "
    "c AS (SELECT *, list_filter(string_split(lower(string_split_regex(substr(said, main_end + 1, start - main_end), '[.;!?]')[-1]), ' '), lambda w: w <> '') AS words FROM p), "
    f"f AS (SELECT *, list_filter(range({T.MOST_FILL + 1}), lambda n: n <= len(words) AND len(list_filter(words[len(words) - n + 1 :], lambda w: NOT regexp_full_match(w, '[a-z0-9-]+') OR list_contains({sql_list(T.BREAKERS)}, w))) = 0 "
    f"AND len(list_filter({sql_list(T.INTRODUCTIONS)}, lambda i: suffix(array_to_string(words[: len(words) - n], ' '), i))) > 0) AS fills FROM c) "
    "SELECT object_id, CAST(start AS INTEGER) AS start, noun AS word FROM f WHERE len(fills) > 0",
    heads="o",
)
def secondary_mentions(spark, sf_dir) -> DataFrame:
    """Second mentions of an object's noun that their clause introduces as another entity."""
    noun = F.split_part("caption", F.lit(" "), F.lit(2))
    tail = F.element_at(F.array(*map(F.lit, TAILS)), F.col("category") + 1)
    rows = objects(spark, sf_dir).select("object_id", noun.alias("noun"), F.concat(F.lit("a "), "caption", F.lit(" drives"), F.replace(tail, F.lit("{}"), noun)).alias("said"), (F.length("caption") + 2).alias("main_end"))
    own = F.filter(A.word_offsets(F.col("said")), lambda w: w["word"] == F.col("noun"))
    found = rows.select("object_id", F.explode(T.secondary_mentions(F.col("said"), own, F.col("main_end"))).alias("m"))
    return found.select("object_id", "m.start", "m.word")


LENS = {"radial": (-0.28, 0.07, -0.01), "tangential": (0.0005, -0.0003)}
FOCAL, CENTRE, IMAGE = (900.0, 880.0), (640.0, 360.0), (1280, 720)


def lens_sql() -> str:
    (k1, k2, k3), (p, q) = LENS["radial"], LENS["tangential"]
    d = lambda v: f"{v!r}::DOUBLE"
    grow = f"(1.0::DOUBLE + r2 * ({d(k1)} + r2 * ({d(k2)} + r2 * {d(k3)})))"
    return f"a * {grow} + {d(2.0 * p)} * a * b + {d(q)} * (r2 + 2.0::DOUBLE * a * a) AS da, b * {grow} + {d(p)} * (r2 + 2.0::DOUBLE * b * b) + {d(2.0 * q)} * a * b AS db"


@query(
    f"WITH n AS (SELECT object_id, x, -y / x AS a, -z / x AS b FROM objects WHERE x > 1), m AS (SELECT *, a * a + b * b AS r2 FROM n), l AS (SELECT object_id, x, {lens_sql()} FROM m) "
    f"SELECT object_id, round({CENTRE[0]}::DOUBLE + {FOCAL[0]}::DOUBLE * da, 3) AS u, round({CENTRE[1]}::DOUBLE + {FOCAL[1]}::DOUBLE * db, 3) AS v, x AS depth FROM l WHERE {CENTRE[0]}::DOUBLE + {FOCAL[0]}::DOUBLE * da BETWEEN 0 AND {IMAGE[0]} AND {CENTRE[1]}::DOUBLE + {FOCAL[1]}::DOUBLE * db BETWEEN 0 AND {IMAGE[1]}",
    heads="o",
)
def lens_projection(spark, sf_dir) -> DataFrame:
    """Objects ahead in the image of a camera whose lens bends: those inside it, with their depth."""
    rows = objects(spark, sf_dir).where("x > 1").select("object_id", F.col("x").alias("depth"), (-F.col("y") / F.col("x")).alias("a"), (-F.col("z") / F.col("x")).alias("b"))
    bent_x, bent_y = G.distort(F.col("a"), F.col("b"), **LENS)
    rows = rows.select("object_id", "depth", (CENTRE[0] + FOCAL[0] * bent_x).alias("u"), (CENTRE[1] + FOCAL[1] * bent_y).alias("v"))
    return rows.where(F.col("u").between(0, IMAGE[0]) & F.col("v").between(0, IMAGE[1])).select("object_id", F.round("u", 3).alias("u"), F.round("v", 3).alias("v"), "depth")


def augment_sql() -> str:
    u = lambda name: uniform_sql(f"aug/{name}", "cloud")
    d = lambda v: f"{v!r}::DOUBLE"
    noise = lambda c: normal_sql(f"aug/noise_{c}", "cloud", "object_id")
    draws = [f"radians(90.0::DOUBLE * floor(4.0::DOUBLE * {u('quarter')}) + {d(2 * augment.TURN)} * {u('turn')} - {d(augment.TURN)}) AS turn", f"{u('flip_x')} > 0.5 AS flip_x", f"{u('flip_y')} > 0.5 AS flip_y"]
    draws += [f"{d(2 * augment.SHIFT)} * {u(f'shift_{c}')} - {d(augment.SHIFT)} AS shift_{c}" for c in "xyz"] + [f"{d(1 - augment.SCALE)} + {d(2 * augment.SCALE)} * {u('scale')} AS scale"]
    draws += [f"{d(augment.NOISE)} * {noise(c)} AS noise_{c}" for c in "xyz"]
    return (
        f"WITH d AS (SELECT *, {', '.join(draws)} FROM objects), f AS (SELECT *, CASE WHEN flip_x THEN -x ELSE x END AS fx, CASE WHEN flip_y THEN -y ELSE y END AS fy, CASE WHEN flip_x THEN pi() - yaw ELSE yaw END AS y1 FROM d), "
        "r AS (SELECT *, fx * cos(turn) - fy * sin(turn) AS rx, fx * sin(turn) + fy * cos(turn) AS ry, CASE WHEN flip_y THEN -y1 ELSE y1 END + turn AS y2 FROM f) "
        "SELECT object_id, round((rx + shift_x) * scale, 4) + 0.0 AS x, round((ry + shift_y) * scale, 4) + 0.0 AS y, round((z + shift_z) * scale, 4) + 0.0 AS z, round(l * scale, 4) + 0.0 AS l, "
        "round(cos(y2), 4) + 0.0 AS cos_yaw, round((rx + noise_x + shift_x) * scale, 4) + 0.0 AS px, round((ry + noise_y + shift_y) * scale, 4) + 0.0 AS py, round((z + noise_z + shift_z) * scale, 4) + 0.0 AS pz FROM r"
    )


@query(augment_sql(), heads="o")
def augmented_scenes(spark, sf_dir) -> DataFrame:
    """Boxes and their centres as points, moved by what their cloud draws; the points also draw noise."""
    rows = objects(spark, sf_dir).select("object_id", "cloud", *M.BOX)
    boxes = augment.moved(rows, "aug", ["cloud"], box=True)
    points = augment.moved(rows.select("cloud", "object_id", "x", "y", "z", F.col("l").alias("own_l"), F.col("yaw").alias("own_yaw")), "aug", ["cloud"], noise=["object_id"])
    both = boxes.withColumn("n", F.row_number().over(Window.partitionBy("object_id").orderBy("x", "y"))).join(points.withColumn("n", F.row_number().over(Window.partitionBy("object_id").orderBy("x", "y"))).select("object_id", "n", *[F.col(c).alias(f"p{c}") for c in "xyz"]), ["object_id", "n"])
    return both.select("object_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("x", "y", "z", "l")], (F.round(F.cos("yaw"), 4) + 0.0).alias("cos_yaw"), *[(F.round(f"p{c}", 4) + 0.0).alias(f"p{c}") for c in "xyz"])


NOUNS = ["gear", "gizmo", "anvil", "widget", "plate", "rod", "ring", "bolt"]
REASONS = ["too_short", "too_long", "spatial_cue", "no_noun", "noun_not_target_category", "no_scene_join", "split_mismatch", "eligible"]


def first_reason(steps: list[tuple[Column, str]], passed: str) -> Column:
    """The name of the first step whose test a row fails, or ``passed``."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for ok, name in steps], F.lit(passed))


@query(
    "WITH s AS (SELECT *, ('0x' || substr(sha1('chain|' || object_id), 1, 4))::INTEGER % 7 AS draw FROM objects), "
    "c AS (SELECT *, CASE draw WHEN 0 THEN caption || ' on the left' WHEN 1 THEN 'it' WHEN 2 THEN 'a shiny thing over there' ELSE caption END AS said, CASE WHEN draw = 3 THEN 'other' ELSE split_part(caption, ' ', 2) END AS class FROM s), "
    f"n AS (SELECT *, list_filter(string_split(said, ' '), lambda w: list_contains({sql_list(NOUNS)}, w))[1] AS noun, CASE WHEN length(said) < 8 THEN 'too_short' WHEN length(said) > 180 THEN 'too_long' WHEN contains(said, ' left') THEN 'spatial_cue' END AS gate FROM c), "
    "r AS (SELECT CASE WHEN gate IS NOT NULL THEN gate WHEN noun IS NULL THEN 'no_noun' WHEN noun <> class THEN 'noun_not_target_category' WHEN split = 'test' THEN 'no_scene_join' WHEN scene_id % 9 = 0 THEN 'split_mismatch' ELSE 'eligible' END AS reason FROM n), "
    f"k AS (SELECT unnest({sql_list(REASONS)}) AS reason, unnest(range({len(REASONS)})) AS place), "
    "g AS (SELECT k.reason, CAST(place AS INTEGER) AS place, count(r.reason) AS n FROM k LEFT JOIN r ON k.reason = r.reason GROUP BY ALL) "
    "SELECT reason, place, n, CAST(sum(n) OVER (ORDER BY place DESC) AS BIGINT) AS reached FROM g",
    heads="o",
)
def eligibility_chain(spark, sf_dir) -> DataFrame:
    """Phrase, noun, class, scene and split checked one after the other; each row counts for the first reason that stops it, and ``reached`` says how many came so far."""
    draw = F.conv(F.substr(hash_order("chain", F.col("object_id")), F.lit(1), F.lit(4)), 16, 10).cast("int") % 7
    said = F.when(draw == 0, F.concat("caption", F.lit(" on the left"))).when(draw == 1, "it").when(draw == 2, "a shiny thing over there").otherwise(F.col("caption"))
    rows = objects(spark, sf_dir).select("scene_id", "split", said.alias("said"), F.when(draw == 3, "other").otherwise(F.split_part("caption", F.lit(" "), F.lit(2))).alias("class"))
    # The index of known scenes: test scenes are missing, and every ninth scene has another split.
    orders = table(spark, sf_dir, "orders").where("o_orderstatus in ('O', 'F')")
    split = F.when(F.col("o_orderkey") % 9 == 0, "none").when(F.col("o_orderstatus") == "O", "train").otherwise("val")
    index = orders.select(F.col("o_orderkey").alias("scene_id"), split.alias("indexed"))
    gate, noun = T.neutral_phrase(F.col("said")), T.first_noun(F.col("said"), F.array(*map(F.lit, NOUNS)))["word"]
    met = rows.join(index, "scene_id", "left").withColumns({"gate": gate["reason"], "noun": noun})
    gates = [(F.col("gate") != name, name) for name in REASONS[:3]]
    steps = [(F.col("noun").isNotNull(), "no_noun"), (F.col("noun") == F.col("class"), "noun_not_target_category"), (F.col("indexed").isNotNull(), "no_scene_join"), (F.col("indexed") == F.col("split"), "split_mismatch")]
    counts = met.groupBy(first_reason([*gates, *steps], "eligible").alias("reason")).agg(F.count("*").alias("n"))
    places = spark.createDataFrame([(r, i) for i, r in enumerate(REASONS)], "reason string, place int")
    full = places.join(counts, "reason", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return full.withColumn("reached", F.sum("n").over(Window.orderBy(F.desc("place"))))  # eight rows


DOCUMENT_SQL = """'{"id": ' || event_id || ', "kind": "' || event_type || '", "props": ' || props || ', "v": ' || CASE event_id % 5 WHEN 0 THEN '"text"' WHEN 1 THEN 'null' WHEN 2 THEN '1.5' WHEN 3 THEN 'true' ELSE '[1, {"deep": {"er": null}}, "x"]' END || CASE WHEN event_id % 7 = 0 THEN ', "extra": {"a": 1, "b": []}' ELSE '' END || '}'"""


def path_profile(docs: DataFrame, column: str, depth: int = 6) -> DataFrame:
    """(path, n, kinds, null_rate, rate) of JSON documents whose schema nobody knows; places of arrays count as one path.

    The documents are taken apart level by level as variants, down to ``depth``;
    each level is a generator and nothing is inferred beforehand.
    """
    level = docs.select(F.lit("$").alias("path"), F.parse_json(F.col(column)).alias("v"))
    nodes = level
    for _ in range(depth):
        inner = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNull(), "[*]").otherwise(F.concat(F.lit("."), "key"))
        level = inner.select(F.concat("path", step).alias("path"), F.col("value").alias("v"))
        nodes = nodes.unionByName(level)
    name = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
    kind = F.when(name == "VOID", "null").when(name.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "number").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").otherwise(F.lower(name))
    counts = nodes.select("path", kind.alias("kind")).groupBy("path", "kind").agg(F.count("*").alias("n"))
    per = counts.groupBy("path").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.round(F.sum(F.when(F.col("kind") == "null", F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("null_rate"))
    total = F.max(F.when(F.col("path") == "$", F.col("n"))).over(Window.partitionBy())  # one row a path
    return per.withColumn("rate", F.round(F.col("n") / total, 6))


@query(
    f"WITH d AS (SELECT event_id, {DOCUMENT_SQL} AS doc FROM events), t AS (SELECT event_id, regexp_replace(j.fullkey, '\\[\\d+\\]', '[*]', 'g') AS path, CASE WHEN j.type = 'NULL' THEN 'null' WHEN j.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN j.type = 'VARCHAR' THEN 'string' ELSE lower(j.type) END AS kind FROM d, json_tree(d.doc) j) "
    "SELECT path, count(*) AS n, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, round(count_if(kind = 'null') / count(*), 6) AS null_rate, round(count(*) / (SELECT count(*) FROM events), 6) AS rate FROM t GROUP BY path"
)
def document_profile(spark, sf_dir) -> DataFrame:
    """Paths of nested documents with their frequency, type conflicts and null rates."""
    return path_profile(table(spark, sf_dir, "events").select(F.expr(DOCUMENT_SQL).alias("doc")), "doc")


def scale_sql(radius: float) -> str:
    cell = "least(greatest(" + " + ".join(f"floor(({c} + {radius}) / {radius}) * {k}" for c, k in (("dx", 4), ("dy", 2), ("dz", 1))) + ", 0), 7)::INTEGER"
    return f"SELECT {radius}::DOUBLE AS radius, scene_id, idx, {cell} AS cell, f, py FROM (SELECT a.scene_id, a.idx, b.f, b.y AS py, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM cloud a JOIN cloud b ON a.scene_id = b.scene_id AND {D2} <= {radius * radius})"


@query(f"WITH {CLOUD_SQL}, g AS ({scale_sql(2.0)} UNION ALL {scale_sql(4.0)}), c AS (SELECT radius, scene_id, idx, cell, count(*) AS n, avg(f + py) AS c0 FROM g GROUP BY ALL) SELECT scene_id, idx, count_if(radius = 2)::BIGINT AS near_cells, count_if(radius = 4)::BIGINT AS far_cells, coalesce(round(sum(CASE WHEN radius = 2 THEN c0 END), 6), 0) + 0.0 AS near_sum, round(sum(CASE WHEN radius = 4 THEN c0 END), 6) + 0.0 AS far_sum FROM c GROUP BY ALL", heads="o")
def multi_scale_pool(spark, sf_dir) -> DataFrame:
    """Local grids of two scales about every point, side by side in one row."""
    p = cloud(spark, sf_dir)
    scales = {"near": 2.0, "far": 4.0}
    of = lambda name: F.when(F.col("scale") == name, F.col("v"))

    keys = ["scene_id", "idx"]

    def lists(rows: DataFrame) -> DataFrame:
        one = lambda p: F.struct(N.apart(p).alias("d2"), (p["f"] + p["y"]).alias("v"), *[N.local_cell(r, 2, p.__getitem__).alias(n) for n, r in scales.items()])
        rows = rows.where(F.size("_near") > 0).select(*keys, F.transform("_near", one).alias("_near"))
        rows = rows.select(*keys, *[F.filter("_near", lambda v: v["d2"] <= r * r).alias(n) for n, r in scales.items()])

        def means(n: str) -> Column:
            held = F.transform(F.array_distinct(F.transform(n, lambda v: v[n])), lambda c: N.mean(F.transform(F.filter(n, lambda v: v[n] == c), lambda v: v["v"])))
            return F.filter(held, lambda v: v.isNotNull())

        rows = rows.select(*keys, *[means(n).alias(n) for n in scales])
        total = lambda n: F.when(F.size(n) > 0, F.aggregate(n, F.lit(0.0), lambda s, v: s + v))
        return rows.select(*keys, *[F.size(n).cast("long").alias(f"{n}_cells") for n in scales], *[(F.coalesce(F.round(total(n), 6), F.lit(0.0)) + 0.0).alias(f"{n}_sum") for n in scales])

    def pairs(met: DataFrame) -> DataFrame:
        held = F.array(*[F.struct(F.lit(n).alias("scale"), (F.col("d2") <= r * r).alias("near"), N.local_cell(r, 2).alias("cell")) for n, r in scales.items()])
        met = met.withColumn("s", F.explode(F.filter(held, lambda h: h["near"])))
        cells = met.groupBy(*keys, F.col("s.scale").alias("scale"), F.col("s.cell").alias("cell")).agg(F.avg(F.col("p_f") + F.col("p_y")).alias("v"))
        return cells.groupBy(*keys).agg(*[F.count(of(n)).alias(f"{n}_cells") for n in scales], *[(F.coalesce(F.round(F.sum(of(n)), 6), F.lit(0.0)) + 0.0).alias(f"{n}_sum") for n in scales])

    far = max(scales.values())
    return N.near_lists(p, p, far, N.local(far), lists, pairs)


@query(
    "WITH w AS (SELECT object_id, unnest(string_split(said, ' ')) AS word, unnest(range(len(string_split(said, ' ')))) AS i, string_split(said, ' ') AS l FROM (SELECT DISTINCT object_id, caption || ' and one more ' || split_part(caption, ' ', 2) AS said FROM objects)) "
    f"SELECT object_id, CAST(row_number() OVER (PARTITION BY object_id ORDER BY i) AS INTEGER) AS nth, CAST(list_sum(list_transform(l[: i], lambda x: length(x) + 1)) AS INTEGER) AS start, word FROM w WHERE list_contains({sql_list(NOUNS)}, word)",
    heads="o",
)
def lateral_mentions(spark, sf_dir) -> DataFrame:
    """Mentions of nouns as rows, by SQL text that calls a table function for each caption."""
    SQL.register(spark)
    said = F.concat("caption", F.lit(" and one more "), F.split_part("caption", F.lit(" "), F.lit(2)))
    rows = objects(spark, sf_dir).select("object_id", said.alias("said"))
    nouns = ", ".join(f"'{n}'" for n in NOUNS)
    # A caption that many objects share is searched once.
    found = spark.sql(f"SELECT c.said, m.nth, m.start, m.word FROM {{captions}} c, LATERAL mentions_of(c.said, array({nouns})) m", captions=rows.select("said").distinct())
    return rows.distinct().join(found, "said").select("object_id", "nth", "start", "word")
