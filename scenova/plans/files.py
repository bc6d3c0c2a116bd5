"""Readers and sinks as queries: the tables are written in the raw layouts to a shared folder, read back and compared in SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenova.functions.ids import hash_order
from scenova.operators.ranks import next_in_order
from scenova.plans.base import query
from scenova.plans.generators import directed
from scenova.sources import npz
from scenova.sources import readers as R
from scenova.sources import scans as V
from scenova.sources import sinks as K
from scenova.sources.scenes import objects, table


def scene_documents(objs: DataFrame) -> DataFrame:
    """Nested scene documents in order of their ids, the objects by id; even categories are referred to, odd ones are context.

    What is gathered and put in order are the objects' own values; documents are made of them where they are written.
    """
    own = F.struct("object_id", "category", "caption", *"xyzlwh", "yaw")
    rows = objs.groupBy("scene_id", "split", "platform", "sequence").agg(F.collect_list(own).alias("_of"))
    rows = rows.withColumn("scene_id", F.col("scene_id").cast("string")).orderBy("scene_id")

    def one(o: Column) -> Column:
        role = F.when(o["category"] % 2 == 0, "referred").otherwise("context")
        said = F.array(F.struct(o["caption"].alias("text"), F.lit("catalogue").alias("source"), F.lit("en").alias("language")))
        box = F.struct(F.array(o["x"], o["y"], o["z"]).alias("center"), F.array(o["l"], o["w"], o["h"]).alias("size"), o["yaw"].alias("yaw_rad"), F.lit("ego").alias("frame"))
        return F.struct(o["object_id"].alias("object_id"), role.alias("role"), o["category"].cast("string").alias("category"), said.alias("referring_expressions"), box.alias("gt_box"))

    axis = lambda *v: F.array(*[F.lit(float(a)) for a in v])
    frame = F.struct(F.lit("ego").alias("name"), F.lit("metre").alias("units"), F.lit("sensor").alias("origin"), axis(0, -1, 0).alias("right_axis"), axis(1, 0, 0).alias("forward_axis"), axis(0, 0, 1).alias("up_axis"))
    return rows.select("scene_id", "split", "platform", "sequence", F.sort_array(F.transform("_of", one)).alias("objects"), frame.alias("frame"))


def written_scenes(spark, sf_dir) -> DataFrame:
    path = K.shared_folder(spark, "scenes")
    K.write_lines(scene_documents(objects(spark, sf_dir)), path)
    return R.scene_objects(R.scenes(spark, path))


@query("SELECT scene_id::VARCHAR AS scene_id, split, platform, sequence, object_id, CASE WHEN category % 2 = 0 THEN 'referred' ELSE 'context' END AS role, category::VARCHAR AS category, caption, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, l, w, h, round(yaw, 6) AS yaw FROM objects", heads="o")
def scene_jsonl(spark, sf_dir) -> DataFrame:
    """Scene documents as JSON lines, written in order, read with the fixed schema and taken apart into objects."""
    rows = written_scenes(spark, sf_dir)
    return rows.select("scene_id", "split", "platform", "sequence", "object_id", "role", "category", F.col("expressions")[0]["text"].alias("caption"), *[F.round(c, 6).alias(c) for c in "xyz"], *"lwh", F.round("yaw", 6).alias("yaw"))


@query(r"SELECT scene_id::VARCHAR AS scene_id, lower(trim(regexp_replace(caption, '\s+', ' ', 'g'))) AS caption, max(object_id) AS object_id FROM objects WHERE category % 2 = 0 GROUP BY ALL", heads="o")
def scene_caption_index(spark, sf_dir) -> DataFrame:
    """Captions of written scenes' referred objects to object ids; the last one of a caption wins."""
    return R.caption_index(written_scenes(spark, sf_dir))


@query("SELECT scene_id::VARCHAR AS qa_id, split, 'How many objects are there?' AS question, count(*) AS answer, round(max(x), 6) AS far FROM objects GROUP BY ALL", heads="o")
def public_private(spark, sf_dir) -> DataFrame:
    """Questions in a public table and keys in a private one, joined again row by row."""
    rows = objects(spark, sf_dir).groupBy(F.col("scene_id").cast("string").alias("qa_id"), "split").agg(F.count("*").alias("answer"), F.max("x").alias("far"))
    root = K.shared_folder(spark, "questions")
    K.write_public_private(rows.withColumn("question", F.lit("How many objects are there?")), root, ["qa_id", "split", "question"])
    public, private = (spark.read.parquet(f"{root}/{side}") for side in ("public", "private"))
    return public.join(private, "qa_id").select("qa_id", "split", "question", "answer", F.round("far", 6).alias("far"))


@query("SELECT sequence, count(*) AS n, round(avg(score), 4) AS mean FROM objects WHERE split = 'val' GROUP BY ALL", heads="o")
def split_files(spark, sf_dir) -> DataFrame:
    """Objects in one folder for each split; one split is read, and the folder alone tells which."""
    path = K.shared_folder(spark, "splits")
    K.write_split(objects(spark, sf_dir).select("sequence", "score", "split"), path)
    return spark.read.parquet(path).where("split = 'val'").groupBy("sequence").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"))


@query(
    "SELECT variant, n_refs, answer, count(*) AS n, count(DISTINCT donor) > 1 AS moved FROM ("
    "WITH q AS (SELECT a_id, b_id, CASE WHEN dy > 0 THEN 'left' ELSE 'right' END AS answer, CASE WHEN dy > 0 THEN 'right' ELSE 'left' END AS other FROM pairs WHERE a_id < b_id AND dy <> 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY sha1('shuffled|' || a_id || '|' || b_id), a_id, b_id) AS place, count(*) OVER (PARTITION BY answer) AS size FROM q) "
    "SELECT 'original' AS variant, 2 AS n_refs, answer, a_id AS donor FROM q UNION ALL SELECT 'swap_eval', 2, other, b_id FROM q UNION ALL SELECT 'joint', 2, answer, a_id FROM q UNION ALL SELECT 'joint', 2, other, b_id FROM q "
    "UNION ALL SELECT 'shuffled', 2, r.answer, d.a_id FROM r JOIN r d ON d.answer = r.answer AND d.place = r.place % r.size + 1) GROUP BY variant, n_refs, answer",
    heads="p",
)
def variant_files(spark, sf_dir) -> DataFrame:
    """One question set as four variants in a folder each: original, swapped, both jointly, and with the references of the next question of the same answer in a shuffled order.

    Scenes are written once and asked inside their rows; a question is exchanged once, to its place in the shuffled order.
    """
    objs = objects(spark, sf_dir).select("scene_id", F.struct("object_id", "y").alias("one"))
    scenes = K.written(objs.groupBy("scene_id").agg(F.array_sort(F.collect_list("one")).alias("_of")).select("_of"), "questions")
    met = scenes.select("_of", F.explode("_of").alias("a")).select("a", F.explode("_of").alias("b"))
    dy = F.col("a.y") - F.col("b.y")
    met = met.where((F.col("a.object_id") < F.col("b.object_id")) & (dy != 0))
    asked = met.select(F.col("a.object_id").alias("a_id"), F.col("b.object_id").alias("b_id"), (dy > 0).alias("left"))
    say = lambda left: F.when(left, "left").otherwise("right").alias("answer")
    refs = lambda a, b: F.array(a, b).alias("refs")
    original = asked.select("a_id", "b_id", refs("a_id", "b_id"), say(F.col("left")))
    swapped = asked.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), refs("b_id", "a_id"), say(~F.col("left")))
    drawn = lambda: hash_order("shuffled", F.col("a_id"), F.col("b_id"))
    follows = next_in_order(asked, ["left"], drawn, ["a_id", "b_id"])
    shuffled = follows.select("a_id", "b_id", refs("_next.a_id", "_next.b_id"), say(F.col("left")))
    path = K.shared_folder(spark, "variants")
    K.write_variants({"original": original, "swap_eval": swapped, "joint": original.unionByName(swapped), "shuffled": shuffled}, path)
    held = spark.read.parquet(path)
    donor = F.col("refs")[0]
    # Texts alone are aggregated behind a sort of all rows, next to a collected set (here of nothing) in a map of the few groups.
    found = held.groupBy("variant", F.size("refs").alias("n_refs"), "answer").agg(F.count("*").alias("n"), F.min(donor).alias("_low"), F.max(donor).alias("_high"), F.collect_set(F.lit(None).cast("string")).alias("_none"))
    return found.where(F.size("_none") == 0).select("variant", "n_refs", "answer", "n", (F.col("_low") != F.col("_high")).alias("moved"))


@query("SELECT o_orderkey::VARCHAR AS qa_id, CASE WHEN o_totalprice > 150000 THEN 'far' ELSE 'near' END AS prediction FROM orders")
def prediction_files(spark, sf_dir) -> DataFrame:
    """Predictions as JSON lines, read by the reader that takes an object with rows too."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("qa_id"), F.when(F.col("o_totalprice") > 150000, "far").otherwise("near").alias("prediction"))
    path = K.shared_folder(spark, "predictions")
    K.write_jsonl(rows, path, ["qa_id"])
    return R.predictions_any(spark, path)


@query("SELECT o_orderkey AS scene_id, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS bank_index FROM orders")
def bank_positions(spark, sf_dir) -> DataFrame:
    """Places of scenes in a bank sorted by status and id."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_id"), "o_orderstatus")
    return R.with_ordinal(rows, ["o_orderstatus", "scene_id"]).select("scene_id", "bank_index")


@query("SELECT scene_id::VARCHAR AS scan_id, object_id, len(string_split(caption, ' ')) AS n_tokens, string_split(caption, ' ')[1] AS first_token FROM objects WHERE split = 'val' AND category < 4", heads="o")
def csv_annotations(spark, sf_dir) -> DataFrame:
    """Annotations as CSV with lists as text, kept where the scan is known and the flag says that the class is named."""
    rows = objects(spark, sf_dir)
    cells = F.concat(F.lit("['"), F.replace("caption", F.lit(" "), F.lit("', '")), F.lit("']"))
    flag = F.when(F.col("category") < 4, "True").otherwise("False")
    path = K.shared_folder(spark, "annotations")
    rows.select(F.col("scene_id").cast("string").alias("scan_id"), "object_id", flag.alias("mentions_target_class"), cells.alias("tokens")).write.option("header", True).csv(path)
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("scan_id"))
    return R.csv_annotations(spark, path, known).select("scan_id", "object_id", F.size("tokens").cast("long").alias("n_tokens"), F.col("tokens")[0].alias("first_token"))


@query("SELECT CAST(l_linenumber AS INTEGER) AS epoch, unnest(['rows', 'quantity']) AS name, unnest([count(*)::DOUBLE, sum(l_quantity)::DOUBLE]) AS value FROM lineitem GROUP BY l_linenumber")
def training_log(spark, sf_dir) -> DataFrame:
    """A coloured log with a block for each of seven epochs, cut into metrics. A log is one short file."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"))
    lines = F.concat(F.lit("\x1b[32mEpoch "), F.col("l_linenumber").cast("string"), F.lit("\x1b[0m\rrows: "), F.col("n").cast("string"), F.lit(" quantity: "), F.col("q").cast("string"))
    path = K.shared_folder(spark, "log")
    rows.coalesce(1).sortWithinPartitions("l_linenumber").select(lines.alias("value")).write.text(path)
    return R.log_metrics(spark, path, "Epoch ", r"(rows|quantity): (\d+)")


ARRAY_NAME_SQL = "CASE category WHEN 0 THEN split_part(caption, ' ', 1) || ' ' || split_part(caption, ' ', 2) WHEN 1 THEN 'old ' || split_part(caption, ' ', 2) WHEN 2 THEN 'old thing' WHEN 3 THEN NULL ELSE split_part(caption, ' ', 2) END"


@query(
    f"WITH n AS (SELECT scene_id::VARCHAR AS scene_id, object_id, caption AS utterance, {ARRAY_NAME_SQL} AS name FROM objects WHERE split <> 'val'), "
    "t AS (SELECT *, CASE WHEN contains(utterance, name) THEN name WHEN contains(utterance, split_part(name, ' ', -1)) THEN split_part(name, ' ', -1) END AS target FROM n) SELECT scene_id, object_id, utterance, target FROM t WHERE target IS NOT NULL",
    heads="o",
)
def array_annotations(spark, sf_dir) -> DataFrame:
    """Annotations as JSON arrays, one for each cloud: scans of a split kept, and the target taken from what the utterance says."""
    word = lambda nth: F.split_part("caption", F.lit(" "), F.lit(nth))
    kind = F.col("category")
    name = F.when(kind == 0, F.concat(word(1), F.lit("_"), word(2))).when(kind == 1, F.concat(F.lit("old_"), word(2))).when(kind == 2, "old_thing").when(kind > 3, word(2))
    one = F.struct(F.col("scene_id").cast("string").alias("scene_id"), "object_id", name.alias("object_name"), F.split("caption", " ").alias("token"))
    rows = objects(spark, sf_dir).groupBy("cloud").agg(F.to_json(F.collect_list(one)).alias("content"))
    path = K.shared_folder(spark, "arrays")
    K.write_documents(rows.select(F.concat(F.col("cloud").cast("string"), F.lit(".json")).alias("name"), "content"), path)
    known = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").cast("string").alias("scene_id"))
    return R.json_array(spark, path, known).select("scene_id", "object_id", "utterance", "target")


@query("SELECT cloud::VARCHAR AS id, count(*) AS n, round(max(score), 2) AS best, arg_max(object_id, {'s': score, 'o': object_id}) AS chosen FROM objects GROUP BY cloud", heads="o")
def prediction_folders(spark, sf_dir) -> DataFrame:
    """One prediction.json for each sample in a folder of its own, found again at any depth; other files beside them are passed over."""
    rows = objects(spark, sf_dir).groupBy("cloud").agg(F.count("*").alias("n"), F.max(F.struct("score", "object_id")).alias("top"))
    content = F.to_json(F.struct(F.col("cloud").cast("string").alias("id"), "n", F.col("top.score").alias("best"), F.col("top.object_id").alias("chosen")))
    at = lambda name: F.concat_ws("/", F.concat(F.lit("part"), F.col("cloud") % 5), F.col("cloud").cast("string"), F.lit(name)).alias("name")
    path = K.shared_folder(spark, "samples")
    K.write_documents(rows.select(at("prediction.json"), content.alias("content")), path)
    K.write_documents(rows.where("cloud % 10 = 0").select(at("notes.json"), content.alias("content")), path)
    held = R.predictions(spark, path, "id string, n long, best double, chosen string")
    return held.withColumn("best", F.round("best", 2))


@query("SELECT p_brand AS key, min(p_type) AS value FROM part GROUP BY p_brand")
def label_files(spark, sf_dir) -> DataFrame:
    """A tab-separated dictionary of labels."""
    path = K.shared_folder(spark, "labels")
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("raw")).agg(F.min("p_type").alias("id"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return R.label_map(spark, path, "raw", "id")


@query("SELECT count(*) AS n FROM objects", heads="o")
def checked_write(spark, sf_dir) -> DataFrame:
    """Rows that a sink has on disk once it has read them again."""
    n = K.write_checked(objects(spark, sf_dir), K.shared_folder(spark, "checked"))
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


@query("SELECT scene_id, count(*) AS n, round(sum(x), 6) AS sum_x, round(max(y), 6) AS far, CAST(round(min(l), 4) AS DOUBLE) AS least_l FROM objects GROUP BY scene_id", heads="o")
def npz_shards(spark, sf_dir) -> DataFrame:
    """Scenes as array shards with ragged boxes, written behind a manifest and read with one of their members left out."""
    one = F.struct("object_id", F.array("x", "y", "z", "l", "w", "h", "yaw").alias("box"))
    rows = objects(spark, sf_dir).groupBy("scene_id", "split").agg(F.transform(F.sort_array(F.collect_list(one)), lambda o: o["box"]).alias("boxes"))
    path = K.shared_folder(spark, "shards")
    npz.register(spark)
    rows.write.format("npz").mode("append").save(path)
    held = spark.read.format("npz").schema("scene_id long, boxes array<array<double>>").load(path)
    boxes = held.select("scene_id", F.explode("boxes").alias("b"))
    return boxes.groupBy("scene_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("b")[0]), 6).alias("sum_x"), F.round(F.max(F.col("b")[1]), 6).alias("far"), F.round(F.min(F.col("b")[3]), 4).alias("least_l"))


@query(
    "SELECT platform, 'frame' || (cloud % 7) AS sequence, CASE WHEN cloud % 11 = 0 THEN 'unreadable' WHEN cloud % 13 = 0 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN cloud % 11 = 0 OR cloud % 13 = 0 THEN 'none' WHEN category = 5 THEN 'short_box' WHEN category = 4 THEN 'bad_box' ELSE 'ok' END AS reason, count(DISTINCT cloud) AS frames, count(*) AS n FROM objects GROUP BY ALL",
    heads="o",
)
def frame_documents(spark, sf_dir) -> DataFrame:
    """Raw frames as one document each under platform, sequence and frame; broken and empty ones are rows, and boxes have the reason why they can't be used."""
    box = F.array("x", "y", "z", "l", "w", F.when(F.col("category") == 4, -F.col("h")).otherwise(F.col("h")), "yaw")
    one = F.struct(F.lit("Car").alias("class"), "caption", F.when(F.col("category") == 5, F.slice(box, 1, 6)).otherwise(box).alias("bbox_3d"))
    rows = objects(spark, sf_dir).groupBy("platform", "cloud").agg(F.sort_array(F.collect_list(F.struct("object_id", one.alias("o")))).alias("held"), F.count("*").alias("n"))
    info = F.to_json(F.struct(F.transform("held", lambda h: h["o"]).alias("ground_info")))
    text = F.when(F.col("cloud") % 11 == 0, F.substr(info, F.lit(1), F.length(info) - 5)).when(F.col("cloud") % 13 == 0, F.lit('{"ground_info": []}')).otherwise(info)
    name = F.concat_ws("/", "platform", F.concat(F.lit("frame"), F.col("cloud") % 7), F.col("cloud").cast("string"), F.lit("meta_info.json"))
    path = K.shared_folder(spark, "frames")
    K.write_documents(rows.select(name.alias("name"), text.alias("content")), path)
    frames = R.raw_frames(spark, path)
    reasons = R.frame_objects(frames).select("platform", "sequence", "frame", F.lit("ok").alias("status"), "reason")
    odd = frames.where("status <> 'ok'").select("platform", "sequence", "frame", "status", F.lit("none").alias("reason"))
    sizes = rows.select("platform", F.concat(F.lit("frame"), F.col("cloud") % 7).alias("sequence"), F.col("cloud").cast("string").alias("frame"), "n")
    odd = odd.hint("merge").join(sizes, ["platform", "sequence", "frame"])  # what broken frames would have held
    both = reasons.withColumn("n", F.lit(1).cast("long")).unionByName(odd)
    return both.groupBy("platform", "sequence", "status", "reason").agg(F.countDistinct("frame").alias("frames"), F.sum("n").alias("n"))


@query("SELECT CAST(cloud AS VARCHAR) AS frame, count(*) AS n, CAST(max(CAST(x AS FLOAT)) AS DOUBLE) AS far, CAST(min(CAST(y AS FLOAT)) AS DOUBLE) AS near, count(DISTINCT CAST(z AS FLOAT)) AS heights FROM objects GROUP BY cloud", heads="o")
def lidar_files(spark, sf_dir) -> DataFrame:
    """Clouds as raw float32 files of four columns, one file a frame, read back point by point."""
    point = F.struct("object_id", *[F.col(c).cast("float").alias(c) for c in "xyz"])
    rows = objects(spark, sf_dir).groupBy("cloud").agg(F.sort_array(F.collect_list(point)).alias("p"))

    @F.arrow_udf("binary")
    def packed(clouds: pa.Array) -> pa.Array:
        points, sizes = clouds.flatten(), clouds.value_lengths().to_numpy(zero_copy_only=False).astype(int)
        rows = np.stack([*[points.field(c).to_numpy(zero_copy_only=False) for c in "xyz"], np.full(len(points), 0.5)], axis=1).astype("<f4")
        return pa.array([c.tobytes() for c in np.split(rows, np.cumsum(sizes)[:-1])][: len(sizes)], pa.binary())

    path = K.shared_folder(spark, "lidar")
    K.write_documents(rows.select(F.concat(F.col("cloud").cast("string"), F.lit("/cloud.bin")).alias("name"), packed("p").alias("content")), path)
    points = R.lidar(spark, path).withColumn("frame", V.scan_of(F.col("path")))
    return points.groupBy("frame").agg(F.count("*").alias("n"), F.max("x").cast("double").alias("far"), F.min("y").cast("double").alias("near"), F.countDistinct("z").alias("heights"))


#: A scan is a cloud: each object has eight corners in two segments, and every fifth object is listed twice.
SCAN_SQL = """numbered AS (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY object_id, x, y) - 1 AS k FROM objects),
corners AS (
    SELECT cloud, k, caption, k * 8 + c AS vertex, CAST(CAST(x + (c % 2 - 0.5::DOUBLE) * l AS FLOAT) AS DOUBLE) AS vx, CAST(CAST(y + (c // 2 % 2 - 0.5::DOUBLE) * w AS FLOAT) AS DOUBLE) AS vy, CAST(CAST(z + (c // 4 - 0.5::DOUBLE) * h AS FLOAT) AS DOUBLE) AS vz
    FROM numbered, (SELECT unnest(range(8)) AS c)
),
drawn AS (SELECT * FROM corners QUALIFY row_number() OVER (PARTITION BY cloud ORDER BY sha1('1184|' || cloud || '|' || vertex)) <= 200)"""


@query(
    f"WITH {SCAN_SQL} SELECT CAST(cloud AS VARCHAR) AS scan, CAST(k AS INTEGER) AS object_id, caption AS label, count(*) AS points, round(min(vx), 5) AS low_x, round(max(vz), 5) AS high_z, round(max(vy) - min(vy), 5) AS width FROM drawn GROUP BY ALL",
    heads="o",
)
def indoor_scans(spark, sf_dir) -> DataFrame:
    """Scans in their three files: vertices meet segments and objects, 200 points of a scan are drawn, and objects listed twice count once.

    A scan's objects are gathered and written once, and its files are read together.
    """
    one = F.struct("object_id", *"xyzlwh", "caption")
    rows = objects(spark, sf_dir).groupBy("cloud").agg(F.array_sort(F.collect_list(one)).alias("o"))
    short = F.transform("o", lambda o: F.struct(*[o[c].alias(c) for c in (*"xyzlwh", "caption")]))
    held = K.written(rows.select("cloud", short.alias("o")), "scenes")
    half = lambda o, c, i, s: (o[c] + (i - 0.5) * o[s]).cast("float").alias(c)
    corners = lambda o: F.array(*[F.struct(half(o, "x", c % 2, "l"), half(o, "y", c // 2 % 2, "w"), half(o, "z", c // 4, "h")) for c in range(8)])
    held = held.select("cloud", F.transform("o", lambda o, k: F.struct(k.alias("k"), corners(o).alias("corners"), o["caption"].alias("caption"))).alias("o"))

    @F.arrow_udf("binary")
    def ply(clouds: pa.Array) -> pa.Array:
        held = clouds.flatten().field("corners")
        points = held.flatten()
        xyz = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in "xyz"], axis=1).astype("<f4")
        ends = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False).astype(int))])
        ends = ends[np.concatenate([[0], np.cumsum(clouds.value_lengths().to_numpy(zero_copy_only=False).astype(int))])]
        body = np.concatenate([xyz.view(np.uint8).reshape(len(xyz), 12), np.full((len(xyz), 1), 9, np.uint8)], axis=1)
        head = "ply\nformat binary_little_endian 1.0\nelement vertex {}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nend_header\n"
        return pa.array([head.format(b - a).encode() + body[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())

    parts = F.flatten(F.transform("o", lambda o: F.concat(F.array_repeat(o["k"] * 2, 4), F.array_repeat(o["k"] * 2 + 1, 4))))
    group = lambda o, id: F.struct(id.alias("objectId"), o["caption"].alias("label"), F.array(o["k"] * 2, o["k"] * 2 + 1).alias("segments"))
    twice = F.transform(F.filter("o", lambda o: o["k"] % 5 == 0), lambda o: group(o, o["k"] + 10_000))
    groups = F.concat(F.transform("o", lambda o: group(o, o["k"])), twice)
    at = lambda name: F.concat(F.col("cloud").cast("string"), F.lit(f"/scan{name}")).alias("name")
    path = K.shared_folder(spark, "scans")
    K.write_documents(held.select(at("_clean_2.ply"), ply("o").alias("content")), path)
    K.write_documents(held.select(at(".segs.json"), F.to_json(F.struct(parts.alias("segIndices"))).alias("content")), path)
    K.write_documents(held.select(at(".aggregation.json"), F.to_json(F.struct(groups.alias("segGroups"))).alias("content")), path)
    found = V.object_boxes(spark, path, 200)
    box = F.col("box")
    return found.select("scan", "object_id", "label", "points", F.round(box[0] - box[3] / 2, 5).alias("low_x"), F.round(box[2] + box[5] / 2, 5).alias("high_z"), F.round(box[4], 5).alias("width"))
