"""Caption and answer text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenova.functions import text as T
from scenova.functions.ids import refs, stable_id
from scenova.plans.base import query
from scenova.sources.scenes import objects, table

VIEW_SQL = "CASE split_part(frame, '_', 2) WHEN '0' THEN 'front view' WHEN '1' THEN 'front-left view' WHEN '2' THEN 'front-right view' WHEN '3' THEN 'side-left view' WHEN '4' THEN 'side-right view' ELSE 'camera view' END"


def turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT conv_id, turn, trim(regexp_replace(replace(text, ',', ' ,'), '\\s+', ' ', 'g')) AS norm, length(' ' || trim(regexp_replace(replace(text, ',', ' ,'), '\\s+', ' ', 'g')) || ' ') AS padded FROM conversations")
def normalize_caption(spark, sf_dir) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", T.normalize_caption(F.col("text")).alias("norm"), F.length(T.format_caption(F.col("text"))).cast("long").alias("padded"))


SUMMED_SQL = "CASE category WHEN 0 THEN caption || '. Summary: a ' || split_part(caption, ' ', 2) || ' ' WHEN 1 THEN 'Summary: one Summary:  ' || caption WHEN 2 THEN caption || ' Summary:' ELSE ' ' || caption END"


@query(f"SELECT object_id, platform, CASE WHEN platform IN ('platform1', 'platform2') THEN trim(string_split(said, 'Summary:')[-1]) ELSE said END AS utterance FROM (SELECT object_id, platform, {SUMMED_SQL} AS said FROM objects)", heads="o")
def summary_utterances(spark, sf_dir) -> DataFrame:
    """What follows the last summary mark on two platforms; the third one's texts stay as they are."""
    rows = objects(spark, sf_dir).select("object_id", "platform", F.expr(SUMMED_SQL).alias("said"))
    return rows.select("object_id", "platform", T.platform_utterance(F.col("said"), F.col("platform"), ["platform1", "platform2"]).alias("utterance"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, replace(regexp_replace('part ,' || l_partkey || ' . not mentioned', ' \\. not mentioned$', ''), ' ,', ',') AS clean FROM lineitem")
def clean_utterance(spark, sf_dir) -> DataFrame:
    said = F.concat(F.lit("part ,"), F.col("l_partkey").cast("string"), F.lit(" . not mentioned"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), T.clean_utterance(said).alias("clean"))


@query(f"SELECT frame, {VIEW_SQL} AS view, CASE split_part(frame, '_', 2) WHEN '0' THEN 0 WHEN '1' THEN -45 WHEN '2' THEN 45 WHEN '3' THEN -90 WHEN '4' THEN 90 END AS degrees, count(*) AS n FROM (SELECT o_orderkey % 50 || '_' || o_orderkey % 6 AS frame FROM orders) GROUP BY ALL")
def frame_views(spark, sf_dir) -> DataFrame:
    frame = F.concat((F.col("o_orderkey") % 50).cast("string"), F.lit("_"), (F.col("o_orderkey") % 6).cast("string"))
    rows = table(spark, sf_dir, "orders").select(frame.alias("frame"))
    return rows.groupBy("frame", T.view_of(F.col("frame")).alias("view"), T.view_degrees(F.col("frame")).alias("degrees")).agg(F.count("*").alias("n"))


CAPTION_SQL = "'This is ' || caption || CASE category WHEN 0 THEN ' located near the gate' WHEN 1 THEN ', positioned left' WHEN 2 THEN ' is walking on the road' WHEN 3 THEN '. It stands still.' WHEN 4 THEN ' with a red roof' ELSE '' END"


def captions(spark, sf_dir) -> DataFrame:
    """Captions with a location phrase after the name."""
    tail = F.when(F.col("category") == 0, " located near the gate").when(F.col("category") == 1, ", positioned left").when(F.col("category") == 2, " is walking on the road").when(F.col("category") == 3, ". It stands still.").when(F.col("category") == 4, " with a red roof").otherwise("")
    return objects(spark, sf_dir).withColumn("said", F.concat(F.lit("This is "), F.col("caption"), tail))


@query(f"SELECT said, CASE WHEN category = 0 THEN caption WHEN category = 1 THEN caption WHEN category IN (2, 3) THEN caption WHEN category = 4 THEN caption || ' with a red roof' ELSE caption END AS short, count(*) AS n FROM (SELECT *, {CAPTION_SQL} AS said FROM objects) GROUP BY ALL", heads="o")
def short_expression(spark, sf_dir) -> DataFrame:
    rows = captions(spark, sf_dir).select("said", T.short_expression(F.col("said")).alias("short"))
    return rows.groupBy("said", "short").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN length(caption) < 8 THEN 'too_short' WHEN regexp_matches(caption, '(?i)\\b(?:left|right|front|behind|back|ahead|rear|near|far|side|center|middle|edge|view|image)\\b') THEN 'spatial_cue' ELSE 'accepted' END AS reason, count(*) AS n FROM objects GROUP BY ALL", heads="o")
def neutral_gate(spark, sf_dir) -> DataFrame:
    """Which captions can be used as neutral phrases, and why the others can't."""
    return objects(spark, sf_dir).groupBy(T.neutral_phrase(F.col("caption"))["reason"].alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, lower(substr(text, 1, 1)) || substr(text, 2) AS folded FROM conversations WHERE starts_with(text, 'The ') OR starts_with(text, 'A ') OR starts_with(text, 'An ')")
def question_form(spark, sf_dir) -> DataFrame:
    rows = turns(spark, sf_dir).where(F.col("text").startswith("The ") | F.col("text").startswith("A ") | F.col("text").startswith("An "))
    return rows.select("conv_id", "turn", T.question_form(F.col("text")).alias("folded"))


@query("SELECT upper(substr(t, 1, 1)) || substr(t, 2) AS sentence, replace(t, ' in the front-left view', '') AS plain, count(*) AS n FROM (SELECT 'the ' || caption || ' in the front-left view' AS t FROM objects) GROUP BY ALL", heads="o")
def view_phrases(spark, sf_dir) -> DataFrame:
    """Entity phrases, capitalised, and with the view taken out."""
    t = T.entity(F.col("caption"), F.lit("front-left view"))
    return objects(spark, sf_dir).groupBy(T.capital(t).alias("sentence"), T.without_views(t).alias("plain")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '\\bthe\\b')) AS the_n, regexp_matches(text, '(?i)\\band\\b') AS has_and FROM documents WHERE lang = 'en'")
def word_counts(spark, sf_dir) -> DataFrame:
    """Whole-word counts and mentions."""
    the = F.regexp_count(F.lower("text"), F.lit(r"(?<![a-z0-9_])the(?![a-z0-9_])"))
    has = F.rlike("text", F.lit(r"(?i)(?<![a-z0-9_])and(?![a-z0-9_])"))
    return docs(spark, sf_dir).where("lang = 'en'").select("doc_id", the.cast("long").alias("the_n"), has.alias("has_and"))


ANSWERS_SQL = """answers AS (SELECT a_id || '|' || b_id AS qa_id, a_id, b_id, dx, dy,
    'It is to the ' || CASE WHEN dy > 0 THEN 'left' ELSE 'right' END || ' and ' || CASE WHEN dx > 0 THEN 'in front of' ELSE 'behind' END || ' the reference object, ' || CAST(abs(CAST(dx AS INTEGER)) AS VARCHAR) || ' meters away.' AS said FROM pairs)"""


def answers(spark, sf_dir) -> DataFrame:
    """A sentence for each ordered pair."""
    from scenova.plans.generators import directed

    met = directed(spark, sf_dir)
    said = F.concat(F.lit("It is "), T.direction_phrase(F.array(F.when(F.col("dy") > 0, "left").otherwise("right"), F.when(F.col("dx") > 0, "front").otherwise("behind"))), F.lit(", "), F.abs(F.bround("dx", 0).cast("int")).cast("string"), F.lit(" meters away."))
    return met.withColumn("said", said).withColumn("qa_id", F.concat_ws("|", "a_id", "b_id"))


@query("SELECT CASE WHEN dy > 0 THEN 'left' ELSE 'right' END AS lateral, CASE WHEN dx > 0 THEN 'front' ELSE 'behind' END AS longitudinal, CAST(abs(CAST(dx AS INTEGER)) AS DOUBLE) AS distance, true AS format_ok, count(*) AS n FROM pairs GROUP BY ALL", heads="p")
def parse_answer(spark, sf_dir) -> DataFrame:
    """Sentences made from geometry and read back."""
    return answers(spark, sf_dir).select(T.parse_answer(F.col("said")).alias("p")).groupBy("p.lateral", "p.longitudinal", "p.distance", "p.format_ok").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, right(trim(text), 1) IN ('.', '!', '?') AND len(regexp_extract_all(text, '[.!?]')) = 1 AS one FROM conversations WHERE NOT regexp_matches(text, '[0-9]\\.[0-9]')")
def one_sentence(spark, sf_dir) -> DataFrame:
    rows = turns(spark, sf_dir).where(~F.rlike("text", F.lit(r"[0-9]\.[0-9]")))
    return rows.select("conv_id", "turn", T.one_sentence(F.col("text")).alias("one"))


@query("SELECT relation, inverse, count(*) AS n FROM (SELECT lat || '_' || lon AS relation, CASE lat WHEN 'left' THEN 'right' ELSE 'left' END || '_' || CASE lon WHEN 'front' THEN 'behind' ELSE 'front' END AS inverse FROM (SELECT CASE WHEN dy > 0 THEN 'left' ELSE 'right' END AS lat, CASE WHEN dx > 0 THEN 'front' ELSE 'behind' END AS lon FROM pairs)) GROUP BY ALL", heads="p")
def inverse_consistency(spark, sf_dir) -> DataFrame:
    from scenova.functions.geometry import inverse_relation
    from scenova.plans.generators import directed

    relation = F.concat_ws("_", F.when(F.col("dy") > 0, "left").otherwise("right"), F.when(F.col("dx") > 0, "front").otherwise("behind"))
    return directed(spark, sf_dir).select(relation.alias("relation")).groupBy("relation", inverse_relation(F.col("relation")).alias("inverse")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS plain, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[0-9]+)?'), ' ') AS decimal FROM documents")
def normalizers(spark, sf_dir) -> DataFrame:
    """The two text normalisers of the evaluators."""
    return docs(spark, sf_dir).select("doc_id", T.norm_plain(F.col("text")).alias("plain"), T.norm_decimal(F.col("text")).alias("decimal"))


@query("SELECT conv_id, turn, CASE WHEN len(w) = 1 THEN CASE w[1] WHEN 'back' THEN 'behind' ELSE w[1] END END AS word FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '\\b(left|right|front|behind|back)\\b')) AS w FROM conversations)")
def relation_words(spark, sf_dir) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", T.only_relation_word(F.col("text")).alias("word"))


@query("SELECT scene_id, string_agg(chr(CAST(65 + i AS INTEGER)) || ':' || object_id, ' ' ORDER BY i) AS refs FROM (SELECT scene_id, object_id, row_number() OVER (PARTITION BY scene_id ORDER BY object_id) - 1 AS i FROM objects) GROUP BY scene_id", heads="o")
def public_refs(spark, sf_dir) -> DataFrame:
    """Parallel arrays zipped to structs with roles by place."""
    rows = objects(spark, sf_dir).groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("object_id", "caption"))).alias("o"))
    made = rows.select("scene_id", refs(F.col("o.object_id"), F.col("o.caption")).alias("r"))
    return made.select("scene_id", F.array_join(F.transform("r", lambda x: F.concat(x["role"], F.lit(":"), x["object_id"])), " ").alias("refs"))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<a href=')) AS links, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS bare FROM pages")
def markup_fields(spark, sf_dir) -> DataFrame:
    """Regex extraction, counting and removal over markup."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("bare"))


@query("SELECT caption, CAST(instr(' ' || caption || ' ', ' ' || split_part(caption, ' ', 2) || ' ') AS INTEGER) AS start, split_part(caption, ' ', 2) AS word, count(*) AS n FROM objects GROUP BY ALL", heads="o")
def target_noun(spark, sf_dir) -> DataFrame:
    """The earliest of some nouns in a caption, with its place."""
    words = F.split("caption", " ")
    noun = T.first_noun(F.col("caption"), F.slice(words, 2, 1))
    return objects(spark, sf_dir).select("caption", noun["start"].alias("start"), noun["word"].alias("word")).groupBy("caption", "start", "word").agg(F.count("*").alias("n"))


@query()
def mention_spans(spark, sf_dir) -> DataFrame:
    """All non-overlapping mentions of a caption's own words in it: offsets need a Python helper."""
    rows = objects(spark, sf_dir).select("object_id", "caption", T.category_mentions(F.col("caption"), F.split("caption", " ")).alias("m"))
    return rows.select("object_id", F.explode("m").alias("m")).select("object_id", "m.*")


@query("SELECT object_id, format('{:.1f}', y) AS said FROM objects", heads="o")
def half_even_numbers(spark, sf_dir) -> DataFrame:
    """One-decimal numbers by their exact binary value."""
    rows = objects(spark, sf_dir)
    return rows.select("object_id", T.half_even(F.col("y")).alias("said"))


@query("SELECT 'A ' || CASE WHEN dx > 0 THEN 'front' ELSE 'behind' END || ' B; B ' || CASE WHEN dy > 0 THEN 'right' ELSE 'left' END || ' A' AS triples, count(*) AS n FROM pairs GROUP BY ALL", heads="p")
def triple_grammar(spark, sf_dir) -> DataFrame:
    """Relations of the canonical grammar, read back from made sentences; the SQL twin has what the sentences say."""
    from scenova.plans.generators import directed

    said = F.concat(F.lit("Object A is "), F.when(F.col("dx") > 0, "in front of").otherwise("behind"), F.lit(" Object B and Object B is to the "), F.when(F.col("dy") > 0, "right").otherwise("left"), F.lit(" of Object A."))
    # A sentence that many pairs say is parsed once.
    sentences = directed(spark, sf_dir).groupBy(said.alias("said")).agg(F.count("*").alias("n"))
    return sentences.groupBy(F.array_join(T.extract_triples(F.col("said")), "; ").alias("triples")).agg(F.sum("n").alias("n"))


@query("SELECT substr(sha1(conv_id || '|' || turn || '|' || role), 1, 16) AS id FROM conversations")
def turn_ids(spark, sf_dir) -> DataFrame:
    return turns(spark, sf_dir).select(stable_id(F.col("conv_id"), F.col("turn"), F.col("role")).alias("id"))
