"""Leakage and provenance audits: rule tables whose violations must be 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenova.functions.text import bound
from scenova.plans.base import query
from scenova.plans.generators import directed
from scenova.sources.scenes import objects, table


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations, n): how many rows break each rule, counted in one pass."""
    held = rows.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(broken, F.lit(False))).alias(name) for name, broken in rules.items()])
    return held.unpivot(["n"], list(rules), "rule", "violations").select("rule", "violations", "n")


def demand(report: DataFrame) -> DataFrame:
    """The report, failing the job where a rule is broken."""
    broken = F.col("violations") > 0
    return report.withColumn("violations", F.when(broken, F.raise_error(F.concat(F.lit("broken rule: "), F.col("rule")))).otherwise(F.col("violations")))


@query("SELECT unnest(['alias', 'choice', 'coordinate', 'question_mark']) AS rule, unnest([count(*) FILTER (WHERE regexp_matches(text, '(?i)\\bobject [a-e]\\b')), count(*) FILTER (WHERE regexp_matches(text, '\\b[A-D]\\)')), count(*) FILTER (WHERE regexp_matches(text, '\\(-?[0-9.]+, *-?[0-9.]+\\)')), count(*) FILTER (WHERE role = 'assistant' AND contains(text, '?'))]) AS violations, count(*) AS n FROM conversations")
def audit_violations(spark, sf_dir) -> DataFrame:
    """Aliases, multiple choice, coordinate pairs and questions in answers."""
    t = F.col("text")
    return violations(
        table(spark, sf_dir, "conversations"),
        {
            "alias": F.rlike(t, F.lit(r"(?i)\bobject [a-e]\b")),
            "choice": F.rlike(t, F.lit(r"\b[A-D]\)")),
            "coordinate": F.rlike(t, F.lit(r"\(-?[0-9.]+, *-?[0-9.]+\)")),
            "question_mark": (F.col("role") == "assistant") & t.contains("?"),
        },
    )


@query("SELECT unnest(['empty_id', 'crossing_scene', 'same_object', 'unknown_split']) AS rule, unnest([count(*) FILTER (WHERE a_id = '' OR b_id = ''), count(*) FILTER (WHERE splits > 1), count(*) FILTER (WHERE a_id = b_id), count(*) FILTER (WHERE split NOT IN ('train', 'val', 'test'))]) AS violations, count(*) AS n FROM (SELECT scene_id, a_id, b_id, count(DISTINCT split) AS splits, min(split) AS split FROM pairs GROUP BY ALL)", heads="p")
def strict_audit(spark, sf_dir) -> DataFrame:
    """Rules that must hold; a broken one ends the job."""
    rows = directed(spark, sf_dir).groupBy("scene_id", "a_id", "b_id").agg(F.countDistinct("split").alias("splits"), F.min("split").alias("split"))
    rules = {"empty_id": (F.col("a_id") == "") | (F.col("b_id") == ""), "crossing_scene": F.col("splits") > 1, "same_object": F.col("a_id") == F.col("b_id"), "unknown_split": ~F.col("split").isin("train", "val", "test")}
    return demand(violations(rows, rules))


#: Up to so many hashed grams of passages go to every task as one array; beyond that texts' grams are shuffled.
SENT_GRAMS = 20_000


def hashed_grams(words: Column, widths: list[int]) -> Column:
    """Distinct hashes of all runs of so many words."""
    none = F.array().cast("array<bigint>")

    def told(held: Column) -> Column:
        runs = lambda n: F.transform(F.sequence(F.lit(1), F.size(held) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(held, i, n), " ")))
        return F.array_distinct(F.flatten(F.array(none, *[F.when(F.size(held) >= n, runs(n)).otherwise(none) for n in widths])))

    return bound(words, told)


def passages_held(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """(item_id, doc_id) of texts (doc_id, text) that hold a passage (item_id, passage) whole.

    Candidates meet on up to five words from inside the passage (its edge words
    may be part of longer ones) by their hash; then the whole passage is looked
    for in the same row, so no text travels. Passages of one or two words have
    none inside: those few are sent whole.
    """
    words = F.split("passage", " ")
    inner = F.size(words) - 2
    width = F.least(F.lit(5), inner)
    passages = passages.withColumns({"width": width, "gram": F.when(inner > 0, F.xxhash64(F.array_join(F.slice(words, F.floor((inner - width) / 2).cast("int") + 2, width), " ")))})
    long = passages.where("width > 0").select("item_id", "gram", "passage")
    widths = [r["width"] for r in passages.where("width > 0").select("width").distinct().collect()]  # five numbers at most
    told = texts.withColumn("grams", hashed_grams(F.split("text", " "), widths))
    if long.limit(SENT_GRAMS + 1).count() <= SENT_GRAMS:
        known = long.agg(F.collect_set("gram").alias("known"))  # one row of SENT_GRAMS numbers at most
        hits = told.join(F.broadcast(known)).withColumn("grams", F.array_intersect("grams", "known")).where(F.size("grams") > 0)
        met = hits.withColumn("gram", F.explode("grams")).join(F.broadcast(long), "gram")
    else:
        found = told.select("doc_id", F.explode("grams").alias("gram")).join(long, "gram")
        met = found.select("doc_id", "item_id", "passage").join(texts, "doc_id")
    short = texts.join(F.broadcast(passages.where("width <= 0").select("item_id", "passage")), F.contains("text", "passage")).select("item_id", "doc_id")
    return met.where(F.contains("text", "passage")).select("item_id", "doc_id").unionByName(short)


@query("SELECT b.item_id, count(*) AS docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def benchmark_leaks(spark, sf_dir) -> DataFrame:
    """Documents that hold a benchmark passage whole."""
    passages = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    held = passages_held(table(spark, sf_dir, "documents").select("doc_id", "text"), passages)
    return held.groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"))


@query("SELECT leaked, count(*) AS n FROM (SELECT contains(lower('Where is the ' || a_caption || '?'), lower(b_caption)) AS leaked FROM pairs) GROUP BY leaked", heads="p")
def leak_flags(spark, sf_dir) -> DataFrame:
    """Questions that hold the other object's caption."""
    question = F.lower(F.concat(F.lit("Where is the "), F.col("a_caption"), F.lit("?")))
    return directed(spark, sf_dir).groupBy(F.contains(question, F.lower("b_caption")).alias("leaked")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey IS NULL) AS orphans FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def reference_check(spark, sf_dir) -> DataFrame:
    """Rows whose reference is missing."""
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return met.agg(F.count("*").alias("n"), F.count_if(F.col("p_partkey").isNull()).alias("orphans"))


@query("SELECT platform, count(*) AS n, count(DISTINCT scene_id) AS scenes, round(quantile_cont(sqrt(x * x + y * y), 0.95), 4) AS radius_95, round(min(z), 6) AS low, round(max(z), 6) AS high, round(count(*) FILTER (WHERE score IS NULL) / count(*), 6) AS missing FROM objects GROUP BY platform", heads="o")
def raw_profile(spark, sf_dir) -> DataFrame:
    """Profile of the raw objects by platform: counts, extents, radius percentile, missing values."""
    return objects(spark, sf_dir).groupBy("platform").agg(F.count("*").alias("n"), F.countDistinct("scene_id").alias("scenes"), F.round(F.expr("percentile(sqrt(x * x + y * y), 0.95)"), 4).alias("radius_95"), F.round(F.min("z"), 6).alias("low"), F.round(F.max("z"), 6).alias("high"), F.round(F.count_if(F.col("score").isNull()) / F.count("*"), 6).alias("missing"))


@query("SELECT sum(raw)::BIGINT AS raw, sum(with_caption)::BIGINT AS with_caption, sum(multi)::BIGINT AS multi, sum(distinct_captions)::BIGINT AS distinct_captions FROM (SELECT 1 AS raw, CASE WHEN min(length(caption)) >= 8 THEN 1 ELSE 0 END AS with_caption, CASE WHEN count(*) >= 2 THEN 1 ELSE 0 END AS multi, CASE WHEN count(*) >= 2 AND count(DISTINCT caption) = count(*) THEN 1 ELSE 0 END AS distinct_captions FROM objects GROUP BY scene_id)", heads="o")
def acceptance_funnel(spark, sf_dir) -> DataFrame:
    """How many scenes pass each stage of acceptance."""
    per = objects(spark, sf_dir).groupBy("scene_id").agg((F.min(F.length("caption")) >= 8).alias("a"), (F.count("*") >= 2).alias("b"), ((F.count("*") >= 2) & (F.countDistinct("caption") == F.count("*"))).alias("c"))
    return per.agg(F.count("*").alias("raw"), F.count_if("a").alias("with_caption"), F.count_if("b").alias("multi"), F.count_if("c").alias("distinct_captions"))
