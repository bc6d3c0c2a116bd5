"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenova.llm import twins


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    # Python workers of a session that was started elsewhere find this package too.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenova.llm.quality import fit_quality, score_quality

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", "expected_grade", "tail_prob", "kept")


def op2_content_defined_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenova.llm.substrings import drop_repeated_passages

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = drop_repeated_passages(docs)
    removed = F.aggregate("repeated_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "repeated_spans", removed.alias("removed_bytes"), "text")


def op3_consistent_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenova.llm.sharding import shard_rows

    return shard_rows(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenova.llm.packing import pack

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, path=public_tokenizers.path("word_bpe_49k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenova.llm.token_counts import token_counts

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenova.llm.jaccard import similar_groups

    groups = similar_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op7_robust_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenova.llm.rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents"))


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenova.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))


def op9_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenova.llm.toxicity import fit_toxicity, score_toxicity

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, net).select("doc_id", "held_out", "score", "predicted")


def op10_block_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenova.llm.nearest import nearest

    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenova.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenova.llm.conversations import repair

    return repair(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenova.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), label=label, is_anchor=F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_content_defined_dedup": op2_content_defined_dedup,
    "op3_consistent_hash_sharding": op3_consistent_hash_sharding,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_token_counts": op5_token_counts,
    "op6_chosen_path_join": op6_chosen_path_join,
    "op7_robust_quality_rules": op7_robust_quality_rules,
    "op8_poisson_mixing": op8_poisson_mixing,
    "op9_recurrent_toxicity": op9_recurrent_toxicity,
    "op10_block_nearest": op10_block_nearest,
    "op11_piecewise_fingerprints": op11_piecewise_fingerprints,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op10_block_nearest": """
        WITH held AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
        ), met AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
            FROM held q JOIN held c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM met)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op12_conversation_repair": twins.CONVERSATION_REPAIR,
    "op13_hard_negatives": twins.HARD_NEGATIVES,
}
