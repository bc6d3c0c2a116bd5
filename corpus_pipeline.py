"""A training corpus from raw documents: reject, deduplicate, mix and pack.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all
but the last return the columns of ``docs``. Rows that a stage drops: the
quality classifier those it rejects; the near-copy stage all but one of each
group; substring dedup those whose text, not blank before, is repeated
throughout and so blank after; mixing those whose drawn count is 0.

Nulls, empty and very long texts, ties and repeated rows are treated as the
operators' modules say: null and empty texts are scored as they are, are near
copies of nothing, hold no passages, weigh one character in the mix and pack as
an end id. Other columns stay, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenova.llm import jaccard, mixing, packing, quality, substrings
from scenova.llm.common import fresh
from scenova.llm.queries import read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"))
    own = {c: fresh(c) for c in docs.columns if c.lower() in ("expected_grade", "tail_prob", "kept")}
    scored = quality.score_quality(docs.withColumns({name: F.col(c) for c, name in own.items()}), model)
    return scored.where("kept").select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before, spans = fresh("before"), fresh("spans")
    rest = substrings.drop_repeated_passages(docs.withColumn(before, F.length(F.col("text"))), spans=spans)
    blank = F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")) == ""
    emptied = F.coalesce(blank & (F.length("text") < F.col(before)), F.lit(False))
    kept = rest.where(~emptied)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.length("text") < F.col(before), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, copy=fresh("copy")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, path=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("substring dedup", substring_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL for a trained classifier and seeded hashes; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
