"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scenova.llm import jaccard, mixing, nearest, packing, quality, rules, sharding, substrings, token_counts, toxicity

CLASH = ["size", "shard", "score", "kept", "copy", "piece", "length", "n_tokens", "n_words", "c", "path", "id", "key", "rate", "count", "start"]
CLASH += ["_i", "_k", "_kept_id", "_kept_key", "_before", "_spans", "_copy", "_was_kept", "_was_tail_prob", "expected_grade", "tail_prob", "repeated_spans", "number", "n", "digest", "place", "mass"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards watch from the old stone tower near the river bank and count passing boats slowly"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    odd = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, "   \n\t ", None, None, 5),
        (None, PROSE, "en", "a", 140),
        (None, PROSE, "en", "a", 140),
        (None, None, None, None, None),
        (4, PROSE, "en", "b", 140),
        (4, PROSE, "en", "b", 140),
        (5, PROSE + " extra words here", "en", "b", 150),
        (6, "long " * 60_000, "de", "c", 300_000),
        (7, "naïve ünïcode 日本語 👍 <|endoftext|> don't", "fr", "a", 40),
        (8, "one two", "fr", "a", 7),
        (4, "another text with the same id as others", "es", "d", 39),
    ]
    return table(spark, odd).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 0, 1), (2, None, None), (4, 1, 0), (5, 1, 0), (6, 0, 1), (7, 1, None), (None, 0, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def empty(docs):
    return docs.where("false")


def test_quality(docs, labels):
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == 13 and all(0 <= r["tail_prob"] <= 1 for r in rows)
    assert quality.score_quality(empty(docs), model).count() == 0
    none = quality.fit_quality(docs, labels.where("false"))
    assert all(r["kept"] for r in quality.score_quality(docs, none).collect())


def test_substrings(docs):
    out = substrings.drop_repeated_passages(docs)
    assert out.count() == 13 and out.columns == docs.columns
    assert substrings.drop_repeated_passages(empty(docs)).count() == 0
    nulls = out.where("text is null").count()
    assert nulls == 2


def test_sharding(docs):
    rows = sharding.shard_rows(docs, shards=4).collect()
    sizes = sorted(sum(r["shard"] == s for r in rows) for s in range(4))
    assert len(rows) == 13 and sizes[-1] - sizes[0] <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert sharding.shard_rows(empty(docs)).count() == 0


def test_sharding_of_one_id(spark):
    rows = [(7, "the same row")] * 5000 + [(7, f"text {i}") for i in range(2000)] + [(i, f"text {i}") for i in range(100, 1100)]
    held = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for most in (300, 10_000):
        found = sharding.shard_rows(held, shards=4, most_in_cell=most).collect()
        assert len(found) == 8000 and sorted(r["doc_id"] for r in found) == sorted(i for i, _ in rows)
        for s in range(4):
            assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(2000))


def test_packing(docs):
    rows = packing.pack(docs, path=public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r["piece"] == 0 for r in rows) == 13
    assert packing.pack(empty(docs), path=public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_tokens(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_counts.token_counts(docs, path, 1024).collect()
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)] == [0, 0] and len(rows) == 13
    assert token_counts.token_counts(empty(docs), path, 1024).count() == 0


def test_jaccard(docs):
    rows = jaccard.similar_groups(docs).collect()
    assert len(rows) == 13
    prose = [r for r in rows if r["id"] in (4, 5) and r["n_links"] > 0]
    assert {r["class_id"] for r in prose} == {4} and all(r["n_links"] == 4 for r in prose)
    assert all(r["n_links"] == 0 for r in rows if r["id"] in (1, 2, 3, 6, 7, 8))
    assert jaccard.similar_groups(empty(docs)).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.where(F.col("text").startswith("The quick")).count() == 1 and kept.count() == 13 - 4
    assert jaccard.keep_one(empty(docs)).count() == 0


def test_rules(docs):
    rows = rules.quality_rules(docs).collect()
    assert len(rows) == 13 and all(not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 8))
    assert rules.quality_rules(empty(docs)).count() == 0


def test_mixing(docs):
    out = mixing.mix(docs, budget=3.0)
    rows = out.collect()
    assert out.columns == docs.columns and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
    assert mixing.mix(empty(docs)).count() == 0
    assert mixing.mix(docs, weights={"b": 1.0, None: 0.0}).where("source <> 'b' or source is null").count() == 0


def test_toxicity(docs, labels):
    net = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, net).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(empty(docs), net).count() == 0
    flat = toxicity.fit_toxicity(docs, labels.where("false"))
    assert {r["score"] for r in toxicity.score_toxicity(docs, flat).collect()} == {0.0}


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (20, None, "x"), (40, [0.0, 0.0], "x"), (60, [nan, 1.0], "x"), (80, [inf, 1.0], "x"), (1, [1.0, 0.0], "x"), (2, [1.0, 0.0], "x"), (3, [None, 1.0], "x"), (4, [1.0, 2.0, 3.0], "x"), (100, [], "x"), (None, [1.0, 1.0], "x"), (5, [-1.0, 1e-30], "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    out = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.nearest(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 5, -1.0)]
    assert nearest.nearest(vectors.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("blocks", [2, 8192])
def test_nearest_with_repeated_rows(spark, blocks):
    rows = [(0, [1.0, 0.0])] * 3 + [(0, [0.0, 2.0])] + [(7, [1.0, 0.0])] * 30 + [(8, [0.5, 0.5]), (20, [0.0, 1.0]), (20, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest.nearest(vectors, F.col("vec_id") % 20 == 0, candidate_block=blocks, query_block=blocks, fan=2).collect()
    want = []
    for q, x in sorted({(q, tuple(x)) for q, x in rows if q % 20 == 0}):
        rest = list(rows)
        rest.remove((q, list(x)))
        scored = sorted(((-(x[0] * y[0] + x[1] * y[1]), i) for i, y in rest))[:20]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, found)) == sorted(want)


def test_nearest_long_vectors(spark):
    vectors = spark.range(45).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda j: F.sin(F.col("id") * j)).alias("embedding"))
    held = {r["vec_id"]: r["embedding"] for r in vectors.collect()}
    rows = nearest.nearest(vectors, F.col("vec_id") % 20 == 0).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for q in (0, 20, 40):
        found = {r["rank"]: r["vec_id"] for r in rows if r["query_id"] == q}
        if q:
            assert [found[k] for k in range(1, 21)] == sorted((i for i in held if i not in (q, 0)), key=lambda i: -dot(held[q], held[i]))[:20]
        else:
            assert not found  # a zero vector takes no part


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages(spark, docs, labels, tmp_path, name, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    out.write.parquet(str(tmp_path / "out"))
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.count() and {tuple(r) for r in kept.select(*CLASH).collect()} == {("x",) * len(CLASH)}
    assert stage(spark, empty(docs), str(tmp_path)).count() == 0


def test_mixing_of_repeated_rows_and_large_means(spark, docs):
    rows = [(1, "same text", "a")] * 40 + [(i, "x" * 100_000, "b") for i in range(2, 12)]
    held = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(held, weights={"a": 1.0, "b": 1.0}).collect()
    copies = [r["copy"] for r in out if r["source"] == "a"]
    # Each of the equal rows draws its own count, near their rate of 500,000 characters to 360.
    first = copies.count(0)
    assert first == 40 and abs(len(copies) / 40 - 500_180 / 360) < 40 and 0 < sum(c == max(copies) for c in copies) < 40


def test_repeated_rows_are_dealt_all_over(spark, monkeypatch):
    rows = [(5, "the same row", "a")] * 3000 + [(i, f"another row {i}", "a") for i in range(100, 3100)]
    held = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    results = []
    for sent in (200_000, 0):
        monkeypatch.setattr(mixing, "SENT_REPEATS", sent)
        out = mixing.mix(held.repartition(3 + len(results)), flatten=1.0).withColumn("task", F.spark_partition_id()).collect()
        results.append(sorted((r["doc_id"], r["text"], r["copy"]) for r in out))
        runs, run = [], 0
        for r in out:
            run = run + 1 if r["doc_id"] == 5 else 0
            runs.append(run)
        tasks = [sum(r["task"] == t and r["doc_id"] == 5 for r in out) for t in {r["task"] for r in out}]
        # Half of all rows: a run of 30 has a chance of 6,000 to 2**30.
        assert max(runs) < 30 and max(tasks) < 2 * sum(tasks) / len(tasks) and abs(sum(tasks) - 3000) < 300
    assert results[0] == results[1]


def test_last_stage(spark, docs, tmp_path):
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, str(tmp_path)).where("piece = 0").count() == 13
