"""Work that many rows share is done once, and what is made inside a row doesn't travel."""

from pyspark.sql import functions as F

from scenova.plans import ranking, samples, spans, texts
from tests.test_bound import plan

SF = "/root/testdata/sf0.001"


def test_sentences_are_counted_before_they_are_parsed(spark):
    assert plan(texts.triple_grammar(spark, SF)).count("Aggregate") == 2  # sentences, then their triples


def test_captions_are_searched_once(spark):
    held = plan(samples.lateral_mentions(spark, SF))
    below = held[held.index("mentions_of") :] if "mentions_of" in held else held[held.index("UDTF") :]
    assert "Aggregate [said" in below


def test_pairs_of_small_scenes_are_made_in_their_row(spark):
    rows = [(s, f"{s}-{i}") for s, n in ((1, 7), (2, 1), (3, 5), (4, 9)) for i in range(n)] + [(3, "3-0")]
    objs = spark.createDataFrame(rows, "scene_id long, object_id string").repartition(3)
    told = lambda df: sorted(map(tuple, df.collect()))
    small = ranking.first_pairs(objs, 30)
    assert "Join" not in plan(small)
    assert told(small) == told(ranking.first_pairs(objs, 30, whole=4)) and len(told(small)) == 30 + 28 + 30


def test_powers_are_taken_once_a_candidate(spark):
    df = spark.createDataFrame([([0, 0, 1], [1.0, 2.0, 5.0])], "s array<int>, v array<double>")
    rows = df.select(spans.span_scores(F.col("s"), F.transform("v", F.exp)).alias("r"))
    assert plan(rows).lower().count("exp(") == 1
    e = [2.718281828459045**v for v in (1, 2, 5)]
    assert [(x["target"], x["score"]) for x in rows.first()["r"]] == [(0, round((e[0] + e[1]) / sum(e) / 2, 9)), (1, round(e[2] / sum(e), 9))]
