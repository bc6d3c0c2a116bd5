"""Values that an expression names many times are computed once a row."""

import contextlib
import io
import time

from pyspark.sql import functions as F

from scenova.functions import text as T
from scenova.plans.audits import hashed_grams


def plan(df) -> str:
    held = io.StringIO()
    with contextlib.redirect_stdout(held):
        df.explain("extended")
    return held.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_words_of_a_clause_are_cut_once(spark):
    df = spark.createDataFrame([("a red car near a big white ",), ("it is on the ",), ("",), (None,)], "clause string")
    rows = df.select(T.introduced(F.col("clause")).alias("ok"))
    assert plan(rows).count("regexp_replace(") == 1
    assert [r["ok"] for r in rows.collect()] == [True, False, False, None]


def test_long_texts_are_split_once_for_their_grams(spark):
    df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: i.cast("string")), " ").alias("t"))
    began = time.time()
    assert df.select(F.size(hashed_grams(F.split("t", " "), [5])).alias("n")).first()["n"] == 19_996
    assert time.time() - began < 20  # a split for each gram: minutes
    short = spark.createDataFrame([("a b",), ("a b a b",), (None,)], "t string").select(F.size(hashed_grams(F.split("t", " "), [2, 3])).alias("n"))
    assert [r["n"] for r in short.collect()][:2] == [1, 4]
