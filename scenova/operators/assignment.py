"""One-to-one assignment of a few targets to many candidates, by columns alone.

An optimal assignment of n targets needs the n best candidates of each: others
block n - 1 of them at most, and whoever holds a worse one can change to the
best that is free. So the candidates are ranked by a window, and what is left,
n lists of n, is enumerated inside one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenova.functions.text import bound


def ranked(scores: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``scores`` (keys, target, candidate, score) with their rank from 0, up to ``most``; ties go to the smaller candidate."""
    order = Window.partitionBy(*keys, "target").orderBy(F.desc("score"), "candidate")
    return scores.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < most)


def best_distinct(lists: Column) -> Column:
    """Candidates of largest total score, one for each list of (score, candidate) structs, best first, and no two alike; of equal totals the least by place."""
    none = F.array().cast("array<bigint>")
    best = lambda held: F.coalesce(F.get(held, F.lit(0))["score"], F.lit(0.0))
    free = lambda s, held: F.filter(held, lambda c: ~F.array_contains(s["picks"], c["candidate"]))
    more = lambda s, c: F.struct((s["total"] + c["score"]).alias("total"), F.concat(s["picks"], F.array(c["candidate"])).alias("picks"))

    # What taking each list's first free candidate gives: no partial sum that can't reach it, even with the best of all lists to come, is followed.
    first = F.struct(F.lit(0.0).alias("total"), none.alias("picks"))
    low = F.aggregate(lists, first, lambda s, held: more(s, F.get(free(s, held), F.lit(0))), lambda s: F.coalesce(s["total"], F.lit(float("-inf"))))
    rest = lambda i: F.aggregate(F.slice(lists, i + 2, F.size(lists)), F.lit(0.0), lambda s, held: s + best(held))
    steps = F.transform(lists, lambda held, i: F.struct(held.alias("held"), rest(i).alias("rest")))

    def followed(least: Column) -> Column:
        def extended(states: Column, step: Column) -> Column:
            ends = F.flatten(F.transform(states, lambda s: F.transform(free(s, step["held"]), lambda c: more(s, c))))
            return F.filter(ends, lambda s: F.coalesce(s["total"] + step["rest"] >= least, F.lit(True)))

        return F.aggregate(steps, F.array(first), extended)

    ends = bound(low - F.abs(low) * 1e-9 - 1e-9, followed)
    return F.array_min(F.transform(ends, lambda s: F.struct((-s["total"]).alias("less"), s["picks"].alias("picks"))))["picks"]


def record_lists(scores: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, lists): a row for each record with its targets in order, each with its ``most`` best candidates as ``held``."""
    one = F.struct("rank", "score", F.col("candidate").cast("long").alias("candidate"))
    top = ranked(scores, keys, most).groupBy(*keys, "target").agg(F.sort_array(F.collect_list(one)).alias("held"))
    return top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("target", "held"))).alias("lists"))


def picks(lists: Column, most: int) -> Column:
    """``best_distinct`` of what ``record_lists`` gave; a record of n targets needs n candidates of each."""
    return bound(F.transform(lists, lambda x: F.slice(x["held"], 1, F.least(F.lit(most), F.size(lists)))), best_distinct)


def assigned(scores: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """(keys, target, candidate, score): the distinct candidates of each record's targets (numbered from 0, at most ``most``) that make the largest sum.

    Fewer candidates than targets leave a record without an assignment.
    """
    lists = record_lists(scores, keys, most)
    return told(lists.withColumn("won", picks(F.col("lists"), most)), keys)


def told(lists: DataFrame, keys: list[str]) -> DataFrame:
    """The assigned candidates ``won`` of each record's ``lists`` with their scores, one row for each target."""
    rows = lists.select(*keys, "lists", F.posexplode("won").alias("place", "candidate"))
    of = F.get("lists", "place")
    score = F.get(F.filter(of["held"], lambda c: c["candidate"] == F.col("candidate")), F.lit(0))["score"]
    return rows.select(*keys, of["target"].alias("target"), "candidate", score.alias("score"))


def top_with_assigned(scores: DataFrame, keys: list[str], k: int, most: int = 5) -> DataFrame:
    """(keys, target, rank, candidate): the ``k`` best candidates of each target, the assigned one in place of the first.

    The assigned candidate may so stand twice in a list. A record's only target keeps its best candidate.
    """
    lists = record_lists(scores, keys, max(k, most)).withColumn("won", picks(F.col("lists"), most))
    rows = lists.select(*keys, "won", F.posexplode("lists").alias("place", "l")).select(*keys, F.col("l.target").alias("target"), F.get("won", "place").alias("won"), F.explode(F.slice("l.held", 1, k)).alias("c"))
    first = F.when(F.col("c.rank") == 0, F.coalesce("won", "c.candidate")).otherwise(F.col("c.candidate"))
    return rows.select(*keys, "target", F.col("c.rank").alias("rank"), first.alias("candidate"))
