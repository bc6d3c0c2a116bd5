"""Linking the objects of an entry to the places of a caption that mention them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_spans(mentions: DataFrame, wanted: DataFrame, entry: str, kind: str = "class") -> DataFrame:
    """(entry, spans): the nth object of a class takes the nth mention of that class; spans in the order of the objects.

    ``mentions``: entry, kind, start, end. ``wanted``: entry, kind, ord. Entries
    where a class has too few mentions or two objects share a span are left out.
    """
    key = Window.partitionBy(entry, kind)
    said = mentions.select(entry, kind, "start", "end", F.row_number().over(key.orderBy("start", "end")).alias("nth"))
    asked = wanted.select(entry, kind, "ord", F.row_number().over(key.orderBy("ord")).alias("nth"))
    met = asked.join(said, [entry, kind, "nth"], "left")
    spans = F.sort_array(F.collect_list(F.struct("ord", "start", "end")))
    per = met.groupBy(entry).agg(spans.alias("spans"), F.count("start").alias("found"), F.countDistinct("start", "end").alias("apart"))
    return per.where((F.col("found") == F.size("spans")) & (F.col("apart") == F.size("spans"))).select(entry, F.transform("spans", lambda s: F.struct(s["start"], s["end"])).alias("spans"))


def unambiguous_targets(mentions: DataFrame, main: DataFrame, others: DataFrame, entry: str, kind: str = "class") -> DataFrame:
    """(entry, targets): the main object and others that their caption names beyond doubt, ordered by place.

    The main object takes the first mention of its class. Another object counts
    if it is the only one of its class and one mention of that class comes
    after the main one's. Entries with one target, or with a place named
    twice, are left out. ``main`` and ``others``: entry, kind, object_id.
    """
    place = F.struct("start", "end")
    first = main.join(mentions, [entry, kind]).groupBy(entry, kind, "object_id").agg(F.min(place).alias("place"))
    after = first.select(entry, F.col("place").alias("_main"))
    later = mentions.join(after, entry).where(F.col("start") > F.col("_main.start"))
    later = later.groupBy(entry, kind).agg(F.count("*").alias("n"), F.min(place).alias("place")).where("n = 1")
    alone = others.groupBy(entry, kind).agg(F.count("*").alias("n"), F.min("object_id").alias("object_id")).where("n = 1")
    both = first.select(entry, kind, "object_id", "place").unionByName(alone.drop("n").join(later.drop("n"), [entry, kind]))
    per = both.groupBy(entry).agg(F.sort_array(F.collect_list(F.struct("place", kind, "object_id"))).alias("targets"), F.countDistinct("place").alias("apart"))
    return per.where((F.size("targets") >= 2) & (F.col("apart") == F.size("targets"))).select(entry, "targets")
