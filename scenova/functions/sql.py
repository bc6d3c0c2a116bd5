"""Functions and table functions that SQL text can call, under their names, once ``register`` has run.

    SELECT o.object_id, m.* FROM objects o, LATERAL mentions_of(o.caption, array('truck', 'fire truck')) m
    SELECT rotated_iou(array(x, y, z, l, w, h, yaw), array(...)) FROM boxes
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scenova.functions.text import MENTIONS, find_mentions
from scenova.operators.sequential import rotated_ious, sevens


def rotated_iou(left: pa.Array, right: pa.Array) -> pa.Array:
    """IoU of turned boxes, arrays of seven numbers; 0 for what isn't a box."""
    return pa.array(rotated_ious(sevens(left), sevens(right)), pa.float64())


def mentions(captions: pd.Series, lists: pd.Series) -> pd.Series:
    """Whole-word mentions of words in a caption, as an array of (start, end, word)."""
    return pd.Series([[{"start": s, "end": e, "word": w} for s, e, w in find_mentions(c, list(ws) if ws is not None else [])] for c, ws in zip(captions, lists)])


class MentionsOf:
    """A row for each mention of ``words`` in ``caption``, in order; none for a null."""

    def eval(self, caption: str, words: list):
        for nth, (start, end, word) in enumerate(find_mentions(caption, list(words) if words is not None else []), 1):
            yield nth, start, end, word


def register(spark: SparkSession) -> None:
    # Types are parsed by a running session, so functions are wrapped only here.
    spark.udf.register("rotated_iou", F.arrow_udf(rotated_iou, "double"))
    spark.udf.register("mentions", F.pandas_udf(mentions, MENTIONS))
    spark.udtf.register("mentions_of", F.udtf(MentionsOf, returnType="nth: int, start: int, end: int, word: string", useArrow=True))
