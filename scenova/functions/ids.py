"""Stable ids, hash orders and hash splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of the sha1 of the parts with | between."""
    return F.substr(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), F.lit(1), F.lit(16))


def hash_order(seed: str, *parts: Column) -> Column:
    """A sort key that takes the place of a seeded shuffle."""
    return F.sha1(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))


def odd_digest(*parts: Column) -> Column:
    """Whether the last hex digit of the sha1 is odd."""
    return F.substr(F.sha1(F.concat_ws("|", *parts)), F.lit(40), F.lit(1)).isin(*"13579bdf")


def role(index: Column) -> Column:
    """A for 0, B for 1 and so on."""
    return F.char(F.lit(65) + index)


def refs(ids: Column, descriptions: Column) -> Column:
    """Parallel arrays as an array of structs with roles by place."""
    zipped = F.arrays_zip(ids.alias("object_id"), descriptions.alias("description"))
    return F.transform(zipped, lambda x, i: F.struct(role(i).alias("role"), x["object_id"].alias("object_id"), x["description"].alias("description")))
