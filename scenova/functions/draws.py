"""Random numbers from hashes: they depend on a seed and on the row's keys, not on partitions, order or retries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenova.functions.ids import hash_order

STEPS = 2.0**32


def uniform(seed: str, *keys: Column) -> Column:
    """In (0, 1): the first 32 bits of a digest, at the middle of their step."""
    return (F.conv(F.substr(hash_order(seed, *keys), F.lit(1), F.lit(8)), 16, 10).cast("double") + 0.5) / STEPS


def normal(seed: str, *keys: Column) -> Column:
    """Standard normal, from two uniform numbers (Box and Muller)."""
    return F.sqrt(-2.0 * F.log(uniform(f"{seed}/r", *keys))) * F.cos(2.0 * math.pi * uniform(f"{seed}/a", *keys))


def uniform_sql(seed: str, *keys: str) -> str:
    return f"((('0x' || substr(sha1('{seed}|' || {" || '|' || ".join(keys)}), 1, 8))::BIGINT + 0.5::DOUBLE) / {STEPS})"


def normal_sql(seed: str, *keys: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln({uniform_sql(seed + '/r', *keys)})) * cos({2.0 * math.pi!r}::DOUBLE * {uniform_sql(seed + '/a', *keys)}))"
