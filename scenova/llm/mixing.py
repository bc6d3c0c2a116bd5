"""Mixing sources to target weights by Poisson replication.

Every source gets a rate: the mean number of times that each of its documents
is repeated, so that its expected share of the characters is its weight and
the expected total is ``budget`` times the input. A uniform number from a hash
of the seed and the document is put through the inverse of the Poisson
distribution with that mean; the document is then exploded by the count that
comes out, and all copies are dealt into one global random order.

Rows repeated outright (equal ids and texts) are numbered first, and the number
goes into both hashes: each of them draws a count of its own and has a place of
its own in the order, however many there are.

The result depends on the seed and the rows only, not on partitions or
retries. Defined cases: a null source is a source of its own; null ids are ids
like others; a null or empty text weighs one character, a very long one all of
its characters; sources without a weight get none of the mix when weights are
given; ties of a place go by id and copy; other columns stay, and no helper
column can clash with them; an empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenova.llm.common import cut, fresh

#: Beyond this many sources (or repeated rows) they are joined by a shuffle and not sent to every task.
SENT_SOURCES, SENT_REPEATS = 20_000, 200_000


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) from a hash."""
    top = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (top.cast("double") + 0.5) * F.lit(2.0**-53)


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The least k with P(X <= k) > u for X ~ Poisson(mean), for any mean.

    Terms are summed from 12 deviations below the mean (0 where that is not
    above 16) to 12 above it; what is outside is below 2**-60. The first term
    is exp(-d - s) / sqrt(2 pi k), with the deviance d of k from the mean and
    the remainder s of Stirling's formula, which doesn't overflow or vanish.
    """
    state = "struct<k:int,p:double,c:double>"
    reach = 12 * F.sqrt(mean) + 20
    low = F.floor(mean - reach)
    low = F.when(low < 16, F.lit(0)).otherwise(low).cast("int")
    k = low.cast("double")
    deviance = k * F.log(k / mean) + mean - k
    stirling = (1 / (12 * k)) * (1 - (1 / (30 * k * k)) * (1 - (2 / (7 * k * k)) * (1 - 3 / (4 * k * k))))
    first = F.when(low == 0, F.exp(-mean)).otherwise(F.exp(-deviance - stirling) / F.sqrt(2 * math.pi * k))

    def step(s, i):
        p = s["p"] * mean / i
        return F.when(s["c"] > u, s).otherwise(F.struct(i.alias("k"), p.alias("p"), (s["c"] + p).alias("c")).cast(state))

    start = F.struct(low.alias("k"), first.alias("p"), first.alias("c")).cast(state)
    summed = F.aggregate(F.sequence(low + 1, F.ceil(mean + reach).cast("int")), start, step, lambda s: s["k"])
    return F.when(mean > 0, summed).otherwise(0)


def digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def tallied(docs: DataFrame, *, id: str, source: str, text: str) -> DataFrame:
    """(source, id, digest, n, mass): how many rows are alike and their characters. One pass over the texts."""
    mass = F.coalesce(F.greatest(F.length(text), F.lit(1)), F.lit(1)).cast("double")
    keys = [F.col(source).alias("source"), F.col(id).alias("id"), digest(F.col(text)).alias("digest")]
    return cut(docs.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(mass).alias("mass")))


def numbered(docs: DataFrame, tally: DataFrame, number: str, *, id: str, text: str, rows_in_bucket: int = 10_000) -> DataFrame:
    """``docs`` with a number from 0 among rows of equal id and text in column ``number``.

    Rows that occur once have 0. The others are written once, so that their
    order holds, and numbered in two levels: inside a bucket, and the buckets.
    """
    own_id, own_digest, bucket, spread, inside, before, n = (fresh(c) for c in ("id", "digest", "bucket", "spread", "inside", "before", "n"))
    again = tally.groupBy(F.col("id").alias(own_id), F.col("digest").alias(own_digest)).agg(F.sum("n").alias(n)).where(F.col(n) > 1)
    many = again.limit(SENT_REPEATS + 1).count()
    once = docs.withColumn(number, F.lit(0).cast("long"))
    if not many:
        return once
    again = F.broadcast(again) if many <= SENT_REPEATS else again
    same = F.col(id).eqNullSafe(F.col(own_id)) & (digest(F.col(text)) == F.col(own_digest))
    rows = cut(docs.join(again, same)).withColumn(spread, F.xxhash64(F.monotonically_increasing_id()))
    rows = rows.withColumn(bucket, F.pmod(F.col(spread), F.ceil(F.col(n) / F.lit(rows_in_bucket))))
    keys = [own_id, own_digest, bucket]
    rows = rows.withColumn(inside, F.row_number().over(Window.partitionBy(*keys).orderBy(spread)) - 1)
    earlier = Window.partitionBy(own_id, own_digest).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias(before)).withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    left = {c: fresh(c) for c in keys}
    sizes = sizes.withColumnsRenamed(left)
    met = rows.join(sizes, F.col(own_id).eqNullSafe(F.col(left[own_id])) & (F.col(own_digest) == F.col(left[own_digest])) & (F.col(bucket) == F.col(left[bucket])))
    met = met.withColumn(number, F.col(before) + F.col(inside)).select(*docs.columns, number)
    return docs.join(again, same, "left_anti").withColumn(number, F.lit(0).cast("long")).unionByName(met)


def source_rates(tally: DataFrame, *, weights: dict[str | None, float] | None, flatten: float, budget: float) -> DataFrame:
    """One row for each source: its name and rate."""
    sizes = cut(tally.groupBy("source").agg(F.sum("mass").alias("mass")))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("mass", F.lit(flatten)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
        weighed = sizes.withColumn("weight", weight)
    total = weighed.agg(F.sum("mass").alias("all"), F.sum("weight").alias("weights")).first()
    whole, share = total["all"] or 0.0, total["weights"] or 0.0
    rate = F.lit(budget * whole) * F.col("weight") / F.lit(share or math.inf) / F.col("mass")
    return weighed.select("source", rate.alias("rate"))


def mix(docs: DataFrame, *, id: str = "doc_id", source: str = "source", text: str = "text", weights: dict[str | None, float] | None = None, flatten: float = 0.5, budget: float = 1.0, seed: int = 20, copy: str = "copy") -> DataFrame:
    """``docs`` mixed to ``weights``, with the number of the copy (from 0 in each document) in column ``copy``, which replaces one of that name.

    Without weights a source weighs its characters to the power ``flatten``:
    1 leaves the shares as they are, 0 makes them equal.
    """
    name, rate, count, place, number = (fresh(c) for c in ("source", "rate", "count", "place", "number"))
    tally = tallied(docs, id=id, source=source, text=text)
    rates = source_rates(tally, weights=weights, flatten=flatten, budget=budget)
    rates = rates.select(F.col("source").alias(name), F.col("rate").alias(rate))
    few = len(rates.select(F.lit(1)).limit(SENT_SOURCES + 1).collect()) <= SENT_SOURCES
    docs = numbered(docs, tally, number, id=id, text=text)
    rated = docs.join(F.broadcast(rates) if few else rates, F.col(source).eqNullSafe(F.col(name)))
    drawn = rated.withColumn(count, poisson_inverse(uniform(seed, F.col(id), F.crc32(F.coalesce(F.col(text), F.lit(""))), F.col(number)), F.col(rate))).drop(name, rate)
    copies = drawn.where(F.col(count) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(count) - 1))).drop(count)
    copies = copies.withColumn(place, F.xxhash64(F.lit(seed + 1), F.col(id), F.col(text), F.col(number), copy))
    return copies.repartition(F.col(place)).sortWithinPartitions(place, id, copy).drop(place, number)
