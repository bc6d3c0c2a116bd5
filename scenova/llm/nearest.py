"""Nearest neighbours by a block matrix join on int8 tiles.

Queries and candidates are dealt into blocks by a hash of their ids, as many
as their counts ask for; a tile is one query block against one candidate
block, and each tile is a group of bounded size. Inside it vectors are rounded
to int8 with a scale each, and one matrix product gives all inner products
with a bound on each one's error (from the norms of the rounding residues).
A pair survives when its upper bound reaches the k-th largest lower bound of
its query; survivors alone are recomputed in double precision on the original
vectors, and the k best of them leave the tile. The lists of a query's tiles
are merged by heaps, FAN lists at a time, in as many levels as that takes. So
the result is exact, whatever the rounding.

Defined cases: vectors that are null, empty, zero, or hold nulls or non-finite
numbers take no part; vectors of different lengths are never compared; equal
scores go by the smaller id; rows with equal ids are candidates each on its
own, and a query leaves out one row of its own id and vector, itself. Query
rows of equal id and vector are one query, answered once; those of equal id
and other vectors are answered each on its own. With fewer than k candidates
all are returned; long vectors are compared whole, in double precision where
float32 sums would round; other columns, of any name, are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lists that one heap merges at once, and rows of lists in a merging group.
FAN, MERGED = 256, 200_000
#: query_key tells query rows of one id apart; copies: how many candidates are alike.
FOUND = "query_id bigint, query_key bigint, vec_id bigint, score double, copies bigint"
COLUMNS = [f.split()[0] for f in FOUND.split(", ")]


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales, the norms of scale * int8, and the norms of what rounding left."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1  # sizes below the least normal number
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def exact(a: np.ndarray, rows: np.ndarray, b: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of a[rows] with b[cols] in double precision, summed in the order of the components."""
    total = np.zeros(len(rows))
    for j in range(a.shape[1]):
        total += a[rows, j] * b[cols, j]
    return total


def tile(q: pd.DataFrame, c: pd.DataFrame, k: int, slab: int = 256) -> Iterator[tuple[np.ndarray, ...]]:
    """For slabs of queries (id, key, v): the COLUMNS of each query's k best candidates (cid, ckey, cv, copies) in this tile."""
    q_ids, q_keys, queries = q["id"].to_numpy(), q["key"].to_numpy(), np.stack(q["v"].to_numpy())
    c_ids, c_keys, vectors, copies = c["cid"].to_numpy(), c["ckey"].to_numpy(), np.stack(c["cv"].to_numpy()), c["copies"].to_numpy()
    c8, c_scale, c_norm, c_rest = rounded(vectors)
    # Products of int8 sums are whole numbers below 2**24 in float32 up to 1,040 dimensions; float64 beyond.
    kind = np.float32 if vectors.shape[1] <= 1040 else np.float64
    c8 = c8.astype(kind).T.copy()
    for at in range(0, len(q), slab):
        ids, keys, x = q_ids[at : at + slab], q_keys[at : at + slab], queries[at : at + slab]
        q8, q_scale, q_norm, q_rest = rounded(x)
        near = (q8.astype(kind) @ c8).astype(np.float64)
        near *= q_scale[:, None]
        near *= c_scale[None, :]
        # <x, y> - <x', y'> = <x - x', y> + <x', y - y'>, and |y| <= |y'| + |y - y'|.
        error = q_rest[:, None] * (c_norm + c_rest)[None, :] + q_norm[:, None] * c_rest[None, :]
        error *= 1 + 1e-9
        error += 1e-12 * (q_norm + q_rest)[:, None] * (c_norm + c_rest)[None, :] + 1e-300
        own = (ids[:, None] == c_ids[None, :]) & (keys[:, None] == c_keys[None, :])
        near[own & (copies == 1)[None, :]] = -np.inf
        low = near - error
        if low.shape[1] > k:
            floor = np.partition(low, low.shape[1] - k, axis=1)[:, -k]
        else:
            floor = np.full(len(x), -np.inf)
        rows, cols = np.nonzero((near + error >= floor[:, None]) & (near > -np.inf))
        score = exact(x, rows, vectors, cols)
        order = np.lexsort((c_ids[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        first = np.searchsorted(rows, np.arange(len(x)))
        best = np.arange(len(rows)) - first[rows] < k
        rows, cols, score = rows[best], cols[best], score[best]
        yield ids[rows], keys[rows], c_ids[cols], score, copies[cols] - own[rows, cols]


def best_of(pdf: pd.DataFrame, k: int) -> dict[tuple[int, int], list[tuple[float, int]]]:
    """The k best (score, -id) of all lists of each query, best first, by one heap for each query."""
    heaps: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for query, key, vec, score, copies in zip(*(pdf[c].tolist() for c in COLUMNS)):
        heap = heaps.setdefault((query, key), [])
        for _ in range(min(copies, k)):
            if len(heap) < k:
                heapq.heappush(heap, (score, -vec))
            else:
                heapq.heappushpop(heap, (score, -vec))
    return {q: sorted(heap, reverse=True) for q, heap in heaps.items()}


def merged(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """One list for each query."""
    rows = [(*query, -vec, score, 1) for query, held in best_of(pdf, k).items() for score, vec in held]
    return pd.DataFrame(rows, columns=COLUMNS)


def ranked(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = [(query, rank, -vec, score) for (query, _), held in best_of(pdf, k).items() for rank, (score, vec) in enumerate(held, 1)]
    return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, *, id: str = "vec_id", vector: str = "embedding", k: int = 20, query_block: int = 8192, candidate_block: int = 8192, fan: int = FAN) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k largest inner products of each query row."""
    held = vectors.where(usable(F.col(vector)) & F.col(id).isNotNull())
    held = held.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    held = held.groupBy("id", "v").agg(F.count("*").alias("copies"), F.max("q").alias("q")).withColumns({"key": F.xxhash64("v"), "dim": F.size("v")})
    n, queries = held.agg(F.count("*"), F.count_if("q")).first()
    c_blocks, q_blocks = max(1, -(-n // candidate_block)), max(1, -(-queries // query_block))
    part = lambda seed, blocks: F.pmod(F.xxhash64(F.lit(seed), "id", "key"), F.lit(blocks)).cast("int")
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = held.where("q").select("id", "key", "v", F.col("dim").alias("dim"), part(1, q_blocks).alias("qb"), all_of(c_blocks).alias("cb"))
    right = held.select(F.col("id").alias("cid"), F.col("key").alias("ckey"), F.col("v").alias("cv"), "copies", F.col("dim").alias("dim"), part(2, c_blocks).alias("cb"), all_of(q_blocks).alias("qb"))

    def join(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({x: [] for x in [*COLUMNS, "list"]})
        found = pd.DataFrame({x: np.concatenate(y) for x, y in zip(COLUMNS, zip(*tile(q, c, k)))})
        return found.assign(list=key[2])

    keys = ["dim", "qb", "cb"]
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(join, FOUND + ", list int")
    part_of = lambda lists: F.pmod(F.xxhash64("query_id", "query_key"), F.lit(max(1, -(-queries * lists * k // MERGED)))).alias("part")
    while c_blocks > fan:
        c_blocks = -(-c_blocks // fan)
        groups = lists.select(*COLUMNS, part_of(fan), F.floor(F.col("list") / fan).cast("int").alias("list")).groupBy("part", "list")
        lists = groups.applyInPandas(lambda key, pdf: merged(pdf, k).assign(list=key[1]), FOUND + ", list int")
    return lists.select(*COLUMNS, part_of(c_blocks)).groupBy("part").applyInPandas(lambda pdf: ranked(pdf, k), "query_id bigint, rank int, vec_id bigint, score double")
