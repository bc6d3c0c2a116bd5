"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**16 cells. Each shard owns ``nodes`` virtual nodes, at cells
hashed from its number; a row sits in the cell of its id's hash and belongs to
the next node clockwise. A shard holds its exact share of the rows (quotas
that differ by one at most); rows that reach a full shard continue clockwise
to the next node whose shard has room. Rows arrive in ring order.

Because rows of one cell behave alike, the walk needs only the row count of
each cell: a table of at most 65,536 numbers however many rows there are. It is
walked on the driver and comes back as runs (cell, ranks from-to, shard, first
slot), of which there are no more than cells and shards together, so it can be
sent to every task. A row's rank in its cell gives its shard and slot. A cell
of more than ``most_in_cell`` rows (one id that fills a large share of the
table) is dealt into buckets that are ranked apart and summed up, so it is many
tasks. The main path is DataFrame operations alone.

Defined cases: a null id hashes by its text, so that such rows spread; a null
text has size 1 and the checksum of no bytes, a very long one all of its bytes;
repeated rows are rows of their own, and ties inside a cell may fall either way;
other columns, of any name, are not read; an empty table stays empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenova.llm.common import cut, text_bytes

CELLS = 1 << 16
RUNS = ("run_cell", "first", "last", "shard", "base")


def ring(shards: int, nodes: int) -> list[int]:
    """The shard whose node each cell reaches first, clockwise, with the order of nodes kept."""
    at: dict[int, tuple[int, int]] = {}
    for shard in range(shards):
        for node in range(nodes):
            h = hashlib.md5(f"{shard}/{node}".encode()).digest()
            cell, tie = int.from_bytes(h[:2], "big"), int.from_bytes(h[2:8], "big")
            at[cell] = max(at.get(cell, (-1, -1)), (tie, shard))
    owner, shard = [0] * CELLS, at[min(at)][1]
    for cell in range(CELLS - 1, -1, -1):
        shard = at[cell][1] if cell in at else shard
        owner[cell] = shard
    if len(set(owner)) < shards:
        raise ValueError(f"{shards} shards of {nodes} nodes don't fit a ring of {CELLS} cells")
    return owner


def walk(counts: dict[int, int], shards: int, nodes: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, first rank, last rank, shard, slot of the first)."""
    owner, total = ring(shards, nodes), sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    follow: list[int] = []  # the cell where the next node clockwise begins
    nxt = 0
    for cell in range(CELLS - 1, -1, -1):
        follow.append(nxt)
        if cell and owner[cell - 1] != owner[cell]:
            nxt = cell
    follow.reverse()
    runs = []
    for cell in sorted(counts):
        left, rank, at = counts[cell], 0, cell
        while left:
            shard = owner[at]
            take = min(left, room[shard] - used[shard])
            if take:
                runs.append((cell, rank, rank + take - 1, shard, used[shard]))
                used[shard] += take
                rank += take
                left -= take
            if left:
                at = follow[at]
    return runs


def hashed(id: Column, text: Column) -> Column:
    return F.when(id.isNull(), F.xxhash64(F.lit("no id"), text)).otherwise(F.xxhash64(id))


def ranked_in_cells(rows: DataFrame, counts: dict[int, int], most_in_cell: int) -> DataFrame:
    """``rows`` (with cell and h) with their rank from 0 in their cell."""
    order = lambda *keys: Window.partitionBy(*keys).orderBy("h", "doc_id", "size", "text_crc32")
    hot = {c: -(-n // most_in_cell) for c, n in counts.items() if n > most_in_cell}
    cool = ~F.col("cell").isin(list(hot)) if len(hot) <= 100 else None
    if not hot:
        return rows.withColumn("rank", F.row_number().over(order("cell")) - 1)
    spark = rows.sparkSession
    parts = F.broadcast(spark.createDataFrame(list(hot.items()), "cell int, parts int"))  # CELLS rows at most
    full = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("at"), F.col("parts")))
    sizes = full.groupBy("cell", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("cell", "part", F.coalesce(before, F.lit(0)).alias("before"))
    full = full.withColumn("inside", F.row_number().over(order("cell", "part")) - 1).join(sizes, ["cell", "part"])
    full = full.withColumn("rank", F.col("before") + F.col("inside")).drop("parts", "part", "before", "inside")
    rest = rows.where(cool) if cool is not None else rows.join(parts, "cell", "left_anti")
    return rest.withColumn("rank", (F.row_number().over(order("cell")) - 1).cast("long")).unionByName(full)


def shard_rows(docs: DataFrame, *, shards: int = 16, nodes: int = 64, id: str = "doc_id", text: str = "text", most_in_cell: int = 10_000) -> DataFrame:
    """One row for each row: id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id).alias("doc_id"),
        (text_bytes(F.col(text)) + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        hashed(F.col(id), F.col(text)).alias("h"),
    )
    # The written rows keep their order, so their numbers are the same whenever they are read.
    rows = cut(rows.withColumn("cell", F.shiftrightunsigned("h", 48).cast("int"))).withColumn("at", F.monotonically_increasing_id())
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # at most CELLS rows
    found = np.array(walk(counts, shards, nodes), np.int64).reshape(-1, len(RUNS))
    runs = spark.createDataFrame(pa.table({k: found[:, i] for i, k in enumerate(RUNS)}))
    ranked = ranked_in_cells(rows, counts, most_in_cell)
    # Runs are bounded by CELLS + shards rows of 32 bytes.
    met = ranked.join(F.broadcast(runs), (F.col("cell") == F.col("run_cell")) & F.col("rank").between(F.col("first"), F.col("last")))
    return met.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
