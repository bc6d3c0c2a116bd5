"""Hard negatives from a two-dimensional block matrix product.

Vectors become whole numbers, floor(scale * x). Anchors and candidates are cut
into row shards, and a shard is written as one row that holds a panel for each
chunk of its dimensions. Every shard of anchors meets every shard of candidates
where the two are read: panels of the same chunk give a tile of partial scores,
and the tiles of a pair are added there. What leaves that place is not the tile
but the few best candidates of each anchor. So no tile and no copy of a panel is
shuffled or written, and what is written grows with the rows. A task holds the
pairs of at most ``ANCHOR_SHARDS`` and ``CANDIDATE_SHARDS`` shards, however
large the table is; long vectors have fewer rows in a shard.

1. Positives: shards hold the rows of a hash of labels, so anchors meet the
   shards that can hold their label and no others. A label that fills many
   shards is dealt over them. The best ``positives`` of each tile are ranked
   for each anchor.
2. Negatives: each anchor carries a window of scores for each positive; every
   anchor shard meets every candidate shard, and a tile gives, for each window,
   its best ``negatives`` of another label. Those are ranked in the end.

Scores are exact: a product is taken in double precision where all of its sums
stay below 2**53, else in 64-bit numbers, whose overflows cancel since the
score itself fits.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component, take no part, nor does a vector whose squared length
after scaling reaches 2**62, since its scores don't fit a long. Zero vectors
take part; empty vectors score 0 among themselves; vectors of different lengths
never meet. Rows with equal ids are rows of their own, as anchors (each is
answered) and as candidates (an anchor leaves out its own row alone). Ties go by
the smaller id. Other columns, of any name, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenova.llm.common import cut

#: Shards that a task reads of either side, about.
ANCHOR_SHARDS, CANDIDATE_SHARDS = 4, 8
#: Components in a shard, about.
MOST_CELLS = 1 << 20
#: Groups of labels: their sizes are a table of at most so many rows, which is sent to every task.
MOST_GROUPS = 1 << 16
PANEL = "n int, rn binary, id binary, label binary, windows binary, v array<binary>"


def whole_numbers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))))


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers in the least of 2, 4 or 8 bytes that holds them, with the width in front."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def wide(raw: bytes, rows: int) -> np.ndarray:
    held = np.frombuffer(raw, f"<i{raw[0]}", offset=1)
    return held.reshape(rows, -1).astype(np.int64)


def panel(pdf: pd.DataFrame, chunk: int) -> pd.DataFrame:
    """One row that holds a shard, its vectors in chunks; rows stand in the order of their numbers."""
    pdf = pdf.sort_values("rn")
    v = np.stack(pdf["v"].to_numpy()).astype(np.int64) if len(pdf["v"].iloc[0]) else np.zeros((len(pdf), 0), np.int64)
    raw = [pdf[c].to_numpy(np.int64).tobytes() for c in ("rn", "id", "label")]
    windows = np.stack(pdf["windows"].to_numpy()).astype(np.int64).tobytes()
    chunks = [narrow(v[:, at : at + chunk]) for at in range(0, max(1, v.shape[1]), chunk)]
    return pd.DataFrame([(len(pdf), *raw, windows, chunks)], columns=[f.split()[0] for f in PANEL.split(", ")])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def summed(row) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Scores of two shards, added up over the tiles of their chunks, and what tells rows apart."""
    total = 0
    for a, b in zip(row.v, row.c_v):
        total = total + product(wide(a, row.n), wide(b, row.c_n))
    held = {"rn": row.rn, "anchor_label": row.label, "windows": row.windows, "crn": row.c_rn, "id": row.c_id, "label": row.c_label}
    held = {c: np.frombuffer(raw, np.int64) for c, raw in held.items()}
    return total, held | {"windows": held["windows"].reshape(row.n, -1, 2)}


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest allowed scores, ties by the smaller id."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def positives_of(k: int):
    def reduce(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (row for pdf in pairs for row in pdf.itertuples(index=False)):
            scores, of = summed(row)
            rows = []
            for i, rn in enumerate(of["rn"].tolist()):
                same = (of["label"] == of["anchor_label"][i]) & (of["crn"] != rn)
                rows += [(rn, int(of["crn"][j]), int(of["id"][j]), int(scores[i, j])) for j in best(scores[i], of["id"], same, k)]
            yield pd.DataFrame(rows, columns=["rn", "crn", "positive_id", "positive_score"])

    return reduce


def negatives_of(k: int):
    def reduce(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (row for pdf in pairs for row in pdf.itertuples(index=False)):
            scores, of = summed(row)
            rows = []
            for i, rn in enumerate(of["rn"].tolist()):
                windows = [(slot, low, high) for slot, (low, high) in enumerate(of["windows"][i].tolist()) if low <= high]
                if not windows:
                    continue
                any_of = (scores[i] >= min(w[1] for w in windows)) & (scores[i] <= max(w[2] for w in windows))
                at = np.flatnonzero(any_of & (of["label"] != of["anchor_label"][i]))
                ids, held = of["id"][at], scores[i, at]
                for slot, low, high in windows:
                    rows += [(rn, slot, int(ids[j]), int(held[j])) for j in best(held, ids, (held >= low) & (held <= high), k)]
            yield pd.DataFrame(rows, columns=["rn", "slot", "negative_id", "negative_score"])

    return reduce


def panels(rows: DataFrame, shard: Column, chunk: int, parts: int) -> DataFrame:
    """(dim, grp, shard) and a panel for each shard of rows (rn, id, label, v, dim, grp, windows), written in ``parts`` even parts."""
    keys = ["dim", "grp", "shard"]
    made = rows.withColumn("shard", shard).groupBy(*keys).applyInPandas(lambda key, pdf: panel(pdf, chunk).assign(dim=key[0], grp=key[1], shard=key[2]), PANEL + ", dim int, grp int, shard int")
    part = F.pmod(F.col("grp") + F.col("shard"), F.lit(parts)).cast("int")
    return cut(made.repartitionById(parts, part))


def shards_of(sizes: Column, rows: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(sizes / F.lit(rows))).cast("int")


def pairs_of_shards(anchors: DataFrame, rows: DataFrame, chunk: int, anchor_rows: int, candidate_rows: int) -> DataFrame:
    """Every anchor shard beside every candidate shard (c_*) of its length and group; both sides know their group's sizes (n_anchors, n_rows)."""
    dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "rn"), n).cast("int")
    n_left, n_right = shards_of(F.col("n_anchors"), anchor_rows), shards_of(F.col("n_rows"), candidate_rows)
    sizes = rows.select("dim", "grp", n_left.alias("lefts"), n_right.alias("rights")).distinct().agg(F.sum("lefts"), F.sum("rights")).first()
    lefts, rights = (max(-(-(n or 0) // most), min(n or 1, 4)) for n, most in zip(sizes, (ANCHOR_SHARDS, CANDIDATE_SHARDS)))
    left = panels(anchors, dealt(1, n_left), chunk, lefts)
    right = panels(rows, dealt(2, n_right), chunk, rights)
    right = right.select("dim", "grp", *[F.col(f.split()[0]).alias(f"c_{f.split()[0]}") for f in PANEL.split(", ")])
    # A task reads a part of either side from where they are written: nothing is exchanged.
    return left.drop("shard").hint("shuffle_replicate_nl").join(right, ["dim", "grp"])


def hard_negatives(
    vectors: DataFrame,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    is_anchor: Column,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    chunk: int = 32,
    anchor_rows: int = 128,
    candidate_rows: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    A negative's score lies between ``window`` per cent of its positive's.
    """
    marked = F.col(label) if isinstance(label, str) else label
    held = vectors.select(F.col(id).cast("long").alias("id"), marked.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    whole = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    fits = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(x * F.lit(float(scale)), F.lit(2.0))) < F.lit(2.0**62)
    held = held.where(whole & F.col("id").isNotNull() & F.col("label").isNotNull()).where(fits)
    held = held.withColumns({"v": whole_numbers(F.col("v"), scale), "dim": F.size("v")})
    # The written rows keep their order, so their numbers are the same whenever they are read.
    held = cut(held).withColumn("rn", F.monotonically_increasing_id())

    by_dim = held.groupBy("dim").agg(F.count("*").alias("n_rows"), F.count_if("anchor").alias("n_anchors"))
    of_dim = by_dim.where("n_anchors > 0").orderBy("dim").collect()  # lengths, not rows
    found, closed = None, F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))  # a window that holds nothing
    for d in of_dim:
        most = max(1, MOST_CELLS // max(1, d["dim"]))
        sides = (chunk, min(anchor_rows, most), min(candidate_rows, most))
        alike = held.where(F.col("dim") == d["dim"]).withColumn("windows", closed)
        groups = min(MOST_GROUPS, -(-d["n_rows"] // candidate_rows))
        alike = alike.withColumn("grp", F.pmod(F.xxhash64("label"), F.lit(groups)).cast("int"))
        sizes = alike.groupBy("grp").agg(F.count("*").alias("n_rows"), F.count_if("anchor").alias("n_anchors")).where("n_anchors > 0")
        alike = alike.join(F.broadcast(sizes), "grp")
        met = pairs_of_shards(alike.where("anchor"), alike, *sides).mapInPandas(positives_of(positives), "rn bigint, crn bigint, positive_id bigint, positive_score bigint")
        order = Window.partitionBy("rn").orderBy(F.desc("positive_score"), "positive_id", "crn")
        chosen = cut(met.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < positives))

        # The whole numbers between two shares of the positive's score, which is 100 * hundreds + rest.
        rest = F.expr("pmod(positive_score, 100L)")
        hundreds = F.expr("(positive_score - pmod(positive_score, 100L)) DIV 100")
        low = (hundreds * window[0] + F.ceil(rest * window[0] / 100)).cast("long")
        high = (hundreds * window[1] + F.floor(rest * window[1] / 100)).cast("long")
        pairs = F.sort_array(F.collect_list(F.struct("slot", F.array(low, high).alias("w"))))
        windows = chosen.groupBy("rn").agg(F.transform(pairs, lambda x: x["w"]).alias("w"))
        padded = F.flatten(F.concat("w", F.array_repeat(closed, F.lit(positives) - F.size("w"))))
        whole_table = {"grp": F.lit(0), "n_rows": F.lit(d["n_rows"]), "n_anchors": F.lit(d["n_anchors"])}
        asking = alike.where("anchor").drop("windows").join(windows, "rn").withColumn("windows", padded).drop("w").withColumns(whole_table)
        offered = held.where(F.col("dim") == d["dim"]).withColumn("windows", closed).withColumns(whole_table)
        met = pairs_of_shards(asking, offered, *sides).mapInPandas(negatives_of(negatives), "rn bigint, slot int, negative_id bigint, negative_score bigint")
        order = Window.partitionBy("rn", "slot").orderBy(F.desc("negative_score"), "negative_id")
        mined = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        names = held.where("anchor").select("rn", F.col("id").alias("anchor_id"))
        mined = mined.join(chosen.select("rn", "slot", "positive_id", "positive_score"), ["rn", "slot"]).join(names, "rn")
        mined = mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        found = mined if found is None else found.unionByName(mined)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return found
