"""N-gram Jaccard join by chosen paths.

Documents are sets of hashed 5-word shingles; two link at similarity 0.8.

1. One pass over the texts gives each row the digest of its set, the set's size
   and a sketch: its SKETCH smallest shingle hashes (for small sets, all). Rows
   of equal sets are one class from here on.
2. Chosen paths over the sketches: in a run every class picks each token of its
   sketch with a chance of 1 / (lam * tokens), by a hash of the path so far, so
   that similar classes pick a shared token together; classes of one path are
   a bucket. Buckets of 2 to ``limit`` classes are compared by brute force,
   larger ones are split on the next token, to ``depth`` tokens at most, and
   what is then still large is compared block against block. In a large bucket,
   classes nearly equal to its pivot are linked to it and need not go on: by
   the triangle inequality the pivot meets whatever they would meet. The number
   of runs follows from the target recall.
3. Pairs whose sketches agree well enough (a few deviations below 0.8) join
   classes to candidate components. In each component all pairs are compared
   exactly, on whole shingle sets, in blocks, so that a large component is
   many tasks. That gives exact links and, from them, the groups.

Defined cases: a text of one to four words has one shingle, all its words; a
text without words (null, empty, blank) is in no group and has no links; rows
of equal sets are linked; repeated rows count as documents of their own; a
group is named by its smallest document id (null ids last; rows of one id go by
a hash of their text). Very long texts are sets like others, none of their
shingles is left out. Other columns, of any name, stay as they are and no helper
column can clash with them. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenova.llm.common import cut, fresh, slices, utf8
from scenova.llm.graph import components

SKETCH = 64
#: Up to this many rows (some 50 bytes each) the list of texts to read again is sent to every task; beyond, texts are shuffled to it.
SENT_ROWS = 250_000
#: Up to this many large buckets (some 300 bytes each, with their pivot's sketch) are sent to every task.
SENT_NODES = 50_000
SET_ROW = "struct<a:bigint,b:bigint,n:int,sketch:binary>"
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizing mix of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD and its inverse modulo 2**64, to the powers 0 to n - 1."""
    inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
    up, down = np.full(n, ODD), np.full(n, inverse)
    if n:
        up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


LETTERS = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=5) for b in range(256)], np.uint64)
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, with array operations over all texts at once."""
    if not len(data):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    gap = IS_SPACE[data]
    word = ~gap
    starts = word & np.r_[True, gap[:-1]]
    starts[offsets[:-1][offsets[:-1] < len(data)]] |= word[offsets[:-1][offsets[:-1] < len(data)]]
    first = np.flatnonzero(starts)
    stop = word & np.r_[gap[1:], True]
    ends_of_text = offsets[1:][offsets[1:] > 0] - 1
    stop[ends_of_text] |= word[ends_of_text]
    last = np.flatnonzero(stop)
    up, down = powers(len(data) + 1)
    total = np.r_[np.uint64(0), np.cumsum(LETTERS[data] * up[:-1], dtype=np.uint64)]
    words = mixed((total[last + 1] - total[first]) * down[first] + (last - first + 1).astype(np.uint64))
    bounds = np.searchsorted(first, offsets)
    n = len(words)
    spread = [np.uint64(pow(int(ODD), 2 * k + 1, 1 << 64)) for k in range(width)]
    whole = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        whole += words[k : k + len(whole)] * spread[k]
    whole = mixed(whole)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mixed(np.array([sum((words[a + k] * spread[k] for k in range(b - a)), np.uint64(0))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_rows(width: int):
    def rows(texts: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        a, b, n, sketch = [], [], [], []
        for i, j in slices(offsets):
            for held in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width):
                digest = np.frombuffer(xxhash.xxh3_128_digest(held.tobytes()), np.int64)
                a.append(digest[0])
                b.append(digest[1])
                n.append(len(held))
                sketch.append(held[:SKETCH].astype(np.uint32).tobytes())
        return pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.array(sketch, pa.binary())], ["a", "b", "n", "sketch"])

    return F.arrow_udf(rows, SET_ROW)


def whole_sets(width: int):
    def rows(texts: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        out = []
        for i, j in slices(offsets):
            out += [held.tobytes() for held in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)]
        return pa.array(out, pa.binary())

    return F.arrow_udf(rows, "binary")


def chosen(path: np.uint64, tokens: np.ndarray, lam: float) -> np.ndarray:
    """Paths that continue ``path`` with the tokens that are picked."""
    u = mixed(tokens.astype(np.uint64) * ODD + path)
    return u[u < np.uint64(min(2**64 - 1, int(2**64 / (lam * max(len(tokens), 1)))))]


def first_paths(runs: int, lam: float):
    """Array of the one-token paths of all runs."""
    seeds = mixed(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def paths(sketches: pa.Array) -> pa.Array:
        out = []
        for raw in sketches.to_pylist():
            tokens = np.frombuffer(raw, np.uint32)
            out.append(np.concatenate([chosen(s, tokens, lam) for s in seeds]).view(np.int64))
        ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))

    return F.arrow_udf(paths, "array<bigint>")


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the Jaccard similarity of two sets from their sorted bottom sketches."""
    return len(np.intersect1d(a, b, assume_unique=True)) / max(len(a), len(b), 1)


def next_paths(lam: float, same: float, least: float):
    """Of a member of a large bucket: whether it is linked to the pivot, and its continued paths.

    The pivot stands for members that are nearly its equals; members that pick
    no token, and so leave the run here, are linked to it if they agree.
    """

    def paths(path: pa.Array, sketch: pa.Array, pivot: pa.Array, is_pivot: pa.Array) -> pa.Array:
        near, more = [], []
        for p, raw, other, own in zip(path.to_numpy(zero_copy_only=False).view(np.uint64), sketch.to_pylist(), pivot.to_pylist(), is_pivot.to_pylist()):
            tokens = np.frombuffer(raw, np.uint32)
            near_by = 0.0 if own else agreement(tokens, np.frombuffer(other, np.uint32))
            more.append([] if near_by >= same else chosen(p, tokens, lam).view(np.int64).tolist())
            near.append(near_by >= least and not more[-1])
        return pa.StructArray.from_arrays([pa.array(near, pa.bool_()), pa.array(more, pa.list_(pa.int64()))], ["near", "paths"])

    return F.arrow_udf(paths, "struct<near:boolean,paths:array<bigint>>")


def streamed(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of a partition that is sorted by ``keys``, one after the other, as arrays."""
    rest: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        new = np.flatnonzero(np.any([cols[k][1:] != cols[k][:-1] for k in keys], axis=0)) + 1
        edges = [0, *new.tolist()]
        for a, b in zip(edges[:-1], edges[1:]):
            yield {c: x[a:b] for c, x in cols.items()}
        rest = pdf.iloc[edges[-1] :]
    if rest is not None and len(rest):
        yield {c: rest[c].to_numpy() for c in rest.columns}


def overlaps(sets: list[np.ndarray], wide: int = 1 << 22) -> np.ndarray:
    """Sizes of all pairwise intersections, from a token-by-set incidence matrix taken in strips."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.r_[True, tokens[1:] != tokens[:-1]]
    shared = np.r_[new[1:], True] & new  # tokens of one set only
    column = np.cumsum(new) - 1
    column, owner = column[~shared], owner[~shared]
    column = np.unique(column, return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    strip = max(1, wide // len(sets))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, strip):
        a, b = np.searchsorted(column, [at, at + strip])
        m = np.zeros((len(sets), min(strip, int(column[-1]) + 1 - at)), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m @ m.T
    out[np.arange(len(sets)), np.arange(len(sets))] = [len(s) for s in sets]
    return np.rint(out).astype(np.int64)


def stars(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each connected member to the smallest id of its part."""
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in np.argwhere(linked):
        if i < j:
            a, b = root(int(i)), root(int(j))
            if a != b:
                if ids[b] < ids[a]:
                    a, b = b, a
                parent[b] = a
    return [(int(ids[i]), int(ids[root(i)])) for i in range(len(ids)) if root(i) != i]


def compare_buckets(least: float):
    """Brute force over buckets: star edges of the pairs whose sketches agree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: set[tuple[int, int]] = set()
        for g in streamed(batches, ["path", "i", "j"]):
            ids = g["c"]
            if len(ids) < 2:
                continue
            sets = [np.frombuffer(raw, np.uint32) for raw in g["sketch"]]
            if len(ids) == 2:
                if agreement(*sets) >= least:
                    found.add((int(max(ids)), int(min(ids))))
            else:
                sizes = np.array([len(s) for s in sets])
                found.update(stars(ids, overlaps([np.sort(s) for s in sets]) >= least * np.maximum.outer(sizes, sizes)))
            if len(found) > 200_000:
                yield pd.DataFrame(list(found), columns=["u", "v"])
                found = set()
        yield pd.DataFrame(list(found), columns=["u", "v"], dtype="int64")

    return run


def verify(num: int, den: int):
    """Exact comparison of blocks: links of each class, and star edges, of the pairs with Jaccard >= num / den."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple[int, int, int]] = []
        for g in streamed(batches, ["comp", "i", "j"]):
            ids, copies, block = g["c"], g["copies"].astype(np.int64), g["block"]
            sets = [np.frombuffer(raw, np.uint64) for raw in g["tokens"]]
            sizes = np.array([len(s) for s in sets], np.int64)
            both = overlaps(sets)
            linked = den * both >= num * (np.add.outer(sizes, sizes) - both)
            np.fill_diagonal(linked, False)
            if g["i"][0] != g["j"][0]:  # pairs inside a block are another group's
                linked &= block[:, None] != block[None, :]
            links = linked @ copies
            edge = dict(stars(ids, linked))
            rows += [(int(c), int(n), edge.get(int(c), int(c))) for c, n in zip(ids, links)]
            if len(rows) > 200_000:
                yield pd.DataFrame(rows, columns=["c", "links", "to"])
                rows = []
        yield pd.DataFrame(rows, columns=["c", "links", "to"], dtype="int64")

    return run


def block_pairs(df: DataFrame, size, block, of: int) -> DataFrame:
    """Copies of each row for all block pairs (i <= j) that its block is in; ``size`` rows in its group, ``of`` in a block."""
    blocks = F.ceil(size / F.lit(of)).cast("int")
    df = df.withColumn("block", F.pmod(block, blocks).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return df.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")


def runs_for(recall: float, similarity: float, lam: float, depth: int) -> int:
    """Runs after which a pair at ``similarity`` has met in a bucket with chance ``recall``, if it takes ``depth`` tokens."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-similarity / lam * p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def candidate_edges(classes: DataFrame, *, lam: float, runs: int, limit: int, depth: int, least: float, block: int = 1024, same: float = 0.9) -> DataFrame:
    """Edges (u, v) between classes (c, sketch) by chosen paths."""
    sketches = classes.select("c", "sketch")
    rows = sketches.select("c", F.explode(first_paths(runs, lam)("sketch")).alias("path"))
    leaves, edges = [], []
    for level in range(1, depth + 1):
        rows = rows if level == 1 else cut(rows)
        nodes = cut(rows.groupBy("path").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("path", "c").alias("h"), F.col("c").alias("c"))).alias("p")).where("size > 1").select("path", "size", F.col("p.c").alias("pivot")))
        met = rows.join(nodes.where(F.col("size") <= limit), "path")
        leaves.append(met.select("path", "c", F.lit(0).alias("i"), F.lit(0).alias("j")))
        pivots = sketches.select(F.col("c").alias("pivot"), F.col("sketch").alias("pivot_sketch"))
        large = cut(nodes.where(F.col("size") > limit).join(pivots, "pivot").select("path", "size", "pivot", "pivot_sketch"))
        n_large = large.limit(SENT_NODES + 1).count()
        if not n_large:
            break
        # One join on the path, with nothing behind it that needs its dealing, so Spark can split a hot path where nodes aren't sent.
        members = rows.join(F.broadcast(large) if n_large <= SENT_NODES else large, "path")
        if level == depth:
            split = block_pairs(members, F.col("size"), F.xxhash64("c"), block)
            leaves.append(split.select("path", "c", "i", "j"))
            break
        known = members.select("path", "c", "pivot", "pivot_sketch").join(sketches, "c")
        grown = known.withColumn("next", next_paths(lam, same, least)("path", "sketch", "pivot_sketch", F.col("c") == F.col("pivot"))).select("c", "pivot", "next")
        grown = cut(grown)
        edges.append(grown.where("next.near").select(F.col("c").alias("u"), F.col("pivot").alias("v")))
        rows = grown.select("c", F.explode("next.paths").alias("path"))
    buckets = leaves[0]
    for more in leaves[1:]:
        buckets = buckets.unionByName(more)
    buckets = buckets.join(sketches, "c").repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")
    found = buckets.select("path", "i", "j", "c", "sketch").mapInPandas(compare_buckets(least), "u bigint, v bigint")
    for more in edges:
        found = found.unionByName(more)
    return found


def similar_groups(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 5, threshold: tuple[int, int] = (4, 5), recall: float = 0.99, lam: float = 0.7, limit: int = 256, depth: int = 4, block: int = 256) -> DataFrame:
    """One row for each row: id, key (of its text), class_id, n_links, class_key (the key of the row that names the class)."""
    num, den = threshold
    at = num / den
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    slim = docs.select(F.col(id).cast("long").alias("id"), key.alias("key"), F.col(text).alias("text"))
    rows = cut(slim.withColumn("s", set_rows(width)("text")).select("id", "key", "s.*"))
    worded = rows.where("n > 0")
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("key").alias("key"))
    classes = worded.groupBy("a", "b").agg(F.min(F.struct(place.alias("place"), F.col("n").alias("n"), F.col("sketch").alias("sketch"))).alias("x"), F.count("*").alias("copies"))
    classes = cut(classes.select(F.col("a").alias("c"), "a", "b", "copies", "x.*"))

    deviation = math.sqrt(at * (1 - at) / SKETCH)
    runs = runs_for(recall, at, lam, 3)
    edges = candidate_edges(classes, lam=lam, runs=runs, limit=limit, depth=depth, least=at - 4 * deviation)
    parts = components(edges)

    sizes = parts.groupBy("label").agg(F.count("*").alias("size"))
    members = parts.join(sizes, "label").select(F.col("node").alias("c"), F.col("label").alias("comp"), "size")
    asked = classes.join(members, "c").select("c", "copies", "comp", "size", F.col("place.id").alias("_id"), F.col("place.key").alias("_key"))
    asked = cut(asked)
    few = asked.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    held = slim.join(F.broadcast(asked) if few else asked, slim["id"].eqNullSafe(asked["_id"]) & (slim["key"] == asked["_key"]))
    held = held.dropDuplicates(["c"]).select("c", "copies", "comp", "size", whole_sets(width)("text").alias("tokens"))
    split = block_pairs(held, F.col("size"), F.xxhash64("c"), block).select("comp", "i", "j", "block", "c", "copies", "tokens")
    split = split.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    checked = cut(split.mapInPandas(verify(num, den), "c bigint, links bigint, to bigint"))
    groups = components(checked.where("c != to").select(F.col("c").alias("u"), F.col("to").alias("v")))
    links = checked.groupBy("c").agg(F.sum("links").alias("links"))

    named = classes.select("c", "a", "b", "copies", "place").join(groups.withColumnRenamed("node", "c"), "c", "left").join(links, "c", "left")
    named = cut(named.select("c", "a", "b", "place", F.coalesce("label", "c").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    names = named.groupBy("group").agg(F.min("place").alias("name"))
    named = named.join(names, "group").select("a", "b", "n_links", F.col("name.id").alias("class_id"), F.col("name.key").alias("class_key"))
    out = rows.select("id", "key", "a", "b", "n").join(named, ["a", "b"], "left")
    alone = F.col("n") == 0
    return out.select(
        "id",
        "key",
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(alone, F.col("key")).otherwise(F.col("class_key")).alias("class_key"),
    )


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group: the one that names it. Rows without words all stay."""
    groups = similar_groups(docs, id=id, text=text, **how)
    kept = groups.where(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key")))
    key, own, kept_id, kept_key = (fresh(name) for name in ("key", "own", "kept_id", "kept_key"))
    kept = kept.select(F.col("id").alias(kept_id), F.col("key").alias(kept_key)).distinct()
    told = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    met = told.join(kept, F.col(id).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key))).drop(kept_id, kept_key)
    # Rows that are repeated outright share id and text; those with words count as copies.
    blank = F.coalesce(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == ""
    return met.withColumn(own, F.when(blank, F.monotonically_increasing_id())).dropDuplicates([id, key, own]).drop(key, own)
