"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last 8 bytes ends a chunk wherever its lowest ``k`` bits
are all ones, so chunk ends follow from what stands around them and not from
their place. Each chunk is one symbol of 12 bits, from a hash of its bytes. A
text's ``k`` is the least (2 at least) with at most 64 chunks; its fingerprint is
``k:symbols at k:symbols at k + 1``, two characters a symbol. Two fingerprints
are compared where they have a scale in common: 1 less the edit distance of the
symbols over the longer length, the best of such scales; without a common scale
0. Equal fingerprints, those of empty texts too, are alike by 1.

``fingerprint_edits`` also builds each document's edited text, whose last third
comes from the next document in descending id order. Rows are dealt into
buckets of that order, whose bounds are keys that occur (a sample of at most
``SAMPLE`` keys, by hash), and the first row of each bucket, which is known from
its key, is also sent to the end of the bucket before. So every text is shuffled
once, and each bucket streams through a task with one text held back. Rows
repeated more than ``HOT`` times outright are counted before the shuffle: all
but the last have themselves as their next document.

Defined cases: a null text is empty; null ids come last, rows of one id go by a
hash of their text, and rows of equal id and text are neighbours; a single
document is its own next; an empty table gives no rows. Other columns, of any
name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenova.llm.common import SLICE_BYTES, cut

#: Rows that a bucket of the order has about, and keys that are sampled for its bounds: EACH for a bucket.
BUCKET, EACH, SAMPLE = 256, 8, 1 << 18
#: Rows repeated outright more often than this (those of the MOST_HOT commonest keys) travel as one.
HOT, MOST_HOT = 10_000, 4096
WINDOW, LEAST, MOST = 8, 2, 64
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Any fixed random numbers: one for each byte.
BYTES = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"
SYMBOLS = np.array([a + b for a in DIGITS for b in DIGITS], "S2")
ROW = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, times bigint"


def rolled(data: np.ndarray) -> np.ndarray:
    """A cyclic hash of the WINDOW bytes that end at each place."""
    h = BYTES[data]
    for step in (1, 2, 4):  # the hash of twice as many bytes from two of half as many
        back = np.zeros_like(h)
        back[step:] = h[:-step]
        h = h ^ ((back << np.uint32(step)) | (back >> np.uint32(32 - step)))
    return h >> np.uint32(4)  # so that the highest bits are never ones


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD and its inverse modulo 2**64, to the powers 0 to n - 1."""
    up, down = np.full(n, ODD), np.full(n, np.uint64(pow(int(ODD), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def fingerprints_of(raws: list[bytes]) -> list[str]:
    """The fingerprints of texts (UTF-8), with array operations over all of them at once."""
    gap = bytes(WINDOW)
    data = np.frombuffer(gap + gap.join(raws), np.uint8)
    sizes = np.array([len(r) for r in raws], np.int64)
    first = WINDOW + np.r_[0, np.cumsum(sizes[:-1] + WINDOW)].astype(np.int64)
    h = rolled(data)
    at = np.flatnonzero((h & 3) == 3)
    owner = np.searchsorted(first, at, "right") - 1
    inside = (owner >= 0) & (at < (first + sizes)[owner])
    at, owner = at[inside], owner[inside]
    flipped = ~h[at]
    level = np.log2((flipped & (np.uint32(0) - flipped)).astype(np.float64)).astype(np.int64)  # ones at the end
    counts = np.bincount(owner * 33 + level, minlength=33 * len(raws)).reshape(-1, 33)
    reached = counts[:, ::-1].cumsum(1)[:, ::-1]
    scale = np.maximum(LEAST, (reached >= MOST).sum(1))  # counts fall with the level

    up, down = powers(1 << int(max(len(data), SLICE_BYTES) + 1).bit_length())
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    parts = []
    for more in (0, 1):
        take = level >= scale[owner] + more
        ends = np.r_[at[take] + 1, (first + sizes)[sizes > 0]]  # what follows the last trigger is a chunk too
        of = np.r_[owner[take], np.flatnonzero(sizes > 0)]
        order = np.lexsort((ends, of))
        ends, of = ends[order], of[order]
        starts = np.r_[0, ends[:-1]]
        new = np.r_[True, of[1:] != of[:-1]][: len(of)]
        starts[new] = first[of[new]]
        full = ends > starts
        ends, of, starts = ends[full], of[full], starts[full]
        value = (total[ends] - total[starts]) * down[starts]
        value ^= value >> np.uint64(31)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        text = SYMBOLS[(value >> np.uint64(52)).astype(np.int64)].tobytes().decode()
        bounds = 2 * np.searchsorted(of, np.arange(len(raws) + 1))
        parts.append([text[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
    return [f"{k}:{a}:{b}" for k, a, b in zip(scale.tolist(), *parts)]


def sliced(raws: list[bytes]) -> list[str]:
    """``fingerprints_of`` in slices of bounded size; one longer text is a slice of its own."""
    out, i = [], 0
    while i < len(raws):
        j, size = i + 1, len(raws[i])
        while j < len(raws) and size + len(raws[j]) <= SLICE_BYTES:
            size += len(raws[j])
            j += 1
        out += fingerprints_of(raws[i:j])
        i = j
    return out


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements of symbols (two characters each) between two sequences, by bit-parallel columns."""
    a, b = [a[i : i + 2] for i in range(0, len(a), 2)], [b[i : i + 2] for i in range(0, len(b), 2)]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, last, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    rise, fall = full, 0  # where the column goes up and down by one
    for y in b:
        equal = where.get(y, 0)
        diagonal = (((equal & rise) + rise) ^ rise) | equal | fall
        across_up = fall | (full & ~(diagonal | rise))
        across_down = rise & diagonal
        distance += bool(across_up & last) - bool(across_down & last)
        across_up = (across_up << 1 | 1) & full
        across_down = (across_down << 1) & full
        rise = across_down | (full & ~(diagonal | across_up))
        fall = across_up & diagonal
    return distance


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, 0 to 1."""
    if a == b:
        return 1.0
    (ka, *xs), (kb, *ys) = a.split(":"), b.split(":")
    best = 0.0
    for x, i in zip(xs, (0, 1)):
        for y, j in zip(ys, (0, 1)):
            if int(ka) + i == int(kb) + j and (x or y):
                best = max(best, 1 - edit_distance(x, y) / (max(len(x), len(y)) // 2))
    return best


def order_key(id: Column, text: Column) -> Column:
    """A string that sorts as descending ids (nulls last) and then a hash of the text."""
    lift = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(id.isNull(), "1").otherwise("0"), lift(F.bitwise_not(F.coalesce(id, F.lit(0)))), lift(F.xxhash64(text)))


def bucket_of(key: Column, bounds: list[str]) -> Column:
    held = np.array([b.encode() for b in bounds], "S33")

    @F.arrow_udf("int")
    def find(keys: pa.Array) -> pa.Array:
        raw = np.array(keys.to_pylist(), "S33")
        return pa.array(np.searchsorted(held, raw, "right").astype(np.int32) - 1)

    return find(key)


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def described(rows: list[tuple]) -> pa.RecordBatch:
    """Results of rows (doc_id, text, next text, times)."""
    own = sliced([t.encode() for _, t, _, _ in rows])
    whole = [edited(t, u).encode() for _, t, u, _ in rows]
    changed = sliced(whole)
    # A row's next text is mostly the text of the row after it.
    later = [i for i in range(len(rows)) if i + 1 == len(rows) or rows[i + 1][1] is not rows[i][2]]
    following = [*own[1:], ""]
    for i, f in zip(later, sliced([rows[i][2].encode() for i in later])):
        following[i] = f
    cols = [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([len(r[1]) for r in rows], pa.int64()),
        pa.array([hashlib.sha256(w).hexdigest() for w in whole]),
        pa.array(own),
        pa.array(changed),
        pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, following)], pa.float64()),
        pa.array([r[3] for r in rows], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in ROW.split(", ")])


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, key, doc_id, text, times) of a sorted partition; each bucket ends with a row of times 0, the first of the next."""
    held, rows, size = None, [], 0
    for batch in batches:
        for bucket, doc, text, times in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "times"))):
            if held and held[0] == bucket:
                if held[3] > 1:
                    rows.append((held[1], held[2], held[2], held[3] - 1))
                rows.append((held[1], held[2], text, 1))
                size += len(held[2]) + len(text)
                if size >= SLICE_BYTES:
                    yield described(rows)
                    rows, size = [], 0
            held = (bucket, doc, text, times)
    if rows:
        yield described(rows)


def fingerprint_edits(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_chars, edited_sha256, the fingerprints of the text and the edited text, and how alike the text's is to the edited's and to the next document's."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = slim.withColumn("key", order_key(F.col("doc_id"), F.col("text")))
    keys = cut(slim.groupBy("key").agg(F.count("*").alias("n")))
    n_keys = keys.count()
    if not n_keys:
        return spark.createDataFrame([], ROW).drop("times")
    hot = [r["key"] for r in keys.where(F.col("n") > HOT).orderBy(F.desc("n"), "key").limit(MOST_HOT).collect()]
    asked = min(SAMPLE, max(1, n_keys // BUCKET) * EACH)
    sample = sorted(r["key"] for r in keys.orderBy(F.xxhash64("key"), "key").limit(asked).collect())
    bounds = sorted({keys.agg(F.min("key")).first()[0], *sample[EACH::EACH]})

    rows = slim.withColumn("times", F.lit(1).cast("long"))
    if hot:
        sent = F.broadcast(spark.createDataFrame([(k,) for k in hot], "key string"))
        once = slim.join(sent, "key", "left_semi").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("times"))
        rows = rows.join(sent, "key", "left_anti").unionByName(once.select("doc_id", "text", "key", "times"))
    rows = rows.withColumn("bucket", bucket_of(F.col("key"), bounds))

    # The first row of each bucket ends the bucket before; the very first ends the last.
    before = F.broadcast(spark.createDataFrame([(k, (i - 1) % len(bounds)) for i, k in enumerate(bounds)], "key string, bucket int"))
    ends = slim.join(before, "key").groupBy("bucket").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    ends = ends.select("doc_id", "text", F.lit("2").alias("key"), F.lit(0).cast("long").alias("times"), "bucket")
    flow = rows.unionByName(ends).repartition("bucket").sortWithinPartitions("bucket", "key")
    out = flow.select("bucket", "doc_id", "text", "times").mapInArrow(stream, ROW)
    if hot:
        out = out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("_")
    return out.drop("times")
