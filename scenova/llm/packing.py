"""Best-fit packing of token sequences by exact-complement hashing.

1. Every text is tokenized whole; its pieces (of at most ``size`` tokens) are
   written once to the checkpoint folder without their tokens.
2. The counts of pieces by length (at most ``size`` numbers, whatever the input)
   go to the driver, which plans patterns: lists of lengths with a number of
   repetitions. The longest open length first takes what fills its gap exactly:
   one length, a pair or a triple, looked up among the sums of available
   lengths; without such, the longest length that fits (best fit), and so on.
   A pattern is repeated as often as the counts allow, so the plan has a size
   that depends on ``size`` and not on the number of documents.
3. Each piece gets its rank among the pieces of its length (counts of hash
   buckets, summed up, plus a rank inside the bucket, so a length that holds a
   third of all rows is still dealt over many tasks, as are rows that are
   repeated outright) and from the plan its sequence and its place there. The
   counts of buckets are summed up in two levels.

Defined cases: a null text is empty and has the end id alone; null ids stay null.
Very long texts are cut into pieces, none is dropped. Pieces of equal length are
interchangeable: which one goes where follows from a hash of their place. Rows
with equal ids and texts are packed each on its own. Other columns, of any name,
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenova.llm.common import cut, slices, utf8

PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"

#: Characters whose lower case (itself admitted), normal form and class (letter, number, other) are plain; other texts go to the library whole.
PLAIN = re.compile("[^\t\n\r -~\xa1-\xac\xae-\u012f\u0131-\u017f]")
#: The pre-token classes of the vocabulary, for plain characters.
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-zA-Z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\u017f]+")


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes; words are encoded once and kept in a bounded cache."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Words are in normal form and cut already, so the merges alone are left to the library.
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.merges.get_vocab(), self.merges.model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of single pre-tokens, many in one call: white space keeps them apart and has no ids, and a word's last id says so."""
        out = []
        for i in range(0, len(words), 200):
            ids = np.array(self.merges.encode(" ".join(words[i : i + 200]), add_special_tokens=False).ids, "<u4")
            raw = ids.tobytes()
            ends = np.r_[0, np.flatnonzero(self.last[ids]) + 1] * 4
            out += [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        found = [None if PLAIN.search(t) or any(s in t for s in self.special) else WORD.findall(t.lower()) for t in texts]
        met = set().union(*(w for w in found if w))
        new = list(met.difference(self.known))
        if new:
            if len(self.known) + len(new) > self.most:  # words of these texts stay, the others go
                self.known = {w: self.known[w] for w in met.intersection(self.known)}
            self.known.update(zip(new, self.words(new), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) if words is not None else self.whole([text])[0] for words, text in zip(found, texts)]


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(text: Column, path: str, size: int, end_id: int) -> Column:
    """Array of the pieces of each text: its ids and ``end_id``, cut every ``size`` ids."""
    end = np.array([end_id], "<u4").tobytes()

    @F.arrow_udf(PIECES)
    def split(texts: pa.Array) -> pa.Array:
        held = encoder(path)
        _, offsets = utf8(texts)
        ends, start, length, crc = [0], [], [], []
        for i, j in slices(offsets):
            for ids in held.ids([t or "" for t in texts[i:j].to_pylist()]):
                ids += end
                for at in range(0, len(ids), 4 * size):
                    part = ids[at : at + 4 * size]
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                ends.append(len(start))
        start = np.array(start, np.int64)
        rows = pa.StructArray.from_arrays([pa.array(start // size, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["piece", "start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return split(text)


@dataclass
class Plan:
    """Pieces of ``length`` with ranks from ``first``, ``times`` of them, go to sequences from ``sequence`` on, at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


class Complements:
    """Lengths still available, and an index from sums to the pairs and triples of lengths that make them.

    ``pair_of[s]`` and ``triple_of[s]`` hold the largest length of such a pair or
    triple, 0 where there is none. Counts only fall, so an entry is checked when
    it is used and found anew when its lengths are spent.
    """

    def __init__(self, counts: np.ndarray, size: int):
        self.left, self.size = counts.copy(), size
        self.left[0] = 0
        self.pair_of, self.triple_of = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        lengths = np.flatnonzero(self.left)
        for a in lengths.tolist():
            small = lengths[(lengths < a + (self.left[a] > 1)) & (lengths <= size - a)]
            self.pair_of[a + small] = a
        for a in lengths.tolist():
            self.triple_of[a + np.flatnonzero(self.pair_of[: size + 1 - a])] = a

    def spend(self, parts: list[int], times: int) -> None:
        for p in parts:
            self.left[p] -= times

    @staticmethod
    def largest_pair(total: int, left: np.ndarray) -> int:
        """The largest of two lengths in ``left`` that make ``total``, 0 if there are none."""
        both = (left[: total + 1] > 0) & (left[total::-1] > 0)
        if total % 2 == 0 and left[total // 2] < 2:
            both[total // 2] = False
        found = np.flatnonzero(both)
        return int(found[-1]) if len(found) else 0

    def pair(self, total: int, free: np.ndarray) -> list[int] | None:
        """Two lengths of ``free`` (those left, less what the open sequence has) that make ``total``."""
        if not (a := int(self.pair_of[total])):
            return None
        b = total - a
        if free[a] <= 0 or free[b] <= (a == b):
            self.pair_of[total] = self.largest_pair(total, self.left)
            a = self.largest_pair(total, free)
        return [a, total - a] if a else None

    def triple(self, total: int, free: np.ndarray) -> list[int] | None:
        """Three lengths of ``free`` that make ``total``, of all there are."""
        if not self.triple_of[total]:
            return None
        first = np.flatnonzero((self.left[: total + 1] > 0) & (self.pair_of[total::-1] > 0))
        self.triple_of[total] = first[-1] if len(first) else 0
        for a in first[::-1].tolist():
            if free[a] > 0:
                free[a] -= 1
                two = self.pair(total - a, free)
                free[a] += 1
                if two:
                    return [a, *two]
        return None

    def fill(self, gap: int, used: list[int]) -> list[int] | None:
        """One, two or three lengths that make the gap exactly."""
        free = self.left.copy()
        for p in used:
            free[p] -= 1
        return [gap] if free[gap] > 0 else self.pair(gap, free) or self.triple(gap, free)


def plan_packing(counts: np.ndarray, size: int) -> Plan:
    """``counts[n]``: pieces of length n, up to ``size``."""
    have = Complements(counts, size)
    length, first, sequence, offset = [], [], [], []
    taken = np.zeros(size + 1, np.int64)
    made = 0
    for longest in range(size, 0, -1):
        while have.left[longest]:
            parts, gap = [longest], size - longest
            while gap:
                if found := have.fill(gap, parts):
                    parts += found
                    break
                fits = np.flatnonzero(have.left[1 : gap + 1] - np.bincount(np.array(parts), minlength=size + 1)[1 : gap + 1] > 0)
                if not len(fits):
                    break
                parts.append(int(fits[-1]) + 1)
                gap -= parts[-1]
            times = int(min(have.left[p] // parts.count(p) for p in parts))
            have.spend(parts, times)
            at = 0
            for p in parts:
                length.append(p)
                first.append(taken[p])
                sequence.append(made)
                offset.append(at)
                taken[p] += times
                at += p
            made += times
    length, first, sequence, offset = (np.array(x, np.int64) for x in (length, first, sequence, offset))
    order = np.lexsort((first, length))
    return Plan(length[order], first[order], sequence[order], offset[order], made)


def place(plan: Plan, length: Column, rank: Column) -> Column:
    """Struct of sequence_id and offset for the piece of this length and rank."""
    wide = np.int64(1) << 48
    keys = plan.length * wide + plan.first

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def find(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        n, r = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, n * wide + r, "right") - 1
        return pa.StructArray.from_arrays([pa.array(plan.sequence[at] + r - plan.first[at]), pa.array(plan.offset[at])], ["sequence_id", "offset"])

    return find(length, rank)


def pack(docs: DataFrame, *, path: str, id: str = "doc_id", text: str = "text", size: int = 4096, end_id: int = 1, bucket_rows: int = 500) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id).alias("doc_id"), F.explode(pieces(F.col(text), path, size, end_id)).alias("p"))
    # The written rows keep their order, so their numbers are the same whenever they are read.
    rows = cut(rows.select("doc_id", "p.*")).withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))

    counts = np.zeros(size + 1, np.int64)
    for n, c in rows.groupBy("length").count().collect():  # at most ``size`` rows
        counts[n] = c
    plan = plan_packing(counts, size)

    # The fullest length sets how many buckets each length has; empty ones cost nothing.
    buckets = int(min(1 << 30, max(1, -(-int(counts.max()) // bucket_rows))))
    rows = rows.withColumn("bucket", F.pmod("spread", F.lit(buckets)))
    rows = rows.withColumn("inside", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("spread")) - 1)
    rows = rows.join(before_buckets(rows.groupBy("length", "bucket").count()), ["length", "bucket"])
    rows = rows.withColumn("at", place(plan, F.col("length"), F.col("before") + F.col("inside")))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def before_buckets(sizes: DataFrame, fan: int = 4096) -> DataFrame:
    """(length, bucket, before): how many rows of the length are in earlier buckets, ``fan`` of which are summed up together."""
    sizes = sizes.withColumn("high", F.floor(F.col("bucket") / fan))
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("length", "high").agg(F.sum("count").alias("n"))
    groups = groups.select("length", "high", before(Window.partitionBy("length").orderBy("high"), "n").alias("base"))
    within = sizes.withColumn("near", before(Window.partitionBy("length", "high").orderBy("bucket"), "count"))
    return within.join(groups, ["length", "high"]).select("length", "bucket", (F.col("base") + F.col("near")).alias("before"))
