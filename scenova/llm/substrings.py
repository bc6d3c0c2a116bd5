"""Substring deduplication by content-defined chunks of a gear rolling hash.

A text is cut where its gear hash (over the last 16 bytes) is the largest
within ``reach`` bytes to either side, so that the cuts follow the content: an
insertion moves no cut outside its own surroundings. Chunks are between
``reach`` and LONGEST bytes long. Chunks of equal digest are duplicates; the
first one, by document id and place, stays. Neighbouring duplicate chunks whose
first ones are neighbours too, in one document, form a stretch. Since a
repeated passage begins and ends inside chunks, the two ends of a stretch are
then extended byte by byte, up to QUOTE bytes, against the text around the
chunks that stay; stretches of one document at one distance that meet are one
passage. A passage whose whole words, here and there, are ``min_words`` or more
leaves the text with the white space after it, so words on its two sides stay
two words. So every word that goes is in a passage of ``min_words`` words that
stands at one earlier place.

Sizes: a digest and a place travel for each chunk, twice, and each text travels
by its id, once to be quoted and once to be cleaned. What is left after each
step is written to the checkpoint folder, so that shuffle files of one step are
gone in the next. A digest that fills a third of all chunks is counted before
the shuffle and meets one row in the join, which Spark can split.

Defined cases: rows with equal id and equal text are one document, so each of
them keeps what that document keeps; rows with a null id come last and are told
apart by their text; null and empty texts stay as they are; a text all of which
is repeated becomes empty; an empty table stays empty.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenova.llm.common import cut, fresh, slices, utf8

GEAR_WINDOW = 16
LONGEST = 192
#: Bytes of the text around a stretch that its ends are held against.
QUOTE = 384
CHUNKS = "array<struct<digest:bigint,start:int,end:int>>"
STRETCHES = "array<struct<start:int,end:int,first_id:bigint,first_key:bigint,first_at:int>>"
QUOTES = "array<struct<first_at:int,size:int,before:binary,after:binary>>"
CLEANED = "struct<text:string,spans:array<struct<start:int,end:int>>>"

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BLANK = frozenset(b" \t\n\x0b\x0c\r")


def gear_table() -> np.ndarray:
    """A random number for each byte, from a fixed rule."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=2016) for b in range(256)], np.uint32)


GEAR = gear_table()


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: the last GEAR_WINDOW bytes, each shifted by its age. Windows are doubled, not rolled."""
    h = GEAR[data]
    n = 1
    while n < GEAR_WINDOW:
        older = np.zeros_like(h)
        older[n:] = h[:-n] << np.uint32(n)
        h = h + older
        n *= 2
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    return h ^ (h >> np.uint32(15))


def peaks(h: np.ndarray, reach: int) -> np.ndarray:
    """Places whose hash is the largest within ``reach`` to either side, ties included."""
    if len(h) <= 2 * reach:
        return np.zeros(0, np.int64)
    most, n = h, 1
    while 2 * n <= reach:  # most[i] = max(h[i : i + n])
        most = np.maximum(most[:-n], most[n:])
        n *= 2
    most = np.maximum(most[: len(h) - reach + 1], most[reach - n : reach - n + len(h) - reach + 1])
    here = h[reach:-reach]
    before, after = most[: len(here)], most[reach + 1 : reach + 1 + len(here)]
    return np.flatnonzero((here >= before) & (here >= after)) + reach


def cuts(data: np.ndarray, offsets: np.ndarray, reach: int) -> np.ndarray:
    """All chunk starts and text ends in ``data``, in order; texts end at ``offsets``."""
    at = peaks(gear(data), reach) + 1
    text = np.searchsorted(offsets, at, "right") - 1
    inside = (at - offsets[text] > GEAR_WINDOW + reach) & (offsets[np.minimum(text + 1, len(offsets) - 1)] - at >= reach)
    at, text = at[inside], text[inside]
    if len(at):
        # Text of a short period has a tie in each period; every so many of them are kept, counted from the first.
        fresh_one = np.r_[True, (np.diff(at) >= reach) | (np.diff(text) > 0)]
        first = np.flatnonzero(fresh_one)
        rank = np.arange(len(at)) - first[np.cumsum(fresh_one) - 1]
        period = np.maximum(at[np.minimum(first + 1, len(at) - 1)] - at[first], 1)
        step = np.maximum(-(-reach // period), 1)
        at = at[rank % step[np.cumsum(fresh_one) - 1] == 0]
    at = np.unique(np.r_[offsets, at])
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > LONGEST)
    if len(wide):
        more = [np.arange(at[i] + LONGEST, at[i + 1], LONGEST) for i in wide]
        at = np.unique(np.concatenate([at, *more]))
    return at


def chunk_column(text: Column, reach: int, min_words: int) -> Column:
    """Chunks of each text. Texts too short for ``min_words`` words have none."""

    @F.arrow_udf(CHUNKS)
    def chunk(texts: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        counts, digests, starts, ends = [], [], [], []
        for i, j in slices(offsets):
            base = offsets[i]
            part, where = data[base : offsets[j]], offsets[i : j + 1] - base
            at = cuts(part, where, reach)
            raw = part.tobytes()
            edges = at.tolist()
            digests.append(np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(edges[:-1], edges[1:])], np.uint64).view(np.int64))
            first = np.searchsorted(at, where)
            counts.append(np.diff(first))
            begin = np.repeat(where[:-1], counts[-1])
            starts.append((at[:-1] - begin).astype(np.int32))
            ends.append((at[1:] - begin).astype(np.int32))
        if not counts:
            counts, digests, starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        count = np.concatenate(counts)
        rows = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (digests, starts, ends)], ["digest", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), rows)

    # ``min_words`` words and the blanks between them need this many bytes.
    return F.when(F.octet_length(text) >= 2 * min_words - 1, chunk(text))


def stretches(marks: pa.Array) -> pa.Array:
    """Neighbouring duplicate chunks whose first ones are neighbours in one document, put together."""
    counts, rows = [0], []
    for held in marks.to_pylist():
        held.sort(key=lambda c: c["start"])
        for k, c in enumerate(held):
            last = rows[-1] if k else None
            if k and c["start"] == last["end"] and (c["first_id"], c["first_key"]) == (last["first_id"], last["first_key"]) and c["first_at"] - last["first_at"] == c["start"] - last["start"]:
                last["end"] = c["end"]
            else:
                rows.append(c)
        counts.append(len(rows))
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_id", pa.int64()), ("first_key", pa.int64()), ("first_at", pa.int32())])
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(rows, kind))


def quotes(texts: pa.Array, asked: pa.Array) -> pa.Array:
    """Up to QUOTE bytes before and after each asked piece of a text."""
    data, offsets = utf8(texts)
    counts, rows = [0], []
    for k, places in enumerate(asked.to_pylist()):
        raw = data[offsets[k] : offsets[k + 1]].tobytes()
        for p in places:
            at, end = p["first_at"], p["first_at"] + p["size"]
            rows.append(p | {"before": raw[max(0, at - QUOTE) : at], "after": raw[end : end + QUOTE]})
        counts.append(len(rows))
    kind = pa.struct([("first_at", pa.int32()), ("size", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(rows, kind))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(np.argmax(differ))


def reached(own: bytes, quote: bytes) -> tuple[int, bool]:
    """How far two texts agree from one point on, and whether a word of the quoted one ends there."""
    n = common_prefix(own, quote)
    return n, quote[n] in BLANK if n < len(quote) else len(quote) < QUOTE


def repeated_spans(raw: bytes, held: list[dict], min_words: int) -> list[tuple[int, int]]:
    """Byte spans (whole words and the white space after them) that stand earlier, from stretches and quotes."""
    by_source: dict[tuple, list[tuple[int, int, bool, bool]]] = {}
    for s in held:
        left, starts = reached(raw[max(0, s["start"] - QUOTE) : s["start"]][::-1], s["before"][::-1])
        right, stops = reached(raw[s["end"] : s["end"] + QUOTE], s["after"])
        by_source.setdefault((s["first_id"], s["first_key"], s["start"] - s["first_at"]), []).append((s["start"] - left, s["end"] + right, starts, stops))
    passages = []
    for found in by_source.values():
        met: list[list] = []
        for a, b, starts, stops in sorted(found):
            if met and a <= met[-1][1]:
                if b > met[-1][1]:
                    met[-1][1], met[-1][3] = b, stops
                elif b == met[-1][1]:
                    met[-1][3] |= stops
            else:
                met.append([a, b, starts, stops])
        for a, b, starts, stops in met:
            # A word at an edge counts only if it is whole in both texts.
            if a < b and raw[a] not in BLANK and not (starts and (a == 0 or raw[a - 1] in BLANK)):
                while a < b and raw[a] not in BLANK:
                    a += 1
            if a < b and raw[b - 1] not in BLANK and not (stops and (b == len(raw) or raw[b] in BLANK)):
                while a < b and raw[b - 1] not in BLANK:
                    b -= 1
            words = [m.span() for m in WORD.finditer(raw, a, b)]
            if len(words) >= min_words:
                passages.append((words[0][0], words[-1][1]))
    spans: list[tuple[int, int]] = []
    for a, b in sorted(passages):
        while b < len(raw) and raw[b] in BLANK:
            b += 1
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b))
        else:
            spans.append((a, b))
    return spans


def without_repeats(text: Column, held: Column, min_words: int) -> Column:
    @F.arrow_udf(CLEANED)
    def clean(texts: pa.Array, known: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        out = []
        for k, (text, held) in enumerate(zip(texts.to_pylist(), known.to_pylist())):
            spans = []
            if held:
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                spans = repeated_spans(raw, held, min_words)
                if spans:
                    edges = [0, *(x for s in spans for x in s), len(raw)]
                    text = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
            out.append({"text": text, "spans": [{"start": a, "end": b} for a, b in spans]})
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.array(out, pa.struct([("text", pa.string()), ("spans", pa.list_(span))]))

    # Else a filter on the result would be pushed below it and clean every text twice.
    return clean.asNondeterministic()(text, held)


def drop_repeated_passages(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_words: int = 50, reach: int = 24, spans: str = "repeated_spans") -> DataFrame:
    """``docs`` with repeated passages taken out of ``text`` and their spans (bytes of the text before) in column ``spans``, which replaces one of that name."""
    key, name = fresh("key"), fresh("id")
    body = F.col(text)
    told = docs.withColumns({name: F.col(id).cast("long"), key: F.when(F.col(id).isNull(), F.xxhash64(body)).otherwise(F.hash(body).cast("long"))})
    slim = told.select(F.col(name).alias("id"), F.col(key).alias("key"), body.alias("text"))

    chunks = slim.select("id", "key", F.explode(chunk_column(F.col("text"), reach, min_words)).alias("c")).select("id", "key", "c.*")
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("i"), F.col("key").alias("k"), F.col("start").alias("s"))
    firsts = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("f")).where("n > 1")
    # Written first, so that both sides of the join are plain exchanges and Spark can split a hot digest.
    firsts = cut(firsts.select("digest", F.col("f.i").alias("first_id"), F.col("f.k").alias("first_key"), F.col("f.s").alias("first_at")))
    later = ~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")) & (F.col("start") == F.col("first_at")))
    marks = chunks.join(firsts, "digest").where(later)

    # Sets, since rows that are repeated outright mark the same places.
    by_doc = marks.groupBy("id", "key").agg(F.collect_set(F.struct("start", "end", "first_id", "first_key", "first_at")).alias("marks"))
    held = by_doc.select("id", "key", F.explode(F.arrow_udf(stretches, STRETCHES)("marks")).alias("s")).select("id", "key", "s.*", (F.col("s.end") - F.col("s.start")).alias("size"))
    held = cut(held)

    asked = held.groupBy("first_id", "first_key").agg(F.collect_set(F.struct("first_at", "size")).alias("asked"))
    met = slim.join(asked, slim["id"].eqNullSafe(asked["first_id"]) & (slim["key"] == asked["first_key"]))
    quoted = met.select("first_id", "first_key", F.explode(F.arrow_udf(quotes, QUOTES)("text", "asked")).alias("q")).select("first_id", "first_key", "q.*")
    quoted = cut(quoted.dropDuplicates(["first_id", "first_key", "first_at", "size"]))  # rows with equal id and text
    right = quoted.select(*[F.col(c).alias(f"_{c}") for c in quoted.columns])
    same = held["first_id"].eqNullSafe(right["_first_id"]) & (held["first_key"] == right["_first_key"]) & (held["first_at"] == right["_first_at"]) & (held["size"] == right["_size"])
    known = held.join(right, same).groupBy("id", "key").agg(F.collect_list(F.struct("start", "end", "first_id", "first_key", "first_at", F.col("_before").alias("before"), F.col("_after").alias("after"))).alias("known"))

    cleaned, known_name, known_id, known_key = (fresh(c) for c in ("cleaned", "known", "known_id", "known_key"))
    known = cut(known).select(F.col("id").alias(known_id), F.col("key").alias(known_key), F.col("known").alias(known_name))
    out = told.join(known, F.col(name).eqNullSafe(F.col(known_id)) & (F.col(key) == F.col(known_key)), "left")
    out = out.withColumn(cleaned, without_repeats(F.col(text), F.col(known_name), min_words))
    out = out.withColumns({text: F.col(cleaned)["text"], spans: F.col(cleaned)["spans"]})
    return out.select(*dict.fromkeys([*docs.columns, spans]))
