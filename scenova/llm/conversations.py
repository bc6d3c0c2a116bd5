"""Repair of conversation structure by a min-plus matrix scan.

Roles must read ``(s?(ua)+)?`` by their initials. Four states say what has been
put out so far: nothing, s, u, a. A turn is a 4x4 matrix over (cost, audit)
pairs: entry (i, j) is the cheapest way to get from state i to state j by its
keeping, its new role or its deletion, after any insertions. Sums are minima of
pairs, products add costs and join audits; of equal costs the audit that is
ASCII-least wins. The product is associative. (Two audits of one cost and one
pair of states are never one the beginning of the other: the letters after the
common part would all be insertions, which cost.) So a conversation's matrix is
reduced as a tree, and the closing insertions end it.

Conversations of up to ``most_rows`` turns and ``most_bytes`` are solved whole
as they stream by, sorted, in a partition dealt by conversation. Longer ones
are cut into blocks across partitions: ordered by ranges, numbered, repeats told
by the least number of equal turns, one matrix for each block, and blocks merged
``FAN`` at a time. Their texts pass once more, in order, to the checksum of the
repaired conversation, which no partition holds whole.

Defined cases: a null id is a conversation of its own; null roles and texts are
one space; null turns come first; rows of one turn go by role and text; rows
repeated outright are duplicates of the first; a role is known by its first
character, and what is neither s, u nor a can't be kept; a conversation without
rows left has zeros, an empty audit and the checksum of no bytes. An empty table
gives no rows. Other columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenova.llm.common import cut

BLANK = " \t\n\x0b\x0c\r"
KEEP, ROLE, DELETE, INSERT = "K", "R", "D", "I"
COST_ROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 3, 4, 3, 3
#: States: nothing, s, u, a. What a new or kept turn of a role leads to, by state.
TURN = (2, 2, 3, 2)
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
WORDS = {2: "user", 3: "assistant"}
#: Blocks merged at once, and turns in a block (a power of two).
FAN, BLOCK = 64, 1 << 11
#: Up to so many long conversations their ids are sent to every task.
SENT = 100_000

Matrix = tuple[tuple[tuple[int, str] | None, ...], ...]
REPAIRED = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def better(a: tuple[int, str] | None, b: tuple[int, str] | None) -> tuple[int, str] | None:
    return b if a is None else a if b is None else min(a, b)


def times(x: Matrix, y: Matrix) -> Matrix:
    """The min-plus product."""
    return tuple(
        tuple(min(((a[0] + y[k][j][0], a[1] + y[k][j][1]) for k, a in enumerate(row) if a and y[k][j]), default=None) for j in range(4))
        for row in x
    )


def insertions() -> Matrix:
    """The closure of insertions: none, one or two turns (a third never pays)."""
    rows = []
    for i in range(4):
        row: list[tuple[int, str] | None] = [None] * 4
        row[i] = (0, "")
        at = i
        for n in (1, 2):
            at = TURN[at]
            row[at] = better(row[at], (n * COST_INSERT, n * INSERT))
        rows.append(tuple(row))
    return tuple(rows)


CLOSURE = insertions()
NONE: Matrix = tuple(tuple((0, "") if i == j else None for j in range(4)) for i in range(4))


@lru_cache(maxsize=64)
def turn_matrix(kind: str) -> Matrix:
    """``kind``: x for turns that must go, else the initial (o for others), in upper case if truncated."""
    extra, initial = COST_TRUNCATED * kind.isupper(), kind.lower()
    rows = []
    for i in range(4):
        row: list[tuple[int, str] | None] = [None] * 4
        row[i] = (COST_DELETE, DELETE)
        if initial != "x":
            row[TURN[i]] = better(row[TURN[i]], (COST_ROLE + extra, ROLE))
            if (j := KEPT.get(initial, {}).get(i)) is not None:
                row[j] = better(row[j], (extra, KEEP))
        rows.append(tuple(row))
    return times(CLOSURE, tuple(rows))


def tree(parts: list[Matrix]) -> Matrix:
    """The product of matrices, neighbours first."""
    while len(parts) > 1:
        parts = [times(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else NONE


@lru_cache(maxsize=200_000)
def block_matrix(kinds: str) -> Matrix:
    return tree([turn_matrix(k) for k in kinds])


def closing(whole: Matrix) -> tuple[int, str]:
    """Cost and audit from nothing to nothing or to a turn of the assistant."""
    ends = times((whole[0],), CLOSURE)[0]
    return better(ends[0], ends[3]) or (0, "")


def kinds_of(initials: list[str], must_go: list[bool], truncated: list[bool]) -> str:
    out = []
    for i, gone, short in zip(initials, must_go, truncated):
        k = "x" if gone else i if i in ("s", "u", "a") else "o"
        out.append(k.upper() if short and not gone else k)
    return "".join(out)


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


class Writer:
    """The repaired turns, put through a checksum as an audit is followed."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first, self.digest = audit, 0, 0, True, hashlib.sha256()

    def put(self, role: str, text: str) -> None:
        self.digest.update((("" if self.first else "\n") + role + ":" + text).encode())
        self.first = False

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            self.state = TURN[self.state]
            self.put(WORDS[self.state], "")

    def turn(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = KEPT[role[:1]][self.state]
            self.put(role, text)
        elif edit == ROLE:
            self.state = TURN[self.state]
            self.put(WORDS[self.state], text)

    def end(self) -> str:
        self.insert()
        return self.digest.hexdigest()


def damaged(turns: DataFrame, *, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, gone) after damage drawn from a checksum of conversation and turn; dropped rows stay, marked ``gone``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    held = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw").isin(0, 1), F.lit("")).when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role"))
    times_over = F.when(F.col("draw") == 3, 2).otherwise(1)
    return held.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("draw") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), times_over)).alias("_")).drop("_")


def flags(rows: DataFrame) -> DataFrame:
    """``rows`` with ``blank`` and ``short``: whether a text has nothing but blanks, or ends without [.!?]."""
    body = F.rtrim(F.col("text"), F.lit(BLANK))
    return rows.withColumns({"blank": body == "", "short": (body != "") & ~F.substring(body, -1, 1).isin(".", "!", "?")})


def solved(conv, rows: list[tuple]) -> tuple:
    """One conversation from its rows (turn, role, text, gone, blank, short), in order."""
    rows = [r for r in rows if not r[3]]
    seen, again = set(), []
    for _, role, text, *_ in rows:
        again.append((role, text) in seen)
        seen.add((role, text))
    blank = [r[4] for r in rows]
    duplicate = [d and not b for d, b in zip(again, blank)]
    short = [r[5] and not d for r, d in zip(rows, duplicate)]
    initials = [r[1][:1] for r in rows]
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(not legal(a, b) for a, b in zip(initials, initials[1:]))
    cost, audit = closing(block_matrix(kinds_of(initials, [b or d for b, d in zip(blank, duplicate)], short)))
    out = Writer(audit)
    for _, role, text, *_ in rows:
        out.turn(role, text)
    return conv, gaps, sum(blank), sum(duplicate), sum(short), illegal, cost, audit, out.end()


def stream_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of a sorted partition, one after the other."""
    names = [f.split()[0] for f in REPAIRED.split(", ")]
    conv, rows, out = None, [], []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out))
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    for batch in batches:
        for c, *row in zip(*(batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "gone", "blank", "short"))):
            if rows and c != conv:
                out.append(solved(conv, rows))
                rows = []
            conv = c
            rows.append(row)
        if len(out) >= 2000:
            yield flush()
            out = []
    if rows:
        out.append(solved(conv, rows))
    if out:
        yield flush()


def pack_matrix(m: Matrix) -> tuple[list[int | None], list[str | None]]:
    flat = [e for row in m for e in row]
    return [e and e[0] for e in flat], [e and e[1] for e in flat]


def unpack_matrix(costs, audits) -> Matrix:
    flat = [None if a is None else (int(c), a) for c, a in zip(costs, audits)]
    return tuple(tuple(flat[4 * i : 4 * i + 4]) for i in range(4))


PARTS = "conv bigint, part bigint, costs array<bigint>, audits array<string>, head string, tail string, illegal bigint, blank bigint, duplicate bigint, truncated bigint"
PART_COLUMNS = [f.split()[0] for f in PARTS.split(", ")]


def block_part(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The matrix of a block and what its neighbours need to know of it."""
    pdf = pdf.sort_values("seq")
    initials, gone = pdf["initial"].tolist(), (pdf["blank"] | pdf["duplicate"]).tolist()
    matrix = tree([turn_matrix(k) for k in kinds_of(initials, gone, pdf["short"].tolist())])
    illegal = sum(not legal(a, b) for a, b in zip(initials, initials[1:]))
    row = (key[0], key[1], *pack_matrix(matrix), initials[0], initials[-1], illegal, *(int(pdf[c].sum()) for c in ("blank", "duplicate", "short")))
    return pd.DataFrame([row], columns=PART_COLUMNS)


def merge_parts(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("part")
    matrix = tree([unpack_matrix(c, a) for c, a in zip(pdf["costs"], pdf["audits"])])
    across = sum(not legal(a, b) for a, b in zip(pdf["tail"].tolist(), pdf["head"].tolist()[1:]))
    row = (key[0], key[1], *pack_matrix(matrix), pdf["head"].iloc[0], pdf["tail"].iloc[-1], int(pdf["illegal"].sum()) + across, *(int(pdf[c].sum()) for c in ("blank", "duplicate", "truncated")))
    return pd.DataFrame([row], columns=PART_COLUMNS)


def stream_checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The checksum of each repaired conversation; its audit comes before its turns."""
    conv, out = None, None
    for batch in batches:
        found = []
        for c, first, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "first", "role", "text"))):
            if first == 0:
                if out:
                    found.append((conv, out.end()))
                conv, out = c, Writer(text)
            else:
                out.turn(role, text)
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], ["conv", "sha"])
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([out.end()], pa.string())], ["conv", "sha"])


def repair_long(rows: DataFrame, block: int, fan: int) -> DataFrame:
    """Conversations that are cut into blocks; ``rows`` (conv, turn, role, text) hold no dropped ones."""
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    slim = flags(rows).select("conv", "turn", "role", F.col("text"), "blank", "short", digest.alias("digest"), F.monotonically_increasing_id().alias("salt"))
    # Ranges keep the order of all turns and cut through a conversation where it is long.
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("salt")]
    slim = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "blank", "short", "digest", F.substring("role", 1, 1).alias("initial"), F.monotonically_increasing_id().alias("seq"))
    slim = cut(slim)
    firsts = slim.groupBy(F.col("conv").alias("c0"), F.col("digest").alias("d0")).agg(F.min("seq").alias("first"))
    told = slim.join(firsts, F.col("conv").eqNullSafe(F.col("c0")) & (F.col("digest") == F.col("d0"))).withColumn("again", F.col("seq") != F.col("first"))
    told = told.withColumn("duplicate", F.col("again") & ~F.col("blank")).withColumn("short", F.col("short") & ~F.col("duplicate"))
    told = told.withColumn("part", F.expr(f"seq DIV {block}"))
    parts = cut(told.select("conv", "part", "seq", "initial", "blank", "duplicate", "short").groupBy("conv", "part").applyInPandas(block_part, PARTS))

    # Blocks get gapless numbers in their conversation, and then FAN neighbours are merged until one is left.
    places = parts.groupBy(F.col("conv").alias("c0")).agg(F.sort_array(F.collect_list("part")).alias("parts"))
    places = places.select("c0", F.posexplode("parts").alias("at", "p0"))
    parts = parts.join(places, F.col("conv").eqNullSafe(F.col("c0")) & (F.col("part") == F.col("p0")))
    parts = parts.withColumn("part", F.col("at").cast("long")).select(*PART_COLUMNS)
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        grouped = parts.withColumn("over", F.expr(f"part DIV {fan}")).groupBy("conv", "over")
        parts, left = grouped.applyInPandas(merge_parts, PARTS), -(-left // fan)

    @F.udf("struct<cost:bigint,audit:string>", useArrow=False)
    def close(costs: list, audits: list) -> tuple[int, str]:
        return closing(unpack_matrix(costs, audits))

    ended = cut(parts.withColumn("end", close("costs", "audits")).select("conv", "illegal", "blank", "duplicate", "truncated", "end.cost", "end.audit"))
    heads = ended.select("conv", F.lit(0).alias("first"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    bodies = rows.select("conv", F.lit(1).alias("first"), "turn", "role", "text")
    flow = heads.unionByName(bodies).repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "first", F.asc_nulls_first("turn"), "role", "text")
    sums = flow.select("conv", "first", "role", "text").mapInArrow(stream_checksums, "conv bigint, sha string")
    spans = slim.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    spans = spans.select(F.col("conv").alias("c1"), F.coalesce("gaps", F.lit(0)).alias("gaps"))
    sums = sums.select(F.col("conv").alias("c2"), "sha")
    met = ended.join(spans, F.col("conv").eqNullSafe(F.col("c1"))).join(sums, F.col("conv").eqNullSafe(F.col("c2")))
    return met.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def repair(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most_rows: int = 4096, most_bytes: int = 8 << 20, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row for each conversation of ``turns``, damaged and repaired: the columns of REPAIRED."""
    rows = damaged(turns, conv=conv, turn=turn, role=role, text=text)
    sizes = rows.groupBy("conv").agg(F.count_if(~F.col("gone")).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = cut(sizes.where((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select(F.col("conv").alias("long_conv")))
    n_long = long.limit(SENT + 1).count()
    is_long = F.col("conv").eqNullSafe(F.col("long_conv"))
    named = F.broadcast(long) if n_long <= SENT else long
    short = flags(rows.join(named, is_long, "left_anti") if n_long else rows)
    short = short.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text")
    out = short.select("conv", "turn", "role", "text", "gone", "blank", "short").mapInArrow(stream_short, REPAIRED)
    if n_long:
        out = out.unionByName(repair_long(rows.where(~F.col("gone")).join(named, is_long, "left_semi"), block, fan))
    return out

