"""Exact token counts of byte-level BPE vocabularies, by rank-synchronous merging.

Texts are cut into pre-tokens; distinct pre-tokens that a worker has not met
yet are merged together, as one ragged array: in each round every sequence
applies its own lowest-rank pair at all places at once, until no sequence has
a pair left. Pre-tokens of more than LONG bytes (text without blanks) go
through the ranks in step instead, each round at the places of one rank alone,
so that their time is nearly in proportion to their length. The counts of
surviving symbols are kept in a bounded cache, long pre-tokens excepted.

Defined cases: null and empty texts have 0 tokens; repeated rows give equal
counts; very long texts are counted whole, in slices; output columns replace
input columns of the same name; an empty table stays empty.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenova.llm.common import slices, text_bytes, utf8

#: The pre-token pattern that byte-level vocabularies of this family are built on.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = np.int64(1) << 40
LONG = 256


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Merger:
    """Merge table of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        vocab = held["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], np.arange(len(keys))[order], made[order]
        self.special = [t["content"] for t in held["added_tokens"]]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE where there is no merge) and what it becomes."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols of each word that survive all merges."""
        long = np.array([len(w) > LONG for w in words], bool)
        out = np.zeros(len(words), np.int64)
        for those, run in ((~long, self.count_by_rounds), (long, self.count_by_ranks)):
            if those.any():
                out[those] = run([words[i] for i in np.flatnonzero(those)])
        return out

    def count_by_ranks(self, words: list[bytes]) -> np.ndarray:
        """All sequences in step: the places of the lowest rank that any of them holds, then of the next one."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n, ends = len(symbols), np.cumsum(lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - lengths] = n, -1  # n and -1: nothing there
        ranks = np.full(n, NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray) -> None:
            """Ranks of the pairs that begin at these places, dealt to the ranks' lists."""
            ranks[places] = NONE
            places = places[after[places] < n]
            rank, _ = self.look_up(symbols[places], symbols[after[places]])
            ranks[places] = rank
            places, rank = places[rank < NONE], rank[rank < NONE]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            edges = np.r_[0, np.flatnonzero(np.diff(rank)) + 1, len(rank)] if len(rank) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                r = int(rank[a])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(places[a:b])

        note(np.arange(n))
        alive = np.ones(n, bool)
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (ranks[at] == r)]
            if not len(at):
                continue
            # In a run of overlapping equal pairs every second one, from the left, merges.
            new = np.r_[True, after[at[:-1]] != at[1:]]
            starts = np.flatnonzero(new)
            at = at[(np.arange(len(at)) - starts[np.cumsum(new) - 1]) % 2 == 0]
            gone = after[at]
            symbols[at] = self.look_up(symbols[at[:1]], symbols[gone[:1]])[1]
            alive[gone] = False
            after[at] = after[gone]
            follow = at[after[at] < n]
            before[after[follow]] = follow
            earlier = before[at]
            note(np.unique(np.r_[at, earlier[earlier >= 0]]))
        return np.add.reduceat(alive, ends - lengths, dtype=np.int64)

    def count_by_rounds(self, words: list[bytes]) -> np.ndarray:
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        out = lengths.copy()
        while len(symbols) > 1:
            rank, made = self.look_up(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = NONE
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, NONE], starts)
            size = np.diff(np.r_[starts, len(symbols)])
            take = (rank == np.repeat(lowest, size)[:-1]) & (rank < NONE)
            # In a run of overlapping equal pairs every second one, from the left, merges.
            at = np.flatnonzero(take)
            if not len(at):
                break
            run = np.r_[True, np.diff(at) > 1]
            first = at[run][np.cumsum(run) - 1]
            at = at[(at - first) % 2 == 0]
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            keep &= np.repeat(lowest < NONE, size)  # sequences without a pair are done
            np.subtract.at(out, owner[at], 1)
            symbols, owner = symbols[keep], owner[keep]
        return out


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


class Counter:
    """Counts of whole texts, with a cache of at most ``most`` pre-tokens."""

    def __init__(self, path: str, most: int = 120_000):
        self.merge, self.most, self.known = merger(path), most, {}
        self.find = regex.compile(PRE_TOKEN).findall
        self.cut = regex.compile("|".join(map(regex.escape, self.merge.special))) if self.merge.special else None

    def counts(self, texts: list[str]) -> list[int]:
        extra, found = [], []
        for text in texts:
            if self.cut is not None and self.cut.search(text):
                parts = self.cut.split(text)
                extra.append(len(parts) - 1)
                found.append([w for p in parts for w in self.find(p)])
            else:
                extra.append(0)
                found.append(self.find(text))
        met = set().union(*found)
        new = sorted(met.difference(self.known))
        once = [w for w in new if len(w) > LONG]
        if once:
            new = [w for w in new if len(w) <= LONG]
            counted = dict(zip(once, self.merge.count([w.encode() for w in once]).tolist()))
            extra = [e + sum(counted.get(w, 0) for w in words) for e, words in zip(extra, found)]
            found = [[w for w in words if w not in counted] for words in found]
        if new:
            if len(self.known) + len(new) > self.most:  # words of these texts stay, the others go
                self.known = {w: self.known[w] for w in met.intersection(self.known)}
            self.known.update(zip(new, self.merge.count([w.encode() for w in new]).tolist()))
        get = self.known.__getitem__
        return [e + sum(map(get, words)) for e, words in zip(extra, found)]


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One for each worker process, so that later tasks find its cache."""
    return Counter(path)


def n_tokens(text: Column, path: str) -> Column:
    """Column of exact token counts; ``path`` names the vocabulary file on every machine."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        held = counter(path)
        _, offsets = utf8(texts)
        out: list[int] = []
        for i, j in slices(offsets):
            out += held.counts([t or "" for t in texts[i:j].to_pylist()])
        return pa.array(out, pa.int64())

    return count(text)


def token_counts(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (existing columns of these names are replaced).

    Empty tables stay empty; null texts count as empty.
    """
    return docs.withColumns({"n_bytes": text_bytes(F.col(text)), "n_tokens": n_tokens(F.col(text), path)}).withColumn("over_limit", F.col("n_tokens") > limit)
