"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A text is read in overlapping windows of WINDOW words, each beginning half a
window after the one before, and every window is scored. The input of a word is
its own embedding, plus the mean embeddings of its character 3-grams (in a
hashed table) and of its first characters. Words and beginnings that too few
training texts hold have no embedding of their own. A gated recurrent unit
reads the window forwards, another one backwards; attention weighs their
states, and the pooled state gives the window's logit. A text's score is the
chance of its highest window.

The network is trained here, in numpy, on at most ``max_docs`` labelled rows
(toxic ones up to half, others up to half, each in hash order), whole texts of
``max_bytes`` in all at most: a text that doesn't fit any more is passed over.
These two numbers bound what the driver holds. Windows learn from their text's
label, and only the windows that score highest stand for a toxic text, since
most of its windows are harmless. One embedding component starts from the
smoothed log-odds of the word among the training texts, and the first round
picks windows by it; all of it is then trained, and scores come from the
pooled states alone.

Defined cases: null, empty and blank texts have no window and score the logit
bias alone; with no labels, or one label only, every score is the share of
toxic labels; repeated rows score alike (scores
have six digits); a null id is never held out and never trained on; all windows
of a very long text are scored, in slices; equal window scores need no order,
since the largest counts; output columns replace input columns of the same
name; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenova.llm.common import slices, utf8

WINDOW, STRIDE = 32, 16
GRAMS = 1 << 13
WIDE, HIDDEN = 8, 6
HEADS = (3, 4, 5, 6)

TOKEN = re.compile(r"\w+")


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the character 3-grams of all words with their ends marked, one after the other, and how many each word has."""
    counts = np.array([len(w) for w in words], np.int64)
    c = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    h = ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
    ends = np.cumsum(counts + 2)
    at = np.repeat(ends - (counts + 2) - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return (1 + h[at] % np.uint64(GRAMS - 1)).astype(np.int64), counts


def heads_of(word: str) -> list[str]:
    return [word[:n] for n in HEADS if len(word) > n]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Parameters by name. Row 0 of ``input``-sized arrays is padding."""

    p: dict[str, np.ndarray]
    words: dict[str, int] = field(default_factory=dict)
    heads: dict[str, int] = field(default_factory=dict)
    prior: float = 0.0
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    steps: int = 0

    @staticmethod
    def fresh(seed: int, words: list[str] = (), heads: list[str] = ()) -> Network:
        """Random parameters. Row 0 of the words and heads is for all that have none of their own."""
        r = np.random.default_rng(seed)
        p = {"word": r.normal(0, 0.05, (len(words) + 1, WIDE)), "head": r.normal(0, 0.05, (len(heads) + 1, WIDE)), "gram": r.normal(0, 0.05, (GRAMS, WIDE))}
        for x in p.values():
            x[0] = x[:, 0] = 0
        for d in "fb":
            p["W" + d] = r.normal(0, 1 / np.sqrt(WIDE), (WIDE, 3 * HIDDEN))
            p["U" + d] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN))
            p["c" + d] = np.zeros(3 * HIDDEN)
        p |= {"A": r.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "a": r.normal(0, 0.3, HIDDEN), "v": r.normal(0, 0.3, 2 * HIDDEN), "b": np.zeros(1)}
        return Network({k: x.astype(np.float32) for k, x in p.items()}, {w: i for i, w in enumerate(words, 1)}, {h: i for i, h in enumerate(heads, 1)})

    def forward(self, x: np.ndarray, mask: np.ndarray) -> dict:
        """Logits of windows x (time, batch, WIDE), with what backward() needs. mask: (time, batch) of 0 and 1."""
        p, t = self.p, len(x)
        keep = {"x": x, "mask": mask}
        states = []
        for d in "fb":
            h = np.zeros((x.shape[1], HIDDEN), np.float32)
            gx = x @ p["W" + d] + p["c" + d]
            hs, zs, rs, ns, us = ([None] * t for _ in range(5))
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                u = h @ p["U" + d]
                zr = sigmoid(gx[i, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = np.tanh(gx[i, :, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                new = z * h + (1 - z) * n
                m = mask[i][:, None]
                zs[i], rs[i], ns[i], us[i] = z, r, n, (h, u[:, 2 * HIDDEN :])
                h = m * new + (1 - m) * h
                hs[i] = h
            keep[d] = (zs, rs, ns, us)
            states.append(np.stack(hs))
        s = np.concatenate(states, axis=2)
        k = np.tanh(s @ p["A"])
        e = np.where(mask > 0, k @ p["a"], -1e9)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = (alpha[:, :, None] * s).sum(0)
        keep |= {"s": s, "k": k, "alpha": alpha, "pooled": pooled, "logit": pooled @ p["v"] + p["b"][0]}
        return keep

    def backward(self, keep: dict, g_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of x for the gradient of the logits."""
        p, x, mask, s, k, alpha = self.p, keep["x"], keep["mask"], keep["s"], keep["k"], keep["alpha"]
        t = len(x)
        g = {"v": keep["pooled"].T @ g_logit, "b": np.array([g_logit.sum()])}
        g_pooled = g_logit[:, None] * p["v"]
        g_alpha = (s * g_pooled[None]).sum(2)
        g_e = alpha * (g_alpha - (alpha * g_alpha).sum(0))
        g_k = g_e[:, :, None] * p["a"]
        g["a"] = (k * g_e[:, :, None]).sum((0, 1))
        g_pre = g_k * (1 - k * k)
        g["A"] = np.tensordot(s, g_pre, ((0, 1), (0, 1)))
        g_s = alpha[:, :, None] * g_pooled[None] + g_pre @ p["A"].T
        g_x = np.zeros_like(x)
        for d, cols in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            zs, rs, ns, us = keep[d]
            U = p["U" + d]
            g_gx = np.zeros((t, x.shape[1], 3 * HIDDEN), np.float32)
            g_u_total = np.zeros_like(U)
            g_h = np.zeros((x.shape[1], HIDDEN), np.float32)
            for i in range(t - 1, -1, -1) if d == "f" else range(t):
                g_h = g_h + g_s[i, :, cols]
                m = mask[i][:, None]
                g_new, g_old = m * g_h, (1 - m) * g_h
                z, r, n, (h, un) = zs[i], rs[i], ns[i], us[i]
                g_z = g_new * (h - n) * z * (1 - z)
                g_n = g_new * (1 - z) * (1 - n * n)
                g_r = g_n * un * r * (1 - r)
                g_gx[i] = np.concatenate([g_z, g_r, g_n], axis=1)
                g_u = np.concatenate([g_z, g_r, g_n * r], axis=1)
                g_u_total += h.T @ g_u
                g_h = g_old + g_new * z + g_u @ U.T
            g["U" + d] = g_u_total
            g["W" + d] = np.tensordot(x, g_gx, ((0, 1), (0, 1)))
            g["c" + d] = g_gx.sum((0, 1))
            g_x += g_gx @ p["W" + d].T
        return g, g_x

    def update(self, g: dict, rate: float) -> None:
        """One Adam step."""
        self.steps += 1
        for k, x in g.items():
            m, v = self.moments.get(k) or (np.zeros_like(self.p[k]), np.zeros_like(self.p[k]))
            m = 0.9 * m + 0.1 * x
            v = 0.999 * v + 0.001 * x * x
            self.moments[k] = (m, v)
            self.p[k] = (self.p[k] - rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-7)).astype(np.float32)


class Rows:
    """Table rows of words, ragged: those of word k are flat[ends[k]:ends[k + 1]]. Word 0 is padding and has none."""

    def __init__(self):
        self.flat, self.ends = np.zeros(0, np.int64), np.zeros(2, np.int64)

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, rows])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def mean(self, table: np.ndarray, start: int, block: int = 8192) -> np.ndarray:
        """Mean table row of each word from number ``start``; 0 where it has none. In blocks, to spare memory."""
        out = np.zeros((len(self.ends) - 1 - start, WIDE), np.float32)
        for k in range(0, len(out), block):
            ends = self.ends[start + k : start + k + block + 1]
            total = np.concatenate([np.zeros((1, WIDE)), np.cumsum(table[self.flat[ends[0] : ends[-1]]], 0, dtype=np.float64)])
            ends = ends - ends[0]
            out[k : k + block] = (total[ends[1:]] - total[ends[:-1]]) / np.maximum(np.diff(ends), 1)[:, None]
        return out

    def spread(self, table: np.ndarray, words: np.ndarray, step: np.ndarray) -> None:
        """Add to the table rows of ``words`` their share of ``step``."""
        n = self.ends[words + 1] - self.ends[words]
        at = np.repeat(self.ends[words] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        table += summed(np.repeat(step / np.maximum(n, 1)[:, None], n, axis=0), self.flat[at], len(table))


class Reader:
    """Word numbers of texts; a word's table rows are found once and kept in a bounded cache."""

    def __init__(self, words: dict[str, int], heads: dict[str, int], most: int = 300_000):
        self.words, self.heads, self.most, self.resets = words, heads, most, 0
        self.reset()

    def reset(self) -> None:
        self.resets += 1
        self.number: dict[str, int] = {}
        self.tables = {"word": Rows(), "head": Rows(), "gram": Rows()}

    def __len__(self) -> int:
        return len(self.number) + 1

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        found = [TOKEN.findall(t.lower()) for t in texts]
        met = set().union(*found)
        if len(self.number) + len(met) > self.most:
            self.reset()
        new = sorted(met.difference(self.number))
        if new:
            self.number.update(zip(new, range(len(self), len(self) + len(new))))
            own = np.array([self.words.get(w, 0) for w in new], np.int64)
            heads = np.array([[self.heads.get(w[:n], 0) if len(w) > n else 0 for n in HEADS] for w in new], np.int64)
            self.tables["word"].add(own[own > 0], own > 0)
            self.tables["head"].add(heads[heads > 0], (heads > 0).sum(1))
            self.tables["gram"].add(*grams_of(new))
        get = self.number.__getitem__
        return [np.fromiter(map(get, words), np.int32, len(words)) for words in found]

    def vectors(self, net: Network, start: int = 0) -> np.ndarray:
        """Input of each word numbered from ``start``; number 0 is padding."""
        out = np.zeros((len(self) - start, WIDE), np.float32)
        for k, rows in self.tables.items():
            out += rows.mean(net.p[k], start)
        return out


def windows(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, padded with 0, and the text of each."""
    rows, owner = [], []
    for k, n in enumerate(numbers):
        if not len(n):
            continue
        count = 1 + max(0, -(-(len(n) - WINDOW) // STRIDE))
        held = np.zeros((count - 1) * STRIDE + WINDOW, np.int32)
        held[: len(n)] = n
        rows.append(np.lib.stride_tricks.sliding_window_view(held, WINDOW)[::STRIDE])
        owner.append(np.full(count, k))
    if not rows:
        return np.zeros((0, WINDOW), np.int32), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(owner)


def summed(values: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the values of each of ``size`` rows."""
    return np.column_stack([np.bincount(rows, values[:, j], size) for j in range(values.shape[1])])


def log_odds(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Lower bounds (two deviations, 0 at least) of the log-odds of what occurs in counts[1] of n[1] toxic and counts[0] of n[0] other texts."""
    odds = np.log((counts[1] + 0.2) / (n[1] + 0.4)) - np.log((counts[0] + 0.8) / (n[0] + 1.6))
    return np.maximum(odds - 2 * np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5)), 0)


def vocabulary(found: Iterable[set[str]], toxic: np.ndarray, least: int) -> tuple[list[str], np.ndarray]:
    """What at least ``least`` texts hold, in order, and its log-odds."""
    counts: dict[str, list[int]] = {}
    for held, y in zip(found, toxic.tolist()):
        for w in held:
            counts.setdefault(w, [0, 0])[y] += 1
    names = sorted(w for w, c in counts.items() if sum(c) >= least)
    table = np.array([counts[w] for w in names], float).reshape(-1, 2).T
    return names, log_odds(table, np.bincount(toxic, minlength=2))


def train(texts: list[str], toxic: np.ndarray, *, steps: int = 400, batch: int = 128, rate: float = 0.01, clean_windows: int = 6, least: int = 4, seed: int = 9) -> Network:
    """Fit on whole texts. In each round a toxic text gives its likeliest windows, another one its likeliest and some others.

    Rounds go on, four at least, until ``steps`` batches are done.
    """
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return Network({}, prior=share)
    words, word_odds = vocabulary((set(TOKEN.findall(t.lower())) for t in texts), toxic, least)
    heads, head_odds = vocabulary(({h for w in set(TOKEN.findall(t.lower())) for h in heads_of(w)} for t in texts), toxic, least)
    net = Network.fresh(seed, words, heads)
    net.p["word"][1:, 0] = word_odds
    net.p["head"][1:, 0] = head_odds
    reader = Reader(net.words, net.heads, most=1 << 62)
    rows, owner = windows(reader.numbers(texts))
    rng = np.random.default_rng(seed)
    label = toxic[owner]
    of_text = np.bincount(owner, minlength=len(texts))[owner]
    turn = 0
    while turn < 4 or net.steps < steps:
        vectors = reader.vectors(net)
        pool = np.flatnonzero((label == 1) | (rng.random(len(rows)) < 2 * clean_windows / of_text))
        seen = rows[pool]
        logits = np.concatenate([net.forward(vectors[seen[i : i + 4096].T], (seen[i : i + 4096].T > 0).astype(np.float32))["logit"] for i in range(0, len(seen), 4096)]) if turn else vectors[:, 0][seen].max(1)
        order = np.lexsort((-logits, owner[pool]))
        first = np.searchsorted(owner[pool][order], np.arange(len(texts)))
        rank = np.empty(len(pool), np.int64)
        rank[order] = np.arange(len(pool)) - first[owner[pool][order]]
        # A second window of a toxic text counts only where it looks toxic itself.
        told = np.where(label[pool] == 1, (rank == 0) | ((rank == 1) & (logits > 0)), (rank < 2) | (rng.random(len(pool)) < 0.5))
        picked = pool[told]
        rng.shuffle(picked)
        for i in range(0, len(picked), batch):
            take = rows[picked[i : i + batch]]
            used, local = np.unique(take, return_inverse=True)
            local = local.reshape(take.shape).T
            x_used = vectors[used]
            keep = net.forward(x_used[local], (take.T > 0).astype(np.float32))
            g_logit = ((sigmoid(keep["logit"]) - label[picked[i : i + batch]]) / len(take)).astype(np.float32)
            g, g_x = net.backward(keep, g_logit)
            net.update(g, rate)
            # Embeddings take plain steps on the rows that occur; sums of their words follow at the next round.
            step = (-rate * 20 * summed(g_x.reshape(-1, WIDE), local.ravel(), len(used))).astype(np.float32)
            step[used == 0] = 0
            vectors[used] += step
            for k, held in reader.tables.items():
                held.spread(net.p[k], used, step / len(reader.tables))
        turn += 1
    net.prior = share
    return net


class Scorer:
    """Scores of whole texts by a trained network, without what training needs.

    The products of the input with W are kept for each known word, and both
    directions take a step at once, one from each end, so that a step is one
    small product for the whole batch; windows are columns. Gates are taken as
    tanh(x / 2), of which sigmoid(x) is a straight line; the halves are put
    into the weights.
    """

    def __init__(self, net: Network):
        self.net, self.reader, self.known = net, Reader(net.words, net.heads), (0, 1)
        if net.steps:
            halves = np.repeat(np.float32([0.5, 0.5, 1]), HIDDEN)
            self.inputs = [((net.p["W" + d] * halves).T, (net.p["c" + d] * halves)[:, None]) for d in "fb"]
            self.gates = [np.zeros((3 * HIDDEN, 1 << 12), np.float32) for _ in "fb"]
            # Rows: z, r and n of both directions.
            u = np.zeros((3, 2, HIDDEN, 2 * HIDDEN), np.float32)
            for k, d in enumerate("fb"):
                u[:, k, :, HIDDEN * k : HIDDEN * (k + 1)] = net.p["U" + d].T.reshape(3, HIDDEN, HIDDEN) / 2
            self.recurrent = u.reshape(6 * HIDDEN, 2 * HIDDEN)

    def refresh(self) -> None:
        """Products of the words that came since."""
        n, start = len(self.reader), self.known[0] if self.known[1] == self.reader.resets else 0
        for k, (w, c) in enumerate(self.inputs):
            if n > self.gates[k].shape[1]:
                more = np.zeros((3 * HIDDEN, 2 * n), np.float32)
                more[:, :start] = self.gates[k][:, :start]
                self.gates[k] = more
        if start < n:
            x = self.reader.vectors(self.net, start).T
            for held, (w, c) in zip(self.gates, self.inputs):
                held[:, start:n] = w @ x + c
        self.known = (n, self.reader.resets)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        p, n, one, both = self.net.p, len(rows), HIDDEN, 2 * HIDDEN
        time = np.ascontiguousarray(rows.T)
        mask = (time > 0).astype(np.float32) / 2
        states = np.empty((WINDOW, both, n), np.float32)
        h, g = np.zeros((both, n), np.float32), np.empty((3 * both, n), np.float32)
        zr, new = g[: 2 * both], g[2 * both :]
        for i in range(WINDOW):
            ends = (i, WINDOW - 1 - i)
            for k, at in enumerate(ends):
                for part in range(3):
                    np.take(self.gates[k][one * part : one * (part + 1)], time[at], axis=1, out=g[both * part + one * k : both * part + one * (k + 1)], mode="clip")
            u = self.recurrent @ h
            zr += u[: 2 * both]
            np.tanh(zr, out=zr)
            # n = tanh(x + r u) with r = (1 + tanh) / 2
            un = u[2 * both :]
            new += un
            un *= zr[both:]
            new += un
            np.tanh(new, out=new)
            # h + (1 - z)(n - h), and h alone at padding
            new -= h
            new *= 1 - zr[:both]
            for k, at in enumerate(ends):
                new[one * k : one * (k + 1)] *= mask[at]
            h += new
            for k, at in enumerate(ends):
                states[at, one * k : one * (k + 1)] = h[one * k : one * (k + 1)]
        e = p["a"] @ np.tanh(p["A"].T @ states)
        e[time == 0] = -1e9
        e -= e.max(0)
        np.exp(e, out=e)
        e /= e.sum(0)
        pooled = np.einsum("tb,thb->hb", e, states)
        return p["v"] @ pooled + p["b"][0]

    def scores(self, texts: list[str]) -> np.ndarray:
        net = self.net
        if net.steps == 0:
            return np.full(len(texts), net.prior)
        numbers = self.reader.numbers(texts)
        self.refresh()
        rows, owner = windows(numbers)
        best = np.full(len(texts), -np.inf)
        # Blocks of whole 64 rows, so that a window's result does not depend on its place in the block.
        n = len(rows)
        rows = np.concatenate([rows, np.zeros((-n % 64, WINDOW), np.int32)])
        for i in range(0, n, 2048):
            held = owner[i : i + 2048]
            np.maximum.at(best, held, self.logits(rows[i : i + 2048])[: len(held)])
        return np.round(sigmoid(np.where(np.isfinite(best), best, net.p["b"][0]).astype(np.float64)), 6)


SCORERS: dict[str, Scorer] = {}


def toxicity(text: Column, net: Network) -> Column:
    net = Network(net.p, net.words, net.heads, net.prior, {}, net.steps)
    name = xxhash.xxh3_128_hexdigest(b"".join(net.p[k].tobytes() for k in sorted(net.p)) + str((net.prior, net.steps)).encode())

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if name not in SCORERS:
            SCORERS.clear()
            SCORERS[name] = Scorer(net)
        held = SCORERS[name]
        _, offsets = utf8(texts)
        out = [held.scores([t or "" for t in texts[i:j].to_pylist()]) for i, j in slices(offsets, 1 << 20)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score(text)


def held_out(id: Column) -> Column:
    """Rows that never train."""
    return F.coalesce(F.crc32(id.cast("string")) % 4 == 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = 3000, max_bytes: int = 64 << 20) -> Network:
    """Train on at most ``max_docs`` labelled rows, of ``max_bytes``, that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(F.col(id))).select(F.col(id).alias("k"), F.col(label).cast("int").alias("y"))
    toxic = known.where("y = 1").orderBy(F.xxhash64("k"), "k").limit(max_docs // 2)
    other = known.where("y = 0").orderBy(F.xxhash64("k"), "k").limit(max_docs // 2)
    # Bounded by max_docs pairs of numbers.
    told = known_rows(docs, toxic.unionByName(other), id, text)
    order = [F.xxhash64("id"), F.col("id"), F.col("y"), F.col("sum")]
    sizes = told.select("id", "y", "sum", "bytes").orderBy(*order).limit(max_docs).collect()
    taken, left = set(), max_bytes
    for r in sizes:
        if r["bytes"] <= left:
            taken.add((r["id"], r["y"], r["sum"]))
            left -= r["bytes"]
    whole = docs.sparkSession.createDataFrame(sorted(taken), "k long, y int, sum long") if taken else told.select(F.col("id").alias("k"), "y", "sum").limit(0)
    rows = known_rows(docs, whole, id, text).orderBy(*order).limit(max_docs).collect()
    return train([r["text"] or "" for r in rows], np.array([r["y"] for r in rows], np.int64))


def known_rows(docs: DataFrame, picked: DataFrame, id: str, text: str) -> DataFrame:
    """One row (id, y, sum, bytes, text) for each picked id and text. ``picked``: k, y and maybe the text's sum; max_docs rows at most."""
    slim = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("sum"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).alias("bytes"))
    same = F.col("id") == F.col("k")
    if "sum" in picked.columns:
        picked = picked.withColumnRenamed("sum", "_sum")
        same = same & (F.col("sum") == F.col("_sum"))
    return slim.join(F.broadcast(picked), same).select("id", "y", "sum", "bytes", "text").dropDuplicates(["id", "y", "sum"])


def score_toxicity(docs: DataFrame, net: Network, *, id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with held_out, score and predicted (existing columns of these names are replaced)."""
    out = docs.withColumns({"held_out": held_out(F.col(id)), "score": toxicity(F.col(text), net)})
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
