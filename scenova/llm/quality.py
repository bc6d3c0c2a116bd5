"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= g_k) = sigmoid(theta_k - w.x) with one weight vector for all grades
and thresholds in order. x holds, for byte 3-grams and 5-grams, the share of
each hash bucket among the text's n-grams, and a level (one of LEVELS) of how
often two places of the text fall into one 5-gram bucket, which tells repeated
text; so whole texts of any length are used and no text is cut. The expected
grade and the probability of reaching grade ``accept`` come from the same w.x.

Fitting uses at most ``max_ratings`` rated rows, those with the smallest hash
of their id, so that it is bounded and the same at every run; scoring covers
every row.

Defined cases: a null, empty or very short text has x = 0 and gets the
probabilities of the thresholds alone. Ratings that are null, or whose
document is missing, are left out. With no ratings, or one grade only, the
model knows no difference: the tail probability is 1 and every row is kept.
Very long texts are read whole, in slices; repeated rows get equal scores; ties
of the hash among rated rows go by id and grade; an empty table stays empty.
Output columns replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenova.llm.common import fresh, slices, utf8

ORDERS = (3, 5)
LEVELS = 24


@dataclass
class OrdinalModel:
    grades: list[int]
    weights: np.ndarray  # one row for each n-gram order
    levels: np.ndarray  # one for each level of repetition
    thresholds: np.ndarray  # ordered, one fewer than grades


def buckets(data: np.ndarray, order: int, size: int) -> np.ndarray:
    """Hash bucket of the n-gram that starts at each byte but the last order - 1."""
    n = len(data) - order + 1
    h = np.zeros(max(n, 0), np.uint32)
    for k in range(order if n > 0 else 0):
        h = h * np.uint32(0x01000193) + data[k : k + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - int(size).bit_length() + 1)).astype(np.int64)


def repetition(found: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Level of each text: half-octaves of the chance that two of its places share a bucket; -1 below 2 places."""
    n = np.maximum(last - first, 0)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    counts = np.bincount(owner * size + found[place], minlength=len(n) * size).reshape(len(n), size)
    square = np.einsum("ij,ij->i", counts, counts, dtype=float)
    chance = (square - n) / np.maximum(n * (n - 1.0), 1)
    level = np.clip(np.floor(2 * np.log2(np.maximum(chance * size, 1))), 0, LEVELS - 1).astype(np.int64)
    return np.where(n > 1, level, -1)


def shares(data: np.ndarray, size: int) -> np.ndarray:
    """x of one text."""
    rows = []
    for order in ORDERS:
        found = buckets(data, order, size)
        rows.append(np.bincount(found, minlength=size) / max(len(found), 1))
    level = repetition(found, np.array([0]), np.array([len(found)]), size)[0]
    rows.append(np.arange(LEVELS) == level)
    return np.concatenate(rows).astype(np.float32)


def scores(data: np.ndarray, offsets: np.ndarray, model: OrdinalModel) -> np.ndarray:
    """w.x of each text, without building x."""
    out = np.zeros(len(offsets) - 1)
    for weights, order in zip(model.weights, ORDERS):
        found = buckets(data, order, len(weights))
        held = weights[found]
        total = np.r_[0.0, np.cumsum(held)]
        first, last = offsets[:-1], np.maximum(offsets[1:] - order + 1, offsets[:-1])
        n = last - first
        last = np.minimum(last, len(total) - 1)
        first = np.minimum(first, last)
        out += np.where(n > 0, (total[last] - total[first]) / np.maximum(n, 1), 0)
    level = repetition(found, first, last, len(weights))
    return out + np.where(level >= 0, model.levels[level], 0)


def fit_cumulative_link(x: np.ndarray, grade: np.ndarray, steps: int = 200, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam. ``grade`` counts from 0; every grade occurs. ``x`` (float32) is scaled in place."""
    n, levels = len(x), int(grade.max()) + 1
    share = np.cumsum(np.bincount(grade, minlength=levels))[:-1] / n
    theta = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(theta), 1e-3))
    scale = 1 / (x.std(0) + 0.02 * x.std() + 1e-8)
    x *= scale.astype(np.float32)
    mean = x.mean(0)
    params = np.concatenate([np.zeros(x.shape[1]), theta[:1], gaps])
    first = np.zeros_like(params)
    second = np.zeros_like(params)
    d = x.shape[1]
    rate = rate / np.sqrt(d)
    for step in range(1, steps + 1):
        w = params[:d].astype(np.float32)
        cuts = params[d] + np.r_[0, np.cumsum(np.exp(params[d + 1 :]))]
        s = (x @ w - mean @ w).astype(float)
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        with np.errstate(over="ignore"):
            hi = 1 / (1 + np.exp(-(edge[grade + 1] - s)))
            lo = 1 / (1 + np.exp(-(edge[grade] - s)))
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_s = (d_hi - d_lo) / n  # d(-log p)/ds
        g_cut = np.zeros(levels - 1)
        for k in range(levels - 1):
            g_cut[k] = (-d_hi[grade == k].sum() + d_lo[grade == k + 1].sum()) / n
        grad = np.empty_like(params)
        gs = g_s.astype(np.float32)
        grad[:d] = gs @ x - gs.sum() * mean + ridge * w
        grad[d] = g_cut.sum()
        grad[d + 1 :] = [g_cut[k + 1 :].sum() * np.exp(params[d + 1 + k]) for k in range(levels - 2)]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        move[: d - LEVELS] *= rate
        move[d - LEVELS :] *= 0.05
        params -= move
    cuts = params[d] + np.r_[0, np.cumsum(np.exp(params[d + 1 :]))]
    return params[:d] * scale, cuts + float(mean @ params[:d].astype(np.float32))


def fit_quality(docs: DataFrame, ratings: DataFrame, *, id: str = "doc_id", text: str = "text", grade: str = "quality", max_ratings: int = 2500, size: int = 2048) -> OrdinalModel:
    """Fit on at most ``max_ratings`` rated rows. ``size`` (a power of 2): hash buckets for each n-gram order."""

    @F.arrow_udf("binary")
    def features(texts: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        return pa.array([shares(data[a:b], size).astype(np.float16).tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())

    key, level = fresh("id"), fresh("grade")
    rated = ratings.where(F.col(grade).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias(key), F.col(grade).cast("int").alias(level))
    rated = rated.orderBy(F.xxhash64(key), key, level).limit(max_ratings)
    # Bounded by max_ratings rows of two numbers, so it can be sent to every task.
    picked = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(rated), F.col("id") == F.col(key))
    rows = picked.select("id", F.col(level).alias("level"), features("text").alias("x"), F.xxhash64("text").alias("h")).orderBy(F.xxhash64("id"), "id", "level", "h").limit(max_ratings).select("level", "x").toPandas()
    grades = sorted(int(g) for g in set(rows["level"]))
    if len(grades) < 2:
        return OrdinalModel(grades or [0], np.zeros((len(ORDERS), size)), np.zeros(LEVELS), np.zeros(0))
    x = np.empty((len(rows), len(ORDERS) * size + LEVELS), np.float32)
    for i, b in enumerate(rows["x"]):
        x[i] = np.frombuffer(b, np.float16)
    known = np.searchsorted(grades, rows["level"].to_numpy())
    del rows
    weights, cuts = fit_cumulative_link(x, known)
    return OrdinalModel(grades, weights[:-LEVELS].reshape(len(ORDERS), size), weights[-LEVELS:], cuts)


def linear_score(text: Column, model: OrdinalModel) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        parts = [scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model) for i, j in slices(offsets)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(text)


def score_quality(docs: DataFrame, model: OrdinalModel, *, text: str = "text", accept: int | None = None, least: float = 0.5) -> DataFrame:
    """``docs`` with expected_grade, tail_prob (of reaching ``accept``, the best grade by default) and kept."""
    accept = model.grades[-1] if accept is None else accept
    below = sum(g < accept for g in model.grades)
    s = fresh("score")
    steps = np.diff(np.array(model.grades, float))
    tail = lambda k: 1 / (1 + F.exp(F.lit(float(model.thresholds[k])) - F.col(s)))
    expected = F.lit(float(model.grades[0]))
    for k, step in enumerate(steps):
        expected = expected + F.lit(float(step)) * tail(k)
    reach = F.lit(1.0) if below == 0 else F.lit(0.0) if below == len(model.grades) else tail(below - 1)
    out = docs.withColumn(s, linear_score(F.col(text), model))
    out = out.withColumns({"expected_grade": expected, "tail_prob": reach})
    return out.withColumn("kept", F.col("tail_prob") >= least).drop(s)
