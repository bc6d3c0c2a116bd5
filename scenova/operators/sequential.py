"""Algorithms that walk a scene step by step, as small numpy helpers.

Spark deals scenes over the cluster and sorts them inside partitions; a
partition streams through ``mapInPandas`` one scene (a few objects or queries)
at a time, which spares the cost of a Python call for each of millions of
groups. The helpers hold nothing between scenes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


Columns = dict[str, np.ndarray]


def per_group(df: DataFrame, keys: list[str], order: list[str], run: Callable[[Columns], Columns], schema: str, *, many: int = 4096) -> DataFrame:
    """``run`` on each group of ``df``, whose rows come in ``order``; its arrays are the result's columns."""
    names = [field.split()[0] for field in schema.split(", ")]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, out = None, []

        def groups() -> Iterator[Columns]:
            nonlocal rest
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

        for group in groups():
            out.append(run(group))
            if len(out) >= many:
                yield pd.DataFrame({c: np.concatenate([o[c] for o in out]) for c in names})
                out = []
        if out:
            yield pd.DataFrame({c: np.concatenate([o[c] for o in out]) for c in names})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(stream, schema)


def footprints(boxes: np.ndarray) -> np.ndarray:
    """Corners (n, 4, 2) of turned rectangles, counter-clockwise."""
    c, s = np.cos(boxes[:, 6]), np.sin(boxes[:, 6])
    local = np.array([[1, 1], [-1, 1], [-1, -1], [1, -1]]) * boxes[:, None, 3:5] / 2
    turn = np.stack([np.stack([c, s], 1), np.stack([-s, c], 1)], 1)
    return local @ turn + boxes[:, None, :2]


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def shared_areas(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Areas that pairs of convex quadrilaterals (n, 4, 2) share.

    The corners of the shared part are corners of one inside the other and
    crossings of edges: 24 candidates for each pair, put in order by angle.
    """
    n = len(p)
    ep, eq = np.roll(p, -1, 1) - p, np.roll(q, -1, 1) - q
    size = 1e-9 * (1 + np.abs(p).max((1, 2)) + np.abs(q).max((1, 2)))[:, None, None]
    inside = lambda x, base, edge: (cross(edge[:, None], x[:, :, None] - base[:, None]) >= -size * np.linalg.norm(edge, axis=2)[:, None]).all(2)
    over = cross(ep[:, :, None], eq[:, None])
    gap = q[:, None] - p[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross(gap, eq[:, None]) / over, cross(gap, ep[:, :, None]) / over
        hit = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        at = p[:, :, None] + np.where(hit, t, 0)[..., None] * ep[:, :, None]
    points = np.concatenate([p, q, at.reshape(n, 16, 2)], 1)
    there = np.concatenate([inside(p, q, eq), inside(q, p, ep), hit.reshape(n, 16)], 1)
    count = there.sum(1)
    middle = np.where(there[..., None], points, 0).sum(1) / np.maximum(count, 1)[:, None]
    rel = points - middle[:, None]
    order = np.argsort(np.where(there, np.arctan2(rel[..., 1], rel[..., 0]), np.inf), axis=1)
    rel = np.take_along_axis(rel, order[..., None], 1)
    # Places beyond the last corner repeat the first one and add nothing.
    rel = np.where((np.arange(24) < count[:, None])[..., None], rel, rel[:, :1])
    return np.where(count >= 3, np.abs(cross(rel, np.roll(rel, -1, 1)).sum(1)) / 2, 0.0)


def rotated_ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of boxes (n, 7: x, y, z, l, w, h, yaw) turned about z; 0 for boxes that aren't boxes."""
    out = np.zeros(len(a))
    good = np.isfinite(a).all(1) & np.isfinite(b).all(1) & (a[:, 3:6] > 0).all(1) & (b[:, 3:6] > 0).all(1)
    a, b = a[good], b[good]
    if len(a):
        tall = np.minimum(a[:, 2] + a[:, 5] / 2, b[:, 2] + b[:, 5] / 2) - np.maximum(a[:, 2] - a[:, 5] / 2, b[:, 2] - b[:, 5] / 2)
        inter = shared_areas(footprints(a), footprints(b)) * np.maximum(tall, 0)
        out[good] = inter / (np.prod(a[:, 3:6], 1) + np.prod(b[:, 3:6], 1) - inter)
    return out


def sevens(boxes: pa.Array) -> np.ndarray:
    """An array of lists of seven numbers as a table; other lists and nulls are rows of NaN."""
    size = np.asarray(pc.fill_null(pc.list_value_length(boxes), 0))
    flat = boxes.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.full((len(boxes), 7), np.nan)
    good = size == 7
    out[good] = flat[(np.cumsum(size) - size)[good][:, None] + np.arange(7)]
    return out


def rotated_iou(a: Column, b: Column) -> Column:
    """Rotated IoU of two arrays of seven numbers."""

    @F.arrow_udf("double")
    def iou(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(rotated_ious(sevens(left), sevens(right)), pa.float64())

    return iou(a, b)


def box_array(prefix: str = "", shift: float | Column = 0.0) -> Column:
    return F.array(F.col(f"{prefix}x") + shift, *[F.col(f"{prefix}{c}") for c in ("y", "z", "l", "w", "h", "yaw")])


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the cheapest one-to-one assignment (rows no more than columns), by shortest augmenting paths."""
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        best, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, last, low = start, -1, 0.0
        while True:
            slack = low + cost[row] - row_price[row] - col_price
            better = ~done & (slack < best)
            best[better], came[better] = slack[better], last
            last = int(np.argmin(np.where(done, np.inf, best)))
            low = best[last]
            done[last] = True
            if row_of[last] < 0:
                break
            row = row_of[last]
        row_price[start] += low
        for j in np.flatnonzero(done):
            if row_of[j] >= 0:
                row_price[row_of[j]] += low - best[j]
            col_price[j] -= low - best[j]
        j = last
        while j >= 0:
            i = came[j]
            row_of[j] = row_of[i] if i >= 0 else start
            j = i
    out = np.full(n, -1)
    for j, i in enumerate(row_of):
        if i >= 0:
            out[i] = j
    return out


def assign(pairs: DataFrame, cost: str, row: str, column: str) -> DataFrame:
    """Cheapest one-to-one assignment within each scene from a table of costs of all (row, column) pairs."""

    def run(g: Columns) -> Columns:
        rows, i = np.unique(g[row], return_inverse=True)
        columns, j = np.unique(g[column], return_inverse=True)
        table = np.full((len(rows), len(columns)), np.inf)
        table[i, j] = g[cost]
        turned = len(rows) > len(columns)
        found = assignment(table.T if turned else table)
        a, b = (rows[found], columns) if turned else (rows, columns[found])
        return {"scene_id": np.repeat(g["scene_id"][:1], len(a)), row: a, column: b}

    return per_group(pairs.select("scene_id", row, column, cost), ["scene_id"], [row, column], run, f"scene_id bigint, {row} string, {column} string")
