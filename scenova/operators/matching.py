"""Predicted boxes against true ones: best overlaps, greedy matching and any-match counts.

Every prediction meets every truth of its frame that it can overlap: both are
spread over the grid cells that their extents touch, and a pair is taken in one
of its shared cells only, the one where the later of the two begins. So frames
with many boxes are many keys, and no pair comes twice. Where a frame's boxes
are a few hundred and one row already, they are matched in that row instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenova.functions import geometry as G
from scenova.operators.sequential import rotated_ious

BOX = ("x", "y", "z", "l", "w", "h", "yaw")
#: Pairs of boxes that a task compares at once.
PAIRS = 1 << 16


def extents(turned: bool) -> tuple[Column, Column]:
    """Half the lengths of a box along x and y."""
    if not turned:
        return F.col("l") / 2, F.col("w") / 2
    c, s = F.abs(F.cos("yaw")), F.abs(F.sin("yaw"))
    return (F.col("l") * c + F.col("w") * s) / 2, (F.col("l") * s + F.col("w") * c) / 2


def spread(boxes: DataFrame, keys: list[str], name: str, turned: bool, width: float) -> DataFrame:
    """``boxes`` once for each cell they touch: keys, the cell (_cx, _cy), the box's least cell and its columns with ``name`` before them."""
    hx, hy = extents(turned)
    cell = lambda v: F.floor(v / F.lit(width))
    ends = {"lx": cell(F.col("x") - hx), "ly": cell(F.col("y") - hy), "ux": cell(F.col("x") + hx), "uy": cell(F.col("y") + hy)}
    held = boxes.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in boxes.columns if c not in keys], *[v.alias(f"{name}_{c}") for c, v in ends.items()])
    held = held.withColumn("_cx", F.explode(F.sequence(f"{name}_lx", f"{name}_ux")))
    return held.withColumn("_cy", F.explode(F.sequence(f"{name}_ly", f"{name}_uy"))).drop(f"{name}_ux", f"{name}_uy")


def overlapping(guesses: DataFrame, truths: DataFrame, keys: list[str], *, turned: bool = False, width: float = 8.0) -> DataFrame:
    """Pairs (keys, columns g_* and t_*) of a guess and a truth with equal ``keys`` whose extents meet in a cell and in height."""
    left, right = spread(guesses, keys, "g", turned, width), spread(truths, keys, "t", turned, width)
    met = left.join(right, [*keys, "_cx", "_cy"])
    once = (F.col("_cx") == F.greatest("g_lx", "t_lx")) & (F.col("_cy") == F.greatest("g_ly", "t_ly"))
    high = F.abs(F.col("g_z") - F.col("t_z")) <= (F.col("g_h") + F.col("t_h")) / 2
    return met.where(once & high).drop("_cx", "_cy", "g_lx", "g_ly", "t_lx", "t_ly")


def of(name: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{name}_{c}") for c in BOX)


def aligned(met: DataFrame) -> Column:
    return G.aligned_iou(of("g"), of("t"))[0]


def best_overlaps(guesses: DataFrame, truths: DataFrame, keys: list[str], *, iou: Callable[[DataFrame], Column] = aligned, turned: bool = False) -> DataFrame:
    """``guesses`` with the truth of largest IoU (the least id on ties) as truth_id and iou, null where none overlaps.

    Guesses have a guess_id and truths a truth_id, both alone in their frame.
    """
    met = overlapping(guesses, truths, keys, turned=turned)
    met = met.withColumn("iou", iou(met)).where("iou > 0")
    best = met.groupBy(*keys, F.col("g_guess_id").alias("guess_id")).agg(F.min(F.struct((-F.col("iou")).alias("less"), F.col("t_truth_id").alias("truth_id"))).alias("b"))
    best = best.select(*keys, "guess_id", F.col("b.truth_id").alias("truth_id"), (-F.col("b.less")).alias("iou"))
    return guesses.join(best, [*keys, "guess_id"], "left")


def greedy_hits(best: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """One row for each threshold and guess with tp: whether it is the first, by score, to reach its best truth. A guess whose best truth is taken takes no other."""
    rows = best.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit = F.coalesce(F.col("iou") > F.col("threshold"), F.lit(False))
    turn = F.row_number().over(Window.partitionBy("threshold", *keys, "truth_id", "hit").orderBy(F.desc("score"), "guess_id"))
    return rows.withColumn("hit", hit).withColumn("tp", F.when(F.col("hit") & (turn == 1), 1).otherwise(0)).drop("hit")


def greedy_masks(best: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """``greedy_hits`` with one row for each guess: bit k of ``tp`` is that of threshold k."""
    bits = F.lit(0)
    for k, threshold in enumerate(thresholds):
        best = best.withColumn(f"_hit{k}", F.coalesce(F.col("iou") > threshold, F.lit(False)))
        turn = F.row_number().over(Window.partitionBy(*keys, "truth_id", f"_hit{k}").orderBy(F.desc("score"), "guess_id"))
        bits = bits + F.when(F.col(f"_hit{k}") & (turn == 1), 1 << k).otherwise(0)
    return best.withColumn("tp", bits).drop(*[f"_hit{k}" for k in range(len(thresholds))])


def box_ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``aligned`` of boxes (n, 6: x, y, z, l, w, h)."""
    shared = [np.maximum(0.0, np.minimum(a[:, c] + a[:, c + 3] / 2, b[:, c] + b[:, c + 3] / 2) - np.maximum(a[:, c] - a[:, c + 3] / 2, b[:, c] - b[:, c + 3] / 2)) for c in range(3)]
    inter = shared[0] * shared[1] * shared[2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return inter / (a[:, 3] * a[:, 4] * a[:, 5] + b[:, 3] * b[:, 4] * b[:, 5] - inter)


def may_meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the extents of turned boxes (n, 7) meet, or nearly."""
    c, s = zip(*[(np.abs(np.cos(v[:, 6])), np.abs(np.sin(v[:, 6]))) for v in (a, b)])
    half = [[(v[:, 3] * c[k] + v[:, 4] * s[k]) / 2, (v[:, 3] * s[k] + v[:, 4] * c[k]) / 2, v[:, 5] / 2] for k, v in enumerate((a, b))]
    return np.logical_and.reduce([np.abs(a[:, k] - b[:, k]) <= (half[0][k] + half[1][k]) * (1 + 1e-9) + 1e-9 for k in range(3)])


def first_alike(ids: pa.Array, starts: np.ndarray) -> np.ndarray:
    """For each element the first one of its list with the same id; lists are in the order of ids and begin at ``starts``."""
    code = pc.fill_null(ids.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    fresh = np.r_[True, code[1:] != code[:-1]][: len(code)]
    fresh[starts[starts < len(code)]] = True
    return np.maximum.accumulate(np.where(fresh, np.arange(len(code)), 0))


def row_boxes(lists: pa.Array, axes: tuple[str, ...]) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray, np.ndarray]:
    """Fields of lists of structs, their boxes as a table, the lists' lengths and where they begin."""
    n = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    held = dict(zip([f.name for f in flat.type], flat.flatten()))
    return held, np.stack([held[c].to_numpy(zero_copy_only=False).astype(float) for c in axes], 1), n, np.cumsum(n) - n


def row_pairs(gn: np.ndarray, tn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of each row's elements, in parts of about ``PAIRS``."""
    g0, t0, pairs = np.cumsum(gn) - gn, np.cumsum(tn) - tn, gn * tn
    ends = np.cumsum(pairs)
    at = 0
    while at < len(pairs):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - pairs[at] + PAIRS, "right")))
        row = np.repeat(np.arange(at, end), pairs[at:end])
        place = np.arange(len(row)) - np.repeat(ends[at:end] - pairs[at:end], pairs[at:end]) + ends[at] - pairs[at]
        yield g0[row] + place // np.maximum(tn[row], 1), t0[row] + place % np.maximum(tn[row], 1)
        at = end


def masks_in_rows(guesses: Column, truths: Column, thresholds: list[float], *, turned: bool = False) -> Column:
    """``greedy_masks`` of frames that are one row each: arrays of structs (idx, score, box) and (idx, box) in the order of the ids idx, a number for each guess.

    A box with a null or NaN meets none. Rows should hold a few hundred boxes at most.
    """
    axes = BOX if turned else BOX[:6]

    @F.arrow_udf("array<int>")
    def masks(g: pa.Array, t: pa.Array) -> pa.Array:
        (mine, gbox, gn, g0), (theirs, tbox, tn, t0) = row_boxes(g, axes), row_boxes(t, axes)
        met = []
        for i, j in row_pairs(gn, tn):
            if turned:
                near = may_meet(gbox[i], tbox[j])
                i, j = i[near], j[near]
            iou = (rotated_ious if turned else box_ious)(gbox[i], tbox[j])
            over = iou > 0
            met.append((i[over], j[over], iou[over]))
        out = np.zeros(len(gbox), np.int32)
        if met and len(gbox) and len(tbox):
            i, j, iou = (np.concatenate(c) for c in zip(*met))
            of, truth = first_alike(mine["idx"], g0), first_alike(theirs["idx"], t0)
            order = np.lexsort((truth[j], -iou, of[i]))
            order = order[np.r_[True, np.diff(of[i][order]) != 0][: len(order)]]
            best, reach = np.full(len(gbox), -1), np.zeros(len(gbox))
            best[of[i][order]], reach[of[i][order]] = truth[j][order], iou[order]
            best, reach = best[of], reach[of]
            score = mine["score"].to_numpy(zero_copy_only=False).astype(float)
            for k, threshold in enumerate(thresholds):
                hit = np.flatnonzero((best >= 0) & (reach > threshold))
                hit = hit[np.lexsort((hit, -score[hit], best[hit]))]
                out[hit[np.r_[True, np.diff(best[hit]) != 0][: len(hit)]]] |= 1 << k
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(gn)].astype("i4")), pa.array(out))

    return masks(guesses, truths)


def best_in_rows(guesses: Column, truths: Column) -> Column:
    """``best_overlaps`` of frames that are one row each: arrays of structs (idx, box) in the order of the ids idx; for each guess the place of its truth, null where none overlaps, and the IoU."""

    @F.arrow_udf("array<struct<at:int,iou:double>>")
    def best(g: pa.Array, t: pa.Array) -> pa.Array:
        (mine, gbox, gn, g0), (theirs, tbox, tn, t0) = row_boxes(g, BOX[:6]), row_boxes(t, BOX[:6])
        at, reach = np.full(len(gbox), -1), np.zeros(len(gbox))
        of, truth = first_alike(mine["idx"], g0), first_alike(theirs["idx"], t0)
        met = []
        for i, j in row_pairs(gn, tn):
            iou = box_ious(gbox[i], tbox[j])
            over = iou > 0
            met.append((i[over], j[over], iou[over]))
        if met:
            i, j, iou = (np.concatenate(c) for c in zip(*met))
            order = np.lexsort((truth[j], -iou, of[i]))
            order = order[np.r_[True, np.diff(of[i][order]) != 0][: len(order)]]
            at[of[i][order]], reach[of[i][order]] = truth[j][order], iou[order]
            at, reach = at[of], reach[of]
        none = at < 0
        place = at - np.repeat(t0, gn)
        held = pa.StructArray.from_arrays([pa.array(place.astype("i4"), mask=none), pa.array(reach, mask=none)], ["at", "iou"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(gn)].astype("i4")), held)

    return best(guesses, truths)


def reached_in_rows(guesses: Column, truths: Column, thresholds: list[float]) -> Column:
    """Of frames that are one row each: how many ids of guesses, then of truths, reach each threshold with any other."""

    @F.arrow_udf("array<bigint>")
    def reached(g: pa.Array, t: pa.Array) -> pa.Array:
        (mine, gbox, gn, g0), (theirs, tbox, tn, t0) = row_boxes(g, BOX[:6]), row_boxes(t, BOX[:6])
        ids = first_alike(mine["idx"], g0), first_alike(theirs["idx"], t0)
        most = [np.full(len(gbox), -1.0), np.full(len(tbox), -1.0)]
        for i, j in row_pairs(gn, tn):
            iou = box_ious(gbox[i], tbox[j])
            over = iou > 0
            for held, of, k in zip(most, ids, (i, j)):
                np.maximum.at(held, of[k[over]], iou[over])
        row_of = np.repeat(np.arange(len(gn)), gn), np.repeat(np.arange(len(tn)), tn)
        counts = [np.bincount(row[held >= cut], minlength=len(gn)) for held, row in zip(most, row_of) for cut in thresholds]
        table = np.stack(counts, 1) if counts else np.zeros((len(gn), 0), int)
        ends = np.arange(len(gn) + 1) * table.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(table.ravel().astype("i8")))

    return reached(guesses, truths)


def any_match(guesses: DataFrame, truths: DataFrame, keys: list[str], *, thresholds: list[float], confidence: float, iou: Callable[[DataFrame], Column] = aligned) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall): guesses above ``confidence`` that reach any truth, those that reach none, and truths that none reaches.

    Not one to one: a truth may serve many guesses.
    """
    return any_rates(any_counts(guesses, truths, keys, thresholds=thresholds, confidence=confidence, iou=iou), thresholds)


def any_counts(guesses: DataFrame, truths: DataFrame, keys: list[str], *, thresholds: list[float], confidence: float, iou: Callable[[DataFrame], Column] = aligned) -> DataFrame:
    """One row: numbers of guesses above ``confidence`` and of truths, and of those that reach each threshold, as arrays."""
    sure = guesses.where(F.col("score") > confidence)
    met = overlapping(sure, truths, keys)
    met = met.select(*keys, F.col("g_guess_id").alias("guess_id"), F.col("t_truth_id").alias("truth_id"), iou(met).alias("iou"))
    sides = {}
    for side in ("guess_id", "truth_id"):
        reach = met.groupBy(*keys, side).agg(F.max("iou").alias("iou"))
        counted = [F.count_if(F.col("iou") >= t).alias(f"n{k}") for k, t in enumerate(thresholds)]
        sides[side] = reach.agg(*counted)
    sizes = sure.agg(F.count("*").alias("guesses")).crossJoin(truths.agg(F.count("*").alias("truths")))
    hits = sides["guess_id"].select(F.array(*[f"n{k}" for k in range(len(thresholds))]).alias("by_guess"))
    found = sides["truth_id"].select(F.array(*[f"n{k}" for k in range(len(thresholds))]).alias("by_truth"))
    return sizes.crossJoin(hits).crossJoin(found)  # one row each


def any_rates(one: DataFrame, thresholds: list[float]) -> DataFrame:
    """``any_match`` of its counts."""
    rows = one.select("guesses", "truths", F.explode(F.arrays_zip(F.array(*map(F.lit, thresholds)).alias("threshold"), "by_guess", "by_truth")).alias("r"))
    tp, fn = F.col("r.by_guess"), F.col("truths") - F.col("r.by_truth")
    precision = F.coalesce(F.try_divide(tp, F.col("guesses")), F.lit(0.0))
    return rows.select(F.col("r.threshold").alias("threshold"), tp.alias("tp"), (F.col("guesses") - tp).alias("fp"), fn.alias("fn"), F.round(precision, 6).alias("precision"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall"))
