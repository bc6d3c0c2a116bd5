"""Augmentation of scenes: one rotation, flip, shift and scale for each scene, drawn by its key and applied alike to points and boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenova.functions import geometry as G
from scenova.functions.draws import normal, uniform

#: Degrees about a quarter turn, shift and scale to either side, noise in metres.
TURN, SHIFT, SCALE, NOISE = 5.0, 0.5, 0.02, 0.005


def drawn(seed: str, *key: Column) -> dict[str, Column]:
    """What a scene draws: quarter turns with a rest (radians), two flips, three shifts and a scale."""
    u = lambda name: uniform(f"{seed}/{name}", *key)
    out = {"turn": F.radians(90.0 * F.floor(4.0 * u("quarter")) + 2 * TURN * u("turn") - TURN), "flip_x": u("flip_x") > 0.5, "flip_y": u("flip_y") > 0.5}
    out |= {f"shift_{c}": 2 * SHIFT * u(f"shift_{c}") - SHIFT for c in "xyz"}
    return out | {"scale": 1 - SCALE + 2 * SCALE * u("scale")}


def moved(rows: DataFrame, seed: str, key: list[str], *, box: bool = False, noise: list[str] | None = None) -> DataFrame:
    """``rows`` with x, y, z moved as their scene ``key`` draws: flips, rotation about z, noise, shift and scale, in this order.

    Boxes turn their yaw and scale their sizes. With ``noise`` (columns that tell
    points apart) every point also draws a normal step along each axis.
    """
    names = {k: f"_{k}" for k in drawn(seed, *map(F.col, key))}
    held = rows.withColumns({names[k]: v for k, v in drawn(seed, *map(F.col, key)).items()})
    d = {k: F.col(v) for k, v in names.items()}
    x = F.when(d["flip_x"], -F.col("x")).otherwise(F.col("x"))
    y = F.when(d["flip_y"], -F.col("y")).otherwise(F.col("y"))
    c, s = F.cos(d["turn"]), F.sin(d["turn"])
    at = {"x": x * c - y * s, "y": x * s + y * c, "z": F.col("z")}
    if noise:
        at = {k: v + NOISE * normal(f"{seed}/noise_{k}", *map(F.col, [*key, *noise])) for k, v in at.items()}
    new = {k: (v + d[f"shift_{k}"]) * d["scale"] for k, v in at.items()}
    if box:
        yaw = F.when(d["flip_x"], F.lit(math.pi) - F.col("yaw")).otherwise(F.col("yaw"))
        yaw = F.when(d["flip_y"], -yaw).otherwise(yaw)
        new |= {"yaw": G.wrap_angle(yaw + d["turn"])} | {k: F.col(k) * d["scale"] for k in "lwh"}
    return held.withColumns(new).drop(*names.values())
