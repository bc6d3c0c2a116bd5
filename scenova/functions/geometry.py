"""Geometry as column expressions: frames, boxes, bearings and relation families.

Front is +x, left is +y, up is +z. The relation families differ on purpose:
each has its own dead zone and its own rule for ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotate_xy(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    a = F.radians(degrees)
    return x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)


def wrap_angle(angle: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(angle + F.pi(), 2 * F.pi()) - F.pi()


def planar(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def spatial(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def bearing(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def sector(dx: Column, dy: Column) -> Column:
    """Quadrant of the bearing: both 45 degree edges are front's, 135 is left's, -135 is right's."""
    return F.when(F.abs(dy) <= dx, "front").when((dy > 0) & (-dx <= dy), "left").when((dy < 0) & (dx >= dy), "right").when((dx == 0) & (dy == 0), "front").otherwise("behind")


def sign_relations(dx: Column, dy: Column) -> Column:
    """[lateral, longitudinal]; 0 is right and behind."""
    return F.array(F.when(dy > 0, "left").otherwise("right"), F.when(dx > 0, "front").otherwise("behind"))


def dead_zone_relation(dx: Column, dy: Column) -> Column:
    """lat_lon label beyond 1.5 / 3.0 m, one axis alone when the other is within 0.75 / 1.5 m, else null."""
    lon = F.when(dx >= 3.0, "front").when(dx <= -3.0, "behind")
    lat = F.when(dy >= 1.5, "left").when(dy <= -1.5, "right")
    return F.when(lon.isNotNull() & lat.isNotNull(), F.concat(lat, F.lit("_"), lon)).when(lon.isNotNull() & (F.abs(dy) <= 0.75), lon).when(lat.isNotNull() & (F.abs(dx) <= 1.5), lat)


def dominant_relation(dx: Column, dy: Column, least: float = 1.0) -> Column:
    """The larger axis (x on ties), null when both are under ``least``."""
    return F.when(F.greatest(F.abs(dx), F.abs(dy)) < least, None).when(F.abs(dx) >= F.abs(dy), F.when(dx > 0, "front").otherwise("behind")).otherwise(F.when(dy > 0, "left").otherwise("right"))


def relation_atoms(dx: Column, dy: Column, band: float = 1.0) -> Column:
    """Axes at or beyond ``band``, lateral first; when there is none, the longitudinal sign (0 is front)."""
    lat = F.when(F.abs(dy) >= band, F.when(dy > 0, "left").otherwise("right"))
    lon = F.when(F.abs(dx) >= band, F.when(dx > 0, "front").otherwise("behind"))
    found = F.array_compact(F.array(lat, lon))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.when(dx >= 0, "front").otherwise("behind")))


def margin_relation(dx: Column, dy: Column, margin: float = 0.25, least: float = 0.5) -> Column:
    """The larger axis when it is at least ``least`` and leads by ``margin``, else null."""
    side, along = F.abs(dy), F.abs(dx)
    return F.when((along >= least) & (along >= side + margin), F.when(dx > 0, "front").otherwise("behind")).when((side >= least) & (side >= along + margin), F.when(dy > 0, "left").otherwise("right"))


def inverse_relation(key: Column) -> Column:
    """Each _-separated word of a relation turned round."""
    turned = F.transform(F.split(key, "_"), lambda w: F.when(w == "left", "right").when(w == "right", "left").when(w == "front", "behind").when(w == "behind", "front"))
    return F.array_join(turned, "_")


def quality_bucket(iou: Column) -> Column:
    return F.when(iou.isNull(), "no_iou").when(iou < 0.1, "<0.1").when(iou < 0.25, "0.1-0.25").when(iou < 0.5, "0.25-0.5").when(iou < 0.75, "0.5-0.75").otherwise(">=0.75")


def overlap(a_centre: Column, a_size: Column, b_centre: Column, b_size: Column) -> Column:
    """Length two intervals share."""
    low = F.greatest(a_centre - a_size / 2, b_centre - b_size / 2)
    high = F.least(a_centre + a_size / 2, b_centre + b_size / 2)
    return F.greatest(F.lit(0.0), high - low)


def hull(a_centre: Column, a_size: Column, b_centre: Column, b_size: Column) -> Column:
    """Length of the smallest interval that holds two."""
    return F.greatest(a_centre + a_size / 2, b_centre + b_size / 2) - F.least(a_centre - a_size / 2, b_centre - b_size / 2)


def aligned_iou(a: tuple, b: tuple) -> tuple[Column, Column]:
    """IoU and generalised IoU of two boxes (x, y, z, l, w, h) along the axes."""
    inter = overlap(a[0], a[3], b[0], b[3]) * overlap(a[1], a[4], b[1], b[4]) * overlap(a[2], a[5], b[2], b[5])
    union = a[3] * a[4] * a[5] + b[3] * b[4] * b[5] - inter
    around = hull(a[0], a[3], b[0], b[3]) * hull(a[1], a[4], b[1], b[4]) * hull(a[2], a[5], b[2], b[5])
    iou = inter / union
    return iou, iou - (around - union) / around


def corners(x: Column, y: Column, z: Column, l: Column, w: Column, h: Column, yaw: Column) -> Column:  # noqa: E741
    """Eight corners, top face first, turned by ``yaw`` about the centre."""
    signs = [(1, 1), (1, -1), (-1, -1), (-1, 1)]
    out = []
    for up in (1, -1):
        for a, b in signs:
            u, v = l * (a / 2), w * (b / 2)
            out.append(F.struct((x + u * F.cos(yaw) - v * F.sin(yaw)).alias("x"), (y + u * F.sin(yaw) + v * F.cos(yaw)).alias("y"), (z + h * (up / 2)).alias("z")))
    return F.array(*out)


def in_box(px: Column, py: Column, pz: Column, box: tuple, *, margin: float = 1e-5, inclusive: bool = False) -> Column:
    """Point in a turned box. Strict in the plane with a margin and inclusive in height, or inclusive throughout without one."""
    x, y, z, l, w, h, yaw = box  # noqa: E741
    u = (px - x) * F.cos(yaw) + (py - y) * F.sin(yaw)
    v = (py - y) * F.cos(yaw) - (px - x) * F.sin(yaw)
    if inclusive:
        return (F.abs(u) <= l / 2) & (F.abs(v) <= w / 2) & (F.abs(pz - z) <= h / 2)
    return (F.abs(u) < l / 2 + margin) & (F.abs(v) < w / 2 + margin) & (F.abs(pz - z) <= h / 2)


def project(x: Column, y: Column, z: Column, focal: tuple[float, float], centre: tuple[float, float]) -> tuple[Column, Column, Column]:
    """Pinhole image coordinates and depth of a point ahead (x forward, y left, z up)."""
    return F.when(x > 0, centre[0] - focal[0] * y / x), F.when(x > 0, centre[1] - focal[1] * z / x), x


def distort(x: Column, y: Column, radial: tuple[float, float, float], tangential: tuple[float, float]) -> tuple[Column, Column]:
    """Image-plane coordinates (at depth 1) through a lens: radial terms of r^2, r^4 and r^6, and two tangential ones."""
    r2 = x * x + y * y
    grow = 1.0 + r2 * (radial[0] + r2 * (radial[1] + r2 * radial[2]))
    p, q = tangential
    return x * grow + 2.0 * p * x * y + q * (r2 + 2.0 * x * x), y * grow + p * (r2 + 2.0 * y * y) + 2.0 * q * x * y


def undistort(u: Column, v: Column, radial: tuple[float, float, float], tangential: tuple[float, float], steps: int = 12) -> Column:
    """Struct (x, y) that ``distort`` sends to (u, v), by fixed-point steps from there."""

    def step(s: Column, _: Column) -> Column:
        bent_x, bent_y = distort(s["x"], s["y"], radial, tangential)
        return F.struct((s["x"] + (u - bent_x)).alias("x"), (s["y"] + (v - bent_y)).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(u.alias("x"), v.alias("y")), step)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def softmax(values: Column) -> Column:
    """Shifted by the largest value."""
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, v: s + v)
    return F.transform(powers, lambda v: v / total)


def close_arrays(a: Column, b: Column, tolerance: float) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))), lambda ok: ok)


def matrix_4x4(flat: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(flat, i * 4 + 1, 4))


def local_plan(boxes: Column) -> Column:
    """Path choice among boxes (structs with x, y, w and ord): steer, pass_side and blocker.

    Paths go straight or swerve 3 m; a path's clearance is the least distance of
    its line to a box ahead (1 < x < 22), less half the box and 1.2 m. The best
    one is taken, straight before left before right on ties; below -0.5 m it is
    stop. Null when nothing is ahead.
    """
    ahead = F.filter(boxes, lambda b: (b["x"] > 1.0) & (b["x"] < 22.0))

    def clearance(offset: float) -> Column:
        gaps = F.transform(ahead, lambda b: F.abs(b["y"] - offset * F.least(F.greatest(b["x"] / 10.0, F.lit(0.0)), F.lit(1.0))) - F.greatest(b["w"] / 2.0, F.lit(0.3)) - 1.2)
        return F.array_min(gaps)

    near = F.array_min(F.transform(ahead, lambda b: F.struct(planar(b["x"], b["y"]).alias("d"), b["ord"].alias("ord"), b["y"].alias("y"))))
    straight, left, right = clearance(0.0), clearance(3.0), clearance(-3.0)
    best = F.greatest(straight, left, right)
    steer = F.when(best < -0.5, "stop").when(straight == best, "straight").when(left == best, "left").otherwise("right")
    offset = F.when(straight == best, 0.0).when(left == best, 3.0).otherwise(-3.0)
    side = F.when(best >= -0.5, F.when(offset > near["y"], "left").otherwise("right"))
    return F.when(F.size(ahead) > 0, F.struct(steer.alias("steer"), side.alias("pass_side"), near["ord"].alias("blocker"), best.alias("clearance")))


def apply_pose(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A point through a pose of 16 numbers, row by row."""
    return tuple(m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3] for i in range(3))


def inverse_pose(m: Column) -> Column:
    """Inverse of a rigid pose of 16 numbers: the rotation transposed, the shift turned back."""
    rows = []
    for i in range(3):
        turned = [m[i], m[4 + i], m[8 + i]]
        rows += [*turned, -(turned[0] * m[3] + turned[1] * m[7] + turned[2] * m[11])]
    return F.array(*rows, *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
