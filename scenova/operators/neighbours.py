"""Neighbourhoods of points as joins on grid cells.

A cloud of up to ``WHOLE`` points is written as one row and compared whole where
it lies, so no pair and no copy of a point travels. In larger clouds cells are
as wide as the radius: a point meets the 27 cells about it and nothing is
compared across the cloud; without a radius the cell follows from how dense the
cloud is. Order among neighbours is by index.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenova.sources.sinks import written

AXES = "xyz"
#: Clouds of up to so many points are one row each.
WHOLE = 512


def clouds(points: DataFrame, whole: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Clouds of up to ``whole`` points as rows (scene_id, _cloud), an array by index; the points of larger ones, or None without such.

    The points are computed and written once; a larger cloud is written in blocks of about ``whole`` points.
    """
    whole = whole or WHOLE
    sized = points.withColumn("_size", F.count("*").over(Window.partitionBy("scene_id")))
    block = F.pmod(F.xxhash64("idx"), F.ceil(F.col("_size") / F.lit(whole))).cast("int")
    one = F.struct("idx", *[c for c in points.columns if c not in ("scene_id", "idx")])
    rows = sized.withColumn("_block", block).groupBy("scene_id", "_size", "_block").agg(F.collect_list(one).alias("_cloud"))
    held = written(rows, "clouds")
    large = held.where(F.col("_size") > whole)
    small = held.where(F.col("_size") <= whole).select("scene_id", F.array_sort("_cloud").alias("_cloud"))
    return small, None if large.isEmpty() else large.select("scene_id", F.explode("_cloud").alias("_c")).select("scene_id", "_c.*").select(points.columns)


def split_clouds(places: pa.Array) -> list[list[np.ndarray]]:
    """The fields of each cloud's structs as arrays."""
    ends = np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False).astype(int))[:-1]
    return list(zip(*[np.split(c.to_numpy(zero_copy_only=False).astype(float), ends) for c in places.flatten().flatten()]))


def lists_of(lengths: list[np.ndarray], values: pa.Array) -> pa.Array:
    """Values cut into lists, and those into one for each cloud."""
    cuts = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype("i4"))
    return pa.ListArray.from_arrays(cuts([len(n) for n in lengths]), pa.ListArray.from_arrays(cuts(np.concatenate([np.zeros(0), *lengths])), values))


def squares(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return sum((c[:, None] - c[None, :]) * (c[:, None] - c[None, :]) for c in (x, y, z))


def near_places(places: pa.Array) -> pa.Array:
    """For each point (x, y, z, r) of each cloud the places of those within r of it, and of a few that rounding can't tell from them."""
    hits = [squares(x, y, z) <= (r * r * (1 + 1e-9))[:, None] for x, y, z, r in split_clouds(places)]
    return lists_of([h.sum(axis=1) for h in hits], pa.array(np.concatenate([np.zeros(0), *[np.nonzero(h)[1] for h in hits]]).astype("i4")))


def each_size(centres: DataFrame, points: DataFrame, within: Callable[[Callable[[str], Column]], Column], small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``small(rows)`` over centres that carry their cloud's points as ``_cloud`` by index (null without one), and ``large(centres, points)`` of larger clouds.

    Where centres and points are the same frame, ``_cloud`` holds only what is ``within`` that distance, as told from the centre's columns, or hardly more.
    """
    few, many = clouds(points)
    if centres is points:
        asked = F.arrow_udf(near_places, "array<array<int>>")
        near = asked(F.transform("_cloud", lambda p: F.struct(*[p[c].alias(c) for c in AXES], within(p.__getitem__).alias("r"))))
        met = few.select("scene_id", "_cloud", F.explode(F.arrays_zip(F.col("_cloud").alias("c"), near.alias("near"))).alias("_v"))
        near = F.when(F.col("scene_id").isNotNull(), F.transform("_v.near", lambda i: F.get("_cloud", i)))
        met = met.select("scene_id", "_v.c.*", near.alias("_cloud"))
        return small(met) if many is None else small(met).unionByName(large(many, many))
    if many is None:
        return small(centres.join(few, "scene_id", "left"))
    wide = many.select("scene_id").distinct()
    rest = small(centres.join(wide, "scene_id", "left_anti").join(few, "scene_id", "left"))
    return rest.unionByName(large(centres.join(wide, "scene_id", "left_semi"), many))


def near_lists(centres: DataFrame, points: DataFrame, radius: float, inside: Callable[[Callable[[str], Column]], Column], finish: Callable[[DataFrame], DataFrame], pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Centres of small clouds go to ``finish`` with those points that are ``inside`` as ``_near``, by index; of larger clouds ``pairs`` gets the pairs that are."""

    def small(rows: DataFrame) -> DataFrame:
        return finish(rows.select(*centres.columns, F.filter("_cloud", lambda p: inside(p.__getitem__)).alias("_near")))

    corner = lambda _: F.lit(radius * 3**0.5)
    return each_size(centres, points, corner, small, lambda c, p: pairs(near_pairs(c, p, radius).where(inside(lambda n: F.col(f"p_{n}")))))


def mean(values: Column) -> Column:
    """Mean of an array without its nulls, null where none is left."""
    told = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(told) > 0, F.aggregate(told, F.lit(0.0), lambda s, v: s + v) / F.size(told))


def apart(p: Column | Callable[[str], Column]) -> Column:
    """Squared distance of the row's point to another one, a struct or its columns by name."""
    at = p if callable(p) and not isinstance(p, Column) else p.__getitem__
    return sum((F.col(c) - at(c)) * (F.col(c) - at(c)) for c in AXES)


def celled(points: DataFrame, width: float) -> DataFrame:
    return points.withColumns({f"c{c}": F.floor(F.col(c) / width).cast("int") for c in AXES})


def around(points: DataFrame) -> DataFrame:
    """Each row once for each of the 27 cells about its own."""
    for c in AXES:
        points = points.withColumn(f"c{c}", F.explode(F.array(*[F.col(f"c{c}") + k for k in (-1, 0, 1)])))
    return points


def near_pairs(centres: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Pairs of a centre and a point of one cloud within a cell of each other, with d2. Columns p_* are the point's."""
    keys = ["scene_id", *[f"c{c}" for c in AXES]]
    left = around(celled(centres, radius))
    right = celled(points, radius)
    right = right.select(*keys, *[F.col(c).alias(f"p_{c}") for c in points.columns if c != "scene_id"])
    d2 = sum((F.col(c) - F.col(f"p_{c}")) * (F.col(c) - F.col(f"p_{c}")) for c in AXES)
    return left.join(right, keys).drop(*keys[1:]).withColumn("d2", d2)


def first_near(centres: DataFrame, points: DataFrame, radius: float, n: int, *, least: float | None = None, inclusive: bool = False, key: str = "idx") -> DataFrame:
    """Each centre with ``_near``, the first ``n`` points by index with d < radius (<= when inclusive), as an array of their columns, null or empty without any.

    With ``least`` only those at that distance or more, or at none, count.
    ``key`` tells the centres of a cloud apart.
    """
    square = radius * radius
    others = [c for c in points.columns if c not in ("scene_id", "idx")]

    def hit(d2: Column) -> Column:
        near = d2 <= square if inclusive else d2 < square
        return near if least is None else near & ((d2 == 0) | (d2 >= least * least))

    def small(rows: DataFrame) -> DataFrame:
        near = F.filter("_cloud", lambda p: hit(apart(p)))
        return rows.select(*centres.columns, F.slice(near, 1, n).alias("_near"))

    def large(centres: DataFrame, points: DataFrame) -> DataFrame:
        met = near_pairs(centres, points, radius).where(hit(F.col("d2")))
        ranked = met.withColumn("rn", F.row_number().over(Window.partitionBy("scene_id", key).orderBy("p_idx"))).where(F.col("rn") <= n)
        one = F.struct(*[F.col(f"p_{c}").alias(c) for c in ("idx", *others)])
        found = ranked.groupBy("scene_id", key).agg(F.array_sort(F.collect_list(one)).alias("_near"))
        return centres.join(found, ["scene_id", key], "left").select(*centres.columns, "_near")

    return each_size(centres, points, lambda _: F.lit(float(radius)), small, large)


def padded(held: Column, n: int) -> Column:
    """``n`` numbers, the first one in place of those that miss; none where there is none."""
    return F.when(F.size(held) > 0, F.concat(held, F.array_repeat(F.get(held, F.lit(0)), F.lit(n) - F.size(held)))).otherwise(F.array().cast("array<int>"))


def ball_query(centres: DataFrame, points: DataFrame, radius: float, n: int, *, least: float | None = None, inclusive: bool = False, key: str = "point_id") -> DataFrame:
    """For each centre the first ``n`` points by index with d < radius (<= when inclusive), padded with the first one.

    With ``least`` only those at that distance or more, or at none, count. A centre without any has an empty array.
    ``key`` tells the centres of a cloud apart; ``idx`` does so where ids repeat.
    """
    found = first_near(centres, points, radius, n, least=least, inclusive=inclusive, key=key)
    return found.select(*dict.fromkeys(["scene_id", key, "point_id"]), padded(F.transform("_near", lambda p: p["idx"]), n).alias("neighbours"))


def voxel_query(centres: DataFrame, points: DataFrame, *, width: float, reach: int, radius: float, n: int) -> DataFrame:
    """For each centre the points of up to ``n`` voxels, in z, y, x order, ``reach`` voxels away at most and within the radius.

    A voxel's first point by index stands for it. The list is padded with its first one; a centre without any has an empty array.
    """
    cells = [f"c{c}" for c in AXES]
    keys, square = ["scene_id", "idx", "point_id"], radius * radius

    def small(rows: DataFrame) -> DataFrame:
        cell = lambda p, c: F.floor(p[c] / width).cast("int")
        near = F.filter("_cloud", lambda p: apart(p) <= square)
        own = lambda c: F.floor(F.col(c) / width).cast("int")
        near = F.filter(near, lambda p: (F.abs(cell(p, "x") - own("x")) <= reach) & (F.abs(cell(p, "y") - own("y")) <= reach) & (F.abs(cell(p, "z") - own("z")) <= reach))
        placed = lambda p: F.struct(cell(p, "z").alias("cz"), cell(p, "y").alias("cy"), cell(p, "x").alias("cx"), p["idx"].alias("i"))
        rows = rows.select(*keys, F.transform("_cloud", placed).alias("_all"), F.transform(near, placed).alias("_near"))
        # Another point of a voxel may come before that within the radius, so all of its voxel are looked at.
        before = lambda v, o: (o["i"] < v["i"]) & (o["cx"] == v["cx"]) & (o["cy"] == v["cy"]) & (o["cz"] == v["cz"])
        first = F.filter("_near", lambda v: ~F.exists("_all", lambda o: before(v, o)))
        return rows.select(*keys, F.transform(F.slice(F.array_sort(first), 1, n), lambda v: v["i"]).alias("h"))

    def large(centres: DataFrame, points: DataFrame) -> DataFrame:
        held = celled(points, width).groupBy("scene_id", *cells).agg(F.min_by(F.struct("idx", *AXES), "idx").alias("p"))
        near = celled(centres, width)
        for c in cells:
            near = near.withColumn(c, F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach)))
        met = near.join(held, ["scene_id", *cells]).where(apart(F.col("p")) <= square)
        first = F.slice(F.sort_array(F.collect_list(F.struct("cz", "cy", "cx", F.col("p.idx").alias("i")))), 1, n)
        found = met.groupBy("scene_id", "idx").agg(F.transform(first, lambda v: v["i"]).alias("h"))
        return centres.select(*keys).join(found, ["scene_id", "idx"], "left").select(*keys, "h")

    corner = radius + width * 3**0.5
    return each_size(centres, points, lambda _: F.lit(corner), small, large).select(*keys, padded(F.col("h"), n).alias("neighbours"))


def nearest_places(places: pa.Array, most: pa.Array) -> pa.Array:
    """For each point of each cloud (x, y, z by index) the places of its nearest other ones, the lowest index on ties."""
    lengths, at, far = [], [], []
    for (x, y, z), n in zip(split_clouds(places), most.to_pylist()):
        d2, size = squares(x, y, z), len(x)
        order = np.argsort(d2, axis=1, kind="stable")
        order = order[order != np.arange(size)[:, None]].reshape(size, size - 1)[:, :n]
        at.append(order.ravel())
        far.append(np.take_along_axis(d2, order, 1).ravel())
        lengths.append(np.full(size, order.shape[1]))
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0), *at]).astype("i4")), pa.array(np.concatenate([np.zeros(0), *far]))], ["at", "d2"])
    return lists_of(lengths, pairs)


def nearest_first(met: DataFrame, n: int) -> DataFrame:
    """The ``n`` nearest p_ points of each (scene_id, idx), the lowest index on ties."""
    met = met.where("idx <> p_idx").withColumn("d2", sum((F.col(c) - F.col(f"p_{c}")) * (F.col(c) - F.col(f"p_{c}")) for c in AXES))
    w = Window.partitionBy("scene_id", "idx").orderBy("d2", "p_idx")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("d", F.sqrt("d2"))


def three_nearest(points: DataFrame, *, whole: int | None = None, n: int = 3) -> DataFrame:
    """The three nearest other points of each point's cloud: rows (scene_id, idx, point_id, rank, p_point_id, d).

    Clouds of up to ``whole`` points (else ``WHOLE``) are compared whole. In larger ones a point
    takes the finest of the grids, each twice as fine as the one before, where
    its own cell holds more than ``n`` points: they are within a cell's
    diagonal, so all nearest ones are in the cells two steps about it.
    """
    few, many = clouds(points, whole)
    asked = F.arrow_udf(nearest_places, "array<array<struct<at:int,d2:double>>>")
    near = asked(F.transform("_cloud", lambda p: F.struct(*[p[c].alias(c) for c in AXES])), F.lit(n))
    met = few.where("scene_id IS NOT NULL").select("scene_id", "_cloud", F.explode(F.arrays_zip(F.col("_cloud").alias("c"), near.alias("near"))).alias("_v"))
    met = met.select("scene_id", "_v.c.*", "_cloud", F.posexplode("_v.near").alias("rank", "_n")).withColumn("_p", F.get("_cloud", F.col("_n.at")))
    others = [c for c in points.columns if c != "scene_id"]
    found = met.select("scene_id", *others, *[F.col(f"_p.{c}").alias(f"p_{c}") for c in others], F.col("_n.d2").alias("d2"), (F.col("rank") + 1).alias("rank"), F.sqrt("_n.d2").alias("d"))
    return found if many is None else found.unionByName(grid_nearest(many, n))


def grid_nearest(points: DataFrame, n: int) -> DataFrame:
    """``three_nearest`` of clouds that are large."""
    named = lambda df: df.select(*[F.col(c).alias(c if c in ("scene_id", "level") or c[0] == "c" else f"p_{c}") for c in df.columns])
    low, high = [F.min(c).alias(f"low_{c}") for c in AXES], [F.max(c).alias(f"high_{c}") for c in AXES]
    sizes = points.groupBy("scene_id").agg(F.count("*").alias("size"), *low, *high)
    extent = F.greatest(*[F.col(f"high_{c}") - F.col(f"low_{c}") for c in AXES], F.lit(1e-9)) * 1.0000001
    depth = F.ceil(F.log2(F.col("size")) / 3).cast("int") + 3
    large = sizes.select("scene_id", extent.alias("extent"), depth.alias("depth"), *[f"low_{c}" for c in AXES])
    cells = [f"c{c}" for c in AXES]
    grids = points.join(large, "scene_id").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    grids = grids.withColumns({f"c{c}": F.floor((F.col(c) - F.col(f"low_{c}")) * F.pow(F.lit(2.0), F.col("level")) / F.col("extent")).cast("int") for c in AXES})
    grids = grids.select(*points.columns, "level", *cells)
    full = grids.groupBy("scene_id", "level", *cells).count().where(F.col("count") > n).drop("count")
    own = grids.join(full, ["scene_id", "level", *cells]).groupBy("scene_id", "idx").agg(F.max("level").alias("level"))
    centres = grids.join(own, ["scene_id", "idx", "level"])
    for c in cells:
        centres = centres.withColumn(c, F.explode(F.sequence(F.col(c) - 2, F.col(c) + 2)))
    met = centres.join(named(grids), ["scene_id", "level", *cells]).drop("level", *cells)
    return nearest_first(met, n)


def interpolate(points: DataFrame, feature: str, **how) -> DataFrame:
    """Feature of each point by inverse distance over its three nearest other points."""
    weight = 1 / (F.col("d") + 1e-8)
    near = three_nearest(points, **how)
    return near.groupBy("scene_id", "idx", "point_id").agg((F.sum(weight * F.col(f"p_{feature}")) / F.sum(weight)).alias("value"))


def voxel_pool(points: DataFrame, width: float, feature: str) -> DataFrame:
    """Count, mean, largest value and first value by index of each voxel."""
    keys = ["scene_id", *[f"c{c}" for c in AXES]]
    return celled(points, width).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(feature).alias("mean"), F.max(feature).alias("most"), F.min_by(feature, "idx").alias("first"))


def paired(c: str) -> Column:
    """A column of a pair's point."""
    return F.col(f"p_{c}")


def local(reach: float, cube: bool = False) -> Callable[[Callable[[str], Column]], Column]:
    """Whether a point is within ``reach`` of the centre, in a ball or a cube, the bound included."""
    return lambda p: F.greatest(*[F.abs(p(c) - F.col(c)) for c in AXES]) <= reach if cube else apart(p) <= reach * reach


def local_neighbours(centres: DataFrame, points: DataFrame, reach: float, *, cube: bool = False, most: int | None = None) -> DataFrame:
    """Pairs of a centre and a point within ``reach`` of it, in a ball or a cube, the bound included.

    With ``most`` a centre has its first points by index only, the size of a local list.
    """
    met = near_pairs(centres, points, reach).where(local(reach, cube)(paired))
    if most is None:
        return met
    return met.withColumn("_place", F.row_number().over(Window.partitionBy("scene_id", "idx").orderBy("p_idx"))).where(F.col("_place") <= most).drop("_place")


def local_cell(reach: float, cells: int, p: Callable[[str], Column] = paired) -> Column:
    """Place of a pair's point in the grid of ``cells`` a side about its centre; the packed place is clamped, not each axis."""
    step = [F.floor((p(c) - F.col(c) + reach) / (2 * reach / cells)) for c in AXES]
    packed = step[0] * (cells * cells) + step[1] * cells + step[2]
    return F.least(F.greatest(packed, F.lit(0)), F.lit(cells**3 - 1)).cast("int")


def local_grid_pool(centres: DataFrame, points: DataFrame, reach: float, cells: int, features: list[str], *, fold: int, cube: bool = False, first: bool = False) -> DataFrame:
    """Rows (scene_id, idx, point_id, cell, n, c0.., dx, dy, dz) for each filled cell of each centre's grid.

    Feature i goes to channel i % ``fold``. A cell has the mean of its points'
    channel sums and offsets, or with ``first`` what its first point by index
    has (of the features of a channel the last one).
    """
    keys = ["scene_id", "idx", "point_id", "cell"]

    def values(p: Callable[[str], Column]) -> dict[str, Column]:
        channels = {f"c{k}": [p(f) for f in features[k::fold]] for k in range(fold)}
        return {k: v[-1] if first else sum(v[1:], v[0]) for k, v in channels.items()} | {f"d{c}": p(c) - F.col(c) for c in AXES}

    def pairs(met: DataFrame) -> DataFrame:
        met, of = met.withColumn("cell", local_cell(reach, cells)), values(paired)
        if first:
            held = met.groupBy(*keys).agg(F.min_by(F.struct(*[v.alias(k) for k, v in of.items()]), "p_idx").alias("_v"))
            return held.select(*keys, F.lit(1).cast("long").alias("n"), "_v.*")
        return met.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(v).alias(k) for k, v in of.items()])

    def finish(rows: DataFrame) -> DataFrame:
        one = lambda p: F.struct(local_cell(reach, cells, p.__getitem__).alias("cell"), *[v.alias(k) for k, v in values(p.__getitem__).items()])
        rows = rows.select(*keys[:3], F.transform("_near", one).alias("_near"))
        rows = rows.withColumn("cell", F.explode(F.array_distinct(F.transform("_near", lambda v: v["cell"]))))
        rows = rows.withColumn("_near", F.filter("_near", lambda v: v["cell"] == F.col("cell")))
        names = [*[f"c{k}" for k in range(fold)], *[f"d{c}" for c in AXES]]
        of = lambda k: F.get("_near", F.lit(0))[k] if first else mean(F.transform("_near", lambda v: v[k]))
        return rows.select(*keys, (F.lit(1) if first else F.size("_near")).cast("long").alias("n"), *[of(k).alias(k) for k in names])

    return near_lists(centres, points, reach, local(reach, cube), finish, pairs)


def local_three_nearest(centres: DataFrame, points: DataFrame, reach: float, cells: int, *, most: int = 1000) -> DataFrame:
    """The three points of a centre's local list nearest to each sub-voxel centre of its grid: (scene_id, idx, point_id, cell, first, second, third).

    Sub-voxels are numbered in x, y, z order. The first neighbour stands in for a missing second or third.
    """
    step = 2 * reach / cells
    at = [-reach + step / 2 + k * step for k in range(cells)]
    centre = F.array(*[F.struct(F.lit(i).alias("cell"), *[F.lit(v).alias(f"o{c}") for c, v in zip(AXES, o)]) for i, o in enumerate((a, b, c) for a in at for b in at for c in at)])
    near = first_near(centres, points, reach, most, inclusive=True).withColumn("_g", F.explode(F.when(F.size("_near") > 0, centre)))
    away = lambda p: sum((F.col(c) + F.col(f"_g.o{c}") - p[c]) * (F.col(c) + F.col(f"_g.o{c}") - p[c]) for c in AXES)
    nearest = F.slice(F.sort_array(F.transform("_near", lambda p: F.struct(away(p).alias("d2"), p["idx"].alias("i")))), 1, 3)
    found = near.select("scene_id", "idx", "point_id", F.col("_g.cell").alias("cell"), nearest.alias("l"))
    place = lambda k: F.coalesce(F.get("l", F.lit(k)), F.get("l", F.lit(0)))["i"]
    return found.select("scene_id", "idx", "point_id", "cell", place(0).alias("first"), place(1).alias("second"), place(2).alias("third"))


def box_pool(boxes: DataFrame, points: DataFrame, cells: int, feature: str, *, width: float, slots: int) -> DataFrame:
    """Rows (scene_id, idx, point_id, code, n, most, mean) for every voxel of every turned box; empty voxels have 0.

    Boxes have x, y, z, l, w, h and yaw. A voxel takes its first ``slots`` - 1
    points by index. Boxes and points of a scene meet on grid cells of ``width``
    that the box's ball covers.
    """
    reach = lambda p: F.sqrt(p("l") * p("l") + p("w") * p("w") + p("h") * p("h")) / 2 + 1e-4
    codes = [(a << 16) + (b << 8) + c for a in range(cells) for b in range(cells) for c in range(cells)]

    def turned_to(p: Callable[[str], Column]) -> list[Column]:
        sx, sy, sz = [p(c) - F.col(c) for c in AXES]
        return [sx * F.cos("yaw") + sy * F.sin("yaw"), sy * F.cos("yaw") - sx * F.sin("yaw"), sz]

    def held_in(u: Column, v: Column, t: Column) -> Column:
        return (F.abs(t) <= F.col("h") / 2) & (F.abs(u) < F.col("l") / 2 + 1e-5) & (F.abs(v) < F.col("w") / 2 + 1e-5)

    def code(u: Column, v: Column, t: Column) -> Column:
        return roi_code(u / F.col("l") + 0.5, v / F.col("w") + 0.5, t / F.col("h") + 0.5, cells)

    def small(rows: DataFrame) -> DataFrame:
        near = F.filter("_cloud", lambda p: held_in(*turned_to(p.__getitem__)))
        rows = rows.withColumn("_near", F.transform(near, lambda p: F.struct(code(*turned_to(p.__getitem__)).alias("code"), p[feature].alias("f"))))
        rows = rows.select("scene_id", "idx", "point_id", "_near", F.explode(F.array(*map(F.lit, codes))).alias("code"))
        rows = rows.withColumn("_near", F.transform(F.slice(F.filter("_near", lambda p: p["code"] == F.col("code")), 1, slots - 1), lambda p: p["f"]))
        return rows.select("scene_id", "idx", "point_id", "code", F.size("_near").cast("long").alias("n"), F.array_max("_near").alias("most"), mean(F.col("_near")).alias("mean"))

    def large(boxes: DataFrame, points: DataFrame) -> DataFrame:
        grid = [f"c{c}" for c in AXES]
        near = boxes.withColumn("_r", reach(F.col))
        for c in AXES:
            near = near.withColumn(f"c{c}", F.explode(F.sequence(F.floor((F.col(c) - F.col("_r")) / width).cast("int"), F.floor((F.col(c) + F.col("_r")) / width).cast("int"))))
        held = celled(points, width).select("scene_id", *grid, *[F.col(c).alias(f"p_{c}") for c in (*AXES, "idx", feature)])
        turned = turned_to(paired)
        met = near.join(held, ["scene_id", *grid]).where(held_in(*turned)).withColumn("code", code(*turned))
        place = F.row_number().over(Window.partitionBy("scene_id", "idx", "code").orderBy("p_idx"))
        kept = met.withColumn("_place", place).where(F.col("_place") < slots)
        pooled = kept.groupBy("scene_id", "idx", "code").agg(F.count("*").alias("n"), F.max(f"p_{feature}").alias("most"), F.avg(f"p_{feature}").alias("mean"))
        every = boxes.select("scene_id", "idx", "point_id", F.explode(F.array(*map(F.lit, codes))).alias("code"))
        return every.join(pooled, ["scene_id", "idx", "code"], "left").select("scene_id", "idx", "point_id", "code", "n", "most", "mean")

    full = each_size(boxes, points, reach, small, large)
    none = F.coalesce(F.col("n"), F.lit(0)) < 1
    return full.select("scene_id", "idx", "point_id", "code", *[F.when(none, zero).otherwise(F.coalesce(c, zero)).alias(c) for c, zero in (("n", F.lit(0).cast("long")), ("most", F.lit(0.0)), ("mean", F.lit(0.0)))])


def roi_code(u: Column, v: Column, t: Column, cells: int) -> Column:
    """Place of a local coordinate (0 to 1 on each axis) in a box's voxels, packed in one number."""
    cell = [F.least(F.greatest(F.floor(a * cells), F.lit(0)), F.lit(cells - 1)).cast("int") for a in (u, v, t)]
    return F.shiftleft(cell[0], 16) + F.shiftleft(cell[1], 8) + cell[2]
