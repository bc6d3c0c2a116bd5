"""Point clouds: neighbourhood, pooling and sampling queries. A customer's objects are a cloud."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenova.functions.ids import hash_order
from scenova.operators import neighbours as N
from scenova.operators import sampling
from scenova.operators import sequential as S
from scenova.plans.base import query
from scenova.sources.scenes import ORDER_SQL, objects

CLOUD_SQL = f"cloud AS (SELECT cloud AS scene_id, object_id AS point_id, CAST(row_number() OVER (PARTITION BY cloud ORDER BY {ORDER_SQL}) - 1 AS INTEGER) AS idx, x, y, z, score AS f FROM objects)"
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


def cloud(spark, sf_dir) -> DataFrame:
    rows = objects(spark, sf_dir).select(F.col("cloud").alias("scene_id"), F.col("object_id").alias("point_id"), "x", "y", "z", F.col("score").alias("f"))
    return rows.withColumn("idx", (F.row_number().over(Window.partitionBy("scene_id").orderBy("point_id", "x", "y", "z", "f")) - 1).cast("int"))


def ball_sql(predicate: str, n: int = 8) -> str:
    """Every point is a centre; its place tells it apart where ids repeat."""
    return f"""WITH {CLOUD_SQL}, h AS (SELECT a.scene_id, a.idx AS place, b.idx, row_number() OVER (PARTITION BY a.scene_id, a.idx ORDER BY b.idx) AS rn FROM cloud a JOIN cloud b ON a.scene_id = b.scene_id AND {predicate}),
    g AS (SELECT scene_id, place, list(idx ORDER BY idx) AS l FROM h WHERE rn <= {n} GROUP BY ALL)
    SELECT c.scene_id, c.idx, c.point_id, coalesce(array_to_string(l, ',') || repeat(',' || l[1], {n} - len(l)::INTEGER), '') AS neighbours FROM cloud c LEFT JOIN g ON c.scene_id = g.scene_id AND c.idx = g.place"""


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("scene_id", "idx", "point_id", F.array_join("neighbours", ",").alias("neighbours"))


@query(ball_sql(f"{D2} < 16.0"), heads="o")
def ball_query(spark, sf_dir) -> DataFrame:
    """First eight points by index strictly within 4 m of each point, padded with the first."""
    p = cloud(spark, sf_dir)
    return shown(N.ball_query(p, p, 4.0, 8, key="idx"))


@query(ball_sql(f"({D2} = 0 OR ({D2} >= 4.0 AND {D2} < 16.0))"), heads="o")
def annulus_query(spark, sf_dir) -> DataFrame:
    """Points at 2 to 4 m, or at none."""
    p = cloud(spark, sf_dir)
    return shown(N.ball_query(p, p, 4.0, 8, least=2.0, key="idx"))


@query(ball_sql(f"{D2} <= 16.0"), heads="o")
def whole_voxel_query(spark, sf_dir) -> DataFrame:
    """``ball_query`` with the radius included."""
    p = cloud(spark, sf_dir)
    return shown(N.ball_query(p, p, 4.0, 8, inclusive=True, key="idx"))


VOXEL = "CAST(floor({0} / 2) AS INTEGER)"
VOXELS_SQL = f"{CLOUD_SQL}, celled AS (SELECT *, {', '.join(f'{VOXEL.format(c)} AS c{c}' for c in 'xyz')} FROM cloud), v AS (SELECT *, row_number() OVER (PARTITION BY scene_id, cx, cy, cz ORDER BY idx) AS turn FROM celled)"


@query(
    f"""WITH {VOXELS_SQL}, h AS (SELECT a.scene_id, a.idx AS place, b.idx, row_number() OVER (PARTITION BY a.scene_id, a.idx ORDER BY b.cz, b.cy, b.cx) AS rn FROM celled a JOIN v b ON a.scene_id = b.scene_id AND b.turn = 1
        AND abs(a.cx - b.cx) <= 2 AND abs(a.cy - b.cy) <= 2 AND abs(a.cz - b.cz) <= 2 AND {D2} <= 9.0),
    g AS (SELECT scene_id, place, list(idx ORDER BY rn) AS l FROM h WHERE rn <= 8 GROUP BY ALL)
    SELECT c.scene_id, c.idx, c.point_id, coalesce(array_to_string(l, ',') || repeat(',' || l[1], 8 - len(l)::INTEGER), '') AS neighbours FROM cloud c LEFT JOIN g ON c.scene_id = g.scene_id AND c.idx = g.place""",
    heads="o",
)
def voxel_query(spark, sf_dir) -> DataFrame:
    """Eight neighbours at most over voxels of 2 m in z, y, x order: the first point of each voxel counts, the radius of 3 m included."""
    p = cloud(spark, sf_dir)
    return shown(N.voxel_query(p, p, width=2.0, reach=2, radius=3.0, n=8))


NN_SQL = f"WITH {CLOUD_SQL}, n AS (SELECT a.scene_id, a.idx, a.point_id, b.point_id AS p_point_id, b.f, {D2} AS d2, row_number() OVER (PARTITION BY a.scene_id, a.idx ORDER BY {D2}, b.idx) AS rank FROM cloud a JOIN cloud b ON a.scene_id = b.scene_id AND a.idx <> b.idx)"


@query(NN_SQL + " SELECT scene_id, idx, point_id, rank, p_point_id, round(sqrt(d2), 6) AS d FROM n WHERE rank <= 3", heads="o")
def three_nn(spark, sf_dir) -> DataFrame:
    """The three nearest of all other points of the cloud, for every point; a smaller cloud gives fewer."""
    p = cloud(spark, sf_dir)
    return N.three_nearest(p).select("scene_id", "idx", "point_id", F.col("rank").cast("long").alias("rank"), "p_point_id", F.round("d", 6).alias("d"))


@query(
    NN_SQL + ", g AS (SELECT scene_id, idx, point_id, list(p_point_id ORDER BY rank) AS l FROM n WHERE rank <= 3 GROUP BY ALL) SELECT scene_id, idx, point_id, l[1] AS first, coalesce(l[2], l[1]) AS second, coalesce(l[3], l[1]) AS third FROM g",
    heads="o",
)
def three_nn_filled(spark, sf_dir) -> DataFrame:
    """Three neighbours of every point that has one; the first stands in for a missing second or third."""
    near = N.three_nearest(cloud(spark, sf_dir)).groupBy("scene_id", "idx", "point_id").agg(*[F.max(F.when(F.col("rank") == k, F.col("p_point_id"))).alias(c) for k, c in enumerate(("first", "second", "third"), 1)])
    return near.withColumns({c: F.coalesce(c, "first") for c in ("second", "third")})


@query(NN_SQL + " SELECT scene_id, idx, point_id, round(sum(f / (sqrt(d2) + 1e-8)) / sum(1 / (sqrt(d2) + 1e-8)), 4) AS value FROM n WHERE rank <= 3 GROUP BY ALL", heads="o")
def idw_interpolate(spark, sf_dir) -> DataFrame:
    """Inverse-distance weighting over the three nearest other points, for every point."""
    return N.interpolate(cloud(spark, sf_dir), "f").select("scene_id", "idx", "point_id", F.round("value", 4).alias("value"))


@query(f"WITH {CLOUD_SQL} SELECT scene_id, CAST(floor(x / 10) AS INTEGER) AS cx, CAST(floor(y / 10) AS INTEGER) AS cy, CAST(floor(z / 10) AS INTEGER) AS cz, count(*) AS n, round(avg(f), 7) AS mean, max(f) AS most, arg_min(f, idx) AS first FROM cloud GROUP BY ALL", heads="o")
def voxel_pool(spark, sf_dir) -> DataFrame:
    rows = N.voxel_pool(cloud(spark, sf_dir), 10.0, "f")
    return rows.select("scene_id", "cx", "cy", "cz", "n", F.round("mean", 7).alias("mean"), "most", "first")


@query(f"WITH {CLOUD_SQL} SELECT c.scene_id, c.point_id, round(avg(p.f), 4) AS mean, count(*) AS n FROM cloud c JOIN cloud p ON c.scene_id = p.scene_id AND p.idx IN (c.idx, c.idx + 1, c.idx + 2) GROUP BY ALL", heads="o")
def gather_features(spark, sf_dir) -> DataFrame:
    """Features gathered by index."""
    p = cloud(spark, sf_dir)
    asked = p.select("scene_id", "point_id", F.explode(F.array(F.col("idx"), F.col("idx") + 1, F.col("idx") + 2)).alias("idx"))
    met = asked.join(p.select("scene_id", "idx", "f"), ["scene_id", "idx"])
    return met.groupBy("scene_id", "point_id").agg(F.round(F.avg("f"), 4).alias("mean"), F.count("*").alias("n"))


@query(f"WITH {CLOUD_SQL} SELECT a.scene_id, a.idx, a.point_id, count(*) AS n, round(avg(b.x - a.x), 6) + 0.0 AS mean_dx FROM cloud a JOIN cloud b ON a.scene_id = b.scene_id AND {D2} < 16.0 GROUP BY ALL", heads="o")
def group_points(spark, sf_dir) -> DataFrame:
    """Neighbourhoods of every point with the centre subtracted."""
    p = cloud(spark, sf_dir)
    keys = ["scene_id", "idx", "point_id"]
    one = lambda rows: rows.select(*keys, F.size("_near").cast("long").alias("n"), N.mean(F.transform("_near", lambda v: v["x"] - F.col("x"))).alias("mean"))
    pairs = lambda met: met.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("p_x") - F.col("x")).alias("mean"))
    return N.near_lists(p, p, 4.0, lambda v: N.apart(v) < 16.0, one, pairs).where("n > 0").select(*keys, "n", (F.round("mean", 6) + 0.0).alias("mean_dx"))


@query(f"WITH {CLOUD_SQL} SELECT scene_id, CAST(floor((x + 25) / 5) AS INTEGER) * 65536 + CAST(floor(y / 5) AS INTEGER) * 256 + CAST(floor(z / 5) AS INTEGER) AS code, count(*) AS n, max(f) AS most FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, floor((x + 25) / 5), floor(y / 5), floor(z / 5) ORDER BY idx) AS rn FROM cloud WHERE x BETWEEN -25 AND 24.9 AND y BETWEEN 0 AND 49.9) WHERE rn <= 3 GROUP BY ALL", heads="o")
def roi_pool(spark, sf_dir) -> DataFrame:
    """Packed voxels of a region, three points of each at most by index (a pooling operator's cap), largest feature kept."""
    p = cloud(spark, sf_dir).where("x between -25 and 24.9 and y between 0 and 49.9")
    cells = [F.floor((F.col("x") + 25) / 5), F.floor(F.col("y") / 5), F.floor(F.col("z") / 5)]
    p = p.withColumn("code", (F.shiftleft(cells[0].cast("int"), 16) + F.shiftleft(cells[1].cast("int"), 8) + cells[2].cast("int")))
    capped = p.withColumn("rn", F.row_number().over(Window.partitionBy("scene_id", "code").orderBy("idx"))).where("rn <= 3")
    return capped.groupBy("scene_id", "code").agg(F.count("*").alias("n"), F.max("f").alias("most"))


@query(f"WITH {CLOUD_SQL} SELECT count(*) AS n, round(avg({D2}), 4) AS mean FROM cloud a JOIN cloud b ON a.scene_id = b.scene_id", heads="o")
def square_distances(spark, sf_dir) -> DataFrame:
    """Squared distances of all pairs of a cloud, by direct differences."""
    p = cloud(spark, sf_dir)
    q = p.select("scene_id", *[F.col(c).alias(f"q{c}") for c in "xyz"])
    d2 = sum((F.col(c) - F.col(f"q{c}")) * (F.col(c) - F.col(f"q{c}")) for c in "xyz")
    return p.join(q, "scene_id").agg(F.count("*").alias("n"), F.round(F.avg(d2), 4).alias("mean"))


@query(f"WITH {CLOUD_SQL} SELECT scene_id, point_id, stratum::INTEGER AS stratum FROM (SELECT *, ntile(4) OVER (PARTITION BY scene_id ORDER BY sqrt(x * x + y * y), idx) AS stratum FROM cloud)", heads="o")
def radius_strata(spark, sf_dir) -> DataFrame:
    """Four equal strata of a cloud by radius, for stratified sampling."""
    return cloud(spark, sf_dir).select("scene_id", "point_id", F.ntile(4).over(by_radius()).alias("stratum"))


def by_radius() -> Window:
    return Window.partitionBy("scene_id").orderBy(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), "idx")


def by_angle() -> Window:
    return Window.partitionBy("scene_id").orderBy(F.col("x") / F.col("y"), "idx")


def farthest_sql(group: str, source: str, n: int, *, head: str = "", feature: str = "") -> str:
    """CTEs q1 to qn: the picks so far of each group of (grp, idx, point_id, x, y, z)."""
    far = "(p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z)" + (f" + (p.{feature} - c.{feature}) * (p.{feature} - c.{feature})" if feature else "")
    out = [f"{head}c AS (SELECT *, {group} AS grp FROM {source})", "q1 AS (SELECT grp, 0 AS place, min(idx) AS idx FROM c GROUP BY grp)"]
    for k in range(1, n):
        near = f"SELECT c.grp, c.idx, min({far}) AS near FROM c JOIN q{k} q ON q.grp = c.grp JOIN c p ON p.grp = q.grp AND p.idx = q.idx GROUP BY ALL"
        out.append(f"q{k + 1} AS (SELECT * FROM q{k} UNION ALL SELECT grp, {k} AS place, arg_max(idx, {{'near': near, 'first': -idx}}) AS idx FROM ({near}) GROUP BY grp HAVING count(*) > {k})")
    return ", ".join(out)


def picks_sql(n: int) -> str:
    return f"SELECT q.grp AS scene_id, c.point_id, q.place FROM q{n} q JOIN c ON c.grp = q.grp AND c.idx = q.idx"


STRATUM = "scene_id * 4 + stratum - 1"


@query(f"WITH {CLOUD_SQL}, {farthest_sql('scene_id', 'cloud', 8)} {picks_sql(8)}", heads="o")
def farthest_points(spark, sf_dir) -> DataFrame:
    """Farthest-point sampling of eight points of each cloud."""
    return sampling.farthest_points(cloud(spark, sf_dir), 8)


@query(f"WITH {CLOUD_SQL}, {farthest_sql(STRATUM, 's', 2, head='s AS (SELECT *, ntile(4) OVER (PARTITION BY scene_id ORDER BY sqrt(x * x + y * y), idx) AS stratum FROM cloud), ')} {picks_sql(2)}", heads="o")
def strata_farthest_points(spark, sf_dir) -> DataFrame:
    """Farthest-point sampling in each stratum of a cloud."""
    p = cloud(spark, sf_dir).withColumn("stratum", F.ntile(4).over(by_radius()))
    p = p.withColumn("scene_id", F.col("scene_id") * 4 + F.col("stratum") - 1)
    return sampling.farthest_points(p, 2)


@query(f"WITH {CLOUD_SQL} SELECT scene_id, point_id, stratum::INTEGER AS stratum FROM (SELECT *, ntile(4) OVER (PARTITION BY scene_id ORDER BY x / y, idx) AS stratum FROM cloud)", heads="o")
def angle_strata(spark, sf_dir) -> DataFrame:
    """Four equal strata of a cloud by the angle atan(x / y), whose order is that of x / y."""
    return cloud(spark, sf_dir).select("scene_id", "point_id", F.ntile(4).over(by_angle()).alias("stratum"))


@query(f"WITH {CLOUD_SQL}, {farthest_sql(STRATUM, 's', 2, head='s AS (SELECT *, ntile(4) OVER (PARTITION BY scene_id ORDER BY x / y, idx) AS stratum FROM cloud), ')} {picks_sql(2)}", heads="o")
def angle_farthest_points(spark, sf_dir) -> DataFrame:
    """Farthest-point sampling in each stratum of angle."""
    p = cloud(spark, sf_dir).withColumn("stratum", F.ntile(4).over(by_angle()))
    return sampling.farthest_points(p.withColumn("scene_id", F.col("scene_id") * 4 + F.col("stratum") - 1), 2)


@query(
    f"SELECT scene_id, point_id, place, 'features' AS kind FROM (WITH {CLOUD_SQL}, {farthest_sql('scene_id', '(SELECT * REPLACE (f / 1000 AS f) FROM cloud)', 4, feature='f')} {picks_sql(4)}) UNION ALL SELECT scene_id, point_id, place, 'coordinates' FROM (WITH {CLOUD_SQL}, {farthest_sql('scene_id', 'cloud', 4)} {picks_sql(4)})",
    heads="o",
)
def feature_farthest_points(spark, sf_dir) -> DataFrame:
    """Farthest-point sampling by coordinates with the feature (in thousands) as a fourth axis, and by coordinates alone."""
    p = cloud(spark, sf_dir).withColumn("f", F.col("f") / 1000)
    kinds = {"features": ("f",), "coordinates": ()}
    held = N.clouds(p)
    both = [sampling.farthest_of(held, 4, features=f).withColumn("kind", F.lit(kind)) for kind, f in kinds.items()]
    return both[0].unionByName(both[1])


@query(f"WITH {CLOUD_SQL} SELECT scene_id, point_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY f DESC, idx) AS rank FROM cloud) WHERE rank <= 8", heads="o")
def score_sample(spark, sf_dir) -> DataFrame:
    """The eight points of each cloud with the best class score; all points of a smaller cloud."""
    w = Window.partitionBy("scene_id").orderBy(F.desc("f"), "idx")
    return cloud(spark, sf_dir).select("scene_id", "point_id", F.row_number().over(w).alias("rank")).where("rank <= 8")


@query(
    f"""WITH {CLOUD_SQL}, h AS (SELECT a.scene_id, a.idx, a.point_id, b.idx AS other, (b.x - a.x) / 4 AS dx, row_number() OVER (PARTITION BY a.scene_id, a.idx ORDER BY b.idx) AS rn FROM cloud a JOIN cloud b ON a.scene_id = b.scene_id AND {D2} < 16.0),
    u AS (SELECT scene_id, idx, point_id, count(*) AS unique_n FROM h WHERE rn <= 8 GROUP BY ALL),
    k AS (SELECT *, unnest(range(8)) AS k FROM u),
    d AS (SELECT *, 1 + ('0x' || substr(sha1('resample|' || point_id || '|' || k), 1, 4))::INTEGER % unique_n AS rn FROM k)
    SELECT d.scene_id, d.idx, d.point_id, d.unique_n, string_agg(h.other::VARCHAR, ',' ORDER BY d.k) AS picks, round(avg(h.dx), 6) + 0.0 AS mean_dx FROM d JOIN h ON d.scene_id = h.scene_id AND d.idx = h.idx AND d.rn = h.rn GROUP BY ALL""",
    heads="o",
)
def resampled_groups(spark, sf_dir) -> DataFrame:
    """Eight draws by a hash from each point's first eight neighbours, their offsets in radii, and how many neighbours differ."""
    p = cloud(spark, sf_dir)
    met = N.first_near(p, p, 4.0, 8).where(F.size("_near") > 0)
    found = met.select("scene_id", "idx", "point_id", F.transform("_near", lambda v: F.struct(v["idx"].alias("i"), ((v["x"] - F.col("x")) / 4).alias("dx"))).alias("held"))
    drawn = lambda k: F.conv(F.substr(hash_order("resample", F.col("point_id"), k), F.lit(1), F.lit(4)), 16, 10).cast("int") % F.size("held")
    found = found.withColumn("drawn", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.get("held", drawn(k))))
    mean = F.aggregate("drawn", F.lit(0.0), lambda s, v: s + v["dx"]) / 8
    return found.select("scene_id", "idx", "point_id", F.size("held").cast("long").alias("unique_n"), F.array_join(F.transform("drawn", lambda v: v["i"]), ",").alias("picks"), (F.round(mean, 6) + 0.0).alias("mean_dx"))


@query()
def seeded_point_sample(spark, sf_dir) -> DataFrame:
    """A numpy generator's sample of each cloud, seeded by the cloud's id; with replacement when it is short."""
    import hashlib

    def pick(g: S.Columns) -> S.Columns:
        name = f"val:{g['scene_id'][0]}"
        rng = np.random.default_rng(int.from_bytes(hashlib.sha1(name.encode()).digest()[:8], "little"))
        n = len(g["idx"])
        at = rng.choice(n, 16, replace=n < 16)
        return {"scene_id": g["scene_id"][at], "place": np.arange(16), "point_id": g["point_id"][at]}

    return S.per_group(cloud(spark, sf_dir).select("scene_id", "point_id", "idx"), ["scene_id"], ["idx"], pick, "scene_id bigint, place long, point_id string")
