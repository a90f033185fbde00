"""Queries over single functions, fits with known answers, graphs and live rows."""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.functions import camera, geodesy, rotations
from larkgrid.operators import fits, frames, graph, relations, scenes, select
from larkgrid.plans.common import CLOUD, LOG, cloud, flight_log, table, written
from larkgrid.streaming import segments


def utm_coordinates(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = F.col("c_acctbal") / 200, F.lit(75.5) + (F.col("c_custkey") % 100) / 40
    e, n = geodesy.utm(lat, lon, geodesy.utm_zone(lon), lat < 0)
    return table(spark, d, "customer").select("c_custkey", F.round(e, 2).alias("e"), F.round(n, 2).alias("n"), geodesy.utm_epsg(lat, lon).alias("epsg"))


_RADIUS, _ALPHA = geodesy._series()
UTM = f"""
WITH p AS (SELECT c_custkey, c_acctbal / 200 AS lat, 75.5::DOUBLE + (c_custkey % 100) / 40 AS lon FROM customer),
z AS (SELECT *, floor((lon + 180) / 6)::INT + 1 AS zone, sin(radians(lat)) AS s, {sqrt(geodesy.E2)!r}::DOUBLE AS k FROM p),
t AS (SELECT *, radians(lon - (zone * 6 - 183)) AS l, sinh(atanh(s) - k * atanh(k * s)) AS t FROM z),
x AS (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM t)
SELECT c_custkey, round(0.9996::DOUBLE * {_RADIUS!r}::DOUBLE * (eta + {' + '.join(f'{a!r}::DOUBLE * cos({2 * i} * xi) * sinh({2 * i} * eta)' for i, a in enumerate(_ALPHA, 1))}) + 500000, 2) AS e,
  round(0.9996::DOUBLE * {_RADIUS!r}::DOUBLE * (xi + {' + '.join(f'{a!r}::DOUBLE * sin({2 * i} * xi) * cosh({2 * i} * eta)' for i, a in enumerate(_ALPHA, 1))}) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 2) AS n,
  CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone AS epsg FROM x
"""


def local_offsets(spark: SparkSession, d: str) -> DataFrame:
    """East, north and up of each customer from an origin of its own, which lies on its meridian: east is 0."""
    c = table(spark, d, "customer")
    lat, lon = F.lit(10.0) + F.col("c_nationkey") / 10, F.lit(5.0) + (F.col("c_custkey") % 7)
    e, n, u = geodesy.enu_between(lat, lon, F.col("c_acctbal"), lat, lon, F.lit(0.0))
    basis = geodesy.enu_basis(0.0, 90.0)
    return c.select("c_custkey", *[(F.round(v, 3) + F.lit(0.0)).alias(k) for k, v in zip("enu", (e, n, u))], *[F.lit(round(x, 6) + 0.0).alias(f"b{i}") for i, x in enumerate(basis[0])])


OFFSETS = "SELECT c_custkey, 0.0::DOUBLE AS e, 0.0::DOUBLE AS n, round(c_acctbal, 3) AS u, -1.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM customer"


def clock_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    s = lambda v: v.cast("string")
    text = F.when(k % 4 == 0, F.concat_ws(":", s(k % 24), s(k % 60), s(k % 59))).when(k % 4 == 1, F.concat_ws(":", s(k % 60), F.concat(s(k % 59), F.lit(".5")))).when(k % 4 == 2, s(k)).otherwise(F.lit("x:1"))
    return table(spark, d, "part").select("p_partkey", camera.hms_seconds(text).alias("s"))


CLOCKS = """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 24) * 3600 + (p_partkey % 60) * 60 + p_partkey % 59 WHEN 1 THEN (p_partkey % 60) * 60 + p_partkey % 59 + 0.5 WHEN 2 THEN p_partkey END::DOUBLE AS s FROM part
"""


def camera_geometry(spark: SparkSession, d: str) -> DataFrame:
    """A distorted point undistorted, its ray and elevation under a half turn about x, the camera's centre, its matrix and a crop."""
    p = table(spark, d, "part").withColumns({"x": F.col("p_size") / 200, "y": (F.col("p_partkey") % 30) / 200})
    r2 = F.col("x") ** 2 + F.col("y") ** 2
    p = p.withColumns({"xd": F.col("x") * (1 - 0.02 * r2), "yd": F.col("y") * (1 - 0.02 * r2)})
    x, y = camera.undistort(F.col("xd"), F.col("yd"), F.lit(-0.02))
    zero, one = F.lit(0.0), F.lit(1.0)
    over = (zero, one, zero, zero)
    ray = camera.ray_direction(over, F.col("x"), F.col("y"))
    centre = camera.camera_centre(over, (F.col("x"), F.col("y"), one))
    f, cx, cy = camera.intrinsics(F.lit(640), F.lit(480), F.lit(90.0))
    k = camera.intrinsics_matrix(f, f, cx, cy)
    low, high = camera.scaled_crop(F.col("p_size"), F.col("p_size") * 9 + 40, F.lit(1000), F.lit(640), 8)
    r = lambda c, n: (F.round(c, 5) + F.lit(0.0)).alias(n)
    return p.select("p_partkey", r(x, "x"), r(y, "y"), *[r(c, f"ray_{a}") for a, c in zip("xyz", ray)], r(camera.ray_elevation(*ray), "elevation"), *[r(c, f"centre_{a}") for a, c in zip("xyz", centre)], r(k[0][0], "fx"), r(k[1][2], "cy"), low.alias("low"), high.alias("high"))


CAMERA = """
WITH p AS (SELECT p_partkey, p_size / 200 AS x, (p_partkey % 30) / 200 AS y, ceil(p_size * 0.64::DOUBLE)::INT AS a, floor((p_size * 9 + 40) * 0.64::DOUBLE)::INT AS b FROM part),
c AS (SELECT *, (b - a) // 8 * 8 AS n FROM p)
SELECT p_partkey, round(x, 5) AS x, round(y, 5) AS y, round(x, 5) AS ray_x, round(-y, 5) + 0.0 AS ray_y, -1.0::DOUBLE AS ray_z, round(degrees(asin(-1 / sqrt(x * x + y * y + 1))), 5) AS elevation,
  round(-x, 5) + 0.0 AS centre_x, round(y, 5) AS centre_y, 1.0::DOUBLE AS centre_z, 320.0::DOUBLE AS fx, 239.5::DOUBLE AS cy, (a + (b - a - n) // 2)::INT AS low, (a + (b - a - n) // 2 + n)::INT AS high FROM c
"""


def heading_turns(spark: SparkSession, d: str) -> DataFrame:
    """A quaternion to a matrix and back, its product with a second frame's, and a point turned by a heading."""
    s = table(spark, d, "supplier")
    a = F.radians(F.col("s_nationkey") * 7.0)
    q = (F.cos(a / 2), F.lit(0.6) * F.sin(a / 2), F.lit(0.0), F.lit(0.8) * F.sin(a / 2))
    m = rotations.quat_to_matrix(q)
    s = s.withColumns({f"m{i}{j}": m[i][j] for i in range(3) for j in range(3)})
    back = rotations.matrix_to_quat([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)])
    x, y = rotations.heading_rotate(F.lit(2.0), F.lit(1.0), F.col("s_nationkey") * 7.0)
    up = rotations.rotation_between(np.array([0.0, 1, 0]), np.array([0.0, 0, 1]))
    return s.select("s_suppkey", *[(F.round(c, 5) + F.lit(0.0)).alias(n) for n, c in zip("wxyz", back)], F.round(x, 5).alias("hx"), F.round(y, 5).alias("hy"), F.lit(round(float(up[2, 1]), 5)).alias("up"))


TURNS = """
WITH s AS (SELECT s_suppkey, radians(s_nationkey * 7.0) AS a FROM supplier)
SELECT s_suppkey, round(cos(a / 2), 5) AS w, round(0.6::DOUBLE * sin(a / 2), 5) AS x, 0.0::DOUBLE AS y, round(0.8::DOUBLE * sin(a / 2), 5) AS z, round(2 * cos(a) - sin(a), 5) AS hx, round(2 * sin(a) + cos(a), 5) AS hy, 1.0::DOUBLE AS up FROM s
"""


def pass_verdicts(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    verdict = relations.pass_verdict(F.col("l_discount") * 8, F.col("l_tax") * 20, F.col("l_quantity") / 15, F.col("l_linenumber"), 2)
    return i.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.sum(scenes.fusion_least_views(F.col("l_linenumber") * 3)).alias("views"))


VERDICTS = """
SELECT CASE WHEN l_linenumber < 2 THEN 'too-short' WHEN l_discount * 8 >= 0.5 AND l_tax * 20 >= 1 THEN '3d' WHEN l_discount * 8 >= 0.2::DOUBLE OR l_quantity / 15 >= 2 THEN 'weak-3d' ELSE 'degenerate' END AS verdict,
  count(*) AS n, sum(CASE WHEN l_linenumber <= 4 THEN 1.5 ELSE 2.5 END)::DOUBLE AS views FROM lineitem GROUP BY 1
"""


def first_best(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    return select.arg_best(i, ["l_suppkey"], F.struct(F.col("l_quantity"), -F.col("l_orderkey"), -F.col("l_linenumber")), ["l_orderkey", "l_linenumber"])


FIRST_BEST = """
WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS k FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber FROM r WHERE k = 1
"""


def large_components(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    edges = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") * 2 % 97 + 1).alias("b")).where("a <> b")
    faces = s.where("s_suppkey <= 97").select(F.col("s_suppkey").alias("face"))
    return graph.keep_large(edges, faces, "face", 4, 0.05, written)


LARGE = """
WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey * 2 % 97 + 1 AS b FROM supplier WHERE s_suppkey % 3 <> 0), u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT s_suppkey AS v, s_suppkey AS r FROM supplier UNION SELECT reach.v, u.b FROM reach JOIN u ON reach.r = u.a),
c AS (SELECT v AS face, min(r) AS component FROM reach WHERE v <= 97 GROUP BY v), n AS (SELECT component, count(*) AS faces FROM c GROUP BY 1)
SELECT face, component, faces FROM c JOIN n USING (component) WHERE faces >= greatest(4, (SELECT count(*) FROM c) * 0.05)
"""


def process_descent(spark: SparkSession, d: str) -> DataFrame:
    """A tree with branches and one chain of a hundred and fifty levels."""
    p = table(spark, d, "part").where("p_partkey <= 200")
    tree = p.select(F.col("p_partkey").alias("pid"), F.when(F.col("p_partkey") <= 40, F.floor(F.col("p_partkey") / 3)).otherwise(F.col("p_partkey") - 1).alias("ppid"))
    return graph.descend(tree, [1, 40], written)


DESCENT = """
WITH RECURSIVE t AS (SELECT p_partkey AS pid, CASE WHEN p_partkey <= 40 THEN p_partkey // 3 ELSE p_partkey - 1 END AS ppid FROM part WHERE p_partkey <= 200),
r AS (SELECT pid, 0 AS depth FROM t WHERE pid IN (1, 40) UNION SELECT t.pid, r.depth + 1 FROM r JOIN t ON t.ppid = r.pid)
SELECT pid, min(depth)::INT AS depth FROM r GROUP BY pid
"""


def nested_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of texts that nest up to twelve levels deep."""
    deep = F.concat(F.repeat(F.lit('{"k":'), F.lit(11)), F.col("n_nationkey").cast("string"), F.repeat(F.lit("}"), F.lit(11)))
    text = F.concat(F.lit('{"a":'), deep, F.lit(',"l":[1,2],"m":[1,2,3,4,5,6,7],"s":"x"}'))
    v = table(spark, d, "nation").select("n_nationkey", F.parse_json(text).alias("v"))
    return frames.flatten(v, ["n_nationkey"], "v", written)


LEAVES = f"""
SELECT n_nationkey, p.path, CASE p.path WHEN 'l.0' THEN '1' WHEN 'l.1' THEN '2' WHEN 'm' THEN '[7 items]' WHEN 's' THEN 'x' ELSE n_nationkey::VARCHAR END AS value
FROM nation, (SELECT unnest(['a{'.k' * 11}', 'l.0', 'l.1', 'm', 's']) AS path) p
"""


def monotone_knots(spark: SparkSession, d: str) -> DataFrame:
    """Medians of quantile bins, pooled where they fall: against the greatest of least means."""
    out = fits.monotone_fit(cloud(spark, d), ["solid"], "x", "z", 8, 3)
    return out.select("solid", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


KNOTS = f"""
WITH {CLOUD}, e AS (SELECT solid, list_sort(list_distinct(quantile_cont(x, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]))) AS e FROM cloud GROUP BY solid),
b AS (SELECT solid, x, z, greatest(0, least(len(e) - 2, len(list_filter(e, lambda v: v <= x)) - 1)) AS bin FROM cloud JOIN e USING (solid)),
m AS (SELECT solid, bin, median(x) AS x, median(z) AS y, count(*) AS w FROM b GROUP BY ALL HAVING count(*) >= 3),
s AS (SELECT j.solid, j.bin AS j, k.bin AS k, sum(i.y * i.w) / sum(i.w) AS mean FROM m j JOIN m k ON j.solid = k.solid AND j.bin <= k.bin JOIN m i ON i.solid = j.solid AND i.bin BETWEEN j.bin AND k.bin GROUP BY ALL),
l AS (SELECT m.solid, m.bin, s.j, min(s.mean) AS least FROM m JOIN s ON s.solid = m.solid AND s.j <= m.bin AND s.k >= m.bin GROUP BY ALL)
SELECT m.solid, round(m.x, 4) AS x, round(max(l.least), 4) AS y FROM m JOIN l ON l.solid = m.solid AND l.bin = m.bin GROUP BY m.solid, m.bin, m.x
"""


def information_criteria(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(fits.gric(F.col("l_discount") * 50, F.lit(1.2), 8, 2), 4).alias("gric"))
    return i


GRIC = "SELECT l_suppkey, round(sum(least(l_discount * 50 / (1.2::DOUBLE * 1.2::DOUBLE), 4.0)) + count(*) * 2 * ln(4.0) + 8 * ln(4 * count(*)), 4) AS gric FROM lineitem GROUP BY 1"


def known_plane(spark: SparkSession, d: str) -> DataFrame:
    """The plane z = 0.1 x + 0.2 y + 1 among a tenth of outliers, and the angle that levels it."""
    c = cloud(spark, d).withColumn("z", F.lit(1.0) + F.col("x") / 10 + F.col("y") / 5 + F.when(F.col("pid") % 10 == 0, 500.0).otherwise(0.0))
    normal, offset, n = fits.ground_plane(c, 0.001, up=np.array([0.0, 0, 1]))
    level = rotations.rotation_between(normal, np.array([0.0, 0, 1]))
    return spark.createDataFrame([(*[round(float(v), 5) for v in normal], round(offset, 5), n, round(float(np.degrees(np.arccos(level[2, 2]))), 4))], "nx double, ny double, nz double, offset double, inliers long, tilt double")


PLANE = """
SELECT round(-0.1::DOUBLE / sqrt(1.05::DOUBLE), 5) AS nx, round(-0.2::DOUBLE / sqrt(1.05::DOUBLE), 5) AS ny, round(1 / sqrt(1.05::DOUBLE), 5) AS nz, round(1 / sqrt(1.05::DOUBLE), 5) AS offset,
  count(*) AS inliers, round(degrees(acos(1 / sqrt(1.05::DOUBLE))), 4) AS tilt FROM lineitem WHERE (l_orderkey * 8 + l_linenumber) % 10 <> 0
"""


def known_similarity(spark: SparkSession, d: str) -> DataFrame:
    """A similarity found among a quarter of wrong pairs."""
    from larkgrid.plans.models import TURN, pairs_of

    c = pairs_of(cloud(spark, d), TURN)
    wrong = F.when(F.col("pid") % 4 == 0, 1000.0 + F.col("colour") * F.col("solid") * 3).otherwise(0.0)
    fit, n = fits.ransac_similarity(c.withColumns({"dx": F.col("dx") + wrong, "dz": F.col("dz") - wrong * F.col("x") / 7}), 0.01)
    return spark.createDataFrame([(round(fit.s, 5), round(float(fit.r[0, 0]), 5), *[round(float(v), 3) for v in fit.t], n)], "s double, cos double, tx double, ty double, tz double, inliers long")


SIMILARITY = "SELECT 1.5::DOUBLE AS s, round(cos(radians(30)), 5) AS cos, 1.0::DOUBLE AS tx, 2.0::DOUBLE AS ty, 3.0::DOUBLE AS tz, count(*) AS inliers FROM lineitem WHERE (l_orderkey * 8 + l_linenumber) % 4 <> 0"


def track_shape(spark: SparkSession, d: str) -> DataFrame:
    found = fits.track_shape(cloud(spark, d))
    return spark.createDataFrame([(round(found["linearity"], 5), round(found["planarity"], 5))], "linearity double, planarity double")


SHAPE = f"""
WITH {CLOUD}, m AS (SELECT var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(y, z) AS e, covar_pop(x, z) AS f FROM cloud),
q AS (SELECT *, (a + b + c) / 3 AS q FROM m), p AS (SELECT *, sqrt(((a - q)**2 + (b - q)**2 + (c - q)**2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM q),
r AS (SELECT *, ((a - q) * (b - q) * (c - q) + 2 * d * e * f - (a - q) * e * e - (b - q) * f * f - (c - q) * d * d) / (2 * p**3) AS r FROM p),
g AS (SELECT *, acos(greatest(-1, least(1, r))) / 3 AS g FROM r),
v AS (SELECT q + 2 * p * cos(g) AS l1, q + 2 * p * cos(g + 2 * pi() / 3) AS l3, 3 * q - (q + 2 * p * cos(g)) - (q + 2 * p * cos(g + 2 * pi() / 3)) AS l2 FROM g)
SELECT round(sqrt(l2 / l1), 5) AS linearity, round(sqrt(l3 / l2), 5) AS planarity FROM v
"""


def aimed_at(spark: SparkSession, d: str) -> DataFrame:
    """Cameras of each solid that look at one point."""
    c = cloud(spark, d).withColumns({"cx": F.col("x") + 60, "cy": F.col("y"), "cz": F.col("z") + 30})
    r = F.sqrt((F.col("cx") - F.col("solid")) ** 2 + (F.col("cy") - 2) ** 2 + (F.col("cz") - 3) ** 2)
    axes = c.select("solid", "cx", "cy", "cz", ((F.col("solid") - F.col("cx")) / r).alias("dx"), ((F.lit(2) - F.col("cy")) / r).alias("dy"), ((F.lit(3) - F.col("cz")) / r).alias("dz"))
    return scenes.subject_point(axes, ["solid"]).select("solid", *[F.round(v, 3).alias(v) for v in ("x", "y", "z", "aimed", "distance")])


AIMED = f"""
WITH {CLOUD} SELECT solid, solid::DOUBLE AS x, 2.0::DOUBLE AS y, 3.0::DOUBLE AS z, 1.0::DOUBLE AS aimed, round(median(sqrt((x + 60 - solid)**2 + (y - 2)**2 + (z + 27)**2)), 3) AS distance FROM cloud GROUP BY solid
"""


def robust_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a tenth of wild points, by two weightings."""
    c = cloud(spark, d).withColumn("v", F.lit(2.0) - 0.25 * F.col("x") + F.when(F.col("pid") % 10 == 0, 900.0).otherwise(0.0))
    one = fits.robust_lines(c, ["solid"], "x", "v").select("solid", F.round("b", 3).alias("cauchy"), "n")
    two = fits.robust_lines(c.where("pid % 10 <> 0"), ["solid"], "x", "v", fits.huber_line).select("solid", F.round("a", 3).alias("a"), F.round("b", 3).alias("huber"))
    return one.join(two, "solid")


LINES = f"WITH {CLOUD} SELECT solid, -0.25::DOUBLE AS cauchy, count(*) AS n, 2.0::DOUBLE AS a, -0.25::DOUBLE AS huber FROM cloud GROUP BY solid"


def segment_jobs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.concat(F.lit("seg_"), F.col("o_orderkey").cast("string")).alias("file"), (F.col("o_orderkey") * 10).cast("double").alias("start_s"), (F.col("o_orderkey") * 10 + 8).cast("double").alias("end_s"))
    return segments.job_rows(o, "live", 2.5, (12.5, 77.6))


JOBS = "SELECT 'live' AS session, 'seg_' || o_orderkey AS job, o_orderkey * 10 + 2.5::DOUBLE AS t0, o_orderkey * 10 + 10.5::DOUBLE AS t1, 12.5::DOUBLE AS lat0, 77.6::DOUBLE AS lon0 FROM orders"


def first_fixes(spark: SparkSession, d: str) -> DataFrame:
    log = flight_log(spark, d).select(F.col("user_id").alias("source"), F.when(F.col("event_id") % 3 == 0, F.col("lat")).alias("lat"), "lon", F.struct("t", "event_id").alias("t"))
    return segments.first_fix(log)


FIXES = f"WITH {LOG} SELECT user_id AS source, arg_min(lat, (t, event_id)) AS lat, arg_min(lon, (t, event_id)) AS lon FROM log WHERE event_id % 3 = 0 GROUP BY 1"

QUERIES = {
    "utm_coordinates": (utm_coordinates, UTM),
    "local_offsets": (local_offsets, OFFSETS),
    "clock_texts": (clock_texts, CLOCKS),
    "camera_geometry": (camera_geometry, CAMERA),
    "heading_turns": (heading_turns, TURNS),
    "pass_verdicts": (pass_verdicts, VERDICTS),
    "first_best": (first_best, FIRST_BEST),
    "large_components": (large_components, LARGE),
    "process_descent": (process_descent, DESCENT),
    "nested_leaves": (nested_leaves, LEAVES),
    "monotone_knots": (monotone_knots, KNOTS),
    "information_criteria": (information_criteria, GRIC),
    "known_plane": (known_plane, PLANE),
    "known_similarity": (known_similarity, SIMILARITY),
    "track_shape": (track_shape, SHAPE),
    "aimed_at": (aimed_at, AIMED),
    "robust_lines": (robust_lines, LINES),
    "segment_jobs": (segment_jobs, JOBS),
    "first_fixes": (first_fixes, FIXES),
}
