"""Queries over models, runs, links and georeferences."""

from __future__ import annotations

from math import cos, radians, sin

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.functions.rotations import Similarity
from larkgrid.operators import models
from larkgrid.plans.common import CLOUD, LOG, cloud, flight_log, table

C30, S30 = cos(radians(30)), sin(radians(30))
TURN = Similarity(1.5, np.array([[C30, -S30, 0], [S30, C30, 0], [0, 0, 1.0]]), np.array([1.0, 2.0, 3.0]))


def key_frames(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    pts = F.when(F.col("o_orderkey") % 7 == 0, "N/A").otherwise((F.col("o_orderkey") / 30).cast("string"))
    return models.key_frame_times(o.select(pts.alias("pts"), F.when(F.col("o_orderkey") % 12 == 0, "K__").otherwise("___").alias("flags")))


KEY_FRAMES = "SELECT o_orderkey / 30 AS t FROM orders WHERE o_orderkey % 12 = 0 AND o_orderkey % 7 <> 0"


def run_listing(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    suffix = F.when(k % 3 == 0, "mp4").when(k % 3 == 1, "JPG").otherwise("txt")
    path = F.concat(F.lit("runs/r"), (k % 40).cast("string"), F.lit("/f"), k.cast("string"), F.lit("."), suffix)
    files = table(spark, d, "part").select(path.alias("path"), F.col("p_size").cast("long").alias("size"), k.alias("mtime"))
    return models.run_listing(files, F.when(F.col("run").endswith("0"), "live").otherwise("build"), ["mp4", "jpg"])


RUN_LISTING = """
SELECT 'r' || (p_partkey % 40) AS run, CASE WHEN p_partkey % 10 = 0 THEN 'live' ELSE 'build' END AS kind, count(*) AS files, sum(p_size)::BIGINT AS bytes, max(p_partkey) AS mtime
FROM part WHERE p_partkey % 3 < 2 GROUP BY 1, 2
"""


def scene_index(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    return models.scene_index(s, "s_nationkey", ["s_name", "s_suppkey"], [(-F.col("s_suppkey")).alias("o")])


SCENE_INDEX = "SELECT s_nationkey, to_json({'models': list({'s_name': s_name, 's_suppkey': s_suppkey} ORDER BY s_suppkey DESC)})::VARCHAR AS json FROM supplier GROUP BY 1"


def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    return models.live_state(flight_log(spark, d), "user_id", ["t", "event_id"], "event_type", ["purchase", "logout"])


LIVE_SESSIONS = f"WITH {LOG} SELECT user_id, arg_max(event_type, (t, event_id)) AS event_type, count(*) AS jobs, count(*) FILTER (event_type IN ('purchase', 'logout')) AS done FROM log GROUP BY 1"


def needed_models(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_size").distinct()
    stages = F.array(F.when(F.col("p_size") % 2 == 0, "depth").otherwise("sfm"), F.lit("splat"))
    found = models.needed_models(stages, {"depth": ["d1", "d2"], "splat": ["d2", "s1"]})
    missing = models.missing_columns(["lat", "t"], ["lat", "lon"])
    return p.select("p_size", F.array_join(found, ",").alias("models"), F.array_join(missing, ",").alias("missing"))


NEEDED = "SELECT DISTINCT p_size, CASE WHEN p_size % 2 = 0 THEN 'd1,d2,s1' ELSE 'd2,s1' END AS models, 'lon' AS missing FROM part"


def flow_agreement(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").withColumns({"fx": F.col("l_quantity") / 10, "fy": F.col("l_discount") * 10})
    ok = models.flow_agrees(F.col("fx"), F.col("fy"), F.col("l_tax") * 20 - F.col("fx"), -F.col("fy"), F.col("l_linenumber") * 20, F.lit(10.0), F.lit(128), F.lit(64))
    return i.groupBy("l_linenumber").agg(F.count_if(ok).alias("kept"))


FLOW = """
WITH f AS (SELECT l_linenumber, l_quantity / 10 AS fx, l_discount * 10 AS fy, l_tax * 20 - l_quantity / 10 AS bx FROM lineitem)
SELECT l_linenumber, count(*) FILTER ((fx + bx)**2 < 0.01::DOUBLE * (fx**2 + fy**2 + bx**2 + fy**2) + 0.5::DOUBLE AND l_linenumber * 20 + fx BETWEEN 0 AND 127 AND 10 + fy BETWEEN 0 AND 63) AS kept FROM f GROUP BY 1
"""


def scale_errors(spark: SparkSession, d: str) -> DataFrame:
    absolute, relative = models.scale_error(F.col("p_retailprice"), F.col("p_size") * 20.0)
    return table(spark, d, "part").select("p_partkey", F.round(absolute, 4).alias("absolute"), F.round(relative, 6).alias("relative"))


SCALE_ERRORS = "SELECT p_partkey, round(p_retailprice - p_size * 20, 4) AS absolute, round((p_retailprice - p_size * 20.0::DOUBLE) / (p_size * 20.0::DOUBLE), 6) AS relative FROM part"


def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").withColumns({"total": F.lit(64.0), "own": F.col("l_quantity") - F.when(F.col("l_suppkey") % 3 == 0, F.col("l_linenumber")).otherwise(0)})
    return models.usage_summary(i, ["l_suppkey"], "l_quantity", "total", "own")


USAGE = """
SELECT l_suppkey, round(avg(l_quantity), 3) AS mean, round(max(l_quantity), 3) AS peak, round(max(l_quantity / 64), 4) AS peak_share, l_suppkey % 3 = 0 AS shared, count(*) AS samples FROM lineitem GROUP BY l_suppkey
"""


def cloud_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d).withColumn("frame", F.when(F.col("solid") % 2 == 0, "a").otherwise("b"))
    out = models.cloud_metrics(c, "solid", 6.0, c.where("colour % 3 = 0").withColumn("frame", F.lit("a")), "frame")
    return out.withColumns({f"{a}_extent": F.round(f"{a}_extent", 5) for a in "xyz"})


CLOUD_METRICS = f"""
WITH {CLOUD}, v AS (SELECT *, floor(x / 6) AS cx, floor(y / 6) AS cy, floor(z / 6) AS cz FROM cloud), r AS (SELECT DISTINCT cx, cy, cz FROM v WHERE colour % 3 = 0),
m AS (SELECT solid, count(*)::BIGINT AS points, round(max(x) - min(x), 5) AS x_extent, round(max(y) - min(y), 5) AS y_extent, round(max(z) - min(z), 5) AS z_extent FROM v GROUP BY solid),
o AS (SELECT solid, count(*) AS voxels, count(r.cx) AS hit FROM (SELECT DISTINCT solid, cx, cy, cz FROM v) d LEFT JOIN r USING (cx, cy, cz) GROUP BY solid)
SELECT solid, points, voxels, x_extent, y_extent, z_extent, CASE WHEN solid % 2 = 0 THEN round(hit / voxels, 6) END AS in_reference, CASE WHEN solid % 2 = 1 THEN 'frame b is not the reference''s' END AS reason FROM m JOIN o USING (solid)
"""


def run_collection(spark: SparkSession, d: str) -> DataFrame:
    out = models.collect_runs(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity", "l_tax", "l_linenumber", 0.079)
    text = F.array_join(F.transform(F.map_entries("stages"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string"))), ",")
    return out.withColumn("stages", text)


COLLECTION = """
WITH p AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS s, max(l_tax) AS m, max(l_linenumber) AS f FROM lineitem GROUP BY ALL)
SELECT l_suppkey, string_agg(l_returnflag || '=' || s::BIGINT, ',' ORDER BY l_returnflag) AS stages, round(sum(s), 3) AS total_s, round(max(f) / sum(s), 4) AS fps, max(m) <= 0.079 AS clean FROM p GROUP BY 1
"""


def view_overlaps(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").select(F.col("l_partkey").alias("tri"), (F.col("l_suppkey") % 12).alias("view"), "l_quantity")
    return models.view_overlaps(i, "tri", "view", "l_quantity").select("i", "j", "n", F.round("mean_i", 4).alias("mean_i"), F.round("mean_j", 4).alias("mean_j"))


OVERLAPS = """
WITH s AS (SELECT l_partkey AS tri, l_suppkey % 12 AS v, l_quantity AS x FROM lineitem)
SELECT a.v AS i, b.v AS j, count(*) AS n, round(avg(a.x), 4) AS mean_i, round(avg(b.x), 4) AS mean_j FROM s a JOIN s b ON a.tri = b.tri AND a.v < b.v GROUP BY ALL
"""


def overlap_ahead(spark: SparkSession, d: str) -> DataFrame:
    lives = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("pass"), F.col("l_linenumber").alias("frame"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 5).alias("until"))
    return models.overlap_ahead(lives, ["pass"], "frame", "until", 3).withColumn("overlap", F.round("overlap", 6))


OVERLAP_AHEAD = """
WITH l AS (SELECT l_suppkey % 20 AS pass, l_linenumber AS frame, l_linenumber + l_quantity::INT % 5 AS until, max(l_linenumber) OVER (PARTITION BY l_suppkey % 20) AS last FROM lineitem)
SELECT pass, frame, g.range::INT AS gap, round(avg((until >= frame + g.range)::INT), 6) AS overlap FROM l, range(1, 4) g WHERE frame + g.range <= last GROUP BY ALL
"""


def pair_statistics(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").withColumns({"i": F.col("l_suppkey") % 10, "j": F.col("l_linenumber"), "bx": F.col("l_quantity") + F.col("l_tax") * 50, "by_": F.col("l_discount") * 10, "zero": F.lit(0.0)})
    return models.pair_statistics(m, ["i", "j"], "l_quantity", "zero", "bx", "by_", 20)


PAIR_STATISTICS = """
WITH m AS (SELECT l_suppkey % 10 AS i, l_linenumber AS j, sqrt((l_quantity + l_tax * 50 - l_quantity)**2 + (l_discount * 10)**2) AS px FROM lineitem)
SELECT i, j, count(*) AS matches, round(median(px), 4) AS median_px, round(quantile_cont(px, 0.9), 4) AS p90_px FROM m GROUP BY ALL HAVING count(*) >= 20
"""


def model_depths(spark: SparkSession, d: str) -> DataFrame:
    obs = table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("model"), F.col("l_partkey").alias("image"), (F.col("l_quantity") - 5).alias("z"))
    return models.model_depth(obs, "model", "image", "z", 50, 2).withColumn("distance", F.round("distance", 4))


MODEL_DEPTHS = """
WITH p AS (SELECT l_suppkey % 7 AS model, l_partkey AS image, count(*) AS k, median(l_quantity - 5) FILTER (l_quantity > 5) AS z FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY image) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM p),
c AS (SELECT r.* FROM r WHERE n <= 50 OR i IN (SELECT floor(s.range * (r.n - 1) / 49) FROM range(50) s))
SELECT model, round(median(z) FILTER (k >= 2), 4) AS distance FROM c GROUP BY model
"""


def link_groups(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    name = lambda c: c.cast("string")
    k = F.col("n_nationkey")
    rows = n.select(name(k).alias("name"), (k * 10 + 5).cast("long").alias("images"), F.lit(None).cast("double").alias("depth"))
    unit = [F.lit(float(x)) for x in np.eye(3).ravel()]
    edges = n.select(name(k).alias("a"), name(k * 3 % 25).alias("b"), F.when(k % 4 == 1, 100).otherwise(400 + k).alias("inliers"), F.lit(1000).alias("candidates"), F.lit(1.0).alias("s"), F.array(*unit).alias("r"), F.array(*[F.lit(0.0)] * 3).alias("t"))
    found, _ = models.link_groups(rows, models.confident_edges(edges, "inliers", "candidates"))
    return spark.createDataFrame([(m, r) for m, (r, _) in found.items()], "name string, root string")


LINK_GROUPS = """
WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_nationkey * 3 % 25 AS b FROM nation WHERE n_nationkey % 4 <> 1), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT n_nationkey AS v, n_nationkey AS r FROM nation UNION SELECT reach.v, u.b FROM reach JOIN u ON reach.r = u.a)
SELECT v::VARCHAR AS name, max(r)::VARCHAR AS root FROM reach GROUP BY v
"""


def pairs_of(df: DataFrame, t: Similarity) -> DataFrame:
    """Points x, y, z as sx, sy, sz and their images as dx, dy, dz."""
    there = t.apply(F.col("x"), F.col("y"), F.col("z"))
    return df.select("*", *[F.col(a).alias(f"s{a}") for a in "xyz"], *[c.alias(f"d{a}") for a, c in zip("xyz", there)])


def group_similarities(spark: SparkSession, d: str) -> DataFrame:
    out = models.similarities(pairs_of(cloud(spark, d), TURN), ["solid"])
    return out.select("solid", "n", F.round("s", 6).alias("s"), F.round(F.col("r")[0], 6).alias("cos"), F.round(F.col("r")[3], 6).alias("sin"), *[F.round(F.col("t")[i], 4).alias(f"t{a}") for i, a in enumerate("xyz")])


SIMILARITIES = f"WITH {CLOUD} SELECT solid, count(*) AS n, 1.5::DOUBLE AS s, round(cos(radians(30)), 6) AS cos, 0.5::DOUBLE AS sin, 1.0::DOUBLE AS tx, 2.0::DOUBLE AS ty, 3.0::DOUBLE AS tz FROM cloud GROUP BY solid"


def similarity_algebra(spark: SparkSession, d: str) -> DataFrame:
    """A transform, its inverse, the transform twice, and its matrix's last column."""
    c = cloud(spark, d).select("pid", "x", "y", "z")
    p = tuple(F.col(a) for a in "xyz")
    twice, back = TURN.compose(TURN).apply(*p), TURN.inverse().apply(*p)
    return c.groupBy((F.col("pid") % 50).alias("g")).agg(*[F.round(F.sum(v), 2).alias(n) for n, v in zip(("x2", "y2", "z2", "xb", "yb", "zb"), (*twice, *back))], *[F.round(F.sum(F.lit(float(v))), 2).alias(f"m{i}") for i, v in enumerate(TURN.matrix()[:3, 3])])


ALGEBRA = f"""
WITH {CLOUD}, c AS (SELECT *, {C30!r}::DOUBLE AS c, {S30!r}::DOUBLE AS s FROM cloud),
o AS (SELECT pid, c, s, z, x, y, 1.5 * (c * x - s * y) + 1 AS x1, 1.5 * (s * x + c * y) + 2 AS y1, 1.5 * z + 3 AS z1 FROM c)
SELECT pid % 50 AS g, round(sum(1.5 * (c * x1 - s * y1) + 1), 2) AS x2, round(sum(1.5 * (s * x1 + c * y1) + 2), 2) AS y2, round(sum(1.5 * z1 + 3), 2) AS z2,
  round(sum((c * (x - 1) + s * (y - 2)) / 1.5), 2) AS xb, round(sum((c * (y - 2) - s * (x - 1)) / 1.5), 2) AS yb, round(sum((z - 3) / 1.5), 2) AS zb,
  count(*)::DOUBLE AS m0, 2.0::DOUBLE * count(*) AS m1, 3.0::DOUBLE * count(*) AS m2 FROM o GROUP BY 1
"""


def georeference(spark: SparkSession, d: str) -> DataFrame:
    """A level and a tilted survey: the first keeps the vertical, the second doesn't."""
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").where(k < 8).select(k.alias("key"), (k % 4).cast("double").alias("x"), F.floor(k / 4).cast("double").alias("y"), (k % 3).cast("double").alias("z"))
    tilt = np.array([[1, 0, 0], [0, cos(radians(10)), -sin(radians(10))], [0, sin(radians(10)), cos(radians(10))]])
    out = []
    for name, t in (("level", TURN), ("tilted", Similarity(2.0, tilt, np.array([5.0, 6.0, 7.0])))):
        mode, found = models.georeference(pairs_of(n, t), "key")
        out.append((name, mode, round(found.s, 5), round(models.tilt_degrees(found), 3), *[round(float(v), 4) for v in found.t]))
    return spark.createDataFrame(out, "survey string, mode string, scale double, tilt double, tx double, ty double, tz double")


GEOREFERENCE = "SELECT 'level' AS survey, 'yaw' AS mode, 1.5::DOUBLE AS scale, 0.0::DOUBLE AS tilt, 1.0::DOUBLE AS tx, 2.0::DOUBLE AS ty, 3.0::DOUBLE AS tz UNION ALL SELECT 'tilted', 'full', 2.0, 10.0, 5.0, 6.0, 7.0"


def depth_calibration(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d).withColumn("depth", F.exp(F.lit(3.0) - 0.02 * F.col("x")))
    out = models.log_affine(c, ["solid"], "x", "depth")
    return out.select("solid", "n", *[(F.round(v, 6) + F.lit(0.0)).alias(v) for v in ("a", "b", "inliers", "error", "median_error", "delta", "log_rmse")])


CALIBRATION = f"""
WITH {CLOUD} SELECT solid, count(*) AS n, -0.02::DOUBLE AS a, 3.0::DOUBLE AS b, 1.0::DOUBLE AS inliers, 0.0::DOUBLE AS error, 0.0::DOUBLE AS median_error, 1.0::DOUBLE AS delta, 0.0::DOUBLE AS log_rmse FROM cloud GROUP BY solid
"""


def depth_fill(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the depths are known; one solid's prediction runs the wrong way, one has none known."""
    up = F.when(F.col("solid") == 2, -1.0).otherwise(1.0)
    c = cloud(spark, d).withColumn("depth", F.when((F.col("pid") % 5 == 0) & (F.col("solid") != 3), F.exp(F.lit(3.0) - 0.02 * up * F.col("x"))))
    out = models.calibrated_fill(c, ["solid"], "x", "depth", 20)
    return out.groupBy("solid", "status").agg(F.count("filled").alias("filled"), F.round(F.sum("filled"), 2).alias("total"))


FILL = f"""
WITH {CLOUD}, c AS (SELECT solid, pid % 5 = 0 AND solid <> 3 AS known, exp(3 - 0.02::DOUBLE * x * CASE WHEN solid = 2 THEN -1 ELSE 1 END) AS z FROM cloud)
SELECT solid, CASE WHEN solid = 3 THEN 'few' WHEN solid = 2 THEN 'contradicts' ELSE 'ok' END AS status, count(*) FILTER (known OR solid NOT IN (2, 3)) AS filled, round(sum(z) FILTER (known OR solid NOT IN (2, 3)), 2) AS total FROM c GROUP BY 1, 2
"""


def uv_texels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    f = table(spark, d, "nation").select(k.alias("face"), (k / 40).alias("u0"), F.lit(0.07).alias("v0"), (k / 40 + 0.31).alias("u1"), (k / 50).alias("v1"), (k / 60 + 0.13).alias("u2"), F.lit(0.83).alias("v2"))
    return models.uv_texels(f, "face", 48).select("face", "px", "py", *[F.round(w, 5).alias(w) for w in "abc"])


TEXELS = """
WITH f AS (SELECT n_nationkey AS face, n_nationkey / 40 * 48 AS u0, 0.07::DOUBLE * 48 AS v0, (n_nationkey / 40 + 0.31::DOUBLE) * 48 AS u1, n_nationkey / 50 * 48 AS v1, (n_nationkey / 60 + 0.13::DOUBLE) * 48 AS u2, 0.83::DOUBLE * 48 AS v2 FROM nation),
g AS (SELECT *, px.range::INT AS px, py.range::INT AS py, px.range + 0.5::DOUBLE AS x, py.range + 0.5::DOUBLE AS y, (v1 - v2) * (u0 - u2) + (u2 - u1) * (v0 - v2) AS det FROM f, range(48) px, range(48) py),
w AS (SELECT *, ((v1 - v2) * (x - u2) + (u2 - u1) * (y - v2)) / det AS a, ((v2 - v0) * (x - u2) + (u0 - u2) * (y - v2)) / det AS b FROM g WHERE abs(det) > 1e-12)
SELECT face, px, py, round(a, 5) AS a, round(b, 5) AS b, round(1 - a - b, 5) AS c FROM w WHERE a >= 0 AND b >= 0 AND 1 - a - b >= 0
"""


def overlay_pixels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("clip"), F.col("l_linenumber").alias("px"), (F.col("l_partkey") % 20).alias("py"), "l_quantity")
    return models.persistent_edges(e, ["clip"], ["px", "py"], "l_quantity", 20.0, 0.6).withColumn("share", F.round("share", 5))


OVERLAY = "SELECT l_suppkey % 5 AS clip, l_linenumber AS px, l_partkey % 20 AS py, round(avg((l_quantity >= 20)::INT), 5) AS share FROM lineitem GROUP BY ALL HAVING avg((l_quantity >= 20)::INT) >= 0.6"


def pattern_agreement(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_suppkey") % 4).alias("f"), "l_partkey", "l_extendedprice")
    return models.pattern_agreement(p, ["l_linenumber"], "f", ["l_partkey"], "l_extendedprice").withColumn("agreement", F.round("agreement", 4))


AGREEMENT = """
WITH p AS (SELECT l_linenumber, l_suppkey % 4 AS f, l_partkey, l_extendedprice AS x FROM lineitem),
r AS (SELECT a.l_linenumber, a.f AS i, b.f AS j, corr(a.x, b.x) AS r FROM p a JOIN p b ON a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey AND a.f < b.f GROUP BY ALL)
SELECT l_linenumber, round(median(r), 4) AS agreement FROM r GROUP BY 1
"""


def carried_frames(spark: SparkSession, d: str) -> DataFrame:
    return models.with_previous(flight_log(spark, d), ["user_id"], ["t", "event_id"], ["value"]).select("event_id", "previous_value")


CARRIED = f"WITH {LOG} SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS previous_value FROM log"

QUERIES = {
    "key_frames": (key_frames, KEY_FRAMES),
    "run_listing": (run_listing, RUN_LISTING),
    "scene_index": (scene_index, SCENE_INDEX),
    "live_sessions": (live_sessions, LIVE_SESSIONS),
    "needed_models": (needed_models, NEEDED),
    "flow_agreement": (flow_agreement, FLOW),
    "scale_errors": (scale_errors, SCALE_ERRORS),
    "usage_summary": (usage_summary, USAGE),
    "cloud_metrics": (cloud_metrics, CLOUD_METRICS),
    "run_collection": (run_collection, COLLECTION),
    "view_overlaps": (view_overlaps, OVERLAPS),
    "overlap_ahead": (overlap_ahead, OVERLAP_AHEAD),
    "pair_statistics": (pair_statistics, PAIR_STATISTICS),
    "model_depths": (model_depths, MODEL_DEPTHS),
    "link_groups": (link_groups, LINK_GROUPS),
    "group_similarities": (group_similarities, SIMILARITIES),
    "similarity_algebra": (similarity_algebra, ALGEBRA),
    "georeference": (georeference, GEOREFERENCE),
    "depth_calibration": (depth_calibration, CALIBRATION),
    "depth_fill": (depth_fill, FILL),
    "uv_texels": (uv_texels, TEXELS),
    "overlay_pixels": (overlay_pixels, OVERLAY),
    "pattern_agreement": (pattern_agreement, AGREEMENT),
    "carried_frames": (carried_frames, CARRIED),
}
