"""Queries over tracks, models, runs and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.functions import camera, geodesy, rotations
from larkgrid.operators import fits, relations, select
from larkgrid.plans.common import table


def track_matches(spark: SparkSession, d: str) -> DataFrame:
    obs = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 40).alias("image"))
    return relations.track_matches(obs, "o_custkey", ["o_orderkey"], "image", 4, 3)


TRACK_MATCHES = """
WITH o AS (SELECT o_custkey, o_orderkey % 40 AS image, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT a.image AS a, b.image AS b, count(*) AS n FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.k - a.k BETWEEN 1 AND 4 GROUP BY ALL HAVING count(*) >= 3
"""


def track_lengths(spark: SparkSession, d: str) -> DataFrame:
    return relations.track_lengths(table(spark, d, "orders"), "o_custkey")


TRACK_LENGTHS = "WITH n AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 2) SELECT count(*) AS tracks, round(avg(n), 4) AS mean_length FROM n"


def coverage_weighted(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 50 + 1).alias("images"))
    dense = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count(F.lit(1)) / 50.0).alias("completeness"))
    return relations.weighted_coverage(c, dense, "c_custkey", "images", "completeness")


COVERAGE = """
WITH d AS (SELECT o_custkey, count(*) / 50.0::DOUBLE AS v FROM orders GROUP BY o_custkey)
SELECT round(sum((c_custkey % 50 + 1) * coalesce(v, 0)) / sum(c_custkey % 50 + 1), 4) AS coverage FROM customer LEFT JOIN d ON o_custkey = c_custkey
"""


def stage_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return relations.stage_rollup(e, ["user_id"], "event_type", "value", ["error", "signup"], "signup", F.col("value") * 20)


STAGE_ROLLUP = """
SELECT user_id, round(sum(value), 3) AS total_s, round(sum(CASE WHEN event_type NOT IN ('error', 'signup') THEN value ELSE 0 END), 3) AS deliverable_s,
  round(sum(CASE WHEN event_type = 'signup' THEN value ELSE 0 END), 3) AS splat_s, round(max(value * 20) * 1.5, 3) AS budget_s,
  round(sum(CASE WHEN event_type NOT IN ('error', 'signup') THEN value ELSE 0 END), 3) <= round(max(value * 20) * 1.5, 3) AS within_budget FROM events GROUP BY user_id
"""


def manifest_anti(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    new = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("key")).distinct()
    return relations.manifest(new, c.select(F.col("c_custkey").alias("key")), "key")


MANIFEST = """
WITH n AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'O')
SELECT key, 0::INT AS origin FROM n UNION ALL SELECT c_custkey, 1::INT FROM customer WHERE c_custkey NOT IN (SELECT key FROM n)
"""


def metric_overlay(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    n = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("a"), F.lit(None).cast("double").alias("b"))
    return relations.overlay(n, s, "key", ["a", "b"])


OVERLAY = """
WITH n AS (SELECT c_custkey AS key, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS a FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(n.key, s_suppkey) AS key, coalesce(n.a, s_acctbal) AS a, s_nationkey::DOUBLE AS b FROM supplier FULL JOIN n ON n.key = s_suppkey
"""


def role_share(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("images"))
    out = select.shares_and_roles(n, ["c_mktsegment"], "images", "c_nationkey", 0.06)
    return out.withColumn("share", F.round("share", 4))


ROLE_SHARE = """
WITH n AS (SELECT c_mktsegment, c_nationkey, count(*) AS images FROM customer GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY images DESC, c_nationkey) - 1 AS position, images / sum(images) OVER (PARTITION BY c_mktsegment) AS share FROM n)
SELECT c_mktsegment, c_nationkey, images, position::INT AS position, round(share, 4) AS share, CASE WHEN position = 0 OR share >= 0.06 THEN 'main' ELSE 'fragment' END AS role FROM p
"""


def model_table(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("model"))
    sfm = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("model")).agg(F.count(F.lit(1)).alias("images"))
    dense = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("model")).agg(F.round(F.avg("s_acctbal"), 2).alias("completeness"))
    splat = n.where("model % 2 = 0").select("model", (F.col("model") * 10).alias("splats"))
    return relations.model_table(sfm, dense, splat, "model", "images", 0.05).withColumn("share", F.round("share", 4))


MODEL_TABLE = """
WITH s AS (SELECT c_nationkey AS model, count(*) AS images FROM customer GROUP BY 1), d AS (SELECT s_nationkey AS model, round(avg(s_acctbal), 2) AS completeness FROM supplier GROUP BY 1)
SELECT model, images, completeness, CASE WHEN model % 2 = 0 THEN model * 10 END AS splats, round(images / sum(images) OVER (), 4) AS share,
  CASE WHEN images / sum(images) OVER () >= 0.05 OR row_number() OVER (ORDER BY images DESC, model DESC) = 1 THEN 'main' ELSE 'fragment' END AS role FROM s LEFT JOIN d USING (model)
"""


def mutual_rank_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o.select("o_orderkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    w = pairs.where("s_nationkey <> c_nationkey").groupBy(F.least("s_nationkey", "c_nationkey").alias("a"), F.greatest("s_nationkey", "c_nationkey").alias("b")).agg(F.count(F.lit(1)).alias("links"))
    return select.mutual_rank(w, "a", "b", "links", 3)


MUTUAL_RANK = """
WITH w AS (SELECT least(s_nationkey, c_nationkey) AS a, greatest(s_nationkey, c_nationkey) AS b, count(*) AS links FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
v AS (SELECT a AS x, b AS y, links FROM w UNION ALL SELECT b, a, links FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY links DESC, y) AS k FROM v)
SELECT least(x, y) AS a, greatest(x, y) AS b, any_value(links) AS links, min(k)::INT AS rank FROM r GROUP BY 1, 2 HAVING min(k) <= 3
"""


def offset_pairs(spark: SparkSession, d: str) -> DataFrame:
    return relations.offset_pairs(table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", [1, 2, 4, 8])


OFFSET_PAIRS = """SELECT a.o_orderpriority, a.o_orderkey AS i, b.o_orderkey AS j, (b.o_orderkey - a.o_orderkey)::INT AS gap FROM orders a JOIN orders b
  ON a.o_orderpriority = b.o_orderpriority AND b.o_orderkey - a.o_orderkey IN (1, 2, 4, 8)"""


def face_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return relations.face_adjacency(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", 2)


FACE_ADJACENCY = """
WITH f AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)
SELECT x.o AS a, y.o AS b, count(*) AS n FROM f x JOIN f y ON x.p = y.p AND x.o < y.o GROUP BY ALL HAVING count(*) >= 2
"""


def rewrite_ids(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 1000).alias("new"))
    return relations.rewrite_ids(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), m, "l_suppkey")


REWRITE_IDS = "SELECT l_orderkey, l_linenumber, l_suppkey + 1000 AS l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 2 = 0"


def weld(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("vid"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 1.0).alias("y"), (F.col("l_tax") * 1.0).alias("z"))
    return relations.weld(v, 2).select("vid", "weld")


WELD = "SELECT l_orderkey * 8 + l_linenumber AS vid, min(l_orderkey * 8 + l_linenumber) OVER (PARTITION BY round(l_quantity, 2), round(l_discount, 2), round(l_tax, 2)) AS weld FROM lineitem"


def used_vertices(spark: SparkSession, d: str) -> DataFrame:
    faces = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("v0"), F.col("l_suppkey").alias("v1"), (F.col("l_orderkey") % 500).alias("v2"))
    return relations.used_vertices(table(spark, d, "part").select(F.col("p_partkey").alias("vid"), "p_name"), faces)


USED_VERTICES = """SELECT p_partkey AS vid, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1
  UNION SELECT l_suppkey FROM lineitem WHERE l_linenumber = 1 UNION SELECT l_orderkey % 500 FROM lineitem WHERE l_linenumber = 1)"""


def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Equal contents by digest, with the first id and the number of copies."""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


CONTENT_DEDUP = "SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1"


def gps_rmse(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    return fits.residual_rmse(i, ["l_returnflag"], (F.col("l_quantity") / 10, F.col("l_discount") * 30, F.col("l_tax") * 20))


GPS_RMSE = """
WITH h AS (SELECT l_returnflag, (l_quantity / 10)**2 + (l_discount * 30)**2 AS h, (l_tax * 20)**2 AS v FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(sqrt(avg(h + v)), 4) AS rmse_3d, round(sqrt(avg(h)), 4) AS rmse_h, round(sqrt(avg(v)), 4) AS rmse_v, round(max(sqrt(h + v)), 4) AS max_error FROM h GROUP BY l_returnflag
"""


def yaw_scale_fit(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").withColumns({"x": F.col("l_quantity") * 3 - F.col("l_discount") * 40, "y": F.col("l_quantity") + F.col("l_discount") * 120, "e": F.col("l_extendedprice") / 1000})
    out = fits.yaw_scale(i, ["l_suppkey"], ("l_quantity", "l_discount", "l_tax"), ("x", "y", "e"))
    return out.select("l_suppkey", "n", *[F.round(c, 4).alias(c) for c in ("scale", "yaw", "tx", "ty", "tz")])


YAW_SCALE = """
WITH i AS (SELECT l_suppkey, l_quantity AS a, l_discount AS b, l_tax AS c, l_quantity * 3 - l_discount * 40 AS x, l_quantity + l_discount * 120 AS y, l_extendedprice / 1000 AS e FROM lineitem),
m AS (SELECT l_suppkey, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(x) AS mx, avg(y) AS my, avg(e) AS me,
  covar_pop(a, x) + covar_pop(b, y) AS re, covar_pop(a, y) - covar_pop(b, x) AS im, var_pop(a) + var_pop(b) AS s FROM i GROUP BY l_suppkey),
f AS (SELECT *, CASE WHEN s > 1e-12 THEN sqrt(re * re + im * im) / s ELSE 1 END AS scale, atan2(im, re) AS yaw FROM m)
SELECT l_suppkey, n, round(scale, 4) AS scale, round(yaw, 4) AS yaw, round(mx - scale * cos(yaw) * ma + scale * sin(yaw) * mb, 4) AS tx,
  round(my - scale * sin(yaw) * ma - scale * cos(yaw) * mb, 4) AS ty, round(me - scale * mc, 4) AS tz FROM f
"""


def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return fits.leave_one_out(table(spark, d, "lineitem").withColumn("p", F.col("l_extendedprice") / 1000), ["l_partkey"], "l_quantity", "p")


LEAVE_ONE_OUT = """
WITH i AS (SELECT l_partkey, row_number() OVER () AS id, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
f AS (SELECT a.l_partkey, any_value(a.x) AS x, any_value(a.y) AS y, count(*) AS n, regr_slope(b.y, b.x) AS s, var_pop(b.x) AS v, avg(b.x) AS mx, avg(b.y) AS my
  FROM i a JOIN i b ON a.l_partkey = b.l_partkey AND a.id <> b.id GROUP BY a.l_partkey, a.id HAVING count(*) >= 2),
g AS (SELECT *, CASE WHEN n * n * v > 1e-9 THEN s ELSE 0 END AS slope FROM f)
SELECT l_partkey, count(*) AS folds, round(sqrt(avg((y - my - slope * (x - mx))**2)), 4) AS rmse, round(sqrt(var_pop(slope) * (count(*) - 1)), 6) AS slope_se FROM g GROUP BY l_partkey
"""


def consensus_value(spark: SparkSession, d: str) -> DataFrame:
    return fits.consensus(table(spark, d, "lineitem"), "l_quantity", "l_linenumber", 10, 40)


CONSENSUS = """
WITH i AS (SELECT l_quantity AS v, l_linenumber AS w FROM lineitem WHERE l_quantity BETWEEN 10 AND 40),
s AS (SELECT v, sum(w) AS w FROM i GROUP BY v), u AS (SELECT *, sum(w) OVER (ORDER BY v) AS upto, sum(w) OVER () AS total FROM s),
m AS (SELECT min(v) AS m FROM u WHERE upto >= total / 2)
SELECT any_value(m) AS consensus, round(sum(CASE WHEN abs(v / m - 1) <= 0.25 THEN w ELSE 0 END) / sum(w), 4) AS share FROM i, m
"""


def geodetic_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Positions to the local frame about (12.5, 77.6), and the angle and height that come back."""
    c = table(spark, d, "customer").withColumns({"lat": F.lit(12.5) + F.col("c_nationkey") / 100, "lon": F.lit(77.6) + (F.col("c_custkey") % 100) / 200, "alt": F.col("c_acctbal") / 10})
    plane = geodesy.TangentPlane(12.5, 77.6, 900.0)
    e, n, u = plane.to_enu(F.col("lat"), F.col("lon"), F.col("alt"))
    c = c.withColumns({"e": e, "n": n, "u": u})
    lat, lon, alt = plane.to_geodetic(F.col("e"), F.col("n"), F.col("u"))
    return c.select("c_custkey", *[F.round(v, 3).alias(v) for v in "enu"], F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"), F.round(alt, 3).alias("alt"), geodesy.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"))


GEODETIC = """
WITH c AS (SELECT c_custkey, 12.5::DOUBLE + c_nationkey / 100 AS lat, 77.6::DOUBLE + (c_custkey % 100) / 200 AS lon, c_acctbal / 10 AS alt FROM customer),
k AS (SELECT 0.0066943799901413165 AS e2, radians(12.5::DOUBLE) AS p0, radians(77.6::DOUBLE) AS l0),
g AS (SELECT c.*, k.*, radians(lat) AS p, radians(lon) AS l, 6378137.0 / sqrt(1 - e2 * sin(radians(lat))**2) AS n, 6378137.0 / sqrt(1 - e2 * sin(p0)**2) AS n0 FROM c, k),
x AS (SELECT *, (n + alt) * cos(p) * cos(l) - (n0 + 900) * cos(p0) * cos(l0) AS dx, (n + alt) * cos(p) * sin(l) - (n0 + 900) * cos(p0) * sin(l0) AS dy,
  (n * (1 - e2) + alt) * sin(p) - (n0 * (1 - e2) + 900) * sin(p0) AS dz FROM g)
SELECT c_custkey, round(-sin(l0) * dx + cos(l0) * dy, 3) AS e, round(-sin(p0) * cos(l0) * dx - sin(p0) * sin(l0) * dy + cos(p0) * dz, 3) AS n,
  round(cos(p0) * cos(l0) * dx + cos(p0) * sin(l0) * dy + sin(p0) * dz, 3) AS u, round(lat, 8) AS lat, round(lon, 8) AS lon, round(alt, 3) AS alt,
  (32600 + floor((lon + 180) / 6) + 1)::INT AS epsg FROM x
"""


def pixel_projection(spark: SparkSession, d: str) -> DataFrame:
    """Points into a camera whose quaternion and offset follow from the supplier, and back to rays."""
    a = F.radians(F.col("s_nationkey") * 3.0)
    cameras = table(spark, d, "supplier").select("s_suppkey", F.cos(a / 2).alias("qw"), F.sin(a / 2).alias("qz"))  # once a camera, not a point
    i = table(spark, d, "lineitem").join(cameras, F.col("l_suppkey") == F.col("s_suppkey"))
    q = (F.col("qw"), F.lit(0.0), F.lit(0.0), F.col("qz"))
    p = camera.to_camera(q, (F.lit(1.0), F.lit(-2.0), F.lit(60.0)), F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100)
    u, v = camera.project(*p, F.lit(800.0), F.lit(-0.05), F.lit(640.0), F.lit(360.0))
    return i.select("l_orderkey", "l_linenumber", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


PROJECTION = """
WITH i AS (SELECT l_orderkey, l_linenumber, radians(s_nationkey * 3.0) AS a, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
c AS (SELECT *, cos(a) * x - sin(a) * y + 1 AS xc, sin(a) * x + cos(a) * y - 2 AS yc, z + 60 AS zc FROM i),
n AS (SELECT *, xc / zc AS p, yc / zc AS q FROM c)
SELECT l_orderkey, l_linenumber, round(800 * p * (1 - 0.05 * (p * p + q * q)) + 640 - 0.5, 4) AS u, round(800 * q * (1 - 0.05 * (p * p + q * q)) + 360 - 0.5, 4) AS v FROM n
"""


def quaternion_path(spark: SparkSession, d: str) -> DataFrame:
    """Half-way rotations between two headings, and their product with a roll."""
    s = table(spark, d, "supplier")
    a, b = F.radians(F.col("s_nationkey") * 5.0), F.radians(F.col("s_suppkey") % 120 * 1.0 + 10)
    turn = lambda x: (F.cos(x / 2), F.lit(0.0), F.lit(0.0), F.sin(x / 2))
    q = rotations.slerp(turn(a), turn(b), F.lit(0.25))
    r = rotations.quat_multiply(q, (F.lit(0.8), F.lit(0.6), F.lit(0.0), F.lit(0.0)))
    return s.select("s_suppkey", *[F.round(c, 3).alias(n) for n, c in zip("wxyz", r)])


QUATERNION = """
WITH h AS (SELECT s_suppkey, radians(s_nationkey * 5.0 + 0.25 * (s_suppkey % 120 + 10 - s_nationkey * 5.0)) / 2 AS a FROM supplier)
SELECT s_suppkey, round(0.8 * cos(a), 3) AS w, round(0.6 * cos(a), 3) AS x, round(0.6 * sin(a), 3) AS y, round(0.8 * sin(a), 3) AS z FROM h
"""


def frame_sizes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    w, h = camera.fitted_size(F.col("p_size") * 40 + 200, F.col("p_partkey") % 1000 + 300, F.lit(960), 8)
    lo, hi = camera.crop_to_multiple(F.col("p_size"), F.col("p_size") * 7 + 30, 16)
    gsd = geodesy.ground_sampling_distance(F.col("p_retailprice"), F.lit(13.17), F.lit(8.83), F.lit(5472.0))
    return p.select("p_partkey", w.alias("w"), h.alias("h"), lo.alias("lo"), hi.alias("hi"), F.round(gsd, 4).alias("gsd"))


FRAME_SIZES = """
WITH p AS (SELECT p_partkey, p_retailprice, p_size, p_size * 40 + 200 AS a, p_partkey % 1000 + 300 AS b FROM part),
s AS (SELECT *, (6 * p_size + 30) // 16 * 16 AS n FROM p)
SELECT p_partkey, greatest(8, round_even(a * (960 / greatest(a, b)) / 8, 0) * 8)::INT AS w, greatest(8, round_even(b * (960 / greatest(a, b)) / 8, 0) * 8)::INT AS h,
  (p_size + (6 * p_size + 30 - n) // 2)::INT AS lo, (p_size + (6 * p_size + 30 - n) // 2 + n)::INT AS hi, round(p_retailprice * 13.17::DOUBLE / (8.83::DOUBLE * 5472.0), 4) AS gsd FROM s
"""


def run_groups(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.groupBy(relations.run_group(F.when(F.col("p_size") > 45, "live").otherwise("file"), F.concat(F.when(F.col("p_partkey") % 5 == 0, "bench_").when(F.col("p_partkey") % 7 == 0, "my-Test-").otherwise(""), "p_name")).alias("run_group")).agg(F.count(F.lit(1)).alias("n"))


RUN_GROUPS = """
WITH p AS (SELECT p_size, CASE WHEN p_partkey % 5 = 0 THEN 'bench_' WHEN p_partkey % 7 = 0 THEN 'my-Test-' ELSE '' END || p_name AS name FROM part)
SELECT CASE WHEN p_size > 45 THEN 'live' WHEN regexp_matches(name, '^(bench|all[_-]|system)') THEN 'benchmark' WHEN regexp_matches(name, '(?i)(test|dev|debug|try|tmp)') THEN 'development' ELSE 'builds' END AS run_group, count(*) AS n FROM p GROUP BY 1
"""

QUERIES = {
    "track_matches": (track_matches, TRACK_MATCHES),
    "track_lengths": (track_lengths, TRACK_LENGTHS),
    "coverage_weighted": (coverage_weighted, COVERAGE),
    "stage_rollup": (stage_rollup, STAGE_ROLLUP),
    "manifest_anti": (manifest_anti, MANIFEST),
    "metric_overlay": (metric_overlay, OVERLAY),
    "role_share": (role_share, ROLE_SHARE),
    "model_table": (model_table, MODEL_TABLE),
    "mutual_rank_pairs": (mutual_rank_pairs, MUTUAL_RANK),
    "offset_pairs": (offset_pairs, OFFSET_PAIRS),
    "face_adjacency": (face_adjacency, FACE_ADJACENCY),
    "rewrite_ids": (rewrite_ids, REWRITE_IDS),
    "weld": (weld, WELD),
    "used_vertices": (used_vertices, USED_VERTICES),
    "content_dedup": (content_dedup, CONTENT_DEDUP),
    "gps_rmse": (gps_rmse, GPS_RMSE),
    "yaw_scale_fit": (yaw_scale_fit, YAW_SCALE),
    "leave_one_out": (leave_one_out, LEAVE_ONE_OUT),
    "consensus_value": (consensus_value, CONSENSUS),
    "geodetic_round_trip": (geodetic_round_trip, GEODETIC),
    "pixel_projection": (pixel_projection, PROJECTION),
    "quaternion_path": (quaternion_path, QUATERNION),
    "frame_sizes": (frame_sizes, FRAME_SIZES),
    "run_groups": (run_groups, RUN_GROUPS),
}
