"""Queries over point clouds and their selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.functions import camera
from larkgrid.operators import clouds, select, similar
from larkgrid.plans.common import CLOUD, cloud, table, written


def cloud_bounds(spark: SparkSession, d: str) -> DataFrame:
    out = clouds.bounds(cloud(spark, d))
    return out.select("n", *[F.round(c, 4).alias(c) for c in out.columns if c != "n"])


CLOUD_BOUNDS = f"WITH {CLOUD} SELECT count(*) AS n, " + ", ".join(f"round(min({a}), 4) AS {a}_min, round(max({a}), 4) AS {a}_max, round(avg({a}), 4) AS {a}_mean, round(max({a}) - min({a}), 4) AS {a}_extent" for a in "xyz") + ", round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), 4) AS max_extent FROM cloud"
_CELL = "floor(x / {0})::BIGINT AS cx, floor(y / {0})::BIGINT AS cy, floor(z / {0})::BIGINT AS cz"


def voxel_coverage(spark: SparkSession, d: str) -> DataFrame:
    return clouds.voxel_coverage(cloud(spark, d), 2.5, ["flag"])


VOXEL_COVERAGE = f"""
WITH {CLOUD}, c AS (SELECT flag, {_CELL.format('2.5')} FROM cloud)
SELECT flag, count(DISTINCT (cx, cy, cz)) AS voxels, count(*) AS n, round(count(DISTINCT (cx, cy, cz)) * 15.625::DOUBLE, 4) AS volume_m3,
  round(count(*) / (count(DISTINCT (cx, cy, cz)) * 15.625::DOUBLE), 3) AS points_per_m3 FROM c GROUP BY flag
"""


def voxel_keys(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return c.groupBy(camera.voxel_key(F.col("x"), F.col("y"), F.col("z"), 4.0).alias("key")).agg(F.count(F.lit(1)).alias("n"))


VOXEL_KEYS = f"""
WITH {CLOUD} SELECT ((floor(x / 4)::BIGINT + 1048576) << 42) | ((floor(y / 4)::BIGINT + 1048576) << 21) | (floor(z / 4)::BIGINT + 1048576) AS key, count(*) AS n FROM cloud GROUP BY 1
"""


def distinct_cells(spark: SparkSession, d: str) -> DataFrame:
    return cloud(spark, d).withColumns(clouds.cells(5.0)).select("solid", "cx", "cy", "cz").distinct()


DISTINCT_CELLS = f"WITH {CLOUD} SELECT DISTINCT solid, {_CELL.format('5')} FROM cloud"


def raster_top(spark: SparkSession, d: str) -> DataFrame:
    return clouds.raster(cloud(spark, d), 2.0, 0.0, 120.0, ["colour", "pid"], "pid").withColumn("z", F.round("z", 4))


def raster_bottom(spark: SparkSession, d: str) -> DataFrame:
    return clouds.raster(cloud(spark, d), 2.0, 0.0, 120.0, ["colour", "pid"], "pid", highest=False).withColumn("z", F.round("z", 4))


_RASTER = """WITH {0}, r AS (SELECT *, floor((120.0 - y) / 2)::BIGINT AS row, floor(x / 2)::BIGINT AS col FROM cloud)
SELECT row, col, round({1}(z, (z, pid)), 4) AS z, {1}(colour, (z, pid)) AS colour, {1}(pid, (z, pid)) AS pid FROM r GROUP BY row, col"""


def voxel_vote(spark: SparkSession, d: str) -> DataFrame:
    return clouds.voxel_vote(cloud(spark, d), "solid", 7, 8.0)


VOXEL_VOTE = f"""
WITH {CLOUD}, c AS (SELECT DISTINCT solid, {_CELL.format('8')} FROM cloud)
SELECT cx, cy, cz, count(*) AS votes FROM c GROUP BY ALL HAVING count(*) >= 4
"""


def iou_sets(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return clouds.voxel_iou(c.where("solid = 1"), c.where("solid = 2"), 8.0)


IOU_SETS = f"""
WITH {CLOUD}, c AS (SELECT {_CELL.format('8')}, min(solid) AS lo, max(solid) AS hi FROM cloud WHERE solid IN (1, 2) GROUP BY 1, 2, 3)
SELECT count(*) FILTER (lo <> hi) AS n_both, count(*) AS n_any, round(count(*) FILTER (lo <> hi) / count(*), 6) AS iou FROM c
"""


def _two_clouds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as probes, suppliers' best-known lines as reference: two clouds of different points."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("pid"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), (F.col("p_partkey") % 17).cast("double").alias("z"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("cid"), (F.col("c_nationkey") * 2).cast("double").alias("x"), (F.abs("c_acctbal") / 500).alias("y"), (F.col("c_custkey") % 13).cast("double").alias("z"))
    return p, c


_TWO = """p AS (SELECT p_partkey AS pid, p_size::DOUBLE AS x, p_retailprice / 100 AS y, (p_partkey % 17)::DOUBLE AS z FROM part),
c AS (SELECT c_custkey AS cid, (c_nationkey * 2)::DOUBLE AS x, abs(c_acctbal) / 500 AS y, (c_custkey % 13)::DOUBLE AS z FROM customer),
j AS (SELECT pid, cid, sqrt((p.x - c.x)**2 + (p.y - c.y)**2 + (p.z - c.z)**2) AS distance, c.y AS cy FROM p, c),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY distance, cid) AS rank FROM j)"""


def nearest_neighbour(spark: SparkSession, d: str) -> DataFrame:
    p, c = _two_clouds(spark, d)
    return clouds.nearest(p, c, "pid", "cid", checkpoint=written).select("pid", "cid", F.round("distance", 4).alias("distance"))


NEAREST = f"WITH {_TWO} SELECT pid, cid, round(distance, 4) AS distance FROM r WHERE rank = 1"


def knn_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean attribute of the four nearest points."""
    p, c = _two_clouds(spark, d)
    near = clouds.nearest(p, c.withColumn("tone", F.col("y") / 7), "pid", "cid", ["tone"], k=4, checkpoint=written)
    return near.groupBy("pid").agg(F.round(F.avg("tone"), 4).alias("tone"), F.count(F.lit(1)).alias("k"))


KNN_MEAN = f"WITH {_TWO} SELECT pid, round(avg(cy / 7), 4) AS tone, count(*) AS k FROM r WHERE rank <= 4 GROUP BY pid"


def radius_neighbours(spark: SparkSession, d: str) -> DataFrame:
    p, c = _two_clouds(spark, d)
    return clouds.within(p, c, 2.0, "pid", "cid", k=3, checkpoint=written).select("pid", "cid", F.round("distance", 4).alias("distance"), "rank")


RADIUS = f"WITH {_TWO} SELECT pid, cid, round(distance, 4) AS distance, rank::INT AS rank FROM r WHERE rank <= 3 AND distance <= 2.0"


def completeness(spark: SparkSession, d: str) -> DataFrame:
    p, c = _two_clouds(spark, d)
    return clouds.completeness(clouds.nearest(p, c, "pid", "cid", checkpoint=written), 1.0)


COMPLETENESS = f"WITH {_TWO} SELECT round(avg((distance <= 1.0)::INT::DOUBLE), 6) AS ratio, round(avg(distance), 6) AS mean_distance FROM r WHERE rank = 1"


def chamfer(spark: SparkSession, d: str) -> DataFrame:
    p, c = _two_clouds(spark, d)
    return clouds.chamfer(clouds.nearest(p, c, "pid", "cid", checkpoint=written), clouds.nearest(c, p, "cid", "pid", checkpoint=written))


CHAMFER = f"""
WITH {_TWO}, f AS (SELECT pid, min(distance) AS d FROM j GROUP BY pid), b AS (SELECT cid, min(distance) AS d FROM j GROUP BY cid),
s AS (SELECT (SELECT avg(d) FROM f) AS fm, (SELECT avg(d * d) FROM f) AS fs, (SELECT avg(d) FROM b) AS bm, (SELECT avg(d * d) FROM b) AS bs)
SELECT round(fm, 6) AS forward_mean, round(bm, 6) AS backward_mean, round((fm + bm) / 2, 6) AS chamfer, round(sqrt((fs + bs) / 2), 6) AS rms FROM s
"""


def band_shares(spark: SparkSession, d: str) -> DataFrame:
    return clouds.distance_bands(cloud(spark, d), "y", [0.0, 10.0, 30.0, float("inf")])


BAND_SHARES = f"""
WITH {CLOUD}, b AS (SELECT CASE WHEN y < 10 THEN 0 WHEN y < 30 THEN 1 ELSE 2 END AS band, y FROM cloud WHERE y >= 0)
SELECT band::INT AS band, count(*) AS n, round(median(y), 2) AS median, round(quantile_cont(y, 0.9), 2) AS p90, round(count(*) / sum(count(*)) OVER (), 3) AS share FROM b GROUP BY band
"""


def best_views(spark: SparkSession, d: str) -> DataFrame:
    out = select.best_views(table(spark, d, "lineitem").withColumn("view", F.col("l_orderkey") * 8 + F.col("l_linenumber")), ["l_partkey"], "view", "l_extendedprice")
    return out.select("l_partkey", "view", "rank", F.round("weight", 4).alias("weight"))


BEST_VIEWS = """
WITH v AS (SELECT l_partkey, l_orderkey * 8 + l_linenumber AS view, l_extendedprice AS s FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY s DESC, view) AS rank FROM v),
b AS (SELECT *, max(s) OVER (PARTITION BY l_partkey) AS best FROM r WHERE rank <= 3 AND s > 0),
g AS (SELECT * FROM b WHERE s >= best * 0.5)
SELECT l_partkey, view, rank::INT AS rank, round(s / sum(s) OVER (PARTITION BY l_partkey), 4) AS weight FROM g
"""


def topn_importance(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumns({"logit": (F.col("p_retailprice") - 1400) / 200, "s0": F.col("p_size") / 50, "s1": (F.col("p_partkey") % 10) / 10, "s2": F.lit(0.1)})
    out = select.top_by_importance(p, "logit", ["s0", "s1", "s2"], 100, [F.col("p_partkey")])
    return out.select("p_partkey", F.round("opacity", 4).alias("opacity"), F.round("importance", 4).alias("importance"))


TOPN = """
WITH p AS (SELECT p_partkey, 1 / (1 + exp(-(p_retailprice - 1400) / 200)) AS opacity, exp(p_size / 50 + (p_partkey % 10) / 10 + 0.1::DOUBLE) AS volume FROM part)
SELECT p_partkey, round(opacity, 4) AS opacity, round(opacity * volume, 4) AS importance FROM p WHERE opacity >= 0.02 ORDER BY opacity * volume DESC, p_partkey LIMIT 100
"""


def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return select.systematic_sample(table(spark, d, "orders"), ["o_orderpriority"], [F.col("o_orderkey")], 24).select("o_orderpriority", "o_orderkey")


SYSTEMATIC = """
WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, o_orderkey FROM r WHERE n <= 24 OR i IN (SELECT round_even(k.range * (n - 1) / 23, 0)::BIGINT FROM range(24) k)
"""


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return select.hash_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 500, "s0")


HASH_SAMPLE = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('s0|' || o_orderkey::VARCHAR), o_orderkey LIMIT 500"


def farthest_view(spark: SparkSession, d: str) -> DataFrame:
    return select.farthest_within(cloud(spark, d), ["colour"], (F.col("z") > 8) & (F.col("x") < 10), "y", "pid")


FARTHEST = f"""
WITH {CLOUD}, n AS (SELECT *, row_number() OVER (PARTITION BY colour ORDER BY pid) - 1 AS i, count(*) OVER (PARTITION BY colour) AS n FROM cloud)
SELECT colour, coalesce(arg_max(pid, (y, -pid)) FILTER (z > 8 AND x < 10), max(pid) FILTER (i = floor(n / 2))) AS pid FROM n GROUP BY colour
"""


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The four most similar keyframes among those of the same place (label), by descriptor."""
    return similar.cosine_top_k(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 4)


COSINE = """
WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM p)
SELECT a, b, cosine, rank::INT AS rank FROM r WHERE rank <= 4
"""

QUERIES = {
    "cloud_bounds": (cloud_bounds, CLOUD_BOUNDS),
    "voxel_coverage": (voxel_coverage, VOXEL_COVERAGE),
    "voxel_keys": (voxel_keys, VOXEL_KEYS),
    "distinct_cells": (distinct_cells, DISTINCT_CELLS),
    "raster_top": (raster_top, _RASTER.format(CLOUD, "arg_max")),
    "raster_bottom": (raster_bottom, _RASTER.format(CLOUD, "arg_min")),
    "voxel_vote": (voxel_vote, VOXEL_VOTE),
    "iou_sets": (iou_sets, IOU_SETS),
    "nearest_neighbour": (nearest_neighbour, NEAREST),
    "knn_mean": (knn_mean, KNN_MEAN),
    "radius_neighbours": (radius_neighbours, RADIUS),
    "completeness": (completeness, COMPLETENESS),
    "chamfer": (chamfer, CHAMFER),
    "band_shares": (band_shares, BAND_SHARES),
    "best_views": (best_views, BEST_VIEWS),
    "topn_importance": (topn_importance, TOPN),
    "systematic_sample": (systematic_sample, SYSTEMATIC),
    "hash_sample": (hash_sample, HASH_SAMPLE),
    "farthest_view": (farthest_view, FARTHEST),
    "cosine_topk": (cosine_topk, COSINE),
}
