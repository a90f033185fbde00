"""Queries over masks, textures, subjects and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.operators import models, scenes
from larkgrid.plans.common import CLOUD, cloud, table


def unmasked_points(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d).withColumns({"w": F.lit(40), "h": F.lit(90)})
    mask = table(spark, d, "part").select((F.col("p_partkey") % 7 + 1).cast("int").alias("solid"), (F.col("p_size") % 40).alias("px"), (F.col("p_partkey") % 90).cast("int").alias("py"))
    return scenes.unmasked(c, mask, ["solid"], "x", "y", "w", "h").select("pid", "solid")


UNMASKED = f"""
WITH {CLOUD}, m AS (SELECT DISTINCT (p_partkey % 7 + 1)::INT AS solid, p_size % 40 AS px, (p_partkey % 90)::INT AS py FROM part),
c AS (SELECT pid, solid, least(greatest(round_even(x, 0)::INT, 0), 39) AS px, least(greatest(round_even(y, 0)::INT, 0), 89) AS py FROM cloud)
SELECT pid, solid FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.solid = c.solid AND m.px = c.px AND m.py = c.py)
"""


def inside_frame(spark: SparkSession, d: str) -> DataFrame:
    return cloud(spark, d).where(scenes.inside(F.col("x"), F.col("y"), F.lit(32), F.lit(48))).groupBy("solid").agg(F.count(F.lit(1)).alias("n"))


INSIDE = f"WITH {CLOUD} SELECT solid, count(*) AS n FROM cloud WHERE x BETWEEN 0 AND 31 AND y BETWEEN 0 AND 47 GROUP BY solid"


def fresh_results(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    outputs = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("format"), F.col("o_orderkey").alias("mtime"))
    inputs = o.where("o_orderkey % 5 = 1").select(F.col("o_custkey").alias("run"), (F.col("o_orderkey") / 20).alias("mtime"))
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("run"), (F.col("c_acctbal") > 0).alias("done"))
    return scenes.fresh(outputs, inputs, runs, ["1-URGENT", "2-HIGH"])


FRESH = """
WITH o AS (SELECT o_custkey AS run, list(DISTINCT o_orderpriority) AS f, min(o_orderkey) AS oldest FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
i AS (SELECT o_custkey AS run, max(o_orderkey / 20) AS newest FROM orders WHERE o_orderkey % 5 = 1 GROUP BY 1)
SELECT c_custkey AS run, coalesce(c_acctbal > 0 AND list_contains(f, '1-URGENT') AND list_contains(f, '2-HIGH') AND oldest > newest, false) AS fresh
FROM customer LEFT JOIN o ON o.run = c_custkey LEFT JOIN i ON i.run = c_custkey
"""


def monotone_map(spark: SparkSession, d: str) -> DataFrame:
    xs, ys = F.array(*[F.lit(float(v)) for v in (5, 12, 20, 45)]), F.array(*[F.lit(float(v)) for v in (1, 2, 7, 7.5)])
    i = table(spark, d, "lineitem")
    return i.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n")).select("l_quantity", "n", F.round(scenes.monotone_value(F.col("l_quantity"), xs, ys, 0.1), 5).alias("v"))


MONOTONE = """
SELECT l_quantity, count(*) AS n, round(CASE WHEN l_quantity < 5 THEN 1 + 0.1::DOUBLE * (l_quantity - 5) WHEN l_quantity < 12 THEN 1 + (l_quantity - 5) / 7 WHEN l_quantity < 20 THEN 2 + (l_quantity - 12) / 8 * 5
  WHEN l_quantity <= 45 THEN 7 + (l_quantity - 20) / 25 * 0.5::DOUBLE ELSE 7.5::DOUBLE + 0.1::DOUBLE * (l_quantity - 45) END, 5) AS v FROM lineitem GROUP BY l_quantity
"""


def occupied_share(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d).withColumns({"alive": F.col("z") > 4, "cell": F.floor(F.col("y") / 3)})
    return scenes.occupied_share(c, ["colour"], "alive", ["cell"]).withColumn("share", F.round("share", 5))


OCCUPIED = f"""
WITH {CLOUD}, p AS (SELECT colour, floor(y / 3) AS cell, count(*) AS n, count(*) FILTER (z > 4) AS a FROM cloud GROUP BY ALL)
SELECT colour, round(least(sum(a) / sum(n), count(*) FILTER (a > 0) / count(*)), 5) AS share FROM p GROUP BY colour
"""


def frame_depth_join(spark: SparkSession, d: str) -> DataFrame:
    """Frames and depth previews by file stem."""
    o = table(spark, d, "orders")
    frames = o.select("o_orderkey", F.concat(F.lit("photos/f_"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("f"))
    depth = o.where("o_orderstatus = 'F'").select(F.concat(F.lit("depth/f_"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("depth"))
    return models.stem_join(frames, "f", depth, "depth").select("stem", "o_orderkey", "depth")


FRAME_DEPTH = "SELECT 'f_' || o_orderkey AS stem, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'depth/f_' || o_orderkey || '.png' END AS depth FROM orders"


def widest_partner(spark: SparkSession, d: str) -> DataFrame:
    return scenes.widest_partner(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_tax", 0.04)


WIDEST = "SELECT l_orderkey, max(l_linenumber) AS l_linenumber FROM lineitem WHERE l_tax >= 0.04 GROUP BY l_orderkey"


def motion_probes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("s", F.col("p_size").cast("double"))
    return p.select("p_partkey", F.explode(scenes.probe_times(F.col("s"))).alias("t")).withColumn("t", F.round("t", 3))


PROBES = "SELECT p_partkey, round(p_size::DOUBLE * (0.05::DOUBLE + 0.85::DOUBLE * range / 11), 3) AS t FROM part, range(12) WHERE p_size >= 10"


def quantile_picks(spark: SparkSession, d: str) -> DataFrame:
    return scenes.quantile_picks(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_totalprice") > 100_000, ["o_totalprice", "o_orderkey"], [0.1, 0.5, 0.9]).select("o_orderpriority", "o_orderkey")


PICKS = """
WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE o_totalprice > 100000)
SELECT o_orderpriority, o_orderkey FROM r WHERE i IN (floor((n - 1) * 0.1::DOUBLE), floor((n - 1) * 0.5::DOUBLE), floor((n - 1) * 0.9::DOUBLE))
"""


def area_sample(spark: SparkSession, d: str) -> DataFrame:
    return scenes.area_sample(table(spark, d, "part"), ["p_partkey"], "p_retailprice", 200, "a").select("p_partkey", "p_retailprice")


AREA_SAMPLE = """
SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 0
ORDER BY -ln((('0x' || substr(md5('a|' || p_partkey), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656.0::DOUBLE) / p_retailprice, p_partkey LIMIT 200
"""


def tie_raster(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d).withColumns({"u": F.floor("x").cast("int"), "v": F.floor("y").cast("int")})
    return scenes.last_write(c, ["solid", "u", "v"], "pid", ["pid", "colour"])


TIE_RASTER = f"WITH {CLOUD} SELECT solid, floor(x)::INT AS u, floor(y)::INT AS v, max(pid) AS pid, arg_max(colour, (pid, colour)) AS colour FROM cloud GROUP BY ALL"


def bilinear_samples(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    pixels = p.groupBy((F.col("p_partkey") % 40).cast("int").alias("px"), (F.col("p_size") % 30).cast("int").alias("py")).agg(F.avg("p_retailprice").alias("value"))
    samples = table(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") * 7 % 380) / 10).alias("u"), (F.abs("c_acctbal") % 28).alias("v"))
    return scenes.bilinear(samples, pixels, "u", "v", "value").select("c_custkey", F.round("value", 3).alias("value"))


BILINEAR = """
WITH pixels AS (SELECT (p_partkey % 40)::INT AS px, (p_size % 30)::INT AS py, avg(p_retailprice) AS value FROM part GROUP BY ALL),
s AS (SELECT c_custkey, (c_custkey * 7 % 380) / 10 AS u, abs(c_acctbal) % 28 AS v FROM customer),
c AS (SELECT c_custkey, floor(u)::INT + i.range AS px, floor(v)::INT + j.range AS py, (CASE WHEN i.range = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN j.range = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM s, range(2) i, range(2) j)
SELECT c_custkey, round(sum(w * value) / sum(w), 3) AS value FROM c JOIN pixels USING (px, py) WHERE w > 0 GROUP BY c_custkey
"""


def texture_atlas(spark: SparkSession, d: str) -> DataFrame:
    faces = scenes.atlas_cells(table(spark, d, "part").select(F.col("p_partkey").alias("face")), "face", 25, 8)
    a, b, c = scenes.texel_weights(F.lit(2.0), F.lit(3.0), 8, F.col("half"))
    return faces.select("face", "u0", "v0", "half", F.round(a, 5).alias("a"), F.round(b, 5).alias("b"), F.round(c, 5).alias("c"))


ATLAS = """
WITH f AS (SELECT p_partkey AS face, p_partkey // 2 AS cell, (p_partkey % 2)::INT AS half FROM part)
SELECT face, cell % 25 * 8 + 1 AS u0, cell // 25 * 8 + 1 AS v0, half, CASE WHEN half = 0 THEN 0.25::DOUBLE ELSE -0.25::DOUBLE END AS a,
  CASE WHEN half = 0 THEN 0.3125::DOUBLE ELSE 0.6875::DOUBLE END AS b, CASE WHEN half = 0 THEN 0.4375::DOUBLE ELSE 0.5625::DOUBLE END AS c FROM f
"""


def log_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The last number that a log names, and a coerced metric."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("loss="), F.col("o_custkey").cast("string"), F.lit(" x loss="), F.col("o_orderkey").cast("string")).alias("log"), "o_totalprice")
    value = scenes.metric(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")), F.array(F.lit(1.0), F.col("o_orderkey").cast("double")))
    return o.select("o_orderkey", scenes.last_match(F.col("log"), "loss=([0-9]+)").cast("long").alias("loss"), F.round(value, 4).alias("metric"))


LOG_METRICS = "SELECT o_orderkey, o_orderkey AS loss, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE (1 + o_orderkey) / 2 END, 4) AS metric FROM orders"

QUERIES = {
    "unmasked_points": (unmasked_points, UNMASKED),
    "inside_frame": (inside_frame, INSIDE),
    "fresh_results": (fresh_results, FRESH),
    "monotone_map": (monotone_map, MONOTONE),
    "occupied_share": (occupied_share, OCCUPIED),
    "frame_depth_join": (frame_depth_join, FRAME_DEPTH),
    "widest_partner": (widest_partner, WIDEST),
    "motion_probes": (motion_probes, PROBES),
    "quantile_picks": (quantile_picks, PICKS),
    "area_sample": (area_sample, AREA_SAMPLE),
    "tie_raster": (tie_raster, TIE_RASTER),
    "bilinear_samples": (bilinear_samples, BILINEAR),
    "texture_atlas": (texture_atlas, ATLAS),
    "log_metrics": (log_metrics, LOG_METRICS),
}
