"""Queries over frame, depth and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.operators import frames, models, select
from larkgrid.plans.common import CLOUD, LOG, cloud, flight_log, table


def depth_supervision(spark: SparkSession, d: str) -> DataFrame:
    return frames.supervised_depth(cloud(spark, d), ["solid"], "y", "x", 0.9).select("pid", "solid", "x")


SUPERVISION = f"""
WITH {CLOUD}, q AS (SELECT solid, quantile_cont(y, 0.005) AS a, quantile_cont(y, 0.995) AS b, quantile_cont(x, 0.99) AS far FROM cloud GROUP BY solid)
SELECT pid, solid, x FROM cloud JOIN q USING (solid) WHERE y BETWEEN a - (b - a) * 0.05 AND b + (b - a) * 0.05 AND x < far * 0.9
"""


def wall_views(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d).withColumn("x", F.when(F.col("colour") % 3 == 0, 20 + F.col("x") / 1000).otherwise(F.col("x")))
    out = frames.wall_views(c, ["colour"], "x", "y")
    return out.select("colour", F.round("spread", 4).alias("spread"), F.round("prior_spread", 4).alias("prior_spread"), "wall")


WALL = f"""
WITH {CLOUD}, c AS (SELECT colour, CASE WHEN colour % 3 = 0 THEN 20 + x / 1000 ELSE x END AS x, y FROM cloud),
s AS (SELECT colour, quantile_cont(ln(x), 0.95) - quantile_cont(ln(x), 0.05) AS a, quantile_cont(ln(y), 0.95) - quantile_cont(ln(y), 0.05) AS b FROM c WHERE x > 0 AND y > 0 GROUP BY colour)
SELECT colour, round(a, 4) AS spread, round(b, 4) AS prior_spread, b > 0.3 AND a < 0.03 * b AS wall FROM s
"""


def depth_fusion(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").withColumn("z", F.lit(20.0) + F.sqrt("l_quantity"))
    return frames.fuse_depth(i, ["l_partkey"], "z", "l_linenumber", 0.04).select("l_partkey", "views", F.round("depth", 4).alias("depth"))


FUSION = """
WITH i AS (SELECT l_partkey, 20.0::DOUBLE + sqrt(l_quantity) AS z, l_linenumber AS w FROM lineitem), m AS (SELECT l_partkey, quantile_disc(z, 0.5) AS m FROM i GROUP BY l_partkey)
SELECT l_partkey, count(*) AS views, round(sum(w * z) / sum(w), 4) AS depth FROM i JOIN m USING (l_partkey) WHERE abs(z / m - 1) <= 0.04 GROUP BY l_partkey HAVING count(*) >= 2
"""


def visible_points(spark: SparkSession, d: str) -> DataFrame:
    return frames.visible(cloud(spark, d), ["solid"], "y", "z", "x", 4.0).select("pid", "solid", "x")


VISIBLE = f"""
WITH {CLOUD}, c AS (SELECT *, min(x) OVER (PARTITION BY solid, floor(y / 4), floor(z / 4)) AS near FROM cloud WHERE x > 0) SELECT pid, solid, x FROM c WHERE x <= near * 1.03
"""


def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    out = frames.quantile_bins(cloud(spark, d), ["flag"], "x", 8)
    return out.groupBy("flag", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("y"), 4).alias("y"))


BINS = f"""
WITH {CLOUD}, e AS (SELECT flag, list_sort(list_distinct(quantile_cont(x, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]))) AS e FROM cloud GROUP BY flag),
b AS (SELECT flag, y, greatest(0, least(len(e) - 2, len(list_filter(e, lambda v: v <= x)) - 1))::INT AS bin FROM cloud JOIN e USING (flag))
SELECT flag, bin, count(*) AS n, round(median(y), 4) AS y FROM b GROUP BY ALL
"""


def band_fill(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d).where("colour % 4 <> 0 or x > 60").withColumn("band", F.floor(F.col("y") / 8).cast("int")).where("band % 3 = 0 and band < 14")
    return frames.fill_bands(c, ["colour"], "band", "z", 14, -1.0).withColumn("z", F.round("z", 4))


BAND_FILL = f"""
WITH {CLOUD}, c AS (SELECT colour, floor(y / 8)::INT AS band, z FROM cloud WHERE (colour % 4 <> 0 OR x > 60) AND floor(y / 8)::INT % 3 = 0 AND floor(y / 8) < 14),
m AS (SELECT colour, band, avg(z) AS v FROM c GROUP BY ALL), g AS (SELECT colour, r.range::INT AS band FROM (SELECT DISTINCT colour FROM c), range(14) r),
j AS (SELECT g.colour, g.band, v, row_number() OVER (PARTITION BY g.colour, g.band ORDER BY abs(m.band - g.band), m.band) AS k FROM g JOIN m USING (colour))
SELECT colour, band, round(v, 4) AS z FROM j WHERE k = 1
"""


def height_histogram(spark: SparkSession, d: str) -> DataFrame:
    return frames.heaviest_bin(cloud(spark, d), ["colour"], "y", "solid", 10.0, 0.1).withColumn("share", F.round("share", 4))


HISTOGRAM = f"""
WITH {CLOUD}, b AS (SELECT colour, floor(y / 10)::BIGINT AS bin, sum(solid) AS a FROM cloud GROUP BY ALL),
t AS (SELECT colour, arg_max(bin, (a, -bin)) AS bin, max(a) AS a, sum(a) AS total FROM b GROUP BY colour)
SELECT colour, bin, round(a / total, 4) AS share FROM t WHERE a >= total * 0.1
"""


def smooth_path(spark: SparkSession, d: str) -> DataFrame:
    out = frames.smooth_path(flight_log(spark, d), ["user_id"], ["t", "event_id"], ["value"], 3)
    return out.select("event_id", "user_id", F.round("value", 4).alias("value"))


SMOOTH = f"""
WITH {LOG}, n AS (SELECT event_id, user_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n,
  first_value(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS a, last_value(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z,
  sum(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM log WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, user_id, round((s + greatest(0, 4 - i) * a + greatest(0, i + 3 - n) * z) / 7, 4) AS value FROM n
"""


def spline_path(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    log = flight_log(spark, d)
    p0, p3 = F.coalesce(F.lag("value").over(w), F.col("value")), F.coalesce(F.lead("value", 2).over(w), F.lead("value").over(w))
    out = log.withColumns({"p0": p0, "p2": F.lead("value").over(w), "p3": p3}).where("p2 is not null")
    return out.select("event_id", F.round(frames.catmull_rom(F.col("p0"), F.col("value"), F.col("p2"), F.col("p3"), F.lit(1 / 3)), 4).alias("value"))


SPLINE = f"""
WITH {LOG}, n AS (SELECT event_id, value AS b, coalesce(lag(value) OVER w, value) AS a, lead(value) OVER w AS c, coalesce(lead(value, 2) OVER w, lead(value) OVER w) AS d FROM log WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, round(0.5 * (2 * b + (c - a) / 3.0::DOUBLE + (2 * a - 5 * b + 4 * c - d) / 9.0::DOUBLE + (3 * b - a - 3 * c + d) / 27.0::DOUBLE), 4) AS value FROM n WHERE c IS NOT NULL
"""


def shot_cuts(spark: SparkSession, d: str) -> DataFrame:
    log = flight_log(spark, d).withColumns({"luma": F.col("value") / 100, "std": F.col("value") / 500, "agree": F.col("value") / 40})
    out = frames.cut_after(log, ["user_id"], ["t", "event_id"], "agree")
    return out.groupBy("user_id").agg(F.count_if("cut").alias("cuts"), F.count_if(frames.usable(F.col("luma"), F.col("std"))).alias("usable"))


CUTS = f"""
WITH {LOG}, c AS (SELECT user_id, value, value / 40 < 0.35 OR lead(1) OVER (PARTITION BY user_id ORDER BY t, event_id) IS NULL AS cut FROM log)
SELECT user_id, count(*) FILTER (cut) AS cuts, count(*) FILTER (value / 100 >= 0.06 AND value / 500 >= 0.025) AS usable FROM c GROUP BY user_id
"""


def kept_passes(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    passes = c.select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") < 0, "degenerate").when(F.col("c_acctbal") < 1000, "too-short").otherwise("3d").alias("verdict"))
    return frames.keep_passes(passes, o, ["o_custkey"], None).select("o_orderkey", "o_custkey")


KEPT = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 1000)"


def triangulated(spark: SparkSession, d: str) -> DataFrame:
    """Two rays per line; midpoint, gap and angle."""
    i = table(spark, d, "lineitem")
    zero = F.lit(0.0)
    x, y, z, gap, angle = frames.triangulate((zero, zero, zero), (F.col("l_quantity"), F.lit(5.0), F.lit(60.0)), (F.lit(10.0), zero, zero), (F.col("l_quantity") - 12, F.lit(5.0) + F.col("l_tax"), F.lit(60.0)))
    return i.select("l_orderkey", "l_linenumber", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"), F.round(gap, 3).alias("gap"), F.round(angle, 3).alias("angle"))


TRIANGULATED = """
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS a1, 5.0::DOUBLE AS a2, 60.0::DOUBLE AS a3, l_quantity - 12 AS b1, 5 + l_tax AS b2, 60.0::DOUBLE AS b3 FROM lineitem),
m AS (SELECT *, a1*a1 + a2*a2 + a3*a3 AS a, a1*b1 + a2*b2 + a3*b3 AS b, b1*b1 + b2*b2 + b3*b3 AS c, -10 * a1 AS d, -10 * b1 AS e FROM r),
k AS (SELECT *, CASE WHEN a*c - b*b > 1e-12 THEN (b*e - c*d) / (a*c - b*b) END AS s, CASE WHEN a*c - b*b > 1e-12 THEN (a*e - b*d) / (a*c - b*b) END AS t FROM m)
SELECT l_orderkey, l_linenumber, round((s*a1 + 10 + t*b1) / 2, 3) AS x, round((s*a2 + t*b2) / 2, 3) AS y, round((s*a3 + t*b3) / 2, 3) AS z,
  round(sqrt((s*a1 - 10 - t*b1)**2 + (s*a2 - t*b2)**2 + (s*a3 - t*b3)**2), 3) AS gap, round(degrees(acos(least(1, greatest(-1, b / sqrt(a*c))))), 3) AS angle FROM k
"""


def depth_table(spark: SparkSession, d: str) -> DataFrame:
    """Per model: counts, medians and means of aligned rows, null where none is."""
    o = table(spark, d, "orders")
    ok = F.col("o_orderstatus") != "P"
    cents = F.round(F.col("o_totalprice") * 100).cast("long")  # whole numbers, so that sums don't depend on their order
    out = models.depth_quality(o.withColumn("model", F.col("o_custkey") % 200), ["model"], ok, cents, cents < 10_500_000)
    return out.withColumns({"median_error": F.col("median_error") / 70_000, "mean_error": F.col("mean_error") / 70_000, "share_good": F.round("share_good", 4)})


DEPTH_TABLE = """
WITH c AS (SELECT o_custkey % 200 AS model, o_orderstatus <> 'P' AS ok, round(o_totalprice * 100)::BIGINT AS cents FROM orders)
SELECT model, count(*) AS n, count(*) FILTER (ok) AS aligned, median(cents) FILTER (ok) / 70000 AS median_error,
  (sum(cents) FILTER (ok))::DOUBLE / count(*) FILTER (ok) / 70000 AS mean_error, round(avg((cents < 10500000)::INT::DOUBLE) FILTER (ok), 4) AS share_good FROM c GROUP BY 1
"""


def pass_counts(spark: SparkSession, d: str) -> DataFrame:
    """Posed images per model and pass folder."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("model"), F.concat(F.lit("pass_"), F.lpad((F.col("o_orderkey") % 7).cast("string"), 2, "0"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("name"))
    return models.pass_counts(o, "model", "name")


PASS_COUNTS = "SELECT o_custkey % 50 AS model, 'pass_' || lpad((o_orderkey % 7)::VARCHAR, 2, '0') AS pass, count(*) AS images FROM orders GROUP BY 1, 2"


def reprojection_mean(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    return i.groupBy("l_suppkey").agg(F.round(models.weighted_mean(F.col("l_discount"), F.col("l_linenumber")), 5).alias("mean_error"), F.round(F.avg(F.when(F.col("l_tax") > 0, F.col("l_tax"))), 5).alias("overlap"))


REPROJECTION = "SELECT l_suppkey, round(sum(l_discount * l_linenumber) / nullif(sum(l_linenumber), 0), 5) AS mean_error, round(avg(l_tax) FILTER (l_tax > 0), 5) AS overlap FROM lineitem GROUP BY l_suppkey"


def gps_models(spark: SparkSession, d: str) -> DataFrame:
    """Posed images with a position, of models that have enough of them."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal > 0")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return models.with_enough(joined, ["c_nationkey"], 500).select("o_orderkey", "c_nationkey")


GPS_MODELS = """
WITH j AS (SELECT o_orderkey, c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0)
SELECT o_orderkey, c_nationkey FROM j WHERE n >= 500
"""


def benchmark_totals(spark: SparkSession, d: str) -> DataFrame:
    """Seconds per video second, runs within budget, median, and the list of misses."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), (F.count(F.lit(1)) * 100_000).alias("video"))
    return o.agg(F.round(F.sum("s") / F.sum("video"), 6).alias("ratio"), F.count_if(F.col("s") <= 1.5 * F.col("video")).alias("within"), F.round(F.median(F.col("s") / F.col("video")), 6).alias("median"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("s") > 2.5 * F.col("video"), F.col("o_custkey")))), ",").alias("misses"))


TOTALS = """
WITH r AS (SELECT o_custkey, sum(o_totalprice) AS s, count(*) * 100000 AS video FROM orders GROUP BY 1)
SELECT round(sum(s) / sum(video), 6) AS ratio, count(*) FILTER (s <= 1.5 * video) AS within, round(median(s / video), 6) AS median,
  coalesce(string_agg(o_custkey::VARCHAR, ',' ORDER BY o_custkey) FILTER (s > 2.5 * video), '') AS misses FROM r
"""


def display_names(spark: SparkSession, d: str) -> DataFrame:
    """The first keyword's label, else the name up to its first separator."""
    p = table(spark, d, "part")
    name = models.display_name(F.col("p_type"), {"steel": "Steel", "brass": "Brass", "copper": "Copper"})
    return p.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


DISPLAY = """
SELECT CASE WHEN contains(lower(p_type), 'steel') THEN 'Steel' WHEN contains(lower(p_type), 'brass') THEN 'Brass' WHEN contains(lower(p_type), 'copper') THEN 'Copper'
  ELSE substr(trim(regexp_split_to_array(p_type, '[ _-]+')[1]), 1, 26) END AS name, count(*) AS n FROM part GROUP BY 1
"""


def queue_order(spark: SparkSession, d: str) -> DataFrame:
    """Jobs in the order in which a queue would start them: urgent first, then by arrival; the first forty per kind."""
    o = table(spark, d, "orders")
    urgent = F.when(F.col("o_orderpriority").startswith("1"), 0).otherwise(1)
    return select.top_k(o.withColumn("urgent", urgent), ["o_orderstatus"], [F.col("urgent"), F.col("o_orderdate"), F.col("o_orderkey")], 40).select("o_orderstatus", "o_orderkey", "rank")


QUEUE = """
WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS rank FROM orders)
SELECT o_orderstatus, o_orderkey, rank::INT AS rank FROM r WHERE rank <= 40
"""

QUERIES = {
    "depth_supervision": (depth_supervision, SUPERVISION),
    "wall_views": (wall_views, WALL),
    "depth_fusion": (depth_fusion, FUSION),
    "visible_points": (visible_points, VISIBLE),
    "quantile_bins": (quantile_bins, BINS),
    "band_fill": (band_fill, BAND_FILL),
    "height_histogram": (height_histogram, HISTOGRAM),
    "smooth_path": (smooth_path, SMOOTH),
    "spline_path": (spline_path, SPLINE),
    "shot_cuts": (shot_cuts, CUTS),
    "kept_passes": (kept_passes, KEPT),
    "triangulated": (triangulated, TRIANGULATED),
    "depth_table": (depth_table, DEPTH_TABLE),
    "pass_counts": (pass_counts, PASS_COUNTS),
    "reprojection_mean": (reprojection_mean, REPROJECTION),
    "gps_models": (gps_models, GPS_MODELS),
    "benchmark_totals": (benchmark_totals, TOTALS),
    "display_names": (display_names, DISPLAY),
    "queue_order": (queue_order, QUEUE),
}
