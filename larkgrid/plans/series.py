"""Queries over flight logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkgrid.operators import series
from larkgrid.plans.common import LOG, flight_log, table


def telemetry_summary(spark: SparkSession, d: str) -> DataFrame:
    return series.summary(flight_log(spark, d), ["user_id"])


TELEMETRY_SUMMARY = f"""
WITH {LOG},
o AS (SELECT *, first_value(lat) OVER w AS lat0, first_value(lon) OVER w AS lon0 FROM log WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT *, radians(lat) AS p, radians(lon) AS l, radians(lat0) AS p0, radians(lon0) AS l0,
  6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(radians(lat))**2) AS n, 6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(radians(lat0))**2) AS n0 FROM o),
x AS (SELECT *, n*cos(p)*cos(l) - n0*cos(p0)*cos(l0) AS dx, n*cos(p)*sin(l) - n0*cos(p0)*sin(l0) AS dy,
  n*(1-0.0066943799901413165)*sin(p) - n0*(1-0.0066943799901413165)*sin(p0) AS dz FROM g),
enu AS (SELECT user_id, t, -sin(l0)*dx + cos(l0)*dy AS e, -sin(p0)*cos(l0)*dx - sin(p0)*sin(l0)*dy + cos(p0)*dz AS n, cos(p0)*cos(l0)*dx + cos(p0)*sin(l0)*dy + sin(p0)*dz AS u FROM x),
s AS (SELECT user_id, sqrt((e - lag(e) OVER w)**2 + (n - lag(n) OVER w)**2 + (u - lag(u) OVER w)**2) AS step FROM enu WINDOW w AS (PARTITION BY user_id ORDER BY t)),
p AS (SELECT user_id, round(coalesce(sum(step), 0), 2) AS path_m FROM s GROUP BY user_id)
SELECT user_id, count(*) AS n, round(max(t) - min(t), 3) AS duration_s, round(min(lat), 8) AS lat_min, round(max(lat), 8) AS lat_max,
  round(min(lon), 8) AS lon_min, round(max(lon), 8) AS lon_max, round(CASE WHEN max(t) - min(t) > 0 THEN (count(*) - 1) / (max(t) - min(t)) END, 3) AS rate_hz,
  round(min(alt_m), 2) AS alt_min, round(max(alt_m), 2) AS alt_max, round(avg(speed_ms), 3) AS speed_mean, round(max(speed_ms), 3) AS speed_max, any_value(path_m) AS path_m
FROM log JOIN p USING (user_id) GROUP BY user_id
"""


def asof_interpolate(spark: SparkSession, d: str) -> DataFrame:
    """Purchases at the interpolated value and altitude of the flight's clicks."""
    log = flight_log(spark, d)
    clicks = log.where("event_type = 'click'").groupBy("user_id", "t").agg(F.min("value").alias("value"), F.min("alt_m").alias("alt_m"))
    probe = log.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    out = series.interpolate(probe, clicks, ["user_id"], "t", ["value", "alt_m"])
    return out.select("event_id", "user_id", F.round("value", 4).alias("value"), F.round("alt_m", 4).alias("alt_m"))


ASOF_INTERPOLATE = f"""
WITH {LOG},
c AS (SELECT user_id, t, min(value) AS value, min(alt_m) AS alt_m FROM log WHERE event_type = 'click' GROUP BY ALL),
p AS (SELECT event_id, user_id, t FROM log WHERE event_type = 'purchase'),
a AS (SELECT p.*, c.t AS t0, c.value AS v0, c.alt_m AS a0 FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.t >= c.t),
b AS (SELECT a.*, c.t AS t1, c.value AS v1, c.alt_m AS a1 FROM a ASOF LEFT JOIN c ON a.user_id = c.user_id AND a.t <= c.t)
SELECT event_id, user_id,
  round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (t - t0) / (t1 - t0) * (v1 - v0) END, 4) AS value,
  round(CASE WHEN t0 IS NULL THEN a1 WHEN t1 IS NULL OR t1 = t0 THEN a0 ELSE a0 + (t - t0) / (t1 - t0) * (a1 - a0) END, 4) AS alt_m FROM b
"""


def asof_left(spark: SparkSession, d: str) -> DataFrame:
    log = flight_log(spark, d)
    out = series.asof_left(log.where("event_type = 'purchase'").select("event_id", "user_id", "t"), log.where("event_type = 'click'"), ["user_id"], "t", ["event_id"], {"click_value": "value", "click_id": "event_id"})
    return out.select("event_id", "user_id", "click_value", "click_id")


ASOF_LEFT = f"""
WITH {LOG}, c AS (SELECT user_id, t, arg_max(value, event_id) AS click_value, max(event_id) AS click_id FROM log WHERE event_type = 'click' GROUP BY ALL),
p AS (SELECT * FROM log WHERE event_type = 'purchase')
SELECT p.event_id, p.user_id, c.click_value, c.click_id FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.t >= c.t
"""


def passes_gaps_islands(spark: SparkSession, d: str) -> DataFrame:
    log = flight_log(spark, d)
    return series.passes(log, ["user_id"], ["t", "event_id"], F.col("event_type") != "error", F.col("value") > 95, 3).withColumns({"first": F.round("first", 3), "last": F.round("last", 3)})


PASSES = f"""
WITH {LOG},
b AS (SELECT *, (NOT event_type <> 'error' OR coalesce(lag(value > 95) OVER w, false))::INT AS brk FROM log WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT user_id, island::BIGINT AS island, round(min(t), 3) AS first, round(max(t), 3) AS last, count(*) AS n FROM i
WHERE event_type <> 'error' GROUP BY user_id, island HAVING count(*) >= 3
"""


def trim_edges(spark: SparkSession, d: str) -> DataFrame:
    return series.trim_edges(flight_log(spark, d), ["user_id"], ["t", "event_id"], "value", 0.8).select("user_id", "event_id", "value")


TRIM = f"""
WITH {LOG}, m AS (SELECT *, median(value) OVER (PARTITION BY user_id) AS med, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM log),
e AS (SELECT user_id, min(k) AS a, max(k) AS b FROM m WHERE value >= med * 0.8 GROUP BY user_id)
SELECT m.user_id, event_id, value FROM m JOIN e ON m.user_id = e.user_id AND k BETWEEN a AND b
"""


def rolling_median_ratio(spark: SparkSession, d: str) -> DataFrame:
    out = series.rolling_median_ratio(flight_log(spark, d), ["user_id"], ["t", "event_id"], "value", 4)
    return out.select("user_id", "event_id", F.round("ratio", 4).alias("ratio"))


ROLLING = f"""
WITH {LOG}, m AS (SELECT *, median(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS med FROM log)
SELECT user_id, event_id, round(CASE WHEN med <= 0 THEN 1.0 ELSE value / med END, 4) AS ratio FROM m
"""


def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    return series.weighted_median(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_linenumber")


WEIGHTED_MEDIAN = """
WITH s AS (SELECT l_returnflag, l_linestatus, l_quantity, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL),
u AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity) AS upto, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus) AS total FROM s)
SELECT l_returnflag, l_linestatus, min(l_quantity) AS weighted_median FROM u WHERE upto >= total / 2 GROUP BY ALL
"""


def low_percentile_cell(spark: SparkSession, d: str) -> DataFrame:
    return series.low_percentile(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", 5)


LOW_PERCENTILE = """
WITH r AS (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, l_extendedprice AS low FROM r WHERE k = floor((n - 1) * 5 / 100) + 1
"""


def adaptive_stride(spark: SparkSession, d: str) -> DataFrame:
    pairs = flight_log(spark, d).withColumn("pair", F.floor(F.col("t") / 86400).cast("long"))
    out = series.adaptive_stride(pairs, ["user_id"], "pair", "value", 2, 200.0, 12)
    return out.withColumn("motion", F.round("motion", 4))


ADAPTIVE_STRIDE = f"""
WITH {LOG}, p AS (SELECT user_id, floor(t / 86400) AS pair, median(value) AS m FROM log GROUP BY ALL),
q AS (SELECT user_id, median(m) AS motion FROM p GROUP BY user_id)
SELECT user_id, round(motion, 4) AS motion, least(12, 2 * greatest(1, floor(200.0 / motion)))::INT AS stride FROM q
"""


def live_session(spark: SparkSession, d: str) -> DataFrame:
    """Recorded seconds of all segments, mean realtime factor of the finished ones."""
    log = flight_log(spark, d)
    return log.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("recorded_s"), F.round(F.avg(F.when(F.col("event_type") == "purchase", F.col("value") / 30)), 4).alias("realtime"))


LIVE_SESSION = f"WITH {LOG} SELECT user_id, round(sum(value), 4) AS recorded_s, round(avg(value / 30) FILTER (event_type = 'purchase'), 4) AS realtime FROM log GROUP BY user_id"


def resource_summary(spark: SparkSession, d: str) -> DataFrame:
    return flight_log(spark, d).groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.percentile("value", F.lit(0.9)), 4).alias("p90"), F.round(F.max("value"), 4).alias("peak"))


RESOURCE_SUMMARY = f"WITH {LOG} SELECT event_type, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.9), 4) AS p90, round(max(value), 4) AS peak FROM log GROUP BY event_type"


def header_normalise(spark: SparkSession, d: str) -> DataFrame:
    from larkgrid.sources.telemetry import normalised

    return table(spark, d, "part").select("p_partkey", normalised(F.concat(F.lit("  "), F.col("p_type"), F.lit(" (m/s) "))).alias("name"))


HEADER_NORMALISE = """SELECT p_partkey, trim(regexp_replace(lower(trim('  ' || p_type || ' (m/s) ')), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part"""


def tolerant_cast(spark: SparkSession, d: str) -> DataFrame:
    from larkgrid.sources.telemetry import tolerant_float

    text = F.expr("case part.p_partkey % 6 when 0 then 'NaN' when 1 then ' -' when 2 then concat(part.p_size, ',5') when 3 then 'x1' when 4 then '' else concat(' ', part.p_retailprice) end")
    return table(spark, d, "part").alias("part").select("p_partkey", tolerant_float(text).alias("v"))


TOLERANT_CAST = """SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN try_cast(p_size::VARCHAR || '5' AS DOUBLE) WHEN 5 THEN p_retailprice END AS v FROM part"""


def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count_if(F.get_json_object("props", "$.k").isNotNull()).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


JSON_PROPS = "SELECT event_type, count(*) FILTER (json_extract(props, '$.k') IS NOT NULL) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type"

QUERIES = {
    "telemetry_summary": (telemetry_summary, TELEMETRY_SUMMARY),
    "asof_interpolate": (asof_interpolate, ASOF_INTERPOLATE),
    "asof_left": (asof_left, ASOF_LEFT),
    "passes_gaps_islands": (passes_gaps_islands, PASSES),
    "trim_edges": (trim_edges, TRIM),
    "rolling_median_ratio": (rolling_median_ratio, ROLLING),
    "weighted_median": (weighted_median, WEIGHTED_MEDIAN),
    "low_percentile_cell": (low_percentile_cell, LOW_PERCENTILE),
    "adaptive_stride": (adaptive_stride, ADAPTIVE_STRIDE),
    "live_session": (live_session, LIVE_SESSION),
    "resource_summary": (resource_summary, RESOURCE_SUMMARY),
    "header_normalise": (header_normalise, HEADER_NORMALISE),
    "tolerant_cast": (tolerant_cast, TOLERANT_CAST),
    "json_props": (json_props, JSON_PROPS),
}
