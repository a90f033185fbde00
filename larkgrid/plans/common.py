"""The driver's tables in the roles that the operators know."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds since the start of 2024, from a timestamp without zone.
SECONDS = "(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {}) / 1000000.0D)"
DUCK_SECONDS = "((epoch_us({}) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0::DOUBLE)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to the folder that driver and executors share and read again: plans stay short, lost executors repeat one step. On a
    single machine without such a folder, cached."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flight_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a flight log: user_id is the flight; positions follow from the value and the event's number."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "user_id", "event_id", "event_type", "value", F.expr(SECONDS.format("ts")).alias("t"),
        (F.lit(12.0) + F.col("value") / 1000).alias("lat"), (F.lit(77.0) + (F.col("event_id") % 1000) / 10000).alias("lon"),
        (F.col("value") * 2).alias("alt_m"), (F.col("value") / 7).alias("speed_ms"),
    )


LOG = f"""log AS (SELECT user_id, event_id, event_type, value, {DUCK_SECONDS.format('ts')} AS t, 12.0::DOUBLE + value / 1000 AS lat,
  77.0::DOUBLE + (event_id % 1000) / 10000 AS lon, value * 2 AS alt_m, value / 7 AS speed_ms FROM events)"""


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a point cloud: quantity, price and discount are the axes, the line number a solid, the supplier a colour."""
    i = table(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100 + F.col("l_tax") * 10).alias("z"),
        F.col("l_linenumber").alias("solid"), F.col("l_suppkey").alias("colour"), F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pid"),
    )


CLOUD = """cloud AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 + l_tax * 10 AS z, l_linenumber AS solid,
  l_suppkey AS colour, l_returnflag AS flag, l_orderkey * 8 + l_linenumber AS pid FROM lineitem)"""
