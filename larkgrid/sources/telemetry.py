"""Flight-log readers: CSV, DJI subtitles, GPX and JSON into one schema, tolerant as flight logs need.

Schema: t seconds; lat, lon; alt_m, rel_alt_m; heading_deg, pitch_deg, roll_deg, yaw_deg; speed_ms; source.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Canonical fields and the normalised headers that stand for them.
ALIASES = {
    "t": "t time timestamp time_s elapsed elapsed_s seconds offset_s",
    "lat": "lat latitude gps_lat gps_latitude lat_deg latitude_deg",
    "lon": "lon lng long longitude gps_lon gps_longitude lon_deg longitude_deg",
    "alt_m": "alt altitude altitude_m alt_m abs_alt absolute_altitude elevation ele gps_alt",
    "rel_alt_m": "rel_alt rel_alt_m relative_altitude relative_altitude_m altitude_agl agl",
    "heading_deg": "heading heading_deg compass_heading course",
    "pitch_deg": "pitch pitch_deg",
    "roll_deg": "roll roll_deg",
    "yaw_deg": "yaw yaw_deg",
    "speed_ms": "speed speed_ms ground_speed ground_speed_ms velocity",
}
FIELDS = tuple(ALIASES)
#: Texts that stand for no value.
PLACEHOLDERS = ("", "nan", "none", "null", "-")
_FIELD_OF = {alias: field for field, names in ALIASES.items() for alias in names.split()}


def normalised(name: Column) -> Column:
    """Lower case, anything but letters and digits as one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), F.lit("_"))


def normalise_header(name: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def tolerant_float(text: Column) -> Column:
    """A number with commas taken out; null for placeholders, booleans and what doesn't parse."""
    t = F.trim(text)
    plain = F.regexp_replace(t, ",", "")
    return F.when(~F.lower(t).isin(*PLACEHOLDERS, "true", "false"), plain.try_cast("double"))


def tolerant_time(text: Column) -> Column:
    """Seconds: a number as it is, or ISO 8601 as seconds since 1970 (UTC where it has no zone)."""
    return F.coalesce(tolerant_float(text), F.unix_micros(F.try_to_timestamp(F.trim(text))) / 1e6)


def from_columns(raw: DataFrame, names: list[str], ordinal: str, source: Column) -> DataFrame:
    """Text columns with any headers to the schema; of several headers for one field the last that parses counts."""
    by_field: dict[str, list[str]] = {}
    for c in names:
        if (field := _FIELD_OF.get(normalise_header(c))) is not None:
            by_field.setdefault(field, []).append(c)
    empty = F.lit(None).cast("double")
    value = lambda f: F.coalesce(*[(tolerant_time if f == "t" else tolerant_float)(F.col(f"`{c}`")) for c in reversed(by_field[f])]) if f in by_field else empty
    out = raw.select(*[value(f).alias(f) for f in FIELDS], source.alias("source"), F.col(ordinal).alias("__n"))
    if "t" not in by_field:
        return out.withColumn("t", (F.row_number().over(Window.partitionBy("source").orderBy("__n")) - 1).cast("double"))
    return out.withColumn("t", F.coalesce("t", F.lit(0.0)))


def rebase(df: DataFrame, ordinal: str = "__n") -> DataFrame:
    """Rows with a position or a height, by time; clocks that start beyond a million seconds start at 0."""
    kept = df.where(F.coalesce("lat", "lon", "alt_m").isNotNull())
    first = F.min("t").over(Window.partitionBy("source"))
    return kept.withColumn("t", F.when(first > 1e6, F.col("t") - first).otherwise(F.col("t"))).drop(ordinal)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma, semicolon or tab separated, whichever the first 4096 characters have most of; a file without a header is an error.

    Rows at t = 0 without a latitude are left out, as loggers write them before the first fix.
    """
    head = spark.read.text(path, wholetext=True).select(F.substring("value", 1, 4096)).first()
    lines = [x for x in (head[0] if head else "").lstrip("\ufeff").splitlines() if x.strip()]
    if not lines:
        raise ValueError(f"no header in {path}")
    sep = max((",", ";", "\t"), key=lambda s: (lines[0].count(s), s == ","))
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)
    names = [c.lstrip("\ufeff") for c in raw.columns]
    raw = raw.toDF(*names).withColumn("__n", F.monotonically_increasing_id())
    rows = from_columns(raw, names, "__n", F.concat(F.lit("csv:"), F.lit(os.path.basename(path))))
    return rebase(rows.where((F.col("t") != 0) | F.col("lat").isNotNull()))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle blocks that hold a latitude and a longitude; time from a stamp in the block, else from the cue."""
    blocks = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n\s*\r?\n")).alias("__n", "b"))
    number = lambda names: F.regexp_extract("b", rf"(?i)\b(?:{names})\s*[:=]?\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    stamp = F.regexp_extract("b", r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?)", 1)
    cue = [F.regexp_extract("b", r"(\d+):(\d\d):(\d\d)[,.](\d{1,3})\s*-->", i).try_cast("double") for i in (1, 2, 3, 4)]
    t = F.coalesce(F.unix_micros(F.try_to_timestamp(F.regexp_replace(F.nullif(stamp, F.lit("")), ",", "."))) / 1e6, cue[0] * 3600 + cue[1] * 60 + cue[2] + cue[3] / 1000, F.lit(0.0))
    none = F.lit(None).cast("double")
    rows = blocks.select(t.alias("t"), number("latitude|lat").alias("lat"), number("longitude|longtitude|lon").alias("lon"), number("abs_alt|altitude").alias("alt_m"), number("rel_alt").alias("rel_alt_m"), number("heading|yaw").alias("heading_deg"), *[none.alias(c) for c in FIELDS[6:]], F.lit(f"srt:{os.path.basename(path)}").alias("source"), "__n")
    return rebase(rows.where("lat is not null and lon is not null"))


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Track, route and way points with both coordinates; malformed XML is an error."""
    parts = []
    for k, tag in enumerate(("trkpt", "rtept", "wpt")):
        raw = spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").option("inferSchema", False).schema("_lat string, _lon string, ele string, time string").load(path)
        parts.append(raw.withColumn("__n", F.monotonically_increasing_id() + F.lit(k << 60)))
    import xml.etree.ElementTree as tree

    try:
        tree.fromstring(spark.read.text(path, wholetext=True).first()[0])
    except tree.ParseError as e:
        raise ValueError(f"malformed GPX in {path}: {e}") from e
    raw = parts[0].unionByName(parts[1]).unionByName(parts[2])
    none = F.lit(None).cast("double")
    rows = raw.select(F.coalesce(tolerant_time(F.col("time")), F.lit(0.0)).alias("t"), tolerant_float(F.col("_lat")).alias("lat"), tolerant_float(F.col("_lon")).alias("lon"), tolerant_float(F.col("ele")).alias("alt_m"), *[none.alias(c) for c in FIELDS[4:]], F.lit(f"gpx:{os.path.basename(path)}").alias("source"), "__n")
    return rebase(rows.where("lat is not null and lon is not null"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, an object that wraps one, or one object; GeoJSON point features as an extension. Other entries are skipped."""
    text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))  # malformed JSON is an error
    lists = [F.try_variant_get("v", p, "array<variant>") for p in ("$", "$.samples", "$.telemetry", "$.gps", "$.data", "$.records", "$.features")]
    rows = text.select(F.posexplode(F.coalesce(*lists, F.array("v"))).alias("__n", "o"))
    rows = rows.withColumn("m", F.try_variant_get("o", "$", "map<string,variant>")).where("m is not null")
    keyed = rows.withColumn("m", F.transform_keys("m", lambda k, _: normalised(k)))
    value = lambda f: F.coalesce(*[(tolerant_time if f == "t" else tolerant_float)(F.try_variant_get(F.col("m")[a], "$", "string")) for a in ALIASES[f].split()])
    point = [F.try_variant_get("o", f"$.geometry.coordinates[{i}]", "double") for i in range(3)]
    extra = {"lon": point[0], "lat": point[1], "alt_m": point[2]}
    out = keyed.select(*[(F.coalesce(value(f), extra[f]) if f in extra else value(f)).alias(f) for f in FIELDS], F.lit(f"json:{os.path.basename(path)}").alias("source"), F.col("__n").cast("long"))
    return rebase(out.withColumn("t", F.coalesce("t", F.col("__n").cast("double"))))


def read(spark: SparkSession, path: str) -> DataFrame:
    """By suffix; any other is an error."""
    suffix = path.rsplit(".", 1)[-1].lower()
    readers = {"csv": read_csv, "tsv": read_csv, "txt": read_csv, "srt": read_srt, "gpx": read_gpx, "json": read_json, "geojson": read_json}
    if suffix not in readers:
        raise ValueError(f"unknown flight-log format: {suffix}")
    return readers[suffix](spark, path)
