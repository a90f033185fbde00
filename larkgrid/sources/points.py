"""Point-cloud, camera-model and stage-result files: readers and writers.

Readers load files with Spark (any store it reads) and parse them on the executors. Writers pack records on the executors and
stream the packed chunks to one file in row order, so the driver holds one chunk at a time.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Scalar types of PLY headers as numpy types.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
_WIDE = {"i1": "short", "u1": "short", "<i2": "short", "<u2": "int", "<i4": "int", "<u4": "long", "<f4": "float", "<f8": "double"}


def ply_header(data: bytes) -> dict:
    """format, elements as (name, count, [(property, type or None for lists)]) and where the data begins."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    start = data.index(b"\n", end) + 1
    out: dict = {"format": "", "elements": [], "start": start}
    for line in data[:end].decode("ascii", "replace").splitlines()[1:]:
        word = line.split()
        if not word or word[0] in ("comment", "obj_info"):
            continue
        if word[0] == "format":
            out["format"] = word[1]
        elif word[0] == "element":
            out["elements"].append((word[1], int(word[2]), []))
        elif word[0] == "property":
            out["elements"][-1][2].append((word[-1], None if word[1] == "list" else PLY_TYPES[word[1]]))
    return out


def _vertices(data: bytes) -> tuple[int, list[tuple[str, str]], np.ndarray]:
    head = ply_header(data)
    name, count, props = head["elements"][0]
    if name != "vertex" or not {"x", "y", "z"} <= {p for p, _ in props}:
        raise ValueError("a cloud needs vertices with x, y and z first")
    kinds = [(p, t) for p, t in props if t]
    if head["format"] == "ascii":
        rows = [x.split() for x in data[head["start"] :].decode("ascii").splitlines()[:count]]
        table = np.zeros(count, dtype=kinds)
        for i, (p, t) in enumerate(props):
            if t:
                table[p] = [float(r[i]) for r in rows]
        return count, kinds, table
    if head["format"] != "binary_little_endian" or any(t is None for _, t in props):
        raise ValueError(f"unsupported PLY format {head['format']}")
    return count, kinds, np.frombuffer(data, np.dtype(kinds), count, head["start"])


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """The vertices of a PLY file (ascii or binary little endian) with all scalar properties; red, green, blue as r, g, b if all are there."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536)).first()
    if head is None:
        raise FileNotFoundError(path)
    _, _, props = ply_header(bytes(head[0]))["elements"][0]
    kinds = [(p, t) for p, t in props if t]
    colour = {"red": "r", "green": "g", "blue": "b"}
    named = {p: colour.get(p, p) if {"red", "green", "blue"} <= {p for p, _ in kinds} else p for p, _ in kinds}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                table = _vertices(content.as_py())[2]
                for i in range(0, len(table), 50_000):
                    part = table[i : i + 50_000]
                    yield pa.RecordBatch.from_pandas(pd.DataFrame({named[p]: part[p].astype({"short": "i2", "int": "i4", "long": "i8", "float": "f4", "double": "f8"}[_WIDE[t]]) for p, t in kinds}), preserve_index=False)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, ", ".join(f"{named[p]} {_WIDE[t]}" for p, t in kinds))


def ply_vertex_count(spark: SparkSession, path: str) -> int:
    """From the header alone."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536)).first()
    return next(n for name, n, _ in ply_header(bytes(head[0]))["elements"] if name == "vertex")


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated x y z and further numbers; lines that don't parse go."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(*[F.get(parts, F.lit(i)).try_cast("double").alias(a) for i, a in enumerate("xyz")])
    return rows.where("x is not null and y is not null and z is not null")


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z and 16-bit r, g, b (null for formats without colour) of an uncompressed LAS file."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                if data[:4] != b"LASF" or data[104] & 0x80:
                    raise ValueError("not an uncompressed LAS file")
                start, kind, size = struct.unpack_from("<I", data, 96)[0], data[104], struct.unpack_from("<H", data, 105)[0]
                n = struct.unpack_from("<Q", data, 247)[0] if data[25] >= 4 else struct.unpack_from("<I", data, 107)[0]
                scale, offset = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
                at = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30}.get(kind)
                raw = np.frombuffer(data, np.uint8, n * size, start).reshape(n, size)
                for i in range(0, n, 50_000):
                    part = raw[i : i + 50_000]
                    xyz = np.ascontiguousarray(part[:, :12]).view("<i4")
                    cols = {a: xyz[:, j] * scale[j] + offset[j] for j, a in enumerate("xyz")}
                    rgb = np.ascontiguousarray(part[:, at : at + 6]).view("<u2").astype("i4") if at else None
                    yield pa.RecordBatch.from_arrays([*[pa.array(v) for v in cols.values()], *[pa.array(rgb[:, j]) if at else pa.nulls(len(part), pa.int32()) for j in range(3)]], [*"xyz", *"rgb"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "x double, y double, z double, r int, g int, b int")


def _stream(df: DataFrame, pack, path: str, header: bytes) -> int:
    """Packed chunks of df, in row order, after the header; returns the rows written."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([pack(batch.to_pandas())], pa.binary())], ["n", "data"])

    written = 0
    with open(path, "wb") as f:
        f.write(header)
        for row in df.mapInArrow(chunks, "n long, data binary").toLocalIterator():
            f.write(row.data)
            written += row.n
    return written


def write_ply(df: DataFrame, path: str, comment: str = "") -> int:
    """x, y, z as float32 and, if r, g, b are there, colours as uchar; binary little endian."""
    colour = {"r", "g", "b"} <= set(df.columns)
    n = df.count()
    lines = ["ply", "format binary_little_endian 1.0", *([f"comment {comment}"] if comment else []), f"element vertex {n}", *[f"property float {a}" for a in "xyz"], *([f"property uchar {c}" for c in ("red", "green", "blue")] if colour else []), "end_header", ""]
    kinds = [(a, "<f4") for a in "xyz"] + ([(c, "u1") for c in "rgb"] if colour else [])

    def pack(pdf: pd.DataFrame) -> bytes:
        out = np.zeros(len(pdf), np.dtype(kinds))
        for c, _ in kinds:
            out[c] = pdf[c].to_numpy()
        return out.tobytes()

    return _stream(df.select(*[c for c, _ in kinds]), pack, path, "\n".join(lines).encode())


def write_las(df: DataFrame, path: str, scale: float = 0.001) -> int:
    """LAS 1.4, point format 7; 8-bit colours become 16-bit; the offset is the floor of the least coordinates."""
    colour = {"r", "g", "b"} <= set(df.columns)
    b = df.agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{a}{k}") for a in "xyz" for k, f in (("0", F.min), ("1", F.max))]).first()
    offset = [float(np.floor(b[f"{a}0"] or 0)) for a in "xyz"]
    head = bytearray(375)
    head[:4] = b"LASF"
    struct.pack_into("<BB", head, 24, 1, 4)
    head[26:34], head[58:66] = b"larkgrid", b"larkgrid"
    struct.pack_into("<HII", head, 94, 375, 375, 0)
    struct.pack_into("<BH", head, 104, 7, 36)
    struct.pack_into("<6d", head, 131, scale, scale, scale, *offset)
    struct.pack_into("<6d", head, 179, *[b[f"{a}{k}"] or 0.0 for a in "xyz" for k in "10"])
    struct.pack_into("<Q", head, 247, b.n)
    struct.pack_into("<Q", head, 255, b.n)

    def pack(pdf: pd.DataFrame) -> bytes:
        out = np.zeros((len(pdf), 36), np.uint8)
        xyz = np.stack([np.rint((pdf[a].to_numpy(float) - o) / scale).astype("<i4") for a, o in zip("xyz", offset)], axis=1)
        out[:, :12] = np.ascontiguousarray(xyz).view(np.uint8).reshape(len(pdf), 12)
        out[:, 14] = 0x11  # first of one return
        if colour:
            rgb = np.stack([(pdf[c].to_numpy().astype(np.uint32) * 257).astype("<u2") for c in "rgb"], axis=1)
            out[:, 30:36] = np.ascontiguousarray(rgb).view(np.uint8).reshape(len(pdf), 6)
        return out.tobytes()

    return _stream(df.select(*"xyz", *("rgb" if colour else "")), pack, path, bytes(head))


def write_web_splats(df: DataFrame, path: str) -> int:
    """32 bytes a splat: position and scale as float32, colour and opacity as bytes, quaternion as bytes about 128."""

    def pack(pdf: pd.DataFrame) -> bytes:
        out = np.zeros(len(pdf), np.dtype([("p", "<f4", 3), ("s", "<f4", 3), ("c", "u1", 4), ("q", "u1", 4)]))
        out["p"], out["s"] = pdf[list("xyz")].to_numpy(), pdf[["sx", "sy", "sz"]].to_numpy()
        out["c"] = np.clip(np.rint(pdf[list("rgba")].to_numpy()), 0, 255)
        q = pdf[["qw", "qx", "qy", "qz"]].to_numpy(float)
        out["q"] = np.clip(np.rint(q / np.linalg.norm(q, axis=1, keepdims=True) * 128 + 128), 0, 255)
        return out.tobytes()

    return _stream(df, pack, path, b"")


def write_text_rows(df: DataFrame, path: str, form: str) -> int:
    """One formatted line per row."""
    return _stream(df, lambda pdf: "".join(form % tuple(r) + "\n" for r in pdf.itertuples(index=False)).encode(), path, b"")


def camera_track_geojson(keyframes: DataFrame) -> DataFrame:
    """One row, a FeatureCollection of keyframe points by name; keyframes are as many as a scene has photos."""
    point = F.struct(F.lit("Feature").alias("type"), F.struct("name").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat", F.coalesce("alt_m", F.lit(0.0))).alias("coordinates")).alias("geometry"))
    placed = keyframes.where("lat is not null and lon is not null").select(F.struct("name", point.alias("f")).alias("s"))
    features = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["f"])
    return placed.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), features.alias("features"))).alias("value"))


def read_colmap(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cameras, images, observations and points of a text model (cameras.txt, images.txt, points3D.txt)."""
    plain = lambda name: spark.read.text(f"{path}/{name}.txt").where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    part = F.split("value", r"\s+")
    number = lambda i, t="double": part[i].cast(t)
    cameras = plain("cameras").select(number(0, "long").alias("camera_id"), part[1].alias("model"), number(2, "int").alias("width"), number(3, "int").alias("height"), F.transform(F.slice(part, 5, F.size(part)), lambda v: v.cast("double")).alias("params"))
    lines = spark.read.text(f"{path}/images.txt", wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: ~x.startswith("#"))).alias("n", "value"))
    pose = lines.where("n % 2 = 0").where(F.trim("value") != "")
    names = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    images = pose.select("n", number(0, "long").alias("image_id"), *[number(i + 1).alias(c) for i, c in enumerate(names)], number(8, "long").alias("camera_id"), part[9].alias("name"))
    triples = lines.where("n % 2 = 1").select((F.col("n") - 1).alias("n"), F.filter(part, lambda x: x != "").alias("p"))
    marks = triples.select("n", "p", F.explode(F.sequence(F.lit(0), F.floor(F.size("p") / 3).cast("int"))).alias("k")).where(F.col("k") < F.floor(F.size("p") / 3))
    at = lambda j: F.get("p", F.col("k") * 3 + j)
    observations = marks.select("n", "k", at(0).cast("double").alias("x"), at(1).cast("double").alias("y"), at(2).cast("long").alias("point_id")).join(images.select("n", "image_id"), "n").drop("n")
    points = plain("points3D").select(number(0, "long").alias("point_id"), *[number(i + 1).alias(a) for i, a in enumerate("xyz")], *[number(i + 4, "int").alias(c) for i, c in enumerate("rgb")], number(7).alias("error"), F.floor((F.size(part) - 8) / 2).cast("int").alias("track"))
    return {"cameras": cameras, "images": images.drop("n"), "observations": observations, "points": points}


def depth_observations(model: dict[str, DataFrame]) -> DataFrame:
    """Camera-frame depth of each observed point, in front of the camera only."""
    from larkgrid.functions.camera import to_camera

    seen = model["observations"].where("point_id >= 0").join(model["points"].select("point_id", *[F.col(a).alias(f"p{a}") for a in "xyz"]), "point_id").join(model["images"], "image_id")
    _, _, z = to_camera(tuple(F.col(f"q{c}") for c in "wxyz"), tuple(F.col(f"t{c}") for c in "xyz"), F.col("px"), F.col("py"), F.col("pz"))
    return seen.select("image_id", "name", "x", "y", z.alias("depth")).where("depth > 0")


def model_statistics(model: dict[str, DataFrame]) -> DataFrame:
    """Posed images, points, mean error of points that have one, mean track length."""
    p = model["points"].agg(F.count(F.lit(1)).alias("points"), F.avg(F.when(F.col("error") >= 0, F.col("error"))).alias("mean_error"), F.avg("track").alias("mean_track"))
    return model["images"].agg(F.count(F.lit(1)).alias("images")).crossJoin(p)  # one row each


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """Stage results root/<run>/<stage>/result.json as run, stage and a variant; corrupt files give null."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "result.json").text(root, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return files.select(F.element_at(parts, -3).alias("run"), F.element_at(parts, -2).alias("stage"), F.try_parse_json("value").alias("result"))


def stage_log(spark: SparkSession, path: str) -> DataFrame:
    """The last state and seconds of each stage that a run's log lines tell: `stage NAME started|finished|failed [in S s]`."""
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_path").alias("file"))
    form = r"stage (\S+) (started|finished|failed)(?:.*? in ([0-9.]+) ?s)?"
    found = raw.select("file", "n", *[F.regexp_extract("value", form, i).alias(c) for i, c in ((1, "stage"), (2, "state"), (3, "s"))]).where("stage <> ''")
    last = found.groupBy("file", "stage").agg(F.max_by(F.struct("state", F.col("s").try_cast("double").alias("seconds")), "n").alias("l"))
    return last.select("file", "stage", "l.state", "l.seconds")


def write_json(path: str, value: dict) -> None:
    with open(path, "w") as f:
        json.dump(value, f, indent=2, default=str)
