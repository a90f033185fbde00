"""Pinhole cameras with one radial term, frame sizes and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkgrid.functions.rotations import Quad, quat_to_matrix


def intrinsics(width: Column, height: Column, hfov_deg: Column) -> tuple[Column, Column, Column]:
    """Focal length and principal point in pixels; a field of view outside (0, 180) is an error."""
    bad = (hfov_deg <= 0) | (hfov_deg >= 180)
    focal = F.when(bad, F.raise_error(F.lit("field of view out of range")).cast("double")).otherwise(width / 2 / F.tan(F.radians(hfov_deg) / 2))
    return focal, (width - 1) / 2, (height - 1) / 2


def to_camera(q: Quad, t: tuple, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    m = quat_to_matrix(q)
    return tuple(m[i][0] * x + m[i][1] * y + m[i][2] * z + t[i] for i in range(3))


def project(xc: Column, yc: Column, zc: Column, f: Column, k1: Column, cx: Column, cy: Column, offset: float = 0.5) -> tuple[Column, Column]:
    """Pixel of a camera-frame point, null behind the camera. offset: where pixel centres lie in the principal point's convention."""
    u, v = xc / zc, yc / zc
    d = 1 + k1 * (u * u + v * v)
    front = zc > 0
    return F.when(front, f * u * d + cx - offset), F.when(front, f * v * d + cy - offset)


def undistort(xd: Column, yd: Column, k1: Column, rounds: int = 6) -> tuple[Column, Column]:
    """Fixed-point inverse of the radial term."""
    start = F.struct(xd.cast("double").alias("x"), yd.cast("double").alias("y"))

    def step(p: Column, _: Column) -> Column:
        d = 1 + k1 * (p["x"] * p["x"] + p["y"] * p["y"])
        return F.struct((xd / d).alias("x"), (yd / d).alias("y"))

    p = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return p["x"], p["y"]


def ray_direction(q: Quad, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """World direction of the normalised image point (x, y, 1)."""
    m = quat_to_matrix(q)
    return tuple(m[0][i] * x + m[1][i] * y + m[2][i] for i in range(3))


def ray_elevation(dx: Column, dy: Column, dz: Column) -> Column:
    """Degrees above the horizon, z up."""
    return F.degrees(F.asin(dz / F.sqrt(dx * dx + dy * dy + dz * dz)))


def camera_centre(q: Quad, t: tuple) -> tuple[Column, Column, Column]:
    m = quat_to_matrix(q)
    return tuple(-(m[0][i] * t[0] + m[1][i] * t[1] + m[2][i] * t[2]) for i in range(3))


def fitted_size(width: Column, height: Column, long_side: Column, multiple: int) -> tuple[Column, Column]:
    """Size with the given longer side, aspect kept, rounded half-even to a multiple, one multiple at least."""
    scale = long_side / F.greatest(width, height)
    side = lambda v: F.greatest(F.lit(multiple), (F.bround(v * scale / multiple) * multiple).cast("int"))
    return side(width), side(height)


def crop_to_multiple(low: Column, high: Column, multiple: int) -> tuple[Column, Column]:
    """The centred part of [low, high) whose length is a multiple."""
    size = F.floor((high - low) / multiple) * multiple
    start = low + F.floor((high - low - size) / 2)
    return start.cast("int"), (start + size).cast("int")


def scaled_crop(low: Column, high: Column, source: Column, target: Column, multiple: int = 2) -> tuple[Column, Column]:
    """One side of a crop of a source frame in a frame of another size: rounded inwards to whole pixels and a multiple, centred."""
    scale = target / source
    return crop_to_multiple(F.ceil(low * scale), F.floor(high * scale), multiple)


def intrinsics_matrix(fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Three rows of three."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(F.array(fx, zero, cx), F.array(zero, fy, cy), F.array(zero, zero, one))


def hms_seconds(text: Column) -> Column:
    """H:M:S, M:S or S to seconds, null where a part doesn't parse."""
    parts = F.split(F.trim(text), ":")
    # any number of digits; white space within a part doesn't count
    number = lambda p: F.when(p.rlike(r"^(\d+\.?\d*|\.\d+)$"), p.cast("double"))
    return F.aggregate(F.transform(parts, lambda p: F.regexp_replace(p, r"\s", "")), F.lit(0.0), lambda a, p: a * 60 + number(p))


def voxel_key(x: Column, y: Column, z: Column, size: float) -> Column:
    """21 bits an axis, offset by 2**20 cells."""
    cell = lambda v: F.floor(v / size).cast("long") + F.lit(1 << 20)
    return F.shiftleft(cell(x), 42).bitwiseOR(F.shiftleft(cell(y), 21)).bitwiseOR(cell(z))
