"""Scenes: masks, textures, terrain, two-view geometry, subjects, freshness and sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inside(u: Column, v: Column, width: Column, height: Column) -> Column:
    return u.between(0, width - 1) & v.between(0, height - 1)


def unmasked(points: DataFrame, mask: DataFrame, view: list[str], u: str, v: str, width: str, height: str) -> DataFrame:
    """Points whose rounded pixel, clamped to the frame, is not one of the mask's cells (view, px, py)."""
    clamp = lambda c, n: F.least(F.greatest(F.bround(c).cast("int"), F.lit(0)), F.col(n) - 1)
    placed = points.withColumns({"px": clamp(u, width), "py": clamp(v, height)})
    return placed.join(mask.select(*view, "px", "py").distinct(), [*view, "px", "py"], "left_anti").drop("px", "py")


def fresh(outputs: DataFrame, inputs: DataFrame, runs: DataFrame, wanted: list[str]) -> DataFrame:
    """(run, fresh): the log says done, every wanted format is there, and the oldest output is newer than the newest input.
    outputs: run, format, mtime; inputs: run, mtime; runs: run, done."""
    made = outputs.groupBy("run").agg(F.collect_set("format").alias("formats"), F.min("mtime").alias("oldest"))
    source = inputs.groupBy("run").agg(F.max("mtime").alias("newest"))
    joined = runs.join(made, "run", "left").join(source, "run", "left")
    complete = F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), F.coalesce("formats", F.array().cast("array<string>")))) == 0
    return joined.select("run", F.coalesce(F.col("done") & complete & (F.col("oldest") > F.col("newest")), F.lit(False)).alias("fresh"))


def metric(average: Column, plain: Column) -> Column:
    """The average if there is one, else the mean of the listed values, else NaN."""
    mean = F.when(F.size(plain) > 0, F.aggregate(plain, F.lit(0.0), lambda a, x: a + x) / F.size(plain))
    return F.coalesce(average, mean, F.lit(float("nan")))


def monotone_value(x: Column, xs: Column, ys: Column, slope: float = 0.0) -> Column:
    """A map given by rising knots: linear between them, with the given slope beyond the ends."""
    i = F.greatest(F.lit(1), F.least(F.size(xs) - 1, F.size(F.filter(xs, lambda k: k <= x))))
    x0, x1, y0, y1 = F.get(xs, i - 1), F.get(xs, i), F.get(ys, i - 1), F.get(ys, i)
    last = F.size(xs) - 1
    return F.when(x < F.get(xs, F.lit(0)), F.get(ys, F.lit(0)) + slope * (x - F.get(xs, F.lit(0)))).when(x > F.get(xs, last), F.get(ys, last) + slope * (x - F.get(xs, last))).otherwise(y0 + (x - x0) / (x1 - x0) * (y1 - y0))


def occupied_share(points: DataFrame, by: list[str], alive: str, cell: list[str]) -> DataFrame:
    """The lesser of the share of points that are alive and the share of cells that hold one."""
    per = points.groupBy(*by, *cell).agg(F.count(F.lit(1)).alias("n"), F.count_if(alive).alias("a"))
    return per.groupBy(*by).agg(F.least(F.sum("a") / F.sum("n"), F.count_if(F.col("a") > 0) / F.count(F.lit(1))).alias("share"))


def last_match(text: Column, pattern: str) -> Column:
    """The first group of a pattern's last match."""
    return F.element_at(F.regexp_extract_all(text, F.lit(pattern), 1), -1)


def widest_partner(pairs: DataFrame, by: list[str], gap: str, overlap: str, least: float = 0.3) -> DataFrame:
    """The largest gap whose overlap is still enough."""
    return pairs.where(F.col(overlap) >= least).groupBy(*by).agg(F.max(gap).alias(gap))


def probe_times(duration: Column, n: int = 12) -> Column:
    """n evenly spaced times from 5 to 90 percent of a clip of ten seconds or more; none of shorter ones."""
    times = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: duration * (0.05 + 0.85 * i / (n - 1)))
    return F.when(duration >= 10, times).otherwise(F.array().cast("array<double>"))


def quantile_picks(df: DataFrame, by: list[str], ok: Column, order: list[str], shares: list[float]) -> DataFrame:
    """The qualifying rows at the given shares of their order."""
    group = Window.partitionBy(*by)
    ranked = df.where(ok).withColumns({"__i": F.row_number().over(group.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(group)})
    at = F.array_distinct(F.array(*[F.floor((F.col("__n") - 1) * s).cast("int") for s in shares]))
    return ranked.where(F.array_contains(at, F.col("__i"))).drop("__i", "__n")


def area_sample(df: DataFrame, key: list[str], area: str, most: int, seed: str) -> DataFrame:
    """Rows without replacement, with chances by area: the smallest of seeded exponential times with the area as rate."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in key])), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(1 << 48))
    return df.where(F.col(area) > 0).withColumn("__t", -F.log(u) / F.col(area)).orderBy("__t", *key).limit(most).drop("__t")


def last_write(df: DataFrame, cell: list[str], ordinal: str, keep: list[str]) -> DataFrame:
    """Of the rows of a pixel the one written last; of equal ordinals the one with the greatest values of `keep`."""
    return df.groupBy(*cell).agg(F.max_by(F.struct(*keep), F.struct(ordinal, *keep)).alias("__b")).select(*cell, *[F.col("__b")[c].alias(c) for c in keep])


def bilinear(samples: DataFrame, pixels: DataFrame, u: str, v: str, value: str) -> DataFrame:
    """samples with the value interpolated between the four pixels (px, py) around; pixels beyond the border don't count."""
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("c")
    spread = samples.select("*", corners).withColumns({"px": (F.floor(u) + F.col("c.i")).cast("int"), "py": (F.floor(v) + F.col("c.j")).cast("int")})
    fu, fv = F.col(u) - F.floor(u), F.col(v) - F.floor(v)
    w = F.when(F.col("c.i") == 1, fu).otherwise(1 - fu) * F.when(F.col("c.j") == 1, fv).otherwise(1 - fv)
    joined = spread.withColumn("w", w).where("w > 0").join(pixels.select("px", "py", F.col(value).alias("__v")), ["px", "py"])
    return joined.groupBy(*samples.columns).agg((F.sum(F.col("w") * F.col("__v")) / F.sum("w")).alias(value))


def atlas_cells(faces: DataFrame, face: str, per_row: int, size: int, gutter: int = 1) -> DataFrame:
    """Two triangles a square cell, row by row: the cell's corner and which half of it the face has. Numbered without one task:
    faces are numbered from 0 as the column says."""
    cell = F.floor(F.col(face) / 2).cast("long")
    return faces.withColumns({"u0": (cell % per_row) * size + gutter, "v0": F.floor(cell / per_row).cast("long") * size + gutter, "half": (F.col(face) % 2).cast("int")})


def texel_weights(u: Column, v: Column, size: int, half: Column) -> tuple[Column, Column, Column]:
    """Barycentric weights of a texel's centre in its half of a cell."""
    a, b = (u + 0.5) / size, (v + 0.5) / size
    return F.when(half == 0, 1 - a - b).otherwise(a + b - 1), F.when(half == 0, a).otherwise(1 - a), F.when(half == 0, b).otherwise(1 - b)


def fusion_least_views(n_maps: Column) -> Column:
    """Two views for a dozen maps or fewer, else three; less a half, as weights add up to it."""
    return F.when(n_maps <= 12, 1.5).otherwise(2.5)


def subject_point(axes: DataFrame, by: list[str], aimed_deg: float = 25.0, least: float = 0.3) -> DataFrame:
    """The point nearest to all viewing axes (cx, cy, cz, dx, dy, dz; unit directions) by least squares, per group, where enough
    of them are aimed at it: x, y, z, aimed (share) and distance (median). Twelve sums a group; the 3x3 solve is a closed form."""
    d, c = ("dx", "dy", "dz"), ("cx", "cy", "cz")
    m = lambda i, j: (1.0 if i == j else 0.0) - F.col(d[i]) * F.col(d[j])
    sums = {f"m{i}{j}": F.sum(m(i, j)) for i in range(3) for j in range(i, 3)} | {f"b{i}": F.sum(sum((m(i, j) * F.col(c[j]) for j in (1, 2)), m(i, 0) * F.col(c[0]))) for i in range(3)}
    s = axes.groupBy(*by).agg(*[v.alias(k) for k, v in sums.items()])
    g = lambda i, j: F.col(f"m{min(i, j)}{max(i, j)}")
    cof = lambda i, j: g((i + 1) % 3, (j + 1) % 3) * g((i + 2) % 3, (j + 2) % 3) - g((i + 1) % 3, (j + 2) % 3) * g((i + 2) % 3, (j + 1) % 3)
    det = g(0, 0) * cof(0, 0) + g(0, 1) * cof(0, 1) + g(0, 2) * cof(0, 2)
    point = s.withColumn("det", det).where(F.abs("det") > 1e-9).select(*by, *[((cof(0, i) * F.col("b0") + cof(1, i) * F.col("b1") + cof(2, i) * F.col("b2")) / F.col("det")).alias(a) for i, a in enumerate("xyz")])
    joined = axes.join(point, by)
    v = [F.col(a) - F.col(k) for a, k in zip("xyz", c)]
    r = F.sqrt(v[0] ** 2 + v[1] ** 2 + v[2] ** 2)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (v[0] * F.col("dx") + v[1] * F.col("dy") + v[2] * F.col("dz")) / r))))
    out = joined.groupBy(*by, "x", "y", "z").agg(F.avg((angle <= aimed_deg).cast("double")).alias("aimed"), F.median(r).alias("distance"))
    return out.where(F.col("aimed") >= least)


def _normalised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = p.mean(0)
    s = np.sqrt(2) / max(np.sqrt(((p - m) ** 2).sum(1)).mean(), 1e-12)
    return (p - m) * s, np.array([[s, 0, -s * m[0]], [0, s, -s * m[1]], [0, 0, 1]])


def homography(a: np.ndarray, b: np.ndarray, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The plane map of b on a by reweighted least squares on normalised points, and the residuals in pixels."""
    (p, tp), (q, tq) = _normalised(a), _normalised(b)
    w = np.ones(len(p))
    h, res = np.eye(3), np.zeros(len(p))
    for _ in range(rounds):
        z, one = np.zeros((len(p), 3)), np.c_[p, np.ones(len(p))]
        rows = np.concatenate([np.c_[one, z, -q[:, :1] * one] * w[:, None], np.c_[z, one, -q[:, 1:] * one] * w[:, None]])
        h = np.linalg.inv(tq) @ np.linalg.svd(rows, full_matrices=False)[2][-1].reshape(3, 3) @ tp
        y = np.c_[a, np.ones(len(a))] @ h.T
        res = np.linalg.norm(y[:, :2] / y[:, 2:] - b, axis=1)
        w = 1 / np.sqrt(1 + (res / max(1.4826 * np.median(res), 1e-6) / 2.0) ** 2)
    return h / h[2, 2], res


def fundamental(a: np.ndarray, b: np.ndarray, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The rank-2 epipolar matrix by reweighted least squares on normalised points, and the Sampson distances in pixels."""
    (p, tp), (q, tq) = _normalised(a), _normalised(b)
    w, f, res = np.ones(len(p)), np.zeros((3, 3)), np.zeros(len(p))
    ah, bh = np.c_[a, np.ones(len(a))], np.c_[b, np.ones(len(b))]
    for _ in range(rounds):
        rows = np.c_[q[:, :1] * np.c_[p, np.ones(len(p))], q[:, 1:] * np.c_[p, np.ones(len(p))], np.c_[p, np.ones(len(p))]] * w[:, None]
        u, s, vt = np.linalg.svd(np.linalg.svd(rows, full_matrices=False)[2][-1].reshape(3, 3))
        f = tq.T @ (u * [s[0], s[1], 0]) @ vt @ tp
        fa, fb = ah @ f.T, bh @ f
        res = np.abs((bh * fa).sum(1)) / np.sqrt((fa[:, :2] ** 2).sum(1) + (fb[:, :2] ** 2).sum(1) + 1e-18)
        w = 1 / np.sqrt(1 + (res / max(1.4826 * np.median(res), 1e-6) / 2.0) ** 2)
    return f / np.linalg.norm(f), res


def two_view(matches: DataFrame, by: list[str], least: int = 16) -> DataFrame:
    """Per image pair (columns ax, ay, bx, by_): does a plane map explain the matches as well as an epipolar matrix does?
    Robust information criteria of both, residual scale and the median residual of the plane map; pairs are bounded by an image."""
    kinds = dict(matches.dtypes)

    def criterion(res: np.ndarray, sigma: float, dimension: int, parameters: int) -> float:
        n = len(res)
        return float(np.minimum((res / sigma) ** 2, 2.0 * (4 - dimension)).sum() + n * dimension * np.log(4) + parameters * np.log(4 * n))

    def analyse(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[["ax", "ay"]].to_numpy(float), pdf[["bx", "by_"]].to_numpy(float)
        if len(a) < least:
            return pd.DataFrame([[*key, len(a), np.nan, np.nan, np.nan, np.nan, None]], columns=[*by, "n", "gric_h", "gric_f", "sigma", "plane_px", "parallax"])
        rh, rf = homography(a, b)[1], fundamental(a, b)[1]
        sigma = max(1.4826 * float(np.median(rf)), 0.1)
        gh, gf = criterion(rh / np.sqrt(2), sigma, 2, 8), criterion(rf, sigma, 3, 7)  # a transfer error holds the noise of both images
        return pd.DataFrame([[*key, len(a), gh, gf, sigma, float(np.median(rh)), gf < gh]], columns=[*by, "n", "gric_h", "gric_f", "sigma", "plane_px", "parallax"])

    return matches.select(*by, "ax", "ay", "bx", "by_").groupBy(*by).applyInPandas(analyse, ", ".join([*[f"{c} {kinds[c]}" for c in by], "n long, gric_h double, gric_f double, sigma double, plane_px double, parallax boolean"]))


def cross_validate(df: DataFrame, by: list[str], x: str, y: str, key: str, folds: int = 5, seed: str = "cv") -> DataFrame:
    """Median relative error of a robust line and of a monotone map on held-out folds of seeded keys, per group."""
    from larkgrid.operators.fits import cauchy_line, isotonic

    fold = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int").alias("fold")
    kinds = dict(df.dtypes)

    def judge(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        line, steps = [], []
        for k in range(folds):
            fit, held = pdf[pdf["fold"] != k], pdf[pdf["fold"] == k]
            a, b, _ = cauchy_line(fit[x].to_numpy(float), fit[y].to_numpy(float))
            order = fit.sort_values(x)
            bins = np.array_split(np.arange(len(order)), max(1, min(24, len(order) // 3)))
            xs = np.array([order[x].to_numpy()[i].mean() for i in bins])
            ys = isotonic(np.array([np.median(order[y].to_numpy()[i]) for i in bins]), np.array([len(i) for i in bins]))
            h, t = held[x].to_numpy(float), held[y].to_numpy(float)
            line.extend(np.abs(a + b * h - t) / np.maximum(np.abs(t), 1e-9))
            steps.extend(np.abs(np.interp(h, xs, ys) - t) / np.maximum(np.abs(t), 1e-9))
        return pd.DataFrame([[*key_, float(np.median(line)), float(np.median(steps))]], columns=[*by, "line_error", "monotone_error"])

    return df.select(*by, x, y, fold).groupBy(*by).applyInPandas(judge, ", ".join([*[f"{c} {kinds[c]}" for c in by], "line_error double, monotone_error double"]))


def terrain(points: DataFrame, size: float, percent: float = 10.0, reach: int = 2, rise: float = 0.5) -> DataFrame:
    """(row, col, ground): the low percentile per cell, opened by a square of `reach` cells (so roofs and trees go), kept where the
    cell isn't much above the opened surface, else the surface. Minimum and maximum filters are separable aggregates over shifted cells."""
    from larkgrid.operators.series import low_percentile

    cells = points.withColumns({"row": F.floor(F.col("y") / size).cast("long"), "col": F.floor(F.col("x") / size).cast("long")})
    low = low_percentile(cells, ["row", "col"], "z", percent).withColumnRenamed("low", "z")

    def sweep(df: DataFrame, value: str, pick) -> DataFrame:
        for axis in ("row", "col"):
            shifted = df.select("row", "col", value, F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("d")).withColumn(axis, F.col(axis) + F.col("d"))
            df = shifted.groupBy("row", "col").agg(pick(value).alias(value))
        return df

    opened = sweep(sweep(low, "z", F.min), "z", F.max).withColumnRenamed("z", "surface")
    return low.join(opened, ["row", "col"]).select("row", "col", F.when(F.col("z") - F.col("surface") <= rise, F.col("z")).otherwise(F.col("surface")).alias("ground"))
