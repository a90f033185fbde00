"""Frame, depth and run tables: predicates, depth statistics, visibility, camera paths, greedy keyframes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(luma_mean: Column, luma_std: Column) -> Column:
    """Neither dark nor flat."""
    return (luma_mean >= 0.06) & (luma_std >= 0.025)


def cut_after(df: DataFrame, by: list[str], order: list[str], consistency: str, least: float = 0.35) -> DataFrame:
    """df with `cut`: an inconsistent frame, and each group's last."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("cut", (F.coalesce(F.col(consistency), F.lit(0.0)) < least) | F.lead(F.lit(1)).over(w).isNull())


def keep_passes(passes: DataFrame, frames: DataFrame, on: list[str], wanted: list | None, verdict: str = "verdict") -> DataFrame:
    """Frames of the wanted passes (all if None) that are neither degenerate nor too short."""
    ok = ~F.col(verdict).isin("degenerate", "too-short")
    if wanted is not None:
        ok &= F.col(on[-1]).isin(wanted)
    return frames.join(passes.where(ok).select(*on).distinct(), on, "left_semi")


def supervised_depth(df: DataFrame, by: list[str], pred: str, depth: str, far: float = 1.5) -> DataFrame:
    """Rows whose prediction lies within its central range, widened by a twentieth, and whose depth isn't far beyond the group's."""
    q = df.groupBy(*by).agg(F.percentile(pred, F.array(F.lit(0.005), F.lit(0.995))).alias("__q"), F.percentile(depth, F.lit(0.99)).alias("__z"))
    slack = (F.col("__q")[1] - F.col("__q")[0]) * 0.05
    return df.join(q, by).where(F.col(pred).between(F.col("__q")[0] - slack, F.col("__q")[1] + slack) & (F.col(depth) < F.col("__z") * far)).drop("__q", "__z")


def wall_views(df: DataFrame, by: list[str], depth: str, prior: str, least_prior: float = 0.3, share: float = 0.03) -> DataFrame:
    """The groups whose log depth hardly varies though the prior's does."""
    spread = lambda c: F.percentile(F.log(c), F.lit(0.95)) - F.percentile(F.log(c), F.lit(0.05))
    s = df.where((F.col(depth) > 0) & (F.col(prior) > 0)).groupBy(*by).agg(spread(depth).alias("spread"), spread(prior).alias("prior_spread"))
    return s.withColumn("wall", (F.col("prior_spread") > least_prior) & (F.col("spread") < share * F.col("prior_spread")))


def flatten(df: DataFrame, keys: list[str], column: str, checkpoint, longest: int = 6) -> DataFrame:
    """(keys, path, value) for each leaf of a variant; lists longer than `longest` are summed up as their length. Level by level, until
    no row goes deeper; checkpoint(DataFrame, name) writes and rereads a level, so plans stay short however deep the data are."""
    kind = F.regexp_extract(F.schema_of_variant("v"), "^([A-Z]+)", 1)
    items = F.try_variant_get("v", "$", "array<variant>")
    listed = F.transform(items, lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
    inner = F.when(F.col("k") == "OBJECT", F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))).when((F.col("k") == "ARRAY") & (F.size(items) <= longest), listed)
    text = F.when(F.col("k") == "ARRAY", F.concat(F.lit("["), F.size(items).cast("string"), F.lit(" items]"))).otherwise(F.try_variant_get("v", "$", "string"))
    level, out = df.select(*keys, F.lit("").alias("path"), F.col(column).alias("v")), None
    while True:
        level = checkpoint(level, "leaves")
        typed = level.withColumn("k", kind).withColumn("inner", inner)
        leaf = typed.where(F.col("inner").isNull()).select(*keys, "path", text.alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        below = typed.where(F.size("inner") > 0).select(*keys, "path", F.explode("inner").alias("e"))
        if below.isEmpty():
            return out
        level = below.select(*keys, F.concat(F.col("path"), F.when(F.col("path") == "", "").otherwise("."), F.col("e.key")).alias("path"), F.col("e.value").alias("v"))


def fuse_depth(df: DataFrame, by: list[str], depth: str, weight: str, tolerance: float = 0.05, least: int = 2) -> DataFrame:
    """Per pixel over views: the lower median, and the weighted mean of the views that agree with it, where enough do."""
    seen = df.where(F.col(depth) > 0)
    middle = seen.groupBy(*by).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {depth})").alias("__m"))
    near = seen.join(middle, by).where(F.abs(F.col(depth) / F.col("__m") - 1) <= tolerance)
    return near.groupBy(*by).agg(F.count(F.lit(1)).alias("views"), (F.sum(F.col(weight) * F.col(depth)) / F.sum(weight)).alias("depth")).where(F.col("views") >= least)


def visible(df: DataFrame, view: list[str], u: str, v: str, depth: str, cell: float, ratio: float = 1.03) -> DataFrame:
    """Points that are not behind the nearest point of their view's cell. The nearest is an aggregate, joined back by cell."""
    celled = df.where(F.col(depth) > 0).withColumns({"__cu": F.floor(F.col(u) / cell), "__cv": F.floor(F.col(v) / cell)})
    front = celled.groupBy(*view, "__cu", "__cv").agg(F.min(depth).alias("__near"))
    return celled.join(front, [*view, "__cu", "__cv"]).where(F.col(depth) <= F.col("__near") * ratio).drop("__cu", "__cv", "__near")


def quantile_bins(df: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """df with `bin`: where its value falls among the group's distinct quantile edges, clipped at both ends."""
    edges = df.groupBy(*by).agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("__e"))
    at = F.size(F.filter("__e", lambda e: e <= F.col(value))) - 1
    return df.join(edges, by).withColumn("bin", F.greatest(F.lit(0), F.least(F.size("__e") - 2, at))).drop("__e")


def fill_bands(df: DataFrame, by: list[str], band: str, value: str, bands: int, default: float) -> DataFrame:
    """The mean per band; an empty band has that of the nearest one (the lower of two), a group without any the default."""
    means = df.where(F.col(value).isNotNull()).groupBy(*by, band).agg(F.avg(value).alias("__v"))
    grid = df.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias(band))
    w = Window.partitionBy(*by).orderBy(band)
    known = F.when(F.col("__v").isNotNull(), F.struct(F.col(band).alias("b"), F.col("__v").alias("v")))
    filled = grid.join(means, [*by, band], "left").withColumns({"__a": F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__z": F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    lower = F.col("__z").isNull() | (F.col("__a").isNotNull() & (F.col(band) - F.col("__a.b") <= F.col("__z.b") - F.col(band)))
    return filled.select(*by, band, F.coalesce(F.when(lower, F.col("__a.v")).otherwise(F.col("__z.v")), F.lit(default)).alias(value))


def heaviest_bin(df: DataFrame, by: list[str], height: str, area: str, size: float, share: float) -> DataFrame:
    """The height bin that most area lies in, where it has enough of all; the lower of equal ones."""
    bins = df.groupBy(*by, F.floor(F.col(height) / size).cast("long").alias("bin")).agg(F.sum(area).alias("__a"))
    top = bins.groupBy(*by).agg(F.max_by(F.struct("bin", "__a"), F.struct("__a", -F.col("bin"))).alias("__t"), F.sum("__a").alias("__all"))
    return top.where(F.col("__t.__a") >= F.col("__all") * share).select(*by, F.col("__t.bin").alias("bin"), (F.col("__t.__a") / F.col("__all")).alias("share"))


def smooth_path(df: DataFrame, by: list[str], order: list[str], columns: list[str], half: int) -> DataFrame:
    """A box filter with the end values repeated beyond the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    near, whole = w.rowsBetween(-half, half), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*by))
    before, after = F.greatest(F.lit(0), F.lit(half + 1) - i), F.greatest(F.lit(0), i + half - n)
    return df.withColumns({c: (F.sum(c).over(near) + before * F.first(c).over(whole) + after * F.last(c).over(whole)) / (2 * half + 1) for c in columns})


def catmull_rom(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    """The spline through p1 and p2 at t from 0 to 1."""
    return 0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t * t + (3 * p1 - p0 - 3 * p2 + p3) * t * t * t)


def triangulate(o1: tuple, d1: tuple, o2: tuple, d2: tuple) -> tuple[Column, Column, Column, Column, Column]:
    """Midpoint of two rays' nearest points, the distance between these, and the angle in degrees; null for parallel rays."""
    dot = lambda a, b: sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])
    w = tuple(a - b for a, b in zip(o1, o2))
    a, b, c, d, e = dot(d1, d1), dot(d1, d2), dot(d2, d2), dot(d1, w), dot(d2, w)
    det = a * c - b * b
    s, t = F.when(det > 1e-12, (b * e - c * d) / det), F.when(det > 1e-12, (a * e - b * d) / det)
    p, q = (tuple(o[i] + k * r[i] for i in range(3)) for o, r, k in ((o1, d1, s), (o2, d2, t)))
    gap = F.sqrt(sum(((x - y) ** 2 for x, y in zip(p[1:], q[1:])), (p[0] - q[0]) ** 2))
    return (*((x + y) / 2 for x, y in zip(p, q)), gap, F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), b / F.sqrt(a * c))))))


def greedy_keyframes(df: DataFrame, by: list[str], index: str, overlap: str, sharpness: str, low: float, high: float) -> DataFrame:
    """Keyframes per pass: from each, the sharpest (of equal ones the latest) of the frames whose overlap with it is still
    between low and high; if none is, the last before it falls below. overlap: array, entry d for the frame d ahead.

    A choice depends on the one before, so a pass is walked in order; passes are bounded by a flight and run in parallel.
    """
    kinds = dict(df.dtypes)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index, ignore_index=True)
        sharp, ahead = pdf[sharpness].to_numpy(float), pdf[overlap].to_list()
        chosen, at = [0], 0
        while at < len(pdf) - 1:
            row = np.asarray(ahead[at][: len(pdf) - 1 - at], float)
            below = np.flatnonzero(row < low)
            reach = int(below[0]) if len(below) else len(row)
            band = np.flatnonzero(row[:reach] <= high)
            if len(band):
                best = sharp[at + 1 + band].max()
                step = int(band[np.flatnonzero(sharp[at + 1 + band] == best)[-1]]) + 1
            else:
                step = max(1, reach)
            at = min(at + step, len(pdf) - 1)
            chosen.append(at)
        return pdf.loc[chosen, [*by, index]]

    return df.groupBy(*by).applyInPandas(walk, ", ".join(f"{c} {kinds[c]}" for c in [*by, index]))


def snap_distinct(probe: DataFrame, by: list[str], t: str, grid: str) -> DataFrame:
    """Each time to the nearest entry of the group's array `grid` among the four closest that no earlier time has taken."""
    kinds = dict(probe.dtypes)

    def snap(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t, ignore_index=True)
        g, used, out = np.sort(np.asarray(pdf[grid][0], float)), set(), []
        for x in pdf[t]:
            close = sorted(range(len(g)), key=lambda i: (abs(g[i] - x), i))[:4]
            free = [i for i in close if i not in used] or close
            used.add(free[0])
            out.append(g[free[0]])
        return pdf.assign(snapped=out)[[*by, t, "snapped"]]

    return probe.groupBy(*by).applyInPandas(snap, ", ".join([*[f"{c} {kinds[c]}" for c in by], f"{t} {kinds[t]}", "snapped double"]))


def laplacian_variance(frames: DataFrame, image: str = "luma", width: str = "width") -> DataFrame:
    """frames with `sharpness`: the unbiased variance of the four-neighbour Laplacian over inner pixels (luma: bytes, row by row)."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            values = []
            for raw, w in zip(pdf[image], pdf[width]):
                a = np.frombuffer(raw, np.uint8).reshape(-1, int(w)).astype(float)
                lap = a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1]
                values.append(lap.var(ddof=1) if lap.size > 1 else 0.0)
            yield pdf.assign(sharpness=values)

    return frames.mapInPandas(batches, ", ".join([*[f"`{c}` {k}" for c, k in frames.dtypes if c != "sharpness"], "sharpness double"]))


def letterbox(frames: DataFrame, by: list[str], image: str = "luma", width: str = "width", dark: int = 20, keep: float = 0.5) -> DataFrame:
    """Per group the crop (top, bottom, left, right) that leaves rows and columns which are bright in any frame; the whole frame if
    that would leave less than `keep` of a side. Row and column maxima are found per frame and merged by Spark."""

    def extremes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for row in pdf.itertuples(index=False):
                a = np.frombuffer(getattr(row, image), np.uint8).reshape(-1, int(getattr(row, width)))
                r, c = np.flatnonzero(a.max(1) > dark), np.flatnonzero(a.max(0) > dark)
                ends = [int(x) for x in (r[0], r[-1] + 1, c[0], c[-1] + 1)] if len(r) else [a.shape[0], 0, a.shape[1], 0]
                out.append([*[getattr(row, b) for b in by], *ends, *a.shape])
            yield pd.DataFrame(out, columns=[*by, "top", "bottom", "left", "right", "h", "w"])

    kinds = dict(frames.dtypes)
    ends = frames.select(*by, image, width).mapInPandas(extremes, ", ".join([*[f"{c} {kinds[c]}" for c in by], *[f"{c} int" for c in ("top", "bottom", "left", "right", "h", "w")]]))
    box = ends.groupBy(*by).agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("left").alias("left"), F.max("right").alias("right"), F.max("h").alias("h"), F.max("w").alias("w"))
    rows_ok, cols_ok = (F.col("bottom") - F.col("top")) >= F.col("h") * keep, (F.col("right") - F.col("left")) >= F.col("w") * keep
    return box.select(*by, F.when(rows_ok, F.col("top")).otherwise(0).alias("top"), F.when(rows_ok, F.col("bottom")).otherwise(F.col("h")).alias("bottom"), F.when(cols_ok, F.col("left")).otherwise(0).alias("left"), F.when(cols_ok, F.col("right")).otherwise(F.col("w")).alias("right"))
