"""Flight-log series: as-of interpolation, segmentation, rolling and weighted medians, path length, summaries.

All work per partition column (a flight, a run, a video) and shuffle once on it; windows that share keys share the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkgrid.functions.geodesy import enu_between


def interpolate(probe: DataFrame, track: DataFrame, by: list[str], t: str, fields: list[str], angles: tuple[str, ...] = ()) -> DataFrame:
    """probe with the fields of track at its times: a two-sided as-of join with linear interpolation.

    Before the first and after the last fix the end value holds. Each field is interpolated on its own between the fixes around
    it that exist; where one side is null the other counts; fixes of equal time give the earlier one's value. Fields in
    `angles` take the shorter way round 360. One union and one window instead of a range join: each side is read once.
    """
    tagged = probe.withColumns({"__side": F.lit(1)} | {f: F.lit(None).cast("double") for f in fields if f not in probe.columns})
    fixes = track.select(*by, t, *[F.col(f).cast("double").alias(f) for f in fields]).withColumn("__side", F.lit(0))
    both = fixes.unionByName(tagged, allowMissingColumns=True)
    back = Window.partitionBy(*by).orderBy(F.col(t), F.col("__side")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.col(t), F.col("__side").desc()).rowsBetween(0, Window.unboundedFollowing)
    fix = lambda f: F.when((F.col("__side") == 0), F.struct(F.col(t).cast("double").alias("t"), F.col(f).alias("v")))
    # rows around that are fixes at all, their values null or not
    around = both.withColumns({f"__a_{f}": F.last(fix(f), ignorenulls=True).over(back) for f in fields} | {f"__b_{f}": F.first(fix(f), ignorenulls=True).over(ahead) for f in fields})

    def value(f: str) -> Column:
        a, b, now = F.col(f"__a_{f}"), F.col(f"__b_{f}"), F.col(t).cast("double")
        span = b["t"] - a["t"]
        step = b["v"] - a["v"]
        if f in angles:
            step = F.pmod(step + 180.0, F.lit(360.0)) - 180.0
        mixed = a["v"] + F.when(span > 0, (now - a["t"]) / span).otherwise(0.0) * step
        mixed = F.pmod(mixed, F.lit(360.0)) if f in angles else mixed
        return F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).when(a["v"].isNull(), b["v"]).when(b["v"].isNull(), a["v"]).otherwise(mixed)

    return around.where("__side = 1").select(*[F.col(c) for c in probe.columns if c not in fields], *[value(f).alias(f) for f in fields])


def asof_left(probe: DataFrame, track: DataFrame, by: list[str], t: str, order: list[str], fields: dict[str, str]) -> DataFrame:
    """probe with the fields of the last track row at or before its time (ties: the last by `order`); null where there is none."""
    struct = F.struct(*[F.col(c).alias(n) for n, c in fields.items()])
    left = probe.withColumns({"__side": F.lit(1), "__row": F.lit(None).cast(track.select(struct.alias("s")).schema["s"].dataType)})
    right = track.select(*by, t, *[c for c in order if c not in by and c != t], F.lit(0).alias("__side"), struct.alias("__row"))
    w = Window.partitionBy(*by).orderBy(t, "__side", *order).rowsBetween(Window.unboundedPreceding, 0)
    both = right.unionByName(left, allowMissingColumns=True).withColumn("__row", F.last("__row", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*probe.columns, *[F.col("__row")[n].alias(n) for n in fields])


def islands(df: DataFrame, by: list[str], order: list[str], keep: Column, cut_after: Column | None = None) -> DataFrame:
    """Rows where keep holds, with `island`: runs of them, broken by rows where it doesn't and after rows where cut_after does."""
    w = Window.partitionBy(*by).orderBy(*order)
    cut = F.coalesce(F.lag(cut_after).over(w), F.lit(False)) if cut_after is not None else F.lit(False)
    flagged = df.withColumn("__break", ((~keep) | cut).cast("int"))
    return flagged.withColumn("island", F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(keep).drop("__break")


def passes(df: DataFrame, by: list[str], order: list[str], keep: Column, cut_after: Column | None, least: int) -> DataFrame:
    """One row per island of at least `least` rows: island, first and last of the first order column, n."""
    runs = islands(df, by, order, keep, cut_after)
    return runs.groupBy(*by, "island").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def trim_edges(df: DataFrame, by: list[str], order: list[str], value: str, ratio: float) -> DataFrame:
    """Each group from its first to its last row whose value is at least ratio times the group's median."""
    group = Window.partitionBy(*by)
    w = group.orderBy(*order)
    ok = F.col(value) >= F.col("__median") * ratio
    marked = df.withColumn("__median", F.median(value).over(group)).withColumn("__n", F.row_number().over(w))
    marked = marked.withColumns({"__first": F.min(F.when(ok, F.col("__n"))).over(group), "__last": F.max(F.when(ok, F.col("__n"))).over(group)})
    return marked.where(F.col("__n").between(F.col("__first"), F.col("__last"))).drop("__median", "__n", "__first", "__last")


def rolling_median_ratio(df: DataFrame, by: list[str], order: list[str], value: str, half: int) -> DataFrame:
    """df with `ratio`: value over the median of the rows at most `half` away; 1 where that isn't positive."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-half, half)
    m = F.percentile(value, F.lit(0.5)).over(w)
    return df.withColumn("ratio", F.when(m <= 0, 1.0).otherwise(F.col(value) / m))


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The first value at which the weights, summed in order of value, reach half of all.

    Equal values are summed before the window, so it runs over distinct values only.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*by).orderBy(value)
    upto, total = F.sum("__w").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum("__w").over(Window.partitionBy(*by))
    return sums.withColumns({"__u": upto, "__t": total}).where(F.col("__u") >= F.col("__t") / 2).groupBy(*by).agg(F.min(value).alias("weighted_median"))


def low_percentile(df: DataFrame, by: list[str], value: str, percent: float) -> DataFrame:
    """The element at floor((n - 1) * percent / 100) of each group's rising values (not percentile_disc)."""
    w = Window.partitionBy(*by)
    at = F.floor((F.count(F.lit(1)).over(w) - 1) * percent / 100) + 1
    ranked = df.withColumns({"__n": F.row_number().over(w.orderBy(value)), "__at": at})
    return ranked.where("__n = __at").select(*by, F.col(value).alias("low"))


def path_length(df: DataFrame, by: list[str], order: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Metres along the fixes in order, in the tangent plane of each group's first fix, at height 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    zero = F.lit(0.0)
    fixes = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    located = fixes.withColumns({"__lat0": F.first(lat).over(w), "__lon0": F.first(lon).over(w)})
    e, n, u = enu_between(F.col(lat), F.col(lon), zero, F.col("__lat0"), F.col("__lon0"), zero)
    local = located.withColumns({"__e": e, "__n": n, "__u": u})
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in ("__n", "__u")), (F.col("__e") - F.lag("__e").over(w)) ** 2))
    return local.withColumn("__step", step).groupBy(*by).agg(F.coalesce(F.sum("__step"), F.lit(0.0)).alias("path_m"))


def summary(df: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """Per flight: n, duration, bounding box, path length, sampling rate, altitude and speed ranges; null where there is nothing to tell."""
    duration = F.max(t) - F.min(t)
    main = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(duration, 3).alias("duration_s"),
        *[F.round(f(c), 8).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))],
        F.round(F.when(duration > 0, (F.count(F.lit(1)) - 1) / duration), 3).alias("rate_hz"),
        *[F.round(f("alt_m"), 2).alias(f"alt_{n}") for n, f in (("min", F.min), ("max", F.max))],
        F.round(F.avg("speed_ms"), 3).alias("speed_mean"),
        F.round(F.max("speed_ms"), 3).alias("speed_max"),
    )
    length = path_length(df, by, [t]).withColumn("path_m", F.round("path_m", 2))
    return main.join(length, by, "left")


def adaptive_stride(pairs: DataFrame, by: list[str], pair: str, flow: str, stride: int, target: float, most: int) -> DataFrame:
    """The stride at which the typical motion (median over pairs of the pair's median) reaches the target."""
    typical = pairs.groupBy(*by, pair).agg(F.median(flow).alias("__m")).groupBy(*by).agg(F.median("__m").alias("motion"))
    return typical.withColumn("stride", F.least(F.lit(most), F.lit(stride) * F.greatest(F.lit(1), F.floor(F.lit(target) / F.col("motion")))).cast("int"))
