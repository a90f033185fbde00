"""Point clouds: bounds, voxels, rasters, nearest neighbours, distance bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkgrid.operators import kdtree
from larkgrid.operators.ranks import percentiles

XYZ = ("x", "y", "z")


def bounds(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """n, min, max and extent per axis, largest extent and centroid; without points an error, unless grouped."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for a in XYZ:
        aggs += [F.min(a).alias(f"{a}_min"), F.max(a).alias(f"{a}_max"), F.avg(a).alias(f"{a}_mean")]
    out = df.groupBy(*by).agg(*aggs)
    out = out.withColumns({f"{a}_extent": F.col(f"{a}_max") - F.col(f"{a}_min") for a in XYZ})
    if not by:
        out = out.withColumn("n", F.when(F.col("n") == 0, F.raise_error(F.lit("no points")).cast("long")).otherwise(F.col("n")))
    return out.withColumn("max_extent", F.greatest(*[f"{a}_extent" for a in XYZ]))


def cells(size: float, axes: tuple[str, ...] = XYZ) -> dict[str, Column]:
    return {f"c{a}": F.floor(F.col(a) / size).cast("long") for a in axes}


def voxel_coverage(df: DataFrame, size: float, by: list[str] = ()) -> DataFrame:
    """Occupied voxels, their volume, and points per cubic metre. Distinct cells are found before they are counted, so a hot group is spread."""
    per_cell = df.withColumns(cells(size)).groupBy(*by, "cx", "cy", "cz").agg(F.count(F.lit(1)).alias("k"))
    out = per_cell.groupBy(*by).agg(F.count(F.lit(1)).alias("voxels"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    volume = F.col("voxels") * (size**3)
    return out.withColumns({"volume_m3": F.round(volume, 4), "points_per_m3": F.round(F.col("n") / volume, 3)})


def raster(df: DataFrame, size: float, x0: float, y1: float, keep: list[str], ordinal: str, highest: bool = True) -> DataFrame:
    """The highest (or lowest) point of each top-down cell; row 0 is at y1. Of equal heights the last by ordinal (or the first)."""
    cell = {"row": F.floor((F.lit(y1) - F.col("y")) / size).cast("long"), "col": F.floor((F.col("x") - F.lit(x0)) / size).cast("long")}
    pick = F.max_by if highest else F.min_by
    return df.withColumns(cell).groupBy("row", "col").agg(pick(F.struct("z", *keep), F.struct("z", ordinal)).alias("__b")).select("row", "col", F.col("__b.z").alias("z"), *[F.col("__b")[c].alias(c) for c in keep])


def voxel_vote(df: DataFrame, solid: str, n_solids: int, size: float) -> DataFrame:
    """Cells that a majority of the solids occupy, and how many do."""
    votes = df.withColumns(cells(size)).select(solid, "cx", "cy", "cz").distinct().groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("votes"))
    return votes.where(F.col("votes") >= n_solids // 2 + 1)


def voxel_iou(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Intersection over union of the occupied cells of two clouds, in one aggregate."""
    one = a.withColumns(cells(size)).select("cx", "cy", "cz", F.lit(1).alias("s"))
    two = b.withColumns(cells(size)).select("cx", "cy", "cz", F.lit(2).alias("s"))
    sides = one.unionByName(two).groupBy("cx", "cy", "cz").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    both = F.count_if(F.col("lo") != F.col("hi"))
    return sides.agg(both.alias("n_both"), F.count(F.lit(1)).alias("n_any"), F.round(both / F.count(F.lit(1)), 6).alias("iou"))


def within(probe: DataFrame, ref: DataFrame, radius: float, key: str, ref_key: str, keep: list[str] = (), k: int = 1, checkpoint=None) -> DataFrame:
    """The k nearest reference points no farther than radius: (key, ref_key, distance, keep, rank)."""
    return kdtree.nearest(probe, ref, key, ref_key, list(keep), k, radius, checkpoint)


def nearest(probe: DataFrame, ref: DataFrame, key: str, ref_key: str, keep: list[str] = (), k: int = 1, checkpoint=None) -> DataFrame:
    """The k nearest reference points of every probe point, exactly: (key, ref_key, distance, keep, rank).

    Two rounds over a k-d tree of the reference. Its steps are kept by `checkpoint` (DataFrame, name -> DataFrame), a written
    table on a cluster, or else persisted. Fewer than k reference points give as many as there are.
    """
    return kdtree.nearest(probe, ref, key, ref_key, list(keep), k, float("inf"), checkpoint)


def completeness(distances: DataFrame, threshold: float) -> DataFrame:
    """Share of distances within the threshold, and their mean."""
    return distances.agg(F.round(F.avg((F.col("distance") <= threshold).cast("double")), 6).alias("ratio"), F.round(F.avg("distance"), 6).alias("mean_distance"))


def chamfer(ab: DataFrame, ba: DataFrame) -> DataFrame:
    """Symmetric mean and root mean square of two sets of nearest distances."""
    stats = lambda d, n: d.agg(F.avg("distance").alias(f"{n}_mean"), F.avg(F.col("distance") ** 2).alias(f"{n}_ms"))
    both = stats(ab, "forward").crossJoin(stats(ba, "backward"))  # one row each
    return both.select(*[F.round(c, 6).alias(n) for n, c in (("forward_mean", F.col("forward_mean")), ("backward_mean", F.col("backward_mean")), ("chamfer", (F.col("forward_mean") + F.col("backward_mean")) / 2), ("rms", F.sqrt((F.col("forward_ms") + F.col("backward_ms")) / 2)))])


def distance_bands(df: DataFrame, distance: str, edges: list[float]) -> DataFrame:
    """Share, median and 90th percentile of the values per half-open band of distance; bands without points are left out."""
    band = F.lit(len(edges) - 1)
    for i in range(len(edges) - 1, 0, -1):
        band = F.when(F.col(distance) < edges[i], i - 1).otherwise(band)
    inside = df.where(F.col(distance) >= edges[0]).select(band.cast("int").alias("band"), F.col(distance).alias("__d"))
    ranks = percentiles(inside, ["band"], "__d", {"median": 0.5, "p90": 0.9}).select("band", F.round("median", 2).alias("median"), F.round("p90", 2).alias("p90"))
    per = inside.groupBy("band").agg(F.count(F.lit(1)).alias("n")).join(ranks, "band")
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(total).withColumn("share", F.round(F.col("n") / F.col("total"), 3)).drop("total")  # one row per band and one in all
