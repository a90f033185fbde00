"""Tracks, model links, run and stage tables: joins and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def track_matches(obs: DataFrame, track: str, order: list[str], image: str, most_gap: int = 4, least: int = 30) -> DataFrame:
    """Image pairs that share enough tracks: observations of one track at most most_gap apart in order. One window, no self-join."""
    w = Window.partitionBy(track).orderBy(*order)
    ahead = obs.select(F.col(image).alias("a"), F.array(*[F.lead(image, g).over(w) for g in range(1, most_gap + 1)]).alias("next")).select("a", F.explode("next").alias("b"))
    return ahead.where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def track_lengths(obs: DataFrame, track: str, least: int = 2) -> DataFrame:
    """Number of tracks of at least `least` observations and their mean length."""
    n = obs.groupBy(track).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return n.agg(F.count(F.lit(1)).alias("tracks"), F.round(F.avg("n"), 4).alias("mean_length"))


def weighted_coverage(models: DataFrame, dense: DataFrame, on: str, weight: str, value: str) -> DataFrame:
    """Sum of weight times value over sum of weights; models without a value count 0; null without weights."""
    joined = models.join(dense.select(on, value), on, "left")
    total = F.sum(weight)
    return joined.agg(F.round(F.sum(F.col(weight) * F.coalesce(F.col(value), F.lit(0.0))) / F.nullif(total, F.lit(0)), 4).alias("coverage"))


def stage_rollup(stages: DataFrame, by: list[str], stage: str, seconds: str, extra: list[str], splat: str, video_s: Column, factor: float = 1.5) -> DataFrame:
    """Total, deliverable (without the `extra` stages) and splat seconds per run, the budget and whether it is met; null without a video length."""
    deliverable = F.sum(F.when(~F.col(stage).isin(extra), F.col(seconds)).otherwise(0.0))
    out = stages.groupBy(*by).agg(F.round(F.sum(seconds), 3).alias("total_s"), F.round(deliverable, 3).alias("deliverable_s"), F.round(F.sum(F.when(F.col(stage) == splat, F.col(seconds)).otherwise(0.0)), 3).alias("splat_s"), F.round(F.max(video_s) * factor, 3).alias("budget_s"))
    return out.withColumn("within_budget", F.col("deliverable_s") <= F.col("budget_s"))


def overlay(new: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Stored rows with the new ones laid over them, field by field where the new one has a value."""
    n, s = new.select(key, *[F.col(f).alias(f"__n_{f}") for f in fields]), stored.select(key, *fields)
    return s.join(n, key, "full_outer").select(key, *[F.coalesce(f"__n_{f}", f).alias(f) for f in fields])


def manifest(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """This run's stages first, then stored ones that it doesn't have."""
    first = new.withColumn("origin", F.lit(0))
    return first.unionByName(stored.join(new, key, "left_anti").withColumn("origin", F.lit(1)))


def model_table(sfm: DataFrame, dense: DataFrame, splat: DataFrame, on: str, images: str, main_share: float = 0.15) -> DataFrame:
    """One row per model with optional dense and splat columns, share and role, the largest first."""
    joined = sfm.join(dense, on, "left").join(splat, on, "left")
    shared = joined.crossJoin(sfm.agg(F.sum(images).alias("__all"), F.max(F.struct(images, on)).alias("__top")))
    main = (F.col(on) == F.col("__top")[on]) | (F.col(images) / F.col("__all") >= main_share)
    return shared.withColumns({"share": F.col(images) / F.col("__all"), "role": F.when(main, "main").otherwise("fragment")}).drop("__all", "__top").orderBy(F.col(images).desc(), on)


def offset_pairs(frames: DataFrame, shot: str, index: str, gaps: list[int]) -> DataFrame:
    """Pairs (i, i + d) of one shot for each d."""
    later = frames.select(shot, (F.col(index)).alias("j"), F.explode(F.array(*[F.lit(g) for g in gaps])).alias("gap")).withColumn("i", F.col("j") - F.col("gap"))
    return frames.select(shot, F.col(index).alias("i")).join(later, [shot, "i"]).select(shot, "i", "j", "gap")


def face_adjacency(faces: DataFrame, face: str, vertex: str, shared: int = 1) -> DataFrame:
    """Pairs of faces that share at least `shared` vertices, each once, and how many they share.

    For two or more, faces meet by the pairs of their vertices, which few have in common, and not by single vertices, of which one
    may belong to very many faces; k shared vertices are k (k - 1) / 2 shared pairs.
    """
    if shared > 1:
        corners = faces.groupBy(face).agg(F.collect_set(vertex).alias("vs")).select(face, F.explode("vs").alias("v"), "vs").select(face, "v", F.explode("vs").alias("w")).where("v < w")
        a, b = corners.withColumnRenamed(face, "a"), corners.withColumnRenamed(face, "b")
        pairs = a.join(b, ["v", "w"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("p"))
        return pairs.select("a", "b", F.round((1 + F.sqrt(1 + 8 * F.col("p"))) / 2).cast("long").alias("n")).where(F.col("n") >= shared)
    a, b = faces.select(vertex, F.col(face).alias("a")).distinct(), faces.select(vertex, F.col(face).alias("b")).distinct()
    pairs = a.join(b, vertex).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shared)


def rewrite_ids(rows: DataFrame, mapping: DataFrame, column: str, old: str = "old", new: str = "new") -> DataFrame:
    """Rows whose foreign key is replaced by its new value; rows without one go."""
    m = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return rows.join(m, F.col(column) == F.col("__old")).withColumn(column, F.col("__new")).drop("__old", "__new")


def run_group(kind: Column, name: Column) -> Column:
    """Label of a run by its kind and name."""
    return F.when(kind == "live", "live").when(name.rlike("^(bench|all[_-]|system)"), "benchmark").when(name.rlike("(?i)(test|dev|debug|try|tmp)"), "development").otherwise("builds")


def pass_verdict(share_3d: Column, median_px: Column, p90_px: Column, frames: Column, least: int = 3) -> Column:
    return F.when(frames < least, "too-short").when((share_3d >= 0.5) & (median_px >= 1.0), "3d").when((share_3d >= 0.2) | (p90_px >= 2.0), "weak-3d").otherwise("degenerate")


def weld(vertices: DataFrame, digits: int = 6) -> DataFrame:
    """vertices (vid, x, y, z) with `weld`, the least vid of those that round to the same place."""
    r = [F.round(a, digits) + F.lit(0.0) for a in ("x", "y", "z")]
    least = vertices.groupBy(*[c.alias(f"__{i}") for i, c in enumerate(r)]).agg(F.min("vid").alias("weld"))
    keyed = vertices.withColumns({f"__{i}": c for i, c in enumerate(r)})
    return keyed.join(least, ["__0", "__1", "__2"]).drop("__0", "__1", "__2")


def used_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices that a face (v0, v1, v2) refers to."""
    used = faces.select(F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return vertices.join(used, "vid", "left_semi")
