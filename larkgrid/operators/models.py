"""Reconstructed models and runs: listings, roll-ups, link graphs, georeferencing, calibrated depth."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkgrid.functions.rotations import Similarity
from larkgrid.operators.clouds import cells
from larkgrid.operators.fits import DST, SRC, track_shape, umeyama, umeyama_from_moments


def key_frame_times(packets: DataFrame, pts: str = "pts", flags: str = "flags") -> DataFrame:
    """Times of the packets whose flags name a key frame and whose time parses, in order."""
    t = F.col(pts).try_cast("double")
    return packets.where(F.col(flags).contains("K") & t.isNotNull()).select(t.alias("t")).orderBy("t")


def run_listing(files: DataFrame, kind: Column, suffixes: list[str]) -> DataFrame:
    """Runs of a file listing (path, size, mtime), newest first: run (the folder), kind, number and bytes of files with the
    suffixes, newest change. Give a binaryFile scan without its content column."""
    run = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    wanted = files.withColumns({"run": run, "suffix": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))}).where(F.col("suffix").isin(suffixes))
    listed = wanted.withColumn("kind", kind).groupBy("run", "kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("mtime").alias("mtime"))
    return listed.orderBy(F.col("mtime").desc(), "run")


def scene_index(models: DataFrame, run: str, columns: list[str], order: list[Column]) -> DataFrame:
    """One JSON text a run: its models as a list in the given order, absent values left out."""
    entries = models.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("entry")))).alias("m"))
    return entries.select(run, F.to_json(F.struct(F.transform("m", lambda x: x["entry"]).alias("models"))).alias("json"))


def live_state(events: DataFrame, session: str, order: list[str], state: str, done: list[str]) -> DataFrame:
    """One row a session: the last state, how many jobs and how many of them are done."""
    return events.groupBy(session).agg(F.max_by(state, F.struct(*order)).alias(state), F.count(F.lit(1)).alias("jobs"), F.count_if(F.col(state).isin(done)).alias("done"))


def write_live_state(stream: DataFrame, path: str, checkpoint: str, session: str, order: list[str], state: str, done: list[str]):
    """Each batch of job events is added to a log, and the state table of all of them written anew. A batch that runs again
    replaces its own part of the log, so the table is right after a restart."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/log/batch={number}")
        whole = batch.sparkSession.read.parquet(f"{path}/log")
        live_state(whole, session, order, state, done).write.mode("overwrite").parquet(f"{path}/state")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def needed_models(stages: Column, models_of: dict[str, list[str]]) -> Column:
    """The distinct models that stages need, in the order of the stages."""
    table = F.create_map(*[x for s, ms in models_of.items() for x in (F.lit(s), F.array(*[F.lit(m) for m in ms]))])
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(stages, lambda s: F.coalesce(F.try_element_at(table, s), none))))


def missing_columns(found: list[str], wanted: list[str]) -> Column:
    """The wanted names that are not among the found ones."""
    return F.array_except(F.array(*[F.lit(w) for w in wanted]).cast("array<string>"), F.array(*[F.lit(c) for c in found]).cast("array<string>"))


def flow_agrees(fx: Column, fy: Column, bx: Column, by: Column, u: Column, v: Column, width: Column, height: Column) -> Column:
    """Whether a point's flow there and back cancel, up to a share of their lengths, and it stays inside the frame."""
    miss = (fx + bx) ** 2 + (fy + by) ** 2
    size = fx**2 + fy**2 + bx**2 + by**2
    return (miss < 0.01 * size + 0.5) & (u + fx).between(0, width - 1) & (v + fy).between(0, height - 1)


def scale_error(measured: Column, expected: Column) -> tuple[Column, Column]:
    """Absolute and relative error of a distance; an expected distance that isn't positive is an error."""
    bad = F.raise_error(F.lit("the expected distance must be positive")).cast("double")
    e = F.when(expected > 0, expected).otherwise(bad)
    return measured - e, (measured - e) / e


def usage_summary(samples: DataFrame, by: list[str], used: str, total: str, own: str) -> DataFrame:
    """Rounded mean and peak of a device's use, and whether others used it too."""
    return samples.groupBy(*by).agg(F.round(F.avg(used), 3).alias("mean"), F.round(F.max(used), 3).alias("peak"), F.round(F.max(F.col(used) / F.col(total)), 4).alias("peak_share"), (F.max(F.col(used) - F.col(own)) > 0).alias("shared"), F.count(F.lit(1)).alias("samples"))


def with_enough(df: DataFrame, by: list[str], least: int) -> DataFrame:
    """The rows of groups of at least `least` rows: a count joined back, so a hot group isn't gathered in one task."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")
    return df.join(counts, by, "left_semi")


def depth_quality(df: DataFrame, by: list[str], aligned: Column, error: Column, good: Column) -> DataFrame:
    """Rows, aligned rows, median and mean error of these and their share of good ones, null where none is aligned. The mean of the
    error, given in whole units, is exact."""
    e = F.when(aligned, error)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(aligned).alias("aligned"), F.median(e).alias("median_error"), (F.sum(e) / F.count(e)).alias("mean_error"), F.avg(F.when(aligned, good.cast("double"))).alias("share_good"))


def pass_counts(images: DataFrame, model: str, name: str) -> DataFrame:
    """Posed images per model and pass folder, the first part of the image's name."""
    return images.groupBy(model, F.split(name, "/")[0].alias("pass")).agg(F.count(F.lit(1)).alias("images"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null without weights."""
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0))


def display_name(name: Column, labels: dict[str, str], longest: int = 26) -> Column:
    """The label of the first keyword that the name holds, else its part before a separator, shortened."""
    low = F.lower(name)
    label = F.lit(None).cast("string")
    for word in reversed(list(labels)):
        label = F.when(low.contains(word), labels[word]).otherwise(label)
    return F.coalesce(label, F.substring(F.trim(F.split(name, r"[ _-]+")[0]), 1, longest))


def stem_join(left: DataFrame, left_path: str, right: DataFrame, right_path: str) -> DataFrame:
    """left with right's path of the same file stem, where there is one."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1)
    return left.withColumn("stem", stem(left_path)).join(right.select(stem(right_path).alias("stem"), right_path), "stem", "left")


def cloud_metrics(points: DataFrame, model: str, size: float, reference: DataFrame, frame: str) -> DataFrame:
    """Per model its points, occupied voxels and extents, and the share of its voxels that the reference occupies; a model in
    another frame than the reference has a reason in place of it. points: model, x, y, z, frame; reference: x, y, z, frame."""
    own = points.withColumns(cells(size)).groupBy(model, frame, "cx", "cy", "cz").agg(F.count(F.lit(1)).alias("k"), *[F.min(a).alias(f"{a}0") for a in "xyz"], *[F.max(a).alias(f"{a}1") for a in "xyz"])
    there = reference.withColumns(cells(size)).select(F.col(frame).alias("__frame"), "cx", "cy", "cz").distinct().withColumn("hit", F.lit(1))
    of = reference.agg(F.max(frame).alias("__of"))  # one row
    joined = own.join(there.withColumnRenamed("__frame", frame), [frame, "cx", "cy", "cz"], "left").crossJoin(of)
    per = joined.groupBy(model, frame, "__of").agg(F.sum("k").alias("points"), F.count(F.lit(1)).alias("voxels"), *[(F.max(f"{a}1") - F.min(f"{a}0")).alias(f"{a}_extent") for a in "xyz"], (F.count("hit") / F.count(F.lit(1))).alias("seen"))
    same = F.col(frame).eqNullSafe(F.col("__of"))
    return per.select(model, "points", "voxels", *[f"{a}_extent" for a in "xyz"], F.when(same, F.round("seen", 6)).alias("in_reference"), F.when(~same, F.concat(F.lit("frame "), F.coalesce(frame, F.lit("unknown")), F.lit(" is not the reference's"))).alias("reason"))


def collect_runs(stages: DataFrame, run: str, stage: str, seconds: str, memory: str, frames: str, limit: float) -> DataFrame:
    """One row a run: seconds by stage as a map, total, frames a second, and whether it is clean: no other process ever held more
    than `limit`."""
    per = stages.groupBy(run, stage).agg(F.sum(seconds).alias("s"), F.max(memory).alias("mem"), F.max(frames).alias("f"))
    by_stage = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(stage), F.round("s", 3).alias("s")))))
    return per.groupBy(run).agg(by_stage.alias("stages"), F.round(F.sum("s"), 3).alias("total_s"), F.round(F.max("f") / F.sum("s"), 4).alias("fps"), (F.max("mem") <= limit).alias("clean"))


def view_overlaps(samples: DataFrame, triangle: str, view: str, value: str) -> DataFrame:
    """For each two views of the same triangles: how many, and the mean value in either. A triangle has few views, so each task
    pairs them where they are gathered."""
    per = samples.groupBy(triangle).agg(F.array_sort(F.collect_list(F.struct(F.col(view).alias("v"), F.col(value).alias("x")))).alias("s"))
    pairs = per.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a.v < b.v")
    return pairs.groupBy(F.col("a.v").alias("i"), F.col("b.v").alias("j")).agg(F.count(F.lit(1)).alias("n"), F.avg("a.x").alias("mean_i"), F.avg("b.x").alias("mean_j"))


def view_gains(overlaps: pd.DataFrame, sigma_n: float = 10.0, sigma_g: float = 0.1) -> dict:
    """Gain per view that makes the means of overlaps agree, from the few rows of view_overlaps: each overlap asks that g_i mean_i
    equals g_j mean_j, each view that its gain stays near 1. Gains are kept within a factor of two."""
    names = sorted({*overlaps["i"], *overlaps["j"]})
    at = {v: k for k, v in enumerate(names)}
    a, b = np.zeros((len(names), len(names))), np.zeros(len(names))
    for r in overlaps.itertuples(index=False):
        i, j = at[r.i], at[r.j]
        a[i, i] += r.n * (r.mean_i**2 / sigma_n**2 + 1 / sigma_g**2)
        a[j, j] += r.n * (r.mean_j**2 / sigma_n**2 + 1 / sigma_g**2)
        a[i, j] -= r.n * r.mean_i * r.mean_j / sigma_n**2
        a[j, i] = a[i, j]
        b[[i, j]] += r.n / sigma_g**2
    return dict(zip(names, np.clip(np.linalg.solve(a, b), 0.5, 2.0).tolist())) if names else {}


def overlap_ahead(lives: DataFrame, by: list[str], frame: str, until: str, horizon: int) -> DataFrame:
    """(by, frame, gap, overlap) for gaps up to the horizon: the share of a frame's points that are still tracked so many frames on.
    lives: a row per point of a frame, and the last frame that it is tracked to."""
    ahead = lives.select(*by, frame, until, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("gap"))
    last = lives.groupBy(*by).agg(F.max(frame).alias("__last"))
    inside = ahead.join(last, by).where(F.col(frame) + F.col("gap") <= F.col("__last"))
    return inside.groupBy(*by, frame, "gap").agg(F.avg((F.col(until) >= F.col(frame) + F.col("gap")).cast("double")).alias("overlap"))


def pair_statistics(matches: DataFrame, by: list[str], ax: str, ay: str, bx: str, by_: str, least: int) -> DataFrame:
    """Per pair of frames: matches, median displacement and its spread, for pairs with enough matches."""
    d = F.sqrt((F.col(bx) - F.col(ax)) ** 2 + (F.col(by_) - F.col(ay)) ** 2)
    return matches.groupBy(*by).agg(F.count(F.lit(1)).alias("matches"), F.round(F.median(d), 4).alias("median_px"), F.round(F.percentile(d, F.lit(0.9)), 4).alias("p90_px")).where(F.col("matches") >= least)


def model_depth(observations: DataFrame, model: str, image: str, depth: str, most: int = 50, least: int = 5) -> DataFrame:
    """A model's viewing distance: the median over evenly spaced images of the median positive depth of their points, of images with
    enough points; null without any."""
    per = observations.groupBy(model, image).agg(F.count(F.lit(1)).alias("__k"), F.median(F.when(F.col(depth) > 0, F.col(depth))).alias("__z"))
    group = Window.partitionBy(model)
    placed = per.withColumns({"__i": F.row_number().over(group.orderBy(image)) - 1, "__n": F.count(F.lit(1)).over(group)})
    spaced = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / (most - 1)).cast("long"))
    chosen = (F.col("__n") <= most) | F.array_contains(F.array_distinct(spaced), F.col("__i").cast("long"))
    return placed.where(chosen).groupBy(model).agg(F.median(F.when(F.col("__k") >= least, F.col("__z"))).alias("distance"))


def confident_edges(edges: DataFrame, inliers: str, candidates: str, least: int = 300, share: float = 0.2) -> DataFrame:
    return edges.where((F.col(inliers) >= least) & (F.col(inliers) >= F.col(candidates) * share))


def link_groups(models: DataFrame, edges: DataFrame, most_ratio: float = 8.0) -> tuple[dict[str, tuple[str, Similarity]], list[tuple[str, str]]]:
    """(model -> its root and the similarity into the root's frame, edges that were refused).

    models: name, images, depth (or null); edges: a, b, inliers, s, r (nine numbers), t (three) taking b into a. By falling
    inliers an edge joins two trees, unless the weighted median depths of both, seen in one frame, differ by more than
    most_ratio. A tree's root is its largest model. A run has as many models as flights: these tables are small by nature.
    """
    rows = models.collect()
    images, depth = {m.name: m.images for m in rows}, {m.name: m.depth for m in rows}
    tree = {m.name: {m.name: Similarity(1.0, np.eye(3), np.zeros(3))} for m in rows}
    root = {m.name: m.name for m in rows}
    refused = []

    def distance(members: dict[str, Similarity], scale: float = 1.0) -> float:
        seen = sorted((scale * t.s * depth[m], images[m]) for m, t in members.items() if depth[m] is not None)
        half, so_far = sum(w for _, w in seen) / 2, 0.0
        for d, w in seen:
            so_far += w
            if so_far >= half:
                return d
        return float("nan")

    for e in sorted(edges.collect(), key=lambda e: (-e.inliers, e.a, e.b)):
        ra, rb = root[e.a], root[e.b]
        if ra == rb:
            continue
        link = Similarity(e.s, np.array(e.r).reshape(3, 3), np.array(e.t))
        # the other tree in this one's root frame
        into = tree[ra][e.a].compose(link).compose(tree[rb][e.b].inverse())
        near, far = distance(tree[ra]), distance(tree[rb], into.s)
        if max(near, far) > most_ratio * min(near, far):
            refused.append((e.a, e.b))
            continue
        moved = {m: into.compose(t) for m, t in tree[rb].items()}
        keep, gone = (ra, rb) if (-images[ra], ra) <= (-images[rb], rb) else (rb, ra)
        back = into.inverse()
        members = tree[ra] | moved if keep == ra else {m: back.compose(t) for m, t in (tree[ra] | moved).items()}
        tree[keep] = members
        del tree[gone]
        root |= dict.fromkeys(members, keep)
    return {m: (r, tree[r][m]) for m, r in root.items()}, refused


def similarities(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The least-squares similarity of each group of pairs sx..dz: sums by Spark, then one 3x3 decomposition a group."""
    means = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in SRC + DST], *[F.covar_pop(a, b).alias(f"{a}{b}") for a in DST for b in SRC], (F.var_pop("sx") + F.var_pop("sy") + F.var_pop("sz")).alias("var"))

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                cov = np.array([[r[f"{a}{b}"] for b in SRC] for a in DST])
                t = umeyama_from_moments(r["n"], np.array([r[f"m_{c}"] for c in SRC]), np.array([r[f"m_{c}"] for c in DST]), cov, r["var"])
                out.append([*[r[c] for c in by], r["n"], t.s, t.r.ravel().tolist(), t.t.tolist()])
            yield pd.DataFrame(out, columns=[*by, "n", "s", "r", "t"])

    kinds = dict(pairs.dtypes)
    return means.where("n >= 3").mapInPandas(solve, ", ".join([*[f"{c} {kinds[c]}" for c in by], "n long, s double, r array<double>, t array<double>"]))


def yaw_similarity(pairs: DataFrame) -> Similarity:
    """The similarity that turns about the vertical only."""
    from larkgrid.operators.fits import yaw_scale

    r = yaw_scale(pairs, [], SRC, DST).first()
    c, s = np.cos(r.yaw), np.sin(r.yaw)
    return Similarity(r.scale, np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]]), np.array([r.tx, r.ty, r.tz]))


def held_out(pairs: DataFrame, key: str, solver: Callable[[DataFrame], Similarity], most: int = 200, least: int = 4) -> dict[str, float] | None:
    """Errors of each held-out pair under the fit of all others, and the jackknife deviation of the scale and of the tilt, for any
    solver. At most `most` folds, by a hash of the key; a fold is a few sums over all pairs."""
    if pairs.count() < least:
        return None
    folds = pairs.orderBy(F.xxhash64(key), key).limit(most).collect()
    miss, scales, tilts = [], [], []
    for row in folds:
        fit = solver(pairs.where(F.col(key) != F.lit(row[key])))
        miss.append(fit(np.array([[row[c] for c in SRC]]))[0] - np.array([row[c] for c in DST]))
        scales.append(fit.s)
        tilts.append(tilt_degrees(fit))
    miss, n = np.array(miss), len(folds)
    spread = lambda v: float(np.sqrt((n - 1) / n * np.sum((np.array(v) - np.mean(v)) ** 2)))
    return {"n": n, "rmse_h": float(np.sqrt((miss[:, :2] ** 2).sum(1).mean())), "rmse_v": float(np.sqrt((miss[:, 2] ** 2).mean())), "scale_se": spread(scales) / float(np.mean(scales)), "tilt_se": spread(tilts)}


def tilt_degrees(t: Similarity) -> float:
    return float(np.degrees(np.arccos(np.clip(t.r[2, 2], -1, 1))))


def georeference(pairs: DataFrame, key: str, mode: str = "auto", least_linearity: float = 0.15, least_tilt: float = 5.0) -> tuple[str, Similarity]:
    """How a model lies on the ground: ("yaw" or "full", transform) from its camera centres and their surveyed places.

    A straight track doesn't fix the roll about itself, so the vertical is kept unless at least six pairs, spread in two
    directions, show a tilt that is significant: above least_tilt even less three of its jackknife deviations.
    """
    if mode != "auto":
        return mode, umeyama(pairs) if mode == "full" else yaw_similarity(pairs)
    spread = track_shape(pairs.select(*[F.col(c).alias(a) for c, a in zip(DST, "xyz")]))["linearity"]
    if pairs.count() >= 6 and spread >= least_linearity:
        full = umeyama(pairs)
        if tilt_degrees(full) > least_tilt and tilt_degrees(full) - 3 * held_out(pairs, key, umeyama, most=50)["tilt_se"] > least_tilt:
            return "full", full
    return "yaw", yaw_similarity(pairs)


def log_affine(df: DataFrame, by: list[str], pred: str, depth: str, rounds: int = 12, least: int = 8) -> DataFrame:
    """Per image the robust fit log depth = a * pred + b and how well it holds: n, share of inliers, mean and median relative error,
    share within 1.25, root mean square of the log. Residuals are weighed by Cauchy's function over 2.5 times their centred
    median deviation. Groups without `least` usable rows or without spread give no row."""
    kinds = dict(df.dtypes)
    columns = ["a", "b", "n", "inliers", "error", "median_error", "delta", "log_rmse"]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        p, z = pdf[pred].to_numpy(float), pdf[depth].to_numpy(float)
        use = np.isfinite(p) & np.isfinite(z) & (z > 0)
        p, z = p[use], z[use]
        empty = pd.DataFrame(columns=[*by, *columns])
        if len(p) < least:
            return empty
        y, w = np.log(z), np.ones(len(p))
        spread = lambda r: max(1.4826 * float(np.median(np.abs(r - np.median(r)))), 1e-3)
        for _ in range(rounds):
            mp, my = np.average(p, weights=w), np.average(y, weights=w)
            var = float((w * (p - mp) ** 2).sum())
            if var <= 1e-12:
                return empty
            a = float((w * (p - mp) * (y - my)).sum()) / var
            r = y - my - a * (p - mp)
            w = 1 / (1 + (r / (2.5 * spread(r))) ** 2)
        b = my - a * mp
        d = np.exp(a * p + b)
        off = np.abs(d - z) / z
        found = [a, b, len(p), float((np.abs(r) < 3 * spread(r)).mean()), float(off.mean()), float(np.median(off)), float((np.maximum(d / z, z / d) < 1.25).mean()), float(np.sqrt((r**2).mean()))]
        return pd.DataFrame([[*key, *found]], columns=[*by, *columns])

    return df.select(*by, pred, depth).groupBy(*by).applyInPandas(run, ", ".join([*[f"{c} {kinds[c]}" for c in by], "a double, b double, n long, inliers double, error double, median_error double, delta double, log_rmse double"]))


def calibrated_fill(df: DataFrame, by: list[str], pred: str, depth: str, least: int = 400, far: float = 3.0, sky: float = 0.005) -> DataFrame:
    """df with `filled` depth and `status` of its image: depth where there is any, else the image's calibrated prediction.

    Pixels whose prediction is below `sky` of the image's largest are sky and stay empty; so do calibrated depths beyond `far`
    times the largest known one. An image with too few known depths ("few") or whose fit goes the wrong way ("contradicts": a
    larger disparity must be nearer) is not filled. Images are joined with their fit by key: only a row an image moves.
    """
    top = df.groupBy(*by).agg(F.max(pred).alias("__top"), F.max(depth).alias("__far"), F.count(F.when(F.col(depth) > 0, 1)).alias("__known"))
    fits = log_affine(df.where(F.col(depth) > 0), by, pred, depth).select(*by, F.col("a").alias("__a"), F.col("b").alias("__b"))
    joined = df.join(top, by).join(fits, by, "left")
    status = F.when((F.col("__known") < least) | F.col("__a").isNull(), "few").when(F.col("__a") >= 0, "contradicts").otherwise("ok")
    guess = F.exp(F.col("__a") * F.col(pred) + F.col("__b"))
    usable = (F.col("status") == "ok") & (F.col(pred) > F.col("__top") * sky) & (guess <= F.col("__far") * far)
    filled = F.when(F.col(depth) > 0, F.col(depth)).when(usable, guess)
    return joined.withColumn("status", status).withColumn("filled", filled).drop("__top", "__far", "__known", "__a", "__b")


def uv_texels(corners: DataFrame, face: str, size: int) -> DataFrame:
    """(face, px, py, a, b, c): the texels whose centres lie in a face's triangle (u0, v0 to u2, v2, in 0 to 1), and their weights.
    Each triangle's bounding box is exploded, so work follows the covered area."""
    p = {k: F.col(k) * size for k in ("u0", "v0", "u1", "v1", "u2", "v2")}
    first = lambda *c: F.greatest(F.lit(0), F.floor(F.least(*c)).cast("int"))
    last = lambda *c: F.least(F.lit(size - 1), F.floor(F.greatest(*c)).cast("int"))
    u, v = (p["u0"], p["u1"], p["u2"]), (p["v0"], p["v1"], p["v2"])
    box = corners.where((last(*u) >= first(*u)) & (last(*v) >= first(*v)))
    at = box.select(face, *[c.alias(k) for k, c in p.items()], F.explode(F.sequence(first(*u), last(*u))).alias("px"), F.sequence(first(*v), last(*v)).alias("__rows")).withColumn("py", F.explode("__rows")).drop("__rows")
    x, y = F.col("px") + 0.5, F.col("py") + 0.5
    det = (F.col("v1") - F.col("v2")) * (F.col("u0") - F.col("u2")) + (F.col("u2") - F.col("u1")) * (F.col("v0") - F.col("v2"))
    a = ((F.col("v1") - F.col("v2")) * (x - F.col("u2")) + (F.col("u2") - F.col("u1")) * (y - F.col("v2"))) / det
    b = ((F.col("v2") - F.col("v0")) * (x - F.col("u2")) + (F.col("u0") - F.col("u2")) * (y - F.col("v2"))) / det
    inside = at.where(F.abs(det) > 1e-12).withColumns({"a": a, "b": b}).withColumn("c", 1 - F.col("a") - F.col("b"))
    return inside.where((F.col("a") >= 0) & (F.col("b") >= 0) & (F.col("c") >= 0)).select(face, "px", "py", "a", "b", "c")


def fill_holes(raster: DataFrame, by: list[str], value: str = "z", rounds: int = 400) -> DataFrame:
    """Rasters (by, row, col, z) with their holes filled: from the nearest known cell, then by `rounds` steps that set each hole to
    the mean of its four neighbours. A raster is bounded by its file, so each is one group."""
    kinds = dict(raster.dtypes)

    def fill(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        grid = np.full((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), np.nan)
        grid[pdf["row"] - r0, pdf["col"] - c0] = pdf[value]
        hole = np.isnan(grid)
        if hole.all():
            return pd.DataFrame(columns=[*by, "row", "col", value])
        while np.isnan(grid).any():  # rings of nearest values
            around = np.pad(grid, 1, constant_values=np.nan)
            near = np.stack([around[:-2, 1:-1], around[2:, 1:-1], around[1:-1, :-2], around[1:-1, 2:]])
            known = ~np.isnan(near)
            ready = np.isnan(grid) & known.any(0)
            grid[ready] = np.where(known, near, 0).sum(0)[ready] / known.sum(0)[ready]
        for _ in range(rounds if hole.any() else 0):
            around = np.pad(grid, 1, mode="edge")
            grid[hole] = ((around[:-2, 1:-1] + around[2:, 1:-1] + around[1:-1, :-2] + around[1:-1, 2:]) / 4)[hole]
        rows, cols = np.indices(grid.shape)
        return pd.DataFrame({**{b: k for b, k in zip(by, key)}, "row": rows.ravel() + r0, "col": cols.ravel() + c0, value: grid.ravel()})

    return raster.select(*by, "row", "col", value).groupBy(*by).applyInPandas(fill, ", ".join([*[f"{c} {kinds[c]}" for c in by], "row long, col long", f"{value} double"]))


def persistent_edges(edges: DataFrame, by: list[str], pixel: list[str], strength: str, strong: float = 20.0, share: float = 0.75) -> DataFrame:
    """Pixels whose edge is strong in at least a share of the frames: overlays that don't move with the scene."""
    votes = edges.groupBy(*by, *pixel).agg(F.avg((F.col(strength) >= strong).cast("double")).alias("share"))
    return votes.where(F.col("share") >= share)


def pattern_agreement(pixels: DataFrame, by: list[str], frame: str, pixel: list[str], value: str) -> DataFrame:
    """Median over pairs of frames of the correlation of their pixels. The few sampled frames of a box meet pixel by pixel."""
    per = pixels.groupBy(*by, *pixel).agg(F.collect_list(F.struct(F.col(frame).alias("f"), F.col(value).cast("double").alias("x"))).alias("s"))
    pairs = per.select(*by, F.explode("s").alias("a"), "s").select(*by, "a", F.explode("s").alias("b")).where("a.f < b.f")
    corr = pairs.groupBy(*by, F.col("a.f").alias("i"), F.col("b.f").alias("j")).agg(F.corr("a.x", "b.x").alias("r"))
    return corr.groupBy(*by).agg(F.median("r").alias("agreement"))


def with_previous(frames: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """frames next to the columns of the frame before, as previous_<column>; chunks need no bridging."""
    w = Window.partitionBy(*by).orderBy(*order)
    return frames.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})
