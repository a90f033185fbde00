"""Operators without SQL: fits, graphs, geometry, against closed forms and brute force."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkgrid.functions import camera, geodesy, rotations
from larkgrid.operators import clouds, fits, graph, relations, select, series
from larkgrid.functions.rotations import Similarity

PAIRS = "sx double, sy double, sz double, dx double, dy double, dz double"


def rotation(seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((3, 3)))
    return q * np.sign(np.linalg.det(q))


def pairs(spark, truth, n=200, noise=0.0, outliers=0, seed=1):
    rng = np.random.default_rng(seed)
    src = rng.uniform(-50, 50, (n, 3))
    dst = truth(src) + rng.standard_normal((n, 3)) * noise
    dst[:outliers] += rng.uniform(50, 200, (outliers, 3))
    return spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(src, dst)], PAIRS)


def test_umeyama_recovers_and_ransac_survives_outliers(spark):
    truth = Similarity(2.5, rotation(3), np.array([10.0, -4, 7]))
    fit = fits.umeyama(pairs(spark, truth))
    assert abs(fit.s - 2.5) < 1e-9 and np.abs(fit.r - truth.r).max() < 1e-9 and np.abs(fit.t - truth.t).max() < 1e-8
    found, n = fits.ransac_similarity(pairs(spark, truth, noise=0.01, outliers=80), 0.5, 300)
    assert n == 120 and abs(found.s - 2.5) < 1e-3
    assert fits.ransac_similarity(pairs(spark, truth, n=7), 0.5) is None
    with pytest.raises(ValueError):
        fits.umeyama(pairs(spark, truth, n=2))


def test_similarity_algebra(spark):
    a, b = Similarity(2.0, rotation(1), np.array([1.0, 2, 3])), Similarity(0.5, rotation(2), np.array([-1.0, 0, 4]))
    p = np.random.default_rng(0).standard_normal((5, 3))
    assert np.allclose(a.compose(b)(p), a(b(p))) and np.allclose(a.inverse()(a(p)), p) and np.allclose(a.matrix()[:3, :3] @ p[0] + a.matrix()[:3, 3], a(p)[0])
    row = spark.createDataFrame([tuple(map(float, p[0]))], "x double, y double, z double").select(*a.apply(F.col("x"), F.col("y"), F.col("z"))).first()
    assert np.allclose(row, a(p)[0])
    for u, v in ((np.array([1.0, 2, 3]), np.array([-3.0, 1, 0.5])), (np.array([0, 0, 1.0]), np.array([0, 0, -1.0]))):
        r = rotations.rotation_between(u, v)
        assert np.allclose(r @ u / np.linalg.norm(u), v / np.linalg.norm(v)) and np.isclose(np.linalg.det(r), 1)


def test_ground_plane_and_track_shape(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([np.c_[rng.uniform(-50, 50, (800, 2)), rng.normal(0, 0.05, 800)], rng.uniform(-50, 50, (200, 3))])
    p[:, 2] += 0.1 * p[:, 0]
    df = spark.createDataFrame([tuple(map(float, x)) for x in p], "x double, y double, z double")
    normal, _, n = fits.ground_plane(df)
    assert abs(normal @ np.array([-0.1, 0, 1]) / math.hypot(0.1, 1)) > 0.999 and n >= 790
    assert np.allclose(fits.level_rotation(df) @ normal, [0, 0, 1])
    line = spark.createDataFrame([(float(i), 2.0 * i, 0.01 * (i % 2)) for i in range(100)], "x double, y double, z double")
    shape = fits.track_shape(line)
    assert abs(shape["extent"] - 99 * math.sqrt(5)) < 1e-3 and shape["linearity"] < 1e-3


def test_isotonic_matches_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        y, w = rng.standard_normal(12), rng.uniform(0.5, 3, 12)
        fit = fits.isotonic(y, w)
        assert (np.diff(fit) >= -1e-12).all()
        # max over starts of min over ends of weighted means
        brute = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(fit, brute)


def test_robust_lines_and_monotone_fit(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 10, 400)
    y = 3 + 2 * x + rng.normal(0, 0.01, 400)
    y[:60] += 50
    df = spark.createDataFrame([(i % 2, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g int, x double, y double")
    for fit in (fits.cauchy_line, fits.huber_line):
        for r in fits.robust_lines(df, ["g"], "x", "y", fit).collect():
            assert abs(r.b - 2) < (0.01 if fit is fits.cauchy_line else 0.5) and r.n == 200
    knots = [(r.x, r.y) for r in fits.monotone_fit(df, ["g"], "x", "y").where("g = 1").orderBy("x").collect()]
    assert len(knots) > 15 and all(a[1] <= b[1] + 1e-9 for a, b in zip(knots, knots[1:]))


def test_geodesy_round_trip_and_utm(spark):
    df = spark.createDataFrame([(12.5, 77.6, 900.0), (-33.9, 18.4, 10.0), (59.3, 18.1, -5.0), (90.0, 0.0, 100.0)], "lat double, lon double, alt double")
    back = df.select(*geodesy.geodetic(*geodesy.ecef(F.col("lat"), F.col("lon"), F.col("alt"))), "lat", "lon", "alt").collect()
    for r in back:
        assert abs(r[0] - r.lat) < 1e-10 and abs(r[2] - r.alt) < 1e-6 and (r.lat == 90 or abs(r[1] - r.lon) < 1e-10)
    # on the central meridian easting is 500 km; at the equator northing is 0; meridian arc to 45 degrees is 4984944.378 m
    u = spark.range(1).select(*geodesy.utm(F.lit(0.0), F.lit(3.0), F.lit(31)), *geodesy.utm(F.lit(45.0), F.lit(3.0), F.lit(31)), geodesy.utm_epsg(F.lit(-1.0), F.lit(3.0))).first()
    assert abs(u[0] - 500_000) < 1e-6 and abs(u[1]) < 1e-6 and abs(u[2] - 500_000) < 1e-6 and abs(u[3] - 4_984_944.378 * 0.9996) < 0.01 and u[4] == 32731


def test_quaternions(spark):
    rng = np.random.default_rng(1)
    q = rng.standard_normal((2, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    a, b = (tuple(F.lit(float(v)) for v in x) for x in q)
    m = rotations.quat_to_matrix(a)
    row = spark.range(1).select(*rotations.matrix_to_quat(m), *rotations.slerp(a, b, F.lit(0.0)), *rotations.slerp(a, b, F.lit(1.0)), *rotations.quat_multiply(a, (a[0], -a[1], -a[2], -a[3]))).first()
    same = lambda u, v: np.allclose(u, v) or np.allclose(u, -np.array(v))
    assert same(row[:4], q[0]) and same(row[4:8], q[0]) and same(row[8:12], q[1]) and np.allclose(row[12:], [1, 0, 0, 0])


def test_camera(spark):
    row = spark.range(1).select(*camera.undistort(F.lit(0.3) * (1 - 0.05 * 0.13), F.lit(0.2) * (1 - 0.05 * 0.13), F.lit(-0.05)), camera.ray_elevation(F.lit(1.0), F.lit(0.0), F.lit(1.0)), camera.hms_seconds(F.lit("1:02:03.5")), *camera.intrinsics(F.lit(640), F.lit(480), F.lit(90.0))).first()
    assert abs(row[0] - 0.3) < 1e-6 and abs(row[1] - 0.2) < 1e-6 and abs(row[2] - 45) < 1e-9 and row[3] == 3723.5 and abs(row[4] - 320) < 1e-9
    with pytest.raises(Exception, match="field of view"):
        spark.range(1).select(*camera.intrinsics(F.lit(640), F.lit(480), F.lit(190.0))).collect()


def test_clock_texts_of_any_length(spark):
    texts = {"1200002": 1200002.0, "1:2345678.1234567": 2345738.1234567, " 1 : 2 ": 62.0, "1 000": 1000.0, ".5": 0.5, "5.": 5.0, "1e3": None, "-5": None, "x:1": None, "": None, "1::2": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.s for r in df.select("t", camera.hms_seconds(F.col("t")).alias("s")).collect()} == texts


def test_interpolation_edges(spark):
    track = spark.createDataFrame([("a", 0.0, 10.0, 350.0), ("a", 10.0, 12.0, 10.0), ("a", 20.0, None, 30.0), ("b", 5.0, 1.0, 1.0)], "run string, t double, lat double, heading double")
    probe = spark.createDataFrame([("a", -1.0), ("a", 5.0), ("a", 10.0), ("a", 15.0), ("a", 99.0), ("b", 0.0), ("c", 1.0)], "run string, t double")
    got = {(r.run, r.t): (r.lat, r.heading) for r in series.interpolate(probe, track, ["run"], "t", ["lat", "heading"], angles=("heading",)).collect()}
    assert got == {("a", -1.0): (10.0, 350.0), ("a", 5.0): (11.0, 0.0), ("a", 10.0): (12.0, 10.0), ("a", 15.0): (12.0, 20.0), ("a", 99.0): (None, 30.0), ("b", 0.0): (1.0, 1.0), ("c", 1.0): (None, None)}


def test_nearest_matches_brute_force(spark):
    rng = random.Random(3)
    cloud = lambda n, s: [(i, rng.gauss(0, s), rng.gauss(0, s), rng.choice([0.0, 100.0])) for i in range(n)]
    a, b = cloud(120, 30), cloud(80, 5)
    p, r = (spark.createDataFrame(x, f"{k} long, x double, y double, z double") for x, k in ((a, "pid"), (b, "rid")))
    got = {(x.pid, x["rank"]): x.rid for x in clouds.nearest(p, r, "pid", "rid", k=3).collect()}
    for i, *q in a:
        for k, j in enumerate(sorted(b, key=lambda o: (math.dist(q, o[1:]), o[0]))[:3], 1):
            assert got[i, k] == j[0]
    assert clouds.nearest(p, r.limit(0), "pid", "rid").count() == 0 and clouds.nearest(p, r.limit(2), "pid", "rid", k=5).count() == 240


def test_nearest_over_many_leaves_matches_brute_force(spark, monkeypatch):
    """Lines of points, equal distances, copies and a far point, which made all points share a cell; 4e8 pairs would not be done in time."""
    rng = np.random.default_rng(8)
    line = lambda n, dx: np.c_[rng.integers(0, 8, n) * dx, np.round(rng.uniform(0, 4, n), 3), rng.integers(0, 3, n)].astype(float)
    a, b = line(20_000, 1), np.r_[line(19_999, 2), [[1e7, 0, 0]]]
    rows = lambda v, k: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], f"{k} long, x double, y double, z double")
    p, r = rows(a, "pid"), rows(b, "rid")
    monkeypatch.setattr(clouds.kdtree, "LEAF", 256)
    start = time.time()
    near = {(x.pid, x["rank"]): (x.rid, x.distance) for x in clouds.nearest(p, r, "pid", "rid", k=3).collect()}
    within = {(x.pid, x["rank"]): (x.rid, x.distance) for x in clouds.within(p, r, 0.9, "pid", "rid", k=3).collect()}
    assert time.time() - start < 120 and len(near) == 60_000
    assert within == {k: v for k, v in near.items() if v[1] <= 0.9}
    for i in range(0, 20_000, 97):
        d = np.sqrt((a[i, 0] - b[:, 0]) ** 2 + (a[i, 1] - b[:, 1]) ** 2 + (a[i, 2] - b[:, 2]) ** 2)
        assert [near[i, k] for k in (1, 2, 3)] == [(int(j), d[j]) for j in np.lexsort((np.arange(len(b)), d))[:3]]


def test_cosine_blocks_match_brute_force(spark):
    """Several blocks, equal vectors, a vector of zeros and a missing one; rows of one group are not paired one by one."""
    from larkgrid.operators import similar

    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (300, 3)).astype(float)
    v[:40] = v[0] = [1.0, 2.0, 1.0]
    v[(v == 0).all(1)] = [1.0, 0.0, 0.0]
    v[299] = 0.0
    rows = [(i, i % 2, None if i == 298 else [float(x) for x in v[i]]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g int, v array<float>")
    found = similar.cosine_top_k(df, "g", "id", "v", 4, block=32)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    got = {(r.a, r["rank"]): (r.b, r.cosine) for r in found.collect()}
    assert len(got) == 1200

    def cosine(i, j):
        if 298 in (i, j):
            return None
        s = lambda x, y: sum(p * q for p, q in zip(x, y))
        return math.nan if 299 in (i, j) else round(s(v[i], v[j]) / (math.sqrt(s(v[i], v[i])) * math.sqrt(s(v[j], v[j]))), 6) + 0.0

    for i in range(300):
        all_ = [(j, cosine(i, j)) for j in range(i % 2, 300, 2) if j != i]
        place = lambda o: math.inf if o[1] is None else -math.inf if math.isnan(o[1]) else -o[1]
        for k, (j, c) in enumerate(sorted(all_, key=lambda o: (place(o), o[0]))[:4], 1):
            b, x = got[i, k]
            assert b == j and (x == c or (c is not None and math.isnan(c) and math.isnan(x)))


def test_percentiles_hold_no_group_in_a_task(spark):
    from larkgrid.operators.ranks import percentiles

    rng = np.random.default_rng(6)
    rows = [(0, float(x)) for x in rng.normal(0, 1e6, 60_000)] + [(1, float(x)) for x in rng.integers(0, 3, 999)] + [(2, None), (3, 7.0), (None, 1.0), (None, 4.0), (3, None)] + [(4, x) for x in (math.nan, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(4).persist()
    qs = {"low": 0.0, "p1": 0.01, "median": 0.5, "p90": 0.9, "top": 1.0}
    plain = df.groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in qs.items()])
    key = lambda r: str(tuple(None if x is None else round(x, 9) for x in r))
    assert sorted(map(key, percentiles(df, ["g"], "v", qs).collect())) == sorted(map(key, plain.collect()))
    assert percentiles(df, [], "v", {"m": 0.5}).first().m == df.agg(F.percentile("v", F.lit(0.5))).first()[0]
    sent = percentiles(df.where("g = 0"), ["g"], "v", {"m": 0.5})
    bands = clouds.distance_bands(df.where("g = 0"), "v", [0.0, 10.0, float("inf")])
    for found in (sent, bands):  # beside the counted values only groups that a sketch misjudged take the plain aggregate
        assert "percentile_approx" in found._jdf.queryExecution().optimizedPlan().toString()


def test_robust_lines_take_equal_points_once(spark):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.integers(0, 9, 60), rng.integers(1, 9, 60)).astype(float)
    y = np.round(1 + 3 * x + rng.integers(-2, 3, len(x)) * 0.25, 2)
    y[:20] += 40
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "g int, x double, y double")

    def fit(px, py, times=None):
        return float(len(px)), *fits.cauchy_line(px, py, times)[:2]

    whole = fits.cauchy_line(x, y)
    r = fits.robust_lines(df, ["g"], "x", "y").first()
    assert np.allclose([r.a, r.b, r.scale], whole) and r.n == len(x)
    assert fits.robust_lines(df, ["g"], "x", "y", fit).first().a == len({*zip(x, y)}) < len(x)


def test_bounds_of_nothing_is_an_error(spark):
    with pytest.raises(Exception, match="no points"):
        clouds.bounds(spark.createDataFrame([], "x double, y double, z double")).collect()


def test_graph(spark):
    keep = lambda df, name: df.persist()
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21)], "a long, b long")
    faces = spark.createDataFrame([(i,) for i in [*range(10), 20, 21, 30]], "fid long")
    got = graph.keep_large(edges, faces, "fid", 3, 0.1, keep).collect()
    assert sorted((r.fid, r.component, r.faces) for r in got) == [(i, 0, 10) for i in range(10)]
    tree = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8)], "pid long, ppid long")
    assert sorted(tuple(r) for r in graph.descend(tree, [2], lambda d, n: d.cache()).collect()) == [(2, 0), (3, 1), (4, 2)]
    t = lambda x: Similarity(1.0, np.eye(3), np.array([x, 0.0, 0.0]))
    forest = graph.spanning_forest([("a", 5), ("b", 9), ("c", 1), ("d", 2)], [("a", "b", 400, t(1)), ("b", "c", 300, t(10)), ("a", "c", 20, t(99))])
    assert {m: (r, s.t[0]) for m, (r, s) in forest.items()} == {"b": ("b", 0.0), "a": ("b", -1.0), "c": ("b", 10.0), "d": ("d", 0.0)}


def test_selections(spark):
    assert spark.range(1).select(select.positions(F.lit(10), 4)).first()[0] == [0, 3, 6, 9]
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("b", 3, 1.0)], "g string, k int, v double")
    assert sorted(tuple(r) for r in select.arg_best(df, ["g"], F.struct("v", "k"), ["k"]).collect()) == [("a", 2), ("b", 3)]
    assert [r[0] for r in spark.createDataFrame([(2, 0.9, 2.0, 9.0), (9, 0.6, 1.5, 2.0), (9, 0.3, 0.1, 0.1), (9, 0.0, 0.1, 0.1)], "n int, s double, m double, p double").select(relations.pass_verdict(F.col("s"), F.col("m"), F.col("p"), F.col("n"))).collect()] == ["too-short", "3d", "weak-3d", "degenerate"]


def test_frames(spark):
    from larkgrid.operators import frames

    rng = random.Random(2)
    rows = [(p, i, [max(0.0, 1 - 0.1 * (d + 1)) for d in range(20)], float(rng.randint(0, 3))) for p in range(3) for i in range(25)]
    df = spark.createDataFrame(rows, "pass int, i int, overlap array<double>, sharp double")
    for p in range(3):
        got = [r.i for r in frames.greedy_keyframes(df, ["pass"], "i", "overlap", "sharp", 0.29, 0.75).where(f"pass = {p}").orderBy("i").collect()]
        sharp, at, expect = {i: s for q, i, _, s in rows if q == p}, 0, [0]
        while at < 24:
            band = [j for j in range(at + 3, min(at + 7, 24) + 1)]
            at = max(band, key=lambda j: (sharp[j], j)) if band else 24
            expect.append(at)
        assert got == expect
    snapped = frames.snap_distinct(spark.createDataFrame([("a", 1.0, [0.0, 2.0, 9.0]), ("a", 1.2, [0.0, 2.0, 9.0]), ("a", 1.9, [0.0, 2.0, 9.0])], "g string, t double, grid array<double>"), ["g"], "t", "grid")
    assert [r.snapped for r in snapped.orderBy("t").collect()] == [0.0, 2.0, 9.0]
    flat = frames.flatten(spark.createDataFrame([(1, '{"a": {"b": 1, "c": [1, {"d": "x"}]}, "l": [1,2,3,4,5,6,7], "n": null}')], "id int, j string").withColumn("v", F.parse_json("j")), ["id"], "v", lambda d, n: d.cache())
    assert sorted((r.path, r.value) for r in flat.collect()) == [("a.b", "1"), ("a.c.0", "1"), ("a.c.1.d", "x"), ("l", "[7 items]"), ("n", None)]


def test_images(spark):
    from larkgrid.operators import frames

    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (12, 16), dtype=np.uint8)
    framed = np.zeros((12, 16), np.uint8)
    framed[2:10, 1:15] = 200
    df = spark.createDataFrame([(1, bytearray(a.tobytes()), 16), (2, bytearray(framed.tobytes()), 16)], "g int, luma binary, width int")
    lap = {r.g: r.sharpness for r in frames.laplacian_variance(df).collect()}
    x = a.astype(float)
    assert abs(lap[1] - (x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]).var(ddof=1)) < 1e-9
    assert {tuple(r) for r in frames.letterbox(df, ["g"]).collect()} == {(1, 0, 12, 0, 16), (2, 2, 10, 1, 15)}


def test_subject_point(spark):
    rng = np.random.default_rng(3)
    target = np.array([5.0, -3, 2])
    rows = []
    for k in range(40):
        c = rng.uniform(-50, 50, 3)
        d = (target - c) / np.linalg.norm(target - c) if k % 4 else rng.standard_normal(3)
        rows.append((k % 2, *map(float, c), *map(float, d / np.linalg.norm(d))))
    from larkgrid.operators import scenes

    df = spark.createDataFrame([r for r in rows if rows.index(r) % 4], "g int, cx double, cy double, cz double, dx double, dy double, dz double")
    got = scenes.subject_point(df, ["g"]).collect()
    assert len(got) == 2 and all(np.allclose([r.x, r.y, r.z], target) and r.aimed == 1 for r in got)


def test_two_view_tells_plane_from_depth(spark):
    from larkgrid.operators import scenes

    rng = np.random.default_rng(4)
    rows = []
    for pair, flat in ((1, True), (2, False), (3, True)):
        n = 10 if pair == 3 else 300
        x = np.c_[rng.uniform(-2, 2, (n, 2)), np.full(n, 8.0) if flat else rng.uniform(4, 14, n)]
        a, y = x[:, :2] / x[:, 2:] * 500, x + [0.8, 0.1, 0.05]
        b = y[:, :2] / y[:, 2:] * 500
        a, b = a + rng.normal(0, 0.2, a.shape), b + rng.normal(0, 0.2, b.shape)
        rows += [(pair, *map(float, p), *map(float, q)) for p, q in zip(a, b)]
    df = spark.createDataFrame(rows, "pair int, ax double, ay double, bx double, by_ double")
    got = {r.pair: r for r in scenes.two_view(df, ["pair"]).collect()}
    assert got[1].parallax is False and got[2].parallax is True and got[3].parallax is None and got[1].plane_px < 1 < got[2].plane_px


def test_cross_validation_prefers_the_better_map(spark):
    from larkgrid.operators import scenes

    rng = np.random.default_rng(5)
    x = rng.uniform(1, 10, 400)
    rows = [(g, i, float(v), float(3 + 2 * v if g == 0 else 1 + 8 * (v > 5)) + float(rng.normal(0, 0.05))) for g in (0, 1) for i, v in enumerate(x)]
    got = {r.g: r for r in scenes.cross_validate(spark.createDataFrame(rows, "g int, k long, x double, y double"), ["g"], "x", "y", "k").collect()}
    assert got[0].line_error < 0.02 and got[1].monotone_error < 0.05 < got[1].line_error


def test_terrain_takes_roofs_away(spark):
    from larkgrid.operators import scenes

    rows = [(x + 0.5, y + 0.5, 0.1 * x + (5.0 if 8 <= x < 11 and 8 <= y < 11 else 0.0)) for x in range(24) for y in range(24)]
    got = {(r.row, r.col): r.ground for r in scenes.terrain(spark.createDataFrame(rows, "x double, y double, z double"), 1.0).collect()}
    assert len(got) == 576 and all(abs(z - 0.1 * c) < 0.5 for (_, c), z in got.items())
