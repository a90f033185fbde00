"""Operators over models and runs whose answers SQL can't give, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkgrid.functions.rotations import Similarity
from larkgrid.operators import frames, graph, models
from larkgrid.plans.models import pairs_of


def test_depths_far_apart_keep_trees_apart(spark):
    rows = spark.createDataFrame([("a", 100, 1.0), ("b", 60, 1.2), ("c", 10, 50.0), ("d", 5, None)], "name string, images long, depth double")
    unit, zero = np.eye(3).ravel().tolist(), [0.0, 0.0, 0.0]
    edges = spark.createDataFrame([("b", "a", 900, 2.0, unit, [1.0, 0.0, 0.0]), ("b", "c", 800, 1.0, unit, zero), ("c", "d", 700, 1.0, unit, zero)], "a string, b string, inliers long, s double, r array<double>, t array<double>")
    found, refused = models.link_groups(rows, edges)
    assert {m: r for m, (r, _) in found.items()} == {"a": "a", "b": "a", "c": "c", "d": "c"} and refused == [("b", "c")]
    t = found["b"][1]  # b into a undoes a into b
    assert np.isclose(t.s, 0.5) and np.allclose(t.t, [-0.5, 0, 0])
    assert not models.link_groups(rows, edges, most_ratio=1000)[1]


def test_held_out_errors_of_any_solver(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.standard_normal((9, 3)))]
    pairs = pairs_of(spark.createDataFrame(rows, "key long, x double, y double, z double"), Similarity(2.0, np.eye(3), np.ones(3)))
    exact = models.held_out(pairs, "key", models.yaw_similarity)
    assert exact["n"] == 9 and max(exact["rmse_h"], exact["rmse_v"], exact["scale_se"], exact["tilt_se"]) < 1e-9
    assert models.held_out(pairs.limit(3), "key", models.yaw_similarity) is None
    straight = pairs_of(spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(9)], "key long, x double, y double, z double"), Similarity(1.0, np.eye(3), np.zeros(3)))
    assert models.georeference(straight, "key")[0] == "yaw"  # its roll isn't known


def test_gains_make_overlaps_agree(spark):
    rows = [(t, v, 100.0 * g + t % 7) for t in range(60) for v, g in (("a", 1.0), ("b", 0.8), ("c", 1.25)) if (t + ord(v)) % 3]
    overlaps = models.view_overlaps(spark.createDataFrame(rows, "tri long, view string, value double"), "tri", "view", "value").toPandas()
    g = models.view_gains(overlaps)
    assert g["b"] > g["a"] > g["c"] and all(0.5 <= x <= 2 for x in g.values())
    miss = lambda k: sum(abs(k[r.i] * r.mean_i - k[r.j] * r.mean_j) for r in overlaps.itertuples())
    assert miss(g) < 0.5 * miss(dict.fromkeys("abc", 1.0))


def test_holes_are_filled_smoothly(spark):
    rows = [("r", i, j, float(i + j)) for i in range(9) for j in range(9) if not (2 <= i <= 6 and 2 <= j <= 6)] + [("empty", 0, 0, None)]
    got = models.fill_holes(spark.createDataFrame(rows, "name string, row long, col long, z double"), ["name"]).collect()
    assert len(got) == 81 and max(abs(r.z - r.row - r.col) for r in got) < 0.05


def test_leaves_and_descents_have_no_last_level(spark):
    text = '{"a":' * 30 + "7" + "}" * 30
    df = spark.createDataFrame([(1, text)], "id long, t string").select("id", F.parse_json("t").alias("v"))
    assert [tuple(r) for r in frames.flatten(df, ["id"], "v", lambda d, n: d.cache()).collect()] == [(1, ".".join(["a"] * 30), "7")]
    ring = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (9, 8)], "pid long, ppid long")
    assert sorted(tuple(r) for r in graph.descend(ring, [1], lambda d, n: d.cache()).collect()) == [(1, 0), (2, 1), (3, 2)]


def test_log_affine_withstands_wild_depths(spark):
    rng = np.random.default_rng(2)
    rows = [("i", float(p), float(np.exp(1 - 0.5 * p)) * (50.0 if k % 9 == 0 else 1.0)) for k, p in enumerate(rng.uniform(0, 4, 200))]
    rows += [("few", 1.0, 2.0)] * 5 + [("flat", 1.0, 2.0)] * 50 + [("i", None, 3.0), ("i", 1.0, -1.0)]
    (r,) = models.log_affine(spark.createDataFrame(rows, "img string, p double, z double"), ["img"], "p", "z").collect()
    assert r.img == "i" and r.n == 200 and abs(r.a + 0.5) < 0.01 and abs(r.b - 1) < 0.02 and 0.85 < r.inliers < 0.92


def test_live_state_is_written_anew_with_each_batch(spark, tmp_path):
    schema = "session string, n long, state string"
    for i, rows in enumerate(([("s", 1, "done"), ("t", 1, "waiting")], [("s", 2, "failed")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        models.write_live_state(stream, f"{tmp_path}/out", f"{tmp_path}/check", "session", ["n"], "state", ["done"]).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/state").collect()) == [("s", "failed", 2, 1), ("t", "waiting", 1, 0)]


def test_a_distance_must_be_expected(spark):
    with pytest.raises(Exception, match="expected distance"):
        spark.range(1).select(*models.scale_error(F.lit(1.0), F.lit(0.0))).collect()
