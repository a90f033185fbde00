import numpy as np
import pytest
from pyspark.sql import functions as F

from larkgrid.sources import points, telemetry
from larkgrid.streaming import segments


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("t").select(*cols).collect()]


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


@pytest.mark.parametrize(
    "text, expect",
    [
        ("t,lat,lon,alt_m\n0,12.5,77.6,100\n1,12.6,77.7,110\n", [(0.0, 12.5, 77.6, 100.0), (1.0, 12.6, 77.7, 110.0)]),
        ("timestamp;Latitude;Longitude;Absolute Altitude\n1;12.5;77.6;-\n2;12.6;77.7;\n", [(1.0, 12.5, 77.6, None), (2.0, 12.6, 77.7, None)]),
        ("lat\tlon\n1\t2\n3\t4\n5\t6\n", [(0.0, 1.0, 2.0, None), (1.0, 3.0, 4.0, None), (2.0, 5.0, 6.0, None)]),
        ("﻿time,lat,lon\n1700000001,1,2\n1700000000,3,4\n", [(0.0, 3.0, 4.0, None), (1.0, 1.0, 2.0, None)]),
        ("t,lat,lon\n0,,\n2,1,2\n", [(2.0, 1.0, 2.0, None)]),
    ],
)
def test_csv(spark, tmp_path, text, expect):
    df = telemetry.read(spark, put(tmp_path, "log.csv", text))
    assert rows(df, "t", "lat", "lon", "alt_m") == expect and df.first().source == "csv:log.csv"


def test_csv_without_header_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        telemetry.read_csv(spark, put(tmp_path, "log.csv", "\n\n"))
    with pytest.raises(ValueError):
        telemetry.read(spark, "log.xlsx")


def test_srt(spark, tmp_path):
    cue = "{}\n00:00:0{},500 --> 00:00:0{},900\n{}\n\n"
    text = cue.format(1, 0, 0, "no position") + cue.format(2, 1, 1, "[latitude: 12.5] [longitude: 77.6] [rel_alt: 50 abs_alt: 100] heading: 90") + cue.format(3, 2, 2, "latitude: 12.6 longitude: 77.7")
    assert rows(telemetry.read(spark, put(tmp_path, "a.srt", text)), "t", "lat", "lon", "alt_m", "rel_alt_m", "heading_deg") == [(1.5, 12.5, 77.6, 100.0, 50.0, 90.0), (2.5, 12.6, 77.7, None, None, None)]


def test_gpx(spark, tmp_path):
    point = '<trkpt lat="{}"{}><ele>{}</ele><time>2024-01-01T00:00:0{}Z</time></trkpt>'
    text = "<gpx><trk><trkseg>" + point.format(12.5, ' lon="77.6"', 100, 1) + point.format(12.6, "", 1, 2) + point.format(12.7, ' lon="77.8"', 110, 3) + "</trkseg></trk></gpx>"
    assert rows(telemetry.read(spark, put(tmp_path, "a.gpx", text)), "t", "lat", "lon", "alt_m") == [(0.0, 12.5, 77.6, 100.0), (2.0, 12.7, 77.8, 110.0)]
    with pytest.raises(ValueError):
        telemetry.read_gpx(spark, put(tmp_path, "b.gpx", text[:-20]))


@pytest.mark.parametrize("wrap", ["{}", '{{"samples": {}}}', '{{"gps": {}}}', '{{"records": {}}}'])
def test_json(spark, tmp_path, wrap):
    text = wrap.format('[{"t": 1, "Lat": 12.5, "lng": 77.6, "speed": "3,5"}, 7, {"t": 2, "lat": 12.6, "lon": 77.7}]')
    assert rows(telemetry.read(spark, put(tmp_path, "a.json", text)), "t", "lat", "lon", "speed_ms") == [(1.0, 12.5, 77.6, 35.0), (2.0, 12.6, 77.7, None)]


def test_ply_round_trip(spark, tmp_path):
    cloud = spark.createDataFrame([(float(i), i / 2, -i * 1.0, i % 256, 7, 255) for i in range(700)], "x double, y double, z double, r int, g int, b int")
    for cols in (list("xyzrgb"), list("xyz")):
        path = str(tmp_path / f"{len(cols)}.ply")
        assert points.write_ply(cloud.select(*cols), path) == 700 and points.ply_vertex_count(spark, path) == 700
        back = points.read_ply(spark, path)
        assert back.columns == cols and [tuple(r) for r in back.collect()] == [tuple(r) for r in cloud.select(*cols).collect()]
    ascii_ = put(tmp_path, "a.ply", "ply\nformat ascii 1.0\ncomment c\nelement vertex 2\nproperty float x\nproperty double y\nproperty int z\nelement face 0\nend_header\n1 2.5 3\n4 5 6\n")
    assert [tuple(r) for r in points.read_ply(spark, ascii_).collect()] == [(1.0, 2.5, 3), (4.0, 5.0, 6)]
    with pytest.raises(Exception, match="PLY"):
        points.read_ply(spark, put(tmp_path, "bad.ply", "nothing"))


def test_las_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    xyz = rng.uniform(-500, 900_000, (2000, 3))
    cloud = spark.createDataFrame([(*map(float, p), i % 256, 1, 2) for i, p in enumerate(xyz)], "x double, y double, z double, r int, g int, b int")
    path = str(tmp_path / "c.las")
    assert points.write_las(cloud, path) == 2000
    back = points.read_las(spark, path).toPandas()
    assert np.abs(back[["x", "y", "z"]].to_numpy() - xyz).max() <= 0.00051 and (back["r"] == [i % 256 * 257 for i in range(2000)]).all()


def test_web_splats_and_text_rows(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 0.1, 0.2, 0.3, 10.0, 20.0, 300.0, 255.0, 2.0, 0.0, 0.0, 0.0)], "x double, y double, z double, sx double, sy double, sz double, r double, g double, b double, a double, qw double, qx double, qy double, qz double")
    assert points.write_web_splats(df, str(tmp_path / "s")) == 1
    data = (tmp_path / "s").read_bytes()
    assert len(data) == 32 and list(data[24:]) == [10, 20, 255, 255, 255, 128, 128, 128]
    assert points.write_text_rows(spark.createDataFrame([(1.5, 2)], "a double, b int"), str(tmp_path / "t"), "%.2f %d") == 1 and (tmp_path / "t").read_text() == "1.50 2\n"


def test_colmap(spark, tmp_path):
    put(tmp_path, "cameras.txt", "# c\n1 PINHOLE 640 480 500 500 320 240\n")
    put(tmp_path, "images.txt", "# i\n1 1 0 0 0 0 0 5 1 pass_01/a.jpg\n10 20 7 30 40 -1\n2 1 0 0 0 0 0 -9 1 pass_01/b.jpg\n\n")
    put(tmp_path, "points3D.txt", "# p\n7 1 2 3 9 8 7 0.5 1 0 2 0\n8 0 0 0 1 1 1 -1 1 1\n")
    model = points.read_colmap(spark, str(tmp_path))
    assert [tuple(r) for r in points.depth_observations(model).collect()] == [(1, "pass_01/a.jpg", 10.0, 20.0, 8.0)]
    assert tuple(points.model_statistics(model).first()) == (2, 2, 0.5, 1.5)


def test_results_logs_and_geojson(spark, tmp_path):
    for run, stage, text in (("r1", "sfm", '{"models": 2}'), ("r1", "dense", "{corrupt"), ("r2", "sfm", "{}")):
        (tmp_path / "runs" / run / stage).mkdir(parents=True)
        (tmp_path / "runs" / run / stage / "result.json").write_text(text)
    got = points.read_results(spark, str(tmp_path / "runs")).select("run", "stage", F.try_variant_get("result", "$.models", "int").alias("m"), F.col("result").isNull().alias("bad")).collect()
    assert sorted(tuple(r) for r in got) == sorted([("r1", "sfm", 2, False), ("r1", "dense", None, True), ("r2", "sfm", None, False)], key=str)
    log = put(tmp_path, "run.log", "x stage sfm started\nstage sfm finished in 12.5 s\nstage dense started\nnoise\n")
    assert sorted(tuple(r)[1:] for r in points.stage_log(spark, log).collect()) == [("dense", "started", None), ("sfm", "finished", 12.5)]
    keys = spark.createDataFrame([("b", 1.0, 2.0, 3.0), ("a", 4.0, 5.0, None), ("c", None, 1.0, 1.0)], "name string, lat double, lon double, alt_m double")
    assert points.camera_track_geojson(keys).first()[0] == '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"a"},"geometry":{"type":"Point","coordinates":[5.0,4.0,0.0]}},{"type":"Feature","properties":{"name":"b"},"geometry":{"type":"Point","coordinates":[2.0,1.0,3.0]}}]}'


def test_segments_arrive_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for k in range(2):
        put(tmp_path / "in", f"{k}.csv", f"seg{k}.mp4,{k * 30},{k * 30 + 30}\n")
        segments.append_once(segments.job_rows(segments.segment_stream(spark, str(tmp_path / "in")), "s", 100.0, (1.0, 2.0)), out, check).awaitTermination()
    jobs = spark.read.parquet(out)
    assert sorted(tuple(r) for r in jobs.select("job", "t0", "t1", "lat0").collect()) == [("seg0.mp4", 100.0, 130.0, 1.0), ("seg1.mp4", 130.0, 160.0, 1.0)]
    results = spark.createDataFrame([("seg0.mp4", "done", "", 160.0), ("seg1.mp4", "failed", "No 3D motion", 190.0)], "job string, state string, message string, done_s double")
    assert sorted((r.job, r.status, r.latency_s, r.realtime) for r in segments.completions(jobs, results).collect()) == [("seg0.mp4", "done", 30.0, 1.0), ("seg1.mp4", "no-3d", 30.0, 1.0)]


def test_queue_starts_jobs_by_priority(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for k, text in enumerate(("s,a,1,0\ns,b,1,1\ns,c,0,2\ns,d,1,3\n", "s,c,,4\n", "s,a,,5\ns,e,0,6\n")):
        put(tmp_path / "in", f"{k}.csv", text)
        stream = segments.start_jobs(spark.readStream.schema(segments.JOB).csv(str(tmp_path / "in")), 2)
        segments.append_once(stream, out, check).awaitTermination()
    assert [r.job for r in spark.read.parquet(out).orderBy("position").collect()] == ["c", "a", "b", "e"]
