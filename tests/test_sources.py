"""Files in, files out, and the progress stream."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from kestrelframe.sources import files, sinks
from kestrelframe.streaming import progress


def write(path, text):
    path.write_text(text)
    return str(path)


def test_telemetry(spark, tmp_path):
    p = write(tmp_path / "gps.csv", "timestamp,frame,latitude,longitude,altitude,speed_mps\n2024-01-01T00:00:00Z,0,47.0,8.0,400,1\n1704067201.5,1,47.0,8.0,400,\n2024-01-01T00:00:03,2,99,8.0,abc,x\n1704067200,3,47,8,400,\n")
    rows = {r.seq: r for r in files.telemetry(spark, p).collect()}
    assert rows[0].time == 1704067200.0 and rows[0].errors == [] and rows[1].time == 1704067201.5
    assert rows[2].errors == ["timestamp", "latitude", "altitude"] and rows[3].errors == []


def test_telemetry_without_frames(spark, tmp_path):
    p = write(tmp_path / "g.csv", "timestamp_utc,latitude,longitude,altitude_m\n1,1,1,1\n1,1,1,1\n")
    assert [r.errors for r in files.telemetry(spark, p).orderBy("seq").collect()] == [[], ["time order"]]


def test_flight(spark, tmp_path):
    good = {"mission_name": "m", "drone_model": "d", "camera_sensor": "c", "video_file": "v", "video_resolution": [4, 3], "video_fps": 30.0, "video_duration_sec": 2.0, "home_point": {"latitude": 1.0, "longitude": 2.0, "altitude_m": 3.0}, "start_time_utc": "2024-01-01T00:00:00Z", "end_time_utc": "2024-01-01T00:01:00Z", "camera_intrinsics": {"focal_length_mm": 4.0, "sensor_width_mm": 8.0}}
    df = files.flight(spark, write(tmp_path / "a.json", json.dumps(good)))
    assert df.first().errors == [] and files.intrinsics(df, 1000, 500).first().fx == 500.0
    bad = good | {"video_fps": -1, "end_time_utc": "2023-01-01T00:00:00Z", "home_point": None, "camera_intrinsics": None}
    df = files.flight(spark, write(tmp_path / "b.json", json.dumps(bad)))
    assert {"missing home_point", "video_fps not positive", "times not increasing"} <= set(df.first().errors) and files.intrinsics(df, 1000, 500).first().source == "PRIOR"


def test_checkpoints(spark, tmp_path):
    p = write(tmp_path / "c.csv", "﻿checkpoint_id,latitude,longitude,elevation,recon_x,recon_y,recon_z,role,vertical_datum\na,1,2,3,1,2,,control,egm96\nb,1,2,3,1,2,3,,odd\nb,91,2,x,,,,judge,\n")
    rows = files.checkpoints(spark, p).collect()
    assert rows[0].errors == [] and rows[0].recon_x is None and rows[0].vertical_datum == "EGM96"
    by = sorted((r for r in rows if r.checkpoint_id == "b"), key=lambda r: r.latitude)
    assert by[0].errors == ["duplicate id"] and by[0].warnings == ["unknown datum"] and by[0].recon_z == 3.0
    assert by[1].errors == ["duplicate id", "latitude", "elevation", "role"]


def test_streams_and_corrections(spark, tmp_path):
    imu = write(tmp_path / "imu.csv", "canonical_time_s,accel_x,accel_y,accel_z,gyro_x,gyro_y,gyro_z\n1,1,2,3,,,\n2,,,,4,5,6\n")
    gps = write(tmp_path / "gps.csv", "canonical_unix_timestamp,lat,lon,alt\n1,2,3,4\n")
    got = {r.stream: r.v for r in files.streams(spark, {"imu": imu, "gps": gps}).collect()}
    assert got == {"accel": [1.0, 2.0, 3.0], "gyro": [4.0, 5.0, 6.0], "gps": [2.0, 3.0, 4.0]}
    c = write(tmp_path / "rtk.csv", "frame,east_correction_m\n30,0.5\n")
    assert [tuple(r) for r in files.corrections(spark, c, 30.0, 100.0).collect()] == [(101.0, 0.5)]
    t = write(tmp_path / "t.txt", "1.0 2 3\n4 5 6\n")
    assert [tuple(r) for r in files.trajectory(spark, t, ["t", "x", "y"]).collect()] == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]


def test_sfm_text(spark, tmp_path):
    i = write(tmp_path / "images.txt", "# c\n1 1 0 0 0 7 8 9 1 a.png\n1.0 2.0 5 3.0 4.0 -1 1 1 5\n2 1 0 0 0 1 1 1 1 b.png\n\n")
    rows = {r.image_id: r for r in files.sfm_images(spark, i).collect()}
    assert rows[1].t == [7.0, 8.0, 9.0] and rows[1].name == "a.png" and rows[1].points == [5] and rows[2].points == []
    assert [tuple(r) for r in files.image_points(files.sfm_images(spark, i)).collect()] == [(1, 5)]
    p = write(tmp_path / "points3D.txt", "# c\n5 1 2 3 10 20 30 0.5 1 0 2 1\n")
    r = files.sfm_points(spark, p).first()
    assert (r.point_id, r.x, r.b, r.error, r.track) == (5, 1.0, 30, 0.5, 2)


def test_ply(spark, tmp_path):
    head = "ply\nformat {}\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\n{}end_header\n"
    write(tmp_path / "a.ply", head.format("ascii 1.0", "") + "0 0 0 1\n1 0 0 1\n0 1 0.5 1\n")
    body = b"".join(struct.pack("<fffB", *v) for v in ((0, 0, 0, 1), (1, 0, 0, 1), (0, 1, 0.5, 1)))
    faces = b"".join(struct.pack(f"<B{len(f)}i", len(f), *f) for f in ((0, 1, 2), (0, 1, 2, 0), (2, 1, 0)))
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian 1.0", "element face 3\nproperty list uchar int vertex_indices\n").encode() + body + faces)
    v = files.ply_vertices(spark, f"{tmp_path}/*.ply").groupBy("path").agg(F.count("*").alias("n"), F.sum("z").alias("z")).collect()
    assert [(r.n, r.z) for r in v] == [(3, 0.5), (3, 0.5)]
    assert [(r.v0, r.v1, r.v2) for r in files.ply_faces(spark, f"{tmp_path}/*.ply").orderBy("fid").collect()] == [(0, 1, 2), (2, 1, 0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 2.5, "x")], "a int, b double, c string")
    sinks.csv_table(df, f"{tmp_path}/csv", ["c", "a"])
    assert {r.value for r in spark.read.text(f"{tmp_path}/csv").collect()} == {"c,a", ",1", "x,2"}
    sinks.json_report(df, f"{tmp_path}/json")
    assert {r.a: r.b for r in spark.read.json(f"{tmp_path}/json").collect()} == {1: None, 2: 2.5}
    m = sinks.manifest(spark, f"{tmp_path}/json").where("format = 'JSON'")
    assert m.count() >= 1 and all(len(r.sha256) == 64 and r.status == "VERIFIED" for r in m.collect())
    d = {r.format: (r.available, r.verified) for r in sinks.deliverables(m).collect()}
    assert d["JSON"] == (True, True) and d["PLY"] == (False, False)
    head = sinks.heatmap(df.where("a = 2"), "b", f"{tmp_path}/heat")
    assert head.first()["max"] == 2.5 and spark.read.parquet(f"{tmp_path}/heat/values").first().value == 2.5
    lines = [r.value for r in sinks.fixed_width(df.orderBy("a"), [("a", 4), ("b", 10), ("c", 3)]).collect()]
    assert lines[1] == "2   2.5000    x" and lines[0].endswith("N/A")
    sinks.text_report(df, [("a", 4)], f"{tmp_path}/text")
    sinks.parquet_arrays(df, f"{tmp_path}/pq", ["a"])
    assert spark.read.parquet(f"{tmp_path}/pq").count() == 2
    listing = files.listing(spark, f"{tmp_path}/json")
    assert sinks.conversion_report(spark, "d", "s", listing, listing, 2).first().rows_converted == 2


def test_progress_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    line = lambda j, s, p, e: json.dumps({"job_id": j, "stage": s, "progress": p, "message": "", "elapsed_sec": e}) + "\n"
    (log / "1.json").write_text(line("a", "A", 0.1, 1.0) + line("a", "B", 0.4, 2.0) + line("zz", "A", 0.1, 1.0))
    jobs = spark.createDataFrame([("a", "n", "running"), ("b", "m", "completed")], "id string, name string, status string")
    run = lambda: progress.follow(progress.snapshots(progress.events(spark, str(log)), jobs), f"{tmp_path}/ck", f"{tmp_path}/out", once=True).awaitTermination()
    run()
    (log / "2.json").write_text(line("b", "F", 1.0, 9.0))
    run()
    run()
    got = {(r.job_id, r.stage): r.final for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", "A"): False, ("a", "B"): False, ("b", "F"): True}


def test_stateful_streams(spark, tmp_path):
    s = spark.createDataFrame([("x", 1.0), ("x", 1.0), ("y", 2.0), ("y", 100.0)], "k string, t double").withColumn("ts", F.timestamp_seconds("t"))
    s.write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(s.schema).parquet(f"{tmp_path}/in")

    def collect(df, mode):
        q = df.writeStream.format("memory").queryName(f"t{mode}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(f"t{mode}").collect()

    assert len(collect(progress.without_copies(src, "ts", ["k"]), "append")) == 3
    log = src.select(F.col("k").alias("job_id"), F.lit("s").alias("stage"), F.col("t").alias("elapsed_sec"), F.col("t").alias("progress"))
    assert {r.job_id: r.progress for r in collect(progress.latest_state(log), "complete")} == {"x": 1.0, "y": 100.0}
    assert sum(r.n for r in collect(progress.windowed_rates(src, "ts", "10 seconds", "1 second", F.col("k")), "update")) == 4


@pytest.mark.parametrize("text,want", [("2024-01-01T00:00:00Z", 1704067200.0), ("2024-01-01T02:00:00+02:00", 1704067200.0), ("5.5", 5.5), ("2024-01-01T00:00:00", None), ("2026", 2026.0), ("", None)])
def test_times(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(files.epoch_of(F.col("s"))).first()[0] == want


def test_sensor_zip(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "log.zip", "w") as z:
        z.writestr("log/OnboardGPS.csv", "time, lat, lon\n1000000, 1, 2\nbad, 3, x\n")
        z.writestr("log/RawAccel.csv", "time, x\n2500000, 9\n")
        z.writestr("readme.txt", "no")
    got = sorted((r.stream, r.seq, r.t, r.v[0]) for r in files.sensor_zip(spark, str(tmp_path / "log.zip")).collect())
    assert got == [("accel", 0, 2.5, 9.0), ("gps", 0, 1.0, 1.0), ("gps", 1, 0.0, 3.0)]


def test_viewer_artifacts(spark, tmp_path):
    points = spark.range(40).select("id", (F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    faces = spark.createDataFrame([(1, "WEAK"), (2, "WEAK"), (3, None)], "fid long, support string")
    made = {r.artifact: r for r in sinks.viewer_artifacts(points, spark.createDataFrame([], "r array<double>, t array<double>"), points, faces, str(tmp_path), 1.0, max_points=10).collect()}
    assert (made["sparse"].n, made["dense_display"].n, made["support"].n) == (40, 10, 2)
    assert not made["cameras"].available and made["cameras"].reason == "No cameras" and not (tmp_path / "cameras").exists()


def test_viewer_keeps_small_clouds_and_writes_camera_centres(spark, tmp_path):
    points = spark.range(40).select("id", F.lit(0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))  # all in one voxel
    poses = spark.createDataFrame([([0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [1.0, 2.0, 3.0]), ([1.0], [1.0]), (None, None)], "r array<double>, t array<double>")
    made = {r.artifact: r.n for r in sinks.viewer_artifacts(points, poses, points, spark.createDataFrame([], "fid long, support string"), str(tmp_path), 1.0, max_points=40).collect()}
    assert made == {"sparse": 40, "cameras": 1, "dense_display": 40, "support": 0}
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "cameras")).select("x", "y", "z").collect()] == [(-2.0, 1.0, -3.0)]


def test_frame_times(spark):
    frames = spark.createDataFrame([("a/1.jpg",), ("2.jpg",), (None,)], "path string")
    times = spark.createDataFrame([("1.jpg", "3.5"), ("1.jpg", "4.5"), ("9.jpg", "1")], "filename string, timestamp string")
    assert {tuple(r) for r in files.frame_times(frames, "path", times).collect()} == {("a/1.jpg", 4.5), ("2.jpg", None), (None, None)}
