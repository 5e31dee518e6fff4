"""Point files in byte ranges: exact round trips, several tasks a file, refused files."""

import struct

import numpy as np
import pytest

from kestrelframe.sources.records import _FORMATS, _HEADER, PointRecords


def read(spark, path, kind, records=100):
    spark.dataSource.register(PointRecords)
    return spark.read.format("point_records").option("path", str(path)).option("kind", kind).option("records", records).load()


def test_las_written_and_read_by_several_tasks(spark, tmp_path):
    df = spark.range(0, 1000, 1, 3).selectExpr("id", "cast(id * 0.25 - 70 as double) x", "cast(500000 + id * 0.001 as double) y", "cast(id % 17 as double) z", "cast(if(id % 5 = 0, null, id) as int) intensity", "cast(if(id % 7 = 0, null, id % 20) as int) classification")
    spark.dataSource.register(PointRecords)
    df.drop("id").write.format("point_records").option("path", str(tmp_path / "las")).mode("append").save()
    files = sorted((tmp_path / "las").iterdir())
    assert len(files) == 3 and all(f.suffix == ".las" for f in files)
    back = read(spark, tmp_path / "las", "las")
    assert back.rdd.getNumPartitions() == 12
    got = sorted((round(r.x, 3), round(r.y, 3), r.z, r.intensity, r.classification) for r in back.collect())
    want = sorted((round(r.x, 3), round(r.y, 3), r.z, r.intensity or 0, 1 if r.classification is None else r.classification) for r in df.collect())
    assert got == want
    for f in files:  # headers hold the numbers and bounds of their own file
        h = struct.unpack(_HEADER, f.read_bytes()[: struct.calcsize(_HEADER)])
        mine = back.where(f"file = '{f}'").selectExpr("count(*) n", "min(x) a", "max(z) b").first()
        assert h[15] == mine.n and abs(h[28] - mine.a) < 1e-9 and h[31] == mine.b and f.stat().st_size == 227 + 20 * mine.n


def test_las_with_time_and_colour_and_longer_records(spark, tmp_path):
    rows = np.zeros(5, np.dtype(_FORMATS[3]))
    rows["x"], rows["gps_time"], rows["blue"], rows["classification"] = np.arange(5), np.arange(5) + 0.5, 7, 2
    size = rows.dtype.itemsize + 4  # four extra bytes a record
    head = struct.pack(_HEADER, b"LASF", 0, 0, bytes(16), 1, 2, b"", b"", 1, 2000, 227, 240, 0, 3, size, 5, 5, 0, 0, 0, 0, 0.5, 0.5, 0.5, 10.0, 0.0, 0.0, *[0.0] * 6)
    (tmp_path / "a.las").write_bytes(head.ljust(240, b"\0") + b"".join(r.tobytes() + b"\xff" * 4 for r in rows))
    got = read(spark, tmp_path / "a.las", "las", 2).orderBy("pos").collect()
    assert [(r.pos, r.x, r.gps_time, r.blue, r.classification) for r in got] == [(k, 10 + k * 0.5, k + 0.5, 7, 2) for k in range(5)]


def test_ply_vertices_and_faces(spark, tmp_path):
    v = np.zeros(250, np.dtype([("nx", "<f4"), ("x", "<f8"), ("y", "<f4"), ("z", "<f4")]))
    v["x"], v["z"] = np.arange(250) * 0.1, 3
    f = np.zeros(130, np.dtype([("n", "u1"), ("v", "<i4", 3)]))
    f["n"], f["v"] = 3, np.arange(390).reshape(-1, 3) % 250
    head = b"ply\nformat binary_little_endian 1.0\ncomment x\nelement vertex 250\nproperty float nx\nproperty double x\nproperty float y\nproperty float z\nelement face 130\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "m.ply").write_bytes(head + v.tobytes() + f.tobytes())
    got = read(spark, tmp_path, "ply_vertices").orderBy("pos").toPandas()
    assert np.array_equal(got["x"], v["x"]) and (got["z"] == 3).all() and list(got["pos"]) == list(range(250))
    faces = read(spark, tmp_path, "ply_faces").orderBy("pos").toPandas()
    assert np.array_equal(faces[["v0", "v1", "v2"]].to_numpy(), f["v"])


def test_refused_and_empty(spark, tmp_path):
    with pytest.raises(Exception, match="no LAS header"):
        (tmp_path / "bad.las").write_bytes(b"nothing")
        read(spark, tmp_path / "bad.las", "las").count()
    (tmp_path / "none").mkdir()
    assert read(spark, tmp_path / "none", "las").count() == 0
    df = spark.createDataFrame([(None, 1.0, 1.0, 1, 1)], "x double, y double, z double, intensity int, classification int")
    with pytest.raises(Exception, match="finite"):
        df.write.format("point_records").option("path", str(tmp_path / "w")).mode("append").save()
    assert not list((tmp_path / "w").glob("*.las"))
