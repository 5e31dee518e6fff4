"""Mission files as DataFrames: telemetry, metadata, checkpoints, sensor logs, point and camera files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """All cells as text: values are judged cell by cell, not by the parser."""
    return spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def _either(df: DataFrame, *names: str) -> Column:
    have = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def epoch_of(text: Column) -> Column:
    """Seconds since 1970 from a zoned ISO time or a plain number; null for times without a zone."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.contains("T")
    return F.coalesce(F.when(zoned, F.unix_micros(F.try_to_timestamp(text)) / 1e6), number(text))


TELEMETRY_OPTIONAL = ("compass_heading_deg", "gimbal_pitch_deg", "gimbal_yaw_deg", "speed_mps", "satellites", "rtk_quality", "heading")


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """GPS telemetry: ``seq, time, frame, latitude, longitude, altitude_m``, the optional columns as text, and ``errors``.

    Rows are kept with what is wrong with them (an empty list: nothing). ``frame`` is 0
    where the file has none, and its order is then not checked. The order of rows is the
    file's; a mission's telemetry is one file, so one ordered window reads it.
    """
    raw = _csv(spark, path)
    place = F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    has_frame = "frame" in raw.columns
    df = raw.select(
        place.alias("_at"),
        epoch_of(_either(raw, "timestamp_utc", "timestamp")).alias("time"),
        (number(F.col("frame")) if has_frame else F.lit(0.0)).alias("frame"),
        number(_either(raw, "latitude")).alias("latitude"),
        number(_either(raw, "longitude")).alias("longitude"),
        number(_either(raw, "altitude_m", "altitude")).alias("altitude_m"),
        *(F.col(c) for c in TELEMETRY_OPTIONAL if c in raw.columns),
    )
    w = Window.partitionBy("_at.f").orderBy("_at.i")
    bad = [
        (F.col("time").isNull(), "timestamp"),
        (F.coalesce(~F.col("latitude").between(-90, 90), F.lit(True)), "latitude"),
        (F.coalesce(~F.col("longitude").between(-180, 180), F.lit(True)), "longitude"),
        (F.coalesce(~F.col("altitude_m").between(-1000, 20000), F.lit(True)), "altitude"),
        (F.col("time") <= F.lag("time").over(w), "time order"),
        (F.col("frame").isNull() | (F.col("frame") < 0) | (F.col("frame") % 1 != 0), "frame"),
    ] + ([(F.col("frame") <= F.lag("frame").over(w), "frame order")] if has_frame else [])
    errors = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in bad)))
    return df.withColumns({"errors": errors, "seq": F.row_number().over(w) - 1}).withColumn("frame", F.col("frame").cast("int")).drop("_at")


FLIGHT = "mission_name string, drone_model string, camera_sensor string, video_file string, video_resolution array<int>, video_fps double, video_duration_sec double, home_point struct<latitude double, longitude double, altitude_m double>, start_time_utc string, end_time_utc string, camera_intrinsics struct<focal_length_mm double, sensor_width_mm double, sensor_height_mm double, image_width_px int, image_height_px int>, synthetic boolean"
FLIGHT_REQUIRED = ("mission_name", "drone_model", "camera_sensor", "video_file", "video_resolution", "video_fps", "video_duration_sec", "home_point", "start_time_utc", "end_time_utc", "camera_intrinsics")


def flight(spark: SparkSession, path: str) -> DataFrame:
    """Flight metadata documents with ``errors``."""
    return flight_errors(spark.read.schema(FLIGHT).option("multiLine", True).json(path))


def flight_errors(df: DataFrame) -> DataFrame:
    """Adds ``errors``: missing keys, rates and durations that are not positive, homes off the globe, times out of order."""
    start, end, home = epoch_of(F.col("start_time_utc")), epoch_of(F.col("end_time_utc")), F.col("home_point")
    bad = [(F.col(c).isNull(), F.lit(f"missing {c}")) for c in FLIGHT_REQUIRED]
    bad += [(~(F.col(c) > 0) | (F.abs(F.col(c)) == float("inf")), F.lit(f"{c} not positive")) for c in ("video_fps", "video_duration_sec")]
    bad += [(~home["latitude"].between(-90, 90) | ~home["longitude"].between(-180, 180), F.lit("home point")), (start.isNull() | end.isNull(), F.lit("time without zone")), (end <= start, F.lit("times not increasing"))]
    return df.withColumn("errors", F.array_compact(F.array(*(F.when(c, t) for c, t in bad))))


def intrinsics(meta: DataFrame, width: int, height: int, override: Sequence[float] | None = None) -> DataFrame:
    """``fx, fy, cx, cy`` for an image size: the override, else from metadata, else a prior of 0.85 widths."""
    k = F.col("camera_intrinsics")
    own = F.try_divide(k["focal_length_mm"], k["sensor_width_mm"]) * width
    f = F.lit(float(override[0])) if override else F.coalesce(own, F.lit(0.85 * width))
    g = F.lit(float(override[1])) if override else F.coalesce(F.try_divide(k["focal_length_mm"], k["sensor_height_mm"]) * height, f)
    source = F.lit("OVERRIDE") if override else F.when(own.isNotNull(), "METADATA").otherwise("PRIOR")
    return meta.select("*", f.alias("fx"), g.alias("fy"), F.lit(width / 2).alias("cx"), F.lit(height / 2).alias("cy"), source.alias("source"))


DATUMS = ("WGS84_ELLIPSOID", "EGM96", "EGM2008", "LOCAL")


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Survey points with ``errors`` and ``warnings``; explicit matches count only when all three coordinates are given."""
    raw = _csv(spark, path)
    raw = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    text = lambda n: F.trim(_either(raw, n))
    recon = [number(_either(raw, f"recon_{c}")) for c in "xyz"]
    all_three = recon[0].isNotNull() & recon[1].isNotNull() & recon[2].isNotNull()
    df = raw.select(
        text("checkpoint_id").alias("checkpoint_id"),
        *(number(_either(raw, c)).alias(c) for c in ("latitude", "longitude", "elevation")),
        *(F.when(all_three, r).alias(f"recon_{c}") for r, c in zip(recon, "xyz", strict=True)),
        F.coalesce(F.upper(text("role")), F.lit("CHECKPOINT")).alias("role"),
        F.upper(text("vertical_datum")).alias("stated_datum"),
    )
    known = F.coalesce(F.col("stated_datum").isin(*DATUMS), F.lit(False))
    copies = F.count("*").over(Window.partitionBy("checkpoint_id"))
    bad = [
        (F.col("checkpoint_id").isNull() | (F.col("checkpoint_id") == ""), "id"),
        (copies > 1, "duplicate id"),
        (F.coalesce(~F.col("latitude").between(-90, 90), F.lit(True)), "latitude"),
        (F.coalesce(~F.col("longitude").between(-180, 180), F.lit(True)), "longitude"),
        (F.col("elevation").isNull(), "elevation"),
        (~F.col("role").isin("CONTROL", "CHECKPOINT"), "role"),
    ]
    errors = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in bad)))
    warnings = F.array_compact(F.array(F.when(F.col("stated_datum").isNotNull() & ~known, F.lit("unknown datum"))))
    return df.withColumns({"errors": errors, "warnings": warnings, "vertical_datum": F.when(known, F.col("stated_datum")).otherwise("UNKNOWN")}).drop("stated_datum")


def streams(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``(stream, t, v)`` of canonical files ``gps``, ``imu``, ``barometer``; an IMU file gives up to three streams. Files that are left out are empty streams."""
    values = {"gps": {"gps": ("lat", "lon", "alt")}, "imu": {"accel": ("accel_x", "accel_y", "accel_z"), "gyro": ("gyro_x", "gyro_y", "gyro_z"), "orientation": ("q_w", "q_x", "q_y", "q_z")}, "barometer": {"barometer": ("pressure", "temperature")}}
    out = spark.createDataFrame([], "stream string, t double, v array<double>")
    for kind, path in paths.items():
        raw = _csv(spark, path)
        t = number(_either(raw, "canonical_time_s", "canonical_unix_timestamp"))
        for name, columns in values[kind].items():
            if columns[0] in raw.columns:
                v = F.array(*(number(_either(raw, c)) for c in columns))
                out = out.unionByName(raw.select(F.lit(name).alias("stream"), t.alias("t"), v.alias("v")).where("t IS NOT NULL AND v[0] IS NOT NULL"))
    return out


def corrections(spark: SparkSession, path: str, fps: float, start: float) -> DataFrame:
    """Correction rows by time: the file's own time, else the frame's."""
    raw = _csv(spark, path)
    t = F.coalesce(epoch_of(_either(raw, "timestamp_utc")), number(_either(raw, "frame")) / fps + start)
    keep = [c for c in raw.columns if c not in ("timestamp_utc", "frame")]
    return raw.select(t.alias("t"), *(number(F.col(c)).alias(c) for c in keep))


def trajectory(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Numbers separated by spaces, without a header."""
    raw = _csv(spark, path, sep=" ", header=False)
    return raw.select(*(number(F.col(f"_c{k}")).alias(n) for k, n in enumerate(names)))


def sfm_images(spark: SparkSession, path: str) -> DataFrame:
    """Text model of posed images, a task for each file: two lines an image, the second its 2-D points. ``(image_id, q, t, name, points)``."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), F.posexplode(F.filter(F.split("value", "\n"), lambda s: ~s.startswith("#"))).alias("k", "line"))
    line = lines.select("f", F.floor(F.col("k") / 2).alias("g"), (F.col("k") % 2).alias("half"), F.trim("line").alias("line")).groupBy("f", "g").agg(F.max(F.when(F.col("half") == 0, F.col("line"))).alias("head"), F.max(F.when(F.col("half") == 1, F.col("line"))).alias("tail")).where("head <> ''")
    h, p = F.split("head", " +"), F.split("tail", " +")
    d = lambda k: F.get(h, F.lit(k)).cast("double")
    every_third = F.filter(F.transform(p, lambda x, i: F.when(i % 3 == 2, x.try_cast("long"))), lambda x: x.isNotNull() & (x != -1))
    return line.select(F.get(h, F.lit(0)).cast("long").alias("image_id"), F.array(*(d(k) for k in range(1, 5))).alias("q"), F.array(*(d(k) for k in range(5, 8))).alias("t"), F.get(h, F.lit(9)).alias("name"), F.array_distinct(F.coalesce(every_third, F.array().cast("array<long>"))).alias("points"))


def image_points(images: DataFrame) -> DataFrame:
    """``(image_id, point_id)``, each once."""
    return images.select("image_id", F.explode("points").alias("point_id"))


def sfm_points(spark: SparkSession, path: str) -> DataFrame:
    """Text model of 3-D points: ``(point_id, x, y, z, r, g, b, error, track)``."""
    v = F.split(F.trim("value"), " +")
    n = lambda k, t="double": F.get(v, F.lit(k)).cast(t)
    lines = spark.read.text(path).where("value NOT LIKE '#%' AND trim(value) <> ''")
    return lines.select(n(0, "long").alias("point_id"), *(n(k).alias(c) for k, c in enumerate("xyz", 1)), *(n(k, "int").alias(c) for k, c in enumerate("rgb", 4)), n(7).alias("error"), F.floor((F.size(v) - 8) / 2).cast("int").alias("track"))


_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def _ply_header(data: bytes) -> tuple[str, list[tuple[str, int, list[tuple]]], int]:
    end = data.index(b"end_header")
    body = data.index(b"\n", end) + 1
    kind, elements = "", []
    for line in data[:end].decode("ascii").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append(tuple(w[1:]))
    return kind, elements, body


def ply_vertices(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of PLY files (ASCII or little-endian): ``(path, vid, x, y, z)`` with vid the place in the file; a file is one task's work."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                kind, elements, at = _ply_header(data)
                for element, n, properties in elements:
                    if element != "vertex":
                        break  # the vertices come first in every file that this reads
                    names = [p[-1] for p in properties]
                    if kind == "ascii":
                        rows = np.array([ln.split()[: len(names)] for ln in data[at:].split(b"\n", n)[:n]], dtype="f8").reshape(n, len(names))
                        got = {c: rows[:, names.index(c)] for c in "xyz"}
                    else:
                        dtype = np.dtype([(p[-1], "<" + _PLY[p[0]]) for p in properties])
                        rows = np.frombuffer(data, dtype, n, at)
                        got = {c: rows[c].astype("f8") for c in "xyz"}
                    yield pd.DataFrame({"path": name, "vid": np.arange(n), **got})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, vid long, x double, y double, z double")


def ply_faces(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of little-endian PLY files: ``(path, fid, v0, v1, v2)``; ASCII files and other polygons give none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                kind, elements, at = _ply_header(data)
                for element, n, properties in elements:
                    if kind == "ascii":
                        break
                    if element == "vertex":
                        at += n * sum(np.dtype(_PLY[p[0]]).itemsize for p in properties)
                    elif element == "face":
                        count, index = np.dtype("<" + _PLY[properties[0][1]]), np.dtype("<" + _PLY[properties[0][2]])
                        tri = np.dtype([("n", count), ("v", index, 3)])
                        rows = np.frombuffer(data, tri, n, at) if len(properties) == 1 and len(data) - at == n * tri.itemsize else None
                        if rows is None or (rows["n"] != 3).any():  # mixed polygons: walk
                            found, p = [], at
                            extra = sum(np.dtype(_PLY[q[0]]).itemsize for q in properties[1:])
                            for _ in range(n):
                                k = int(np.frombuffer(data, count, 1, p)[0])
                                p += count.itemsize
                                if k == 3:
                                    found.append(np.frombuffer(data, index, 3, p))
                                p += k * index.itemsize + extra
                            v = np.array(found, dtype="i8").reshape(-1, 3)
                        else:
                            v = rows["v"].astype("i8")
                        yield pd.DataFrame({"path": name, "fid": np.arange(len(v)), "v0": v[:, 0], "v1": v[:, 1], "v2": v[:, 2]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, fid long, v0 long, v1 long, v2 long")


SENSOR_LOGS = ("gps", "accel", "gyro", "baro")


def sensor_zip(spark: SparkSession, path: str) -> DataFrame:
    """Sensor logs inside zip files: ``(stream, seq, t, v)`` from members named after their stream.

    The first column of a log is a time in microseconds (0 where it cannot be read), the others are numbers.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for batch in batches:
            for data in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for member in z.namelist():
                        stream = next((s for s in SENSOR_LOGS if s in member.rsplit("/", 1)[-1].lower()), None)
                        if stream is None or not member.endswith(".csv"):
                            continue
                        log = pd.read_csv(z.open(member), dtype=str, skipinitialspace=True)
                        t = pd.to_numeric(log.iloc[:, 0], errors="coerce").fillna(0.0) / 1e6
                        v = log.iloc[:, 1:].apply(pd.to_numeric, errors="coerce").to_numpy(float)
                        yield pd.DataFrame({"stream": stream, "seq": np.arange(len(log)), "t": t, "v": list(v)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "stream string, seq long, t double, v array<double>")


EVENT = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("progress", T.DoubleType()), T.StructField("message", T.StringType()), T.StructField("elapsed_sec", T.DoubleType())])


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: ``(path, bytes, modified)``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def frame_times(frames: DataFrame, path: str, times: DataFrame) -> DataFrame:
    """Frames with the ``time_sec`` that ``times(filename, timestamp)`` gives for the last part of their path; null if none does, the latest row if several do."""
    known = times.groupBy(F.col("filename").alias("_f")).agg(F.max(F.col("timestamp").cast("double")).alias("time_sec"))
    return frames.join(known, F.element_at(F.split(path, "/"), -1) == F.col("_f"), "left").drop("_f")
