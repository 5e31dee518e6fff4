"""What missions leave behind: tables, reports, manifests, artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import camera_centre
from ..functions.messages import EMPTY_DENSE, EMPTY_SPARSE
from ..operators import clouds
from ..storage import materialise


def finite(df: DataFrame) -> DataFrame:
    """Numbers that JSON cannot hold become null."""
    fix = {c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fix) if fix else df


def csv_table(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Fixed columns in order, empty where null."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def json_report(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    finite(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Size, SHA-256, format and status of every file below a folder; files are hashed where they are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.upper(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("format"), F.when(F.col("length") > 0, "VERIFIED").otherwise("FAILED").alias("status"))


FORMATS = ("PLY", "LAS", "GLB", "GLTF", "OBJ", "FBX", "TIF", "JSON")


def deliverables(files: DataFrame, formats: Sequence[str] = FORMATS) -> DataFrame:
    """Every format once, with whether it is there and verified."""
    want = files.sparkSession.createDataFrame([(f,) for f in formats], "format string")
    have = files.groupBy("format").agg(F.count("*").alias("files"), F.bool_and(F.col("status") == "VERIFIED").alias("ok"))
    out = want.join(F.broadcast(have), "format", "left")
    return out.select("format", F.col("files").isNotNull().alias("available"), F.coalesce("ok", F.lit(False)).alias("verified"), F.coalesce("files", F.lit(0)).alias("files"))


def heatmap(df: DataFrame, value: str, path: str, available: bool = True) -> DataFrame:
    """Writes values as 32-bit numbers beside their summary row, or the summary alone; returns it."""
    v = F.col(value)
    head = df.agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median")).withColumn("status", F.lit("AVAILABLE" if available else "UNAVAILABLE"))
    if available:
        df.select(v.cast("float").alias("value")).write.mode("overwrite").parquet(f"{path}/values")
    json_report(head, f"{path}/summary")
    return head


def fixed_width(df: DataFrame, columns: Sequence[tuple[str, int]], digits: int = 4) -> DataFrame:
    """Lines of padded cells; numbers with ``digits`` decimals, N/A where null."""
    kinds = dict(df.dtypes)

    def cell(name: str, width: int) -> Column:
        c = F.format_string(f"%.{digits}f", F.col(name)) if kinds[name] in ("double", "float") else F.col(name).cast("string")
        return F.rpad(F.when(F.col(name).isNull(), "N/A").otherwise(c), width, " ")

    return df.select(F.rtrim(F.concat(*(cell(n, w) for n, w in columns))).alias("value"))


def text_report(df: DataFrame, columns: Sequence[tuple[str, int]], path: str) -> None:
    fixed_width(df, columns).write.mode("overwrite").text(path)


def parquet_arrays(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def conversion_report(spark: SparkSession, dataset: str, sequence: str, inputs: DataFrame, outputs: DataFrame, rows: int) -> DataFrame:
    """One row: what a conversion read and wrote."""
    files = lambda df, name: df.agg(F.sort_array(F.collect_list("path")).alias(name))  # noqa: E731  a conversion's files are one field of its report
    head = spark.range(1).select(F.lit(dataset).alias("dataset"), F.lit(sequence).alias("sequence"))
    return head.crossJoin(files(inputs, "input_files")).crossJoin(files(outputs, "output_files")).withColumn("rows_converted", F.lit(rows).cast("long"))


def thinned(points: DataFrame, size: float, max_points: int) -> DataFrame:
    """The cloud itself if it has at most ``max_points``; else the first point of each voxel, voxels doubling from ``size`` until there are so few.

    The points are read once for their voxels; larger voxels are counted from the smaller ones that they hold.
    """
    if points.count() <= max_points:
        return points
    cells = materialise(points.select(*clouds.voxel(size)).distinct(), "voxels")
    while cells.count() > max_points:
        size *= 2
        cells = materialise(cells.select(*(F.floor(F.col(f"v{c}") / 2).alias(f"v{c}") for c in "xyz")).distinct(), "voxels")
    return clouds.voxel_first(points, clouds.voxel(size))


def viewer_artifacts(sparse: DataFrame, cameras: DataFrame, dense: DataFrame, faces: DataFrame, path: str, size: float, max_points: int = 2_000_000) -> DataFrame:
    """Files for a browser below ``path``, and a row ``(artifact, available, reason, n)`` for each.

    ``sparse`` points go out as they are (Parquet), of ``cameras(r, t)`` (rotations by rows, translations) the centres (JSON
    lines; poses that are not three by four drop); ``dense`` goes :func:`thinned`; of ``faces`` with a ``support`` class a
    count by class goes out. An empty input writes nothing and is not available.
    """
    spark = sparse.sparkSession
    whole = cameras.where((F.size("r") == 9) & (F.size("t") == 3))
    r = [[F.get("r", F.lit(3 * i + j)) for j in range(3)] for i in range(3)]
    centres = whole.select(*(c.alias(n) for c, n in zip(camera_centre(r, tuple(F.get("t", F.lit(i)) for i in range(3))), "xyz", strict=True)))
    parts = [
        ("sparse", sparse, "parquet", EMPTY_SPARSE), ("cameras", centres, "json", "No cameras"),
        ("dense_display", thinned(dense, size, max_points), "parquet", EMPTY_DENSE), ("support", faces.groupBy("support").agg(F.count("*").alias("faces")), "json", "No faces"),
    ]
    rows = []
    for name, df, kind, reason in parts:
        empty, to = df.isEmpty(), f"{path}/{name}"
        if not empty:
            df.write.mode("overwrite").format(kind).save(to)
        n = 0 if empty else spark.read.schema(df.schema).format(kind).load(to).count()
        rows.append((name, not empty, reason if empty else None, n))
    return spark.createDataFrame(rows, "artifact string, available boolean, reason string, n long")
