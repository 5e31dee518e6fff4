"""Point clouds: grids, voxels, tiles, matches, error statistics. Neighbours are in :mod:`space`."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .orderstats import with_quantiles


def error_statistics(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, median, RMSE, exact percentiles and maximum."""
    v = F.col(value)
    sums = rows.groupBy(*by).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rmse"), F.max(v).alias("max"))
    places = {"median": 0.5, "p68": 0.68, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return with_quantiles(sums, rows, value, places, by).select(*by, "count", "mean", "median", "rmse", "p68", "p90", "p95", "p99", "max")


def coverage(rows: DataFrame, value: str, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows at or below each threshold; 0 when there are none."""
    return rows.groupBy(*by).agg(*(F.coalesce(F.avg((F.col(value) <= t).cast("double")), F.lit(0.0)).alias(f"within_{t:.2f}".replace(".", "_")) for t in thresholds))


def in_box(low: Sequence[float], high: Sequence[float], margin: float = 0.0) -> Column:
    """Inside an axis-aligned box drawn in by ``margin``, bounds included."""
    out = F.lit(True)
    for c, a, b in zip("xyz", low, high, strict=True):
        out = out & F.col(c).between(a + margin, b - margin)
    return out


def cell(points: DataFrame, resolution: float) -> DataFrame:
    """Adds raster ``row`` and ``col``; the origin is the cloud's upper left corner."""
    box = points.agg(F.min("x").alias("_x0"), F.max("y").alias("_y1"))
    out = points.crossJoin(F.broadcast(box))  # one row
    return out.withColumns({"col": F.floor((F.col("x") - F.col("_x0")) / resolution), "row": F.floor((F.col("_y1") - F.col("y")) / resolution)}).drop("_x0", "_y1")


def surface(cells: DataFrame) -> DataFrame:
    """Highest and lowest point of every occupied cell."""
    return cells.groupBy("row", "col").agg(F.max("z").alias("dsm"), F.min("z").alias("low"), F.count("*").alias("n"))


def top_colour(cells: DataFrame, colours: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Height and colour of the highest point of every cell, the last id on ties."""
    best = F.max(F.struct("z", "id", *colours)).alias("_b")
    return cells.groupBy("row", "col").agg(best).select("row", "col", F.col("_b.z").alias("dsm"), *(F.col(f"_b.{c}").alias(c) for c in colours))


def tiles(points: DataFrame, size: float, overlap: float, x0: float, y0: float) -> DataFrame:
    """A row for every tile whose half-open, widened box holds the point; ``inner`` marks the tile that owns it."""

    def span(c: str, origin: float) -> tuple[Column, Column]:
        return F.floor((F.col(c) - origin - overlap) / size), F.floor((F.col(c) - origin + overlap) / size)

    (a, b), (c, d) = span("x", x0), span("y", y0)
    out = points.withColumn("tx", F.explode(F.sequence(a, b))).withColumn("ty", F.explode(F.sequence(c, d)))
    lo_x, lo_y = x0 + F.col("tx") * size, y0 + F.col("ty") * size
    near = (F.col("x") >= lo_x - overlap) & (F.col("x") < lo_x + size + overlap) & (F.col("y") >= lo_y - overlap) & (F.col("y") < lo_y + size + overlap)
    inner = (F.floor((F.col("x") - x0) / size) == F.col("tx")) & (F.floor((F.col("y") - y0) / size) == F.col("ty"))
    return out.where(near).withColumn("inner", inner)


def voxel(size: float, axes: Sequence[str] = ("x", "y", "z")) -> list[Column]:
    return [F.floor(F.col(c) / size).alias(f"v{c}") for c in axes]


def voxel_sample(points: DataFrame, size: float, seed: int = 42) -> DataFrame:
    """One member of each voxel, the same for equal seeds whatever the partitioning."""
    row = F.struct(F.xxhash64(F.lit(seed), F.col("id")).alias("_k"), *points.columns)
    return points.groupBy(*voxel(size)).agg(F.min(row).alias("_r")).select("_r.*").select(*points.columns)


def whole(c: Column) -> Column:
    """Floor as a double: NaN, infinities and values beyond a long stay apart, which Spark's floor sends to 0 or the ends of a long."""
    return F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)


def voxel_apart(size: float, axes: Sequence[str] = ("x", "y", "z")) -> list[Column]:
    """Voxels by double numbers, so that coordinates that are no place have voxels of their own."""
    return [whole(F.col(c) / size).alias(f"v{c}") for c in axes]


def voxel_first(points: DataFrame, cells: Sequence[Column]) -> DataFrame:
    """The member of least id of each voxel, null ids last; of members of one id the least row, whatever the partitioning."""
    row = F.struct(F.col("id").isNull().alias("_last"), "id", *(c for c in points.columns if c != "id"))
    return points.groupBy(*cells).agg(F.min(row).alias("_r")).select("_r.*").select(*points.columns)


def voxel_centroids(points: DataFrame, size: float) -> DataFrame:
    return points.groupBy(*voxel(size)).agg(*(F.avg(c).alias(c) for c in "xyz"), F.count("*").alias("n"))


def dilate(cells: DataFrame, rounds: int) -> DataFrame:
    """Cells within ``rounds`` steps, a step being one of four directions."""
    steps = [(i, j) for i in range(-rounds, rounds + 1) for j in range(-rounds, rounds + 1) if abs(i) + abs(j) <= rounds]
    d = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))
    return cells.select("cx", "cy", d.alias("_d")).select((F.col("cx") + F.col("_d.i")).alias("cx"), (F.col("cy") + F.col("_d.j")).alias("cy")).distinct()


def ratio_matches(pairs: DataFrame, ratio: float, one_to_one: bool = True) -> DataFrame:
    """From ``(query, train, distance)``: nearest neighbours that are clearly nearer than the second, each train row once if asked."""
    w = Window.partitionBy("query").orderBy("distance", "train")
    two = pairs.withColumns({"_r": F.row_number().over(w), "_second": F.lead("distance").over(w)}).where("_r = 1").where(F.col("distance") < ratio * F.col("_second"))
    if one_to_one:
        best = F.min(F.struct("distance", "query")).alias("_b")
        return two.groupBy("train").agg(best).select(F.col("_b.query").alias("query"), "train", F.col("_b.distance").alias("distance"))
    return two.select("query", "train", "distance")


def diagonal(low: Sequence[float], high: Sequence[float]) -> float:
    return math.dist(low, high)
