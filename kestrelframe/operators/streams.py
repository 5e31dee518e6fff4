"""Ordered-neighbour operators on sensor streams: statistics, gaps, duplicates, sampling.

Where one stream may hold much of the data, ``width`` (in units of the first order
column) cuts it into buckets that are windowed apart; a bucket's first row takes its
neighbour from the last row of the bucket before, carried over the few bucket rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geodesy import planar_step
from .asof import _beside


def deduplicate(samples: DataFrame, by: Sequence[str], time: str, seq: str, keep: str = "first") -> DataFrame:
    """One sample for each time: the first or the last in source order."""
    pick = F.min_by if keep == "first" else F.max_by
    row = F.struct(*(c for c in samples.columns if c not in (*by, time)))
    return samples.groupBy(*by, time).agg(pick(row, F.col(seq)).alias("_r")).select(*by, time, "_r.*").select(*samples.columns)


def previous(rows: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str = "prev", width: float | None = None) -> DataFrame:
    """Adds ``name``, a struct of the previous row's ``columns`` in ``order`` (null on the first row)."""
    row = F.struct(*columns)
    if width is None:
        return rows.withColumn(name, F.lag(row).over(Window.partitionBy(*by).orderBy(*order)))
    keys = [*by, "_bucket"]
    cut = rows.withColumn("_bucket", F.floor(F.col(order[0]) / width))
    local = cut.withColumn("_local", F.lag(row).over(Window.partitionBy(*keys).orderBy(*order)))
    ends = cut.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_last"))
    ends = ends.select(*keys, F.lag("_last").over(Window.partitionBy(*by).orderBy("_bucket")).alias("_carry"))
    joined = _beside(local, ends, keys)
    return joined.withColumn(name, F.coalesce("_local", "_carry")).select(*rows.columns, name)


def statistics(samples: DataFrame, by: Sequence[str], time: str, seq: str, time_width: float | None = None, seq_width: float | None = None) -> DataFrame:
    """Per stream: kept samples, ends, duration, duplicates, backward steps in source order, largest gap, order flags.

    Rows of one ``seq`` stand in the order of time: equal rows then give equal results on any partitioning.
    """
    near = previous(samples, by, [seq, time], [time], "_source", seq_width)
    near = previous(near, by, [time, seq], [time], "_line", time_width)
    before, earlier = F.col("_source")[time], F.col("_line")[time]
    flagged = near.withColumns({"_back": (F.col(time) < before).cast("long"), "_same": (F.col(time) == earlier).cast("long"), "_gap": F.col(time) - earlier})
    return flagged.groupBy(*by).agg(
        (F.count("*") - F.coalesce(F.sum("_same"), F.lit(0))).alias("sample_count"),
        F.min(time).alias("start_time"),
        F.max(time).alias("end_time"),
        (F.max(time) - F.min(time)).alias("duration"),
        F.coalesce(F.sum("_same"), F.lit(0)).alias("duplicate_count"),
        F.coalesce(F.sum("_back"), F.lit(0)).alias("backward_count"),
        F.coalesce(F.max("_gap"), F.lit(0.0)).alias("largest_gap_s"),
        (F.coalesce(F.sum("_back"), F.lit(0)) == 0).alias("source_was_monotonic"),
        (F.coalesce(F.sum("_back"), F.lit(0)) > 0).alias("rows_reordered"),
    )


def coverage(stats: DataFrame, mission_start: Column, mission_end: Column) -> DataFrame:
    """Overlap of each stream with the mission and its share; null and 0 for a stream without samples."""
    lo, hi = F.greatest(mission_start, F.col("start_time")), F.least(mission_end, F.col("end_time"))
    has = F.col("start_time").isNotNull()
    lo, hi = F.when(has, lo), F.when(has, hi)
    return stats.withColumns({"overlap_start": lo, "overlap_end": hi, "overlap_duration": hi - lo, "coverage_fraction": F.greatest(F.lit(0.0), F.coalesce(F.try_divide(hi - lo, mission_end - mission_start), F.lit(0.0)))})


def steps(track: DataFrame, by: Sequence[str], time: str, lat: str, lon: str, width: float | None = None) -> DataFrame:
    """Adds ``dt``, ``step_m`` and ``speed`` from the previous fix; null on the first."""
    p = F.col("_prev")
    out = previous(track, by, [time], [time, lat, lon], "_prev", width)
    out = out.withColumns({"dt": F.col(time) - p[time], "step_m": planar_step(p[lat], p[lon], F.col(lat), F.col(lon))}).drop("_prev")
    return out.withColumn("speed", F.when(F.col("dt") > 0, F.try_divide("step_m", "dt")).when(F.col("dt").isNotNull(), 0.0))


def audit(track: DataFrame, by: Sequence[str], time: str, lat: str, lon: str, max_gap: float = 3.0, max_speed: float = 35.0, width: float | None = None) -> DataFrame:
    """Gaps, outliers, stationary steps, and whether gaps block the mission."""
    s = F.col("speed")
    return steps(track, by, time, lat, lon, width).groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("dt") > max_gap).alias("gaps"),
        F.count_if(s > max_speed).alias("outliers"),
        F.count_if((s <= max_speed) & (s < 0.2)).alias("stationary"),
    ).withColumn("blocked", (F.col("gaps") > 5) | (F.col("gaps") / F.col("rows") > 0.1))


def order_faults(rows: DataFrame, by: Sequence[str], seq: str, time: str, width: float | None = None) -> DataFrame:
    """Steps back and repeats in source order, and the largest step back; rows of one ``seq`` stand in the order of time."""
    d = F.col(time) - F.col("_prev")[time]
    near = previous(rows, by, [seq, time], [time], "_prev", width).withColumn("_d", d)
    return near.groupBy(*by).agg(F.count_if(F.col("_d") < 0).alias("backward"), F.count_if(F.col("_d") == 0).alias("duplicates"), F.coalesce(F.min(F.when(F.col("_d") < 0, F.col("_d"))), F.lit(0.0)).alias("largest_jump_back"))


def stratified(frames: int, fps: Column | float, window_s: float = 5.0, per_window: int = 3):
    """Predicate over a frame index: every step-th frame of each window, step = frames in window div ``per_window``."""

    def keep(index: Column) -> Column:
        size = F.greatest(F.lit(1), F.floor(window_s * (fps if isinstance(fps, Column) else F.lit(fps))).cast("long"))
        start = F.floor(index / size) * size
        length = F.least(start + size, F.lit(frames)) - start
        step = F.greatest(F.lit(1), F.floor(length / per_window).cast("long"))
        return (index - start) % step == 0

    return keep


def chunk_best(candidates: DataFrame, index: str, total: int, target: int, score: Column) -> DataFrame:
    """First, last, and the best-scored candidate of each of ``target - 2`` chunks between; earliest on ties."""
    step = (total - 2) / max(1, target - 2)
    at = F.col(index) - 1
    j = F.least(F.floor(at / step), F.lit(target - 3))
    # int(j * step) cuts the chunks; a candidate may sit just across floor's rounding
    j = F.when(at < F.floor(j * step), j - 1).when(at >= F.floor((j + 1) * step), j + 1).otherwise(j)
    inner = candidates.where((F.col(index) > 0) & (F.col(index) < total - 1)).withColumns({"_j": j, "_s": score})
    inner = inner.where((F.col("_j") >= 0) & (F.col("_j") < target - 2))
    best = inner.groupBy("_j").agg(F.max(F.struct(F.col("_s"), -F.col(index))).alias("_b")).select((-F.col("_b.col2")).alias(index))
    return best.unionByName(candidates.where(F.col(index).isin(0, total - 1)).select(index)).distinct()


def bridge(selected: DataFrame, index: str, total: int, target: int) -> DataFrame:
    """Adds the midpoint of every gap above one and a half expected steps; one pass.

    The selection has at most ``target`` rows, so one ordered window holds it.
    """
    nxt = F.lead(index).over(Window.orderBy(index))
    gaps = selected.select(F.col(index), nxt.alias("_n")).where(F.col("_n") - F.col(index) > total / target * 1.5)
    return selected.select(index).unionByName(gaps.select(F.floor((F.col(index) + F.col("_n")) / 2).alias(index))).distinct()


def every_nth(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("_k", rank).where(F.col("_k") % n == 0).drop("_k")


def evenly_spaced(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """``n`` rows of each group at positions ``int(i * size / n)``; all rows of smaller groups."""
    w = Window.partitionBy(*by)
    at = rows.withColumns({"_k": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    i = F.ceil(F.col("_k") * n / F.col("_n"))
    return at.where((F.col("_n") <= n) | ((i < n) & (F.floor(i * F.col("_n") / n) == F.col("_k")))).drop("_k", "_n")


def skip_pairs(rows: DataFrame, by: Sequence[str], order: str, value: str, skip: int = 2) -> DataFrame:
    """Pairs of each row with the ``skip``-th after it."""
    return rows.select(*by, F.col(value).alias("a"), F.lead(value, skip).over(Window.partitionBy(*by).orderBy(order)).alias("b")).where("b IS NOT NULL")


def drift(pairs: DataFrame, by: Sequence[str], time: str, truth: str, measured: str) -> DataFrame:
    """Least-squares bias and drift of ``truth - measured`` over relative time, and the residuals' spread."""
    start = pairs.groupBy(*by).agg(F.min(time).alias("_start"))
    rel = (_beside(pairs, start, by) if by else pairs.crossJoin(F.broadcast(start))).withColumns({"_t": F.col(time) - F.col("_start"), "_d": F.col(truth) - F.col(measured)})
    n, st, sd, stt, std, sdd = (F.col(c) for c in ("n", "st", "sd", "stt", "std", "sdd"))
    sums = rel.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_t").alias("st"), F.sum("_d").alias("sd"), F.sum(F.col("_t") * F.col("_t")).alias("stt"), F.sum(F.col("_t") * F.col("_d")).alias("std"), F.sum(F.col("_d") * F.col("_d")).alias("sdd"))
    fits = (n > 2) & (n * stt - st * st > 0)
    slope = F.when(fits, F.try_divide(n * std - st * sd, n * stt - st * st)).otherwise(0.0)
    out = sums.withColumn("drift", slope).withColumn("bias", (sd - F.col("drift") * st) / n)
    var = (sdd + F.col("bias") * F.col("bias") * n + F.col("drift") * F.col("drift") * stt - 2 * F.col("bias") * sd - 2 * F.col("drift") * std + 2 * F.col("bias") * F.col("drift") * st) / n
    return out.select(*by, F.col("n").alias("rows"), "bias", "drift", F.when(fits, F.sqrt(F.greatest(F.lit(0.0), var))).otherwise(0.0).alias("residual_std"))
