"""Joins along time: bracketing as-of, interpolation, nearest, tolerance.

Every join is an equi-join on the keys plus windows; none compares all pairs. Where
one key may hold much of the data, ``width`` cuts its time line into buckets that
are windowed apart; what a bucket needs from outside is the last sample before and
the first after it, carried over the few bucket rows. Probes whose key or time is null keep
their place in the result, with ``width`` or without.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bracket(probes: DataFrame, samples: DataFrame, by: Sequence[str], time: str, values: Sequence[str], width: float | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Each probe with ``prev`` and ``next``: the sample at or before it and the one at or after it (structs of time, ``ties`` and values, or null).

    Of samples at one time, ``prev`` is the last and ``next`` the first in the order of ``ties``, then of the values.
    """
    by = list(by)
    sample = F.struct(F.col(time), *(F.col(v) for v in dict.fromkeys([*ties, *values])))
    rows = probes.withColumn("_probe", F.lit(True)).unionByName(samples.select(*by, time, sample.alias("_s")).withColumn("_probe", F.lit(False)), allowMissingColumns=True)
    keys = by
    if width is not None:
        rows, keys = rows.withColumn("_bucket", F.floor(F.col(time) / width)), [*by, "_bucket"]
    at = Window.partitionBy(*keys)
    # a time's samples stand before its probes both ways
    up = at.orderBy(F.col(time), "_probe", "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = at.orderBy(F.col(time).desc(), "_probe", F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({"prev": F.last("_s", ignorenulls=True).over(up), "next": F.last("_s", ignorenulls=True).over(down)}).where("_probe").drop("_probe", "_s")
    if width is None:
        return out
    ends = rows.groupBy(*keys).agg(F.max("_s").alias("_last"), F.min("_s").alias("_first"))
    line = Window.partitionBy(*by)
    ends = ends.select(
        *keys,
        F.last("_last", ignorenulls=True).over(line.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_first", ignorenulls=True).over(line.orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    joined = _beside(out, ends, keys)
    return joined.withColumns({"prev": F.coalesce("prev", "_before"), "next": F.coalesce("next", "_after")}).drop("_before", "_after", "_bucket")


def _beside(rows: DataFrame, ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with what ``ends`` has for their keys; a null key or bucket is a key like any other, as in a window."""
    ends = ends.withColumnsRenamed({k: f"_end_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(ends[f"_end_{k}"]) for k in keys))
    return rows.join(ends, same).drop(*(f"_end_{k}" for k in keys))


def interpolate(bracketed: DataFrame, time: str, value: str, max_gap: float, has_stream: Column | None = None) -> DataFrame:
    """Adds ``status``, ``dt_s`` and ``value``; no value is made up beyond the samples or over gaps above ``max_gap``."""
    t, p, n = F.col(time), F.col("prev"), F.col("next")
    t1, t2 = p[time], n[time]
    missing = ~has_stream if has_stream is not None else t1.isNull() & t2.isNull()
    status = (
        F.when(missing, "MISSING_STREAM")
        .when(t1.isNull() | t2.isNull(), "OUTSIDE_SENSOR_RANGE")
        .when((t1 == t) | (t2 == t), "EXACT")
        .when(t2 - t1 > max_gap, "GAP_TOO_LARGE")
        .otherwise("INTERPOLATED")
    )
    return bracketed.withColumn("status", status).withColumns(
        {
            "dt_s": F.when(F.col("status").isin("GAP_TOO_LARGE", "INTERPOLATED"), F.least(t - t1, t2 - t)).otherwise(0.0),
            "value": F.when(F.col("status") == "EXACT", F.when(t1 == t, p[value]).otherwise(n[value])).when(F.col("status") == "INTERPOLATED", p[value] + (n[value] - p[value]) * F.try_divide(t - t1, t2 - t1)),
        }
    )


def clamped(bracketed: DataFrame, time: str, value: str) -> DataFrame:
    """Adds ``value``: linear between samples, constant beyond the first and last."""
    t, p, n = F.col(time), F.col("prev"), F.col("next")
    mixed = p[value] + (n[value] - p[value]) * F.coalesce(F.try_divide(t - p[time], n[time] - p[time]), F.lit(0.0))
    return bracketed.withColumn("value", F.when(p.isNull(), n[value]).when(n.isNull(), p[value]).otherwise(mixed))


def nearest(bracketed: DataFrame, time: str, value: str) -> DataFrame:
    """Adds ``value`` and ``error_s`` of the sample closest in time, the earlier one on ties."""
    t, p, n = F.col(time), F.col("prev"), F.col("next")
    later = p.isNull() | (n[time] - t < t - p[time])
    return bracketed.withColumns({"value": F.when(later, n[value]).otherwise(p[value]), "error_s": F.when(later, n[time] - t).otherwise(t - p[time])})


def first_within(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, ordinal: str, tolerance: float, keep: Sequence[str]) -> DataFrame:
    """Each left row with the right row of least ``ordinal`` among those less than ``tolerance`` away; rows without one drop.

    Times are dealt into buckets of the tolerance. A right row stands in its own bucket, whose left rows are all
    near enough, and in those beside it, where running minima from the common edge reach as far as the tolerance:
    work follows the rows, however many are near each other. Distances are compared as ``time`` plus or minus
    the tolerance. Equal left rows each keep their match; of equal ordinals the earliest time wins; null keys and
    times match nothing. ``keep`` columns have an order.
    """
    by = list(by)
    near = lambda df: df.where(reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in by), F.abs(F.col(time)) < float("inf")))
    bucket = F.floor(F.col(time) / tolerance)
    a = near(left).withColumns({"_k": bucket, "_low": F.col(time) - tolerance, "_high": F.col(time) + tolerance, "_sample": F.lit(False)})
    found = F.struct(F.col(ordinal).alias("_o"), F.col(time).alias("_t"), *(F.col(c).alias(f"m_{c}") for c in keep))
    sides = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), (bucket + d).alias("k")) for d in (-1, 0, 1))))
    b = near(right).select(*by, F.col(time).alias("_low"), F.col(time).alias("_high"), found.alias("_f"), sides.alias("_s"))
    b = b.select(*by, "_low", "_high", F.col("_s.k").alias("_k"), F.lit(True).alias("_sample"), *(F.when(F.col("_s.d") == d, F.col("_f")).alias(n) for d, n in ((1, "_before"), (0, "_own"), (-1, "_after"))))
    at = Window.partitionBy(*by, "_k")
    # a left row stands before the right rows at just the tolerance
    down, up = (at.orderBy(*o, "_sample").rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in ([F.col("_low").desc()], [F.col("_high")]))
    rows = a.unionByName(b, allowMissingColumns=True)
    best = rows.withColumn("_m", F.least(F.min("_before").over(down), F.min("_own").over(at), F.min("_after").over(up))).where(~F.col("_sample") & F.col("_m").isNotNull())
    return best.select(*left.columns, F.col("_m._t").alias("match_t"), *(F.col(f"_m.m_{c}").alias(f"m_{c}") for c in keep))
