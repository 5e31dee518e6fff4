"""Exact quantiles of any number of groups, without a group in one task.

Values fall into bins by a monotone map of the value (sign and logarithm), so a first
pass needs no bounds: it counts each group's bins, with their least and greatest
value. Running counts over a group's bins (at most some 12,000, whatever its rows) tell
which bins hold the wanted ranks. Rows of those bins alone are read on: bins above
``ROWS`` rows are cut into ``CUTS`` equal ranges, again and again, and a bin that is
small, or holds one value, gives up its ranks. Every pass is a partial aggregate, and
no task ever sorts more than ``ROWS`` rows of a group.

Nulls are left out; NaN is the greatest value, as in Spark's own order. Groups by
null are groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialise

ROWS = 1 << 16
CUTS = 1 << 12
_INF = float("inf")


def _bin(v: Column) -> Column:
    """A bin of about a quarter's relative width; never falls when ``v`` grows."""
    size = lambda x: F.log(x) + 800
    place = F.when(v > 0, size(v)).when(v < 0, -size(-v)).otherwise(0.0)
    return F.when(F.isnan(v), 1 << 20).when(v == _INF, 1 << 19).when(v == -_INF, -(1 << 19)).otherwise(F.floor(place * 4)).cast("long")


def _spread(total: Column, wanted: Mapping[str, float | tuple[str, float]]) -> dict[str, tuple[Column, Column]]:
    """For each statistic, the place between ranks that it asks for, and the rank below it."""
    out = {}
    for name, w in wanted.items():
        at = F.lit(w) * (total - 1) if isinstance(w, float) else F.least(F.floor(F.lit(w[1]) * total), total - 1).cast("double")
        out[name] = (at, F.floor(at))
    return out


def _ranks(total: Column, wanted: Mapping[str, float | tuple[str, float]]) -> Column:
    low = [r for _, r in _spread(total, wanted).values()]
    return F.array_distinct(F.array(*low, *(F.least(r + 1, total - 1) for r in low)))


def _held(hist: DataFrame, keys: Sequence[str], bin_: str, ranks: Column, before: Column) -> DataFrame:
    """Bins of a histogram ``(keys, bin, n, lo, hi)`` with ``below``, the rows under them, and ``ranks``, the wanted ranks that they hold."""
    w = Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    out = hist.withColumn("below", before + F.coalesce(F.sum("n").over(w), F.lit(0)))
    mine = F.filter(ranks, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))
    return out.withColumn("ranks", mine).where(F.size("ranks") > 0)


def quantiles(rows: DataFrame, value: str, wanted: Mapping[str, float | tuple[str, float]], by: Sequence[str] = (), most: int = ROWS, cuts: int = CUTS) -> DataFrame:
    """``(*by, *wanted)``: one row for each group that has a value.

    A statistic is a fraction, read between ranks in a straight line, or ``("upper",
    fraction)``, the value at rank ``floor(fraction * n)`` counted from 0.
    """
    keys = [f"_g{k}" for k in range(len(by))]
    data = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    data = data.withColumn("_b", _bin(F.col("_v")))
    hist = data.groupBy(*keys, "_b").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    hist = hist.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    bins = _held(hist, keys, "_b", _ranks(F.col("total"), wanted), F.lit(0))
    bins = materialise(bins.withColumn("_k", F.monotonically_increasing_id()), "quantile_bins")
    one = (F.col("n") == 1) | F.col("lo").eqNullSafe(F.col("hi"))
    found = bins.where(one).select(*keys, "total", F.explode("ranks").alias("_r"), F.col("lo").alias("_v"))
    open_ = bins.where(~one)
    # by value, not by row: a group's bins are few, so this table is as long as the groups are many
    at = open_.select("_k", F.col("_b").alias("_at"), *(F.col(k).alias(f"_o{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_o{k}")) for k in keys), F.col("_b") == F.col("_at"))
    left = data.join(at if keys else F.broadcast(at), same).select("_k", "_v")  # without groups: two rows for each statistic at most
    left = materialise(left, "quantile_rows")
    while True:
        large = open_.where(F.col("n") > most)
        small = open_.where(F.col("n") <= most)
        w = Window.partitionBy("_k").orderBy("_v")
        ranked = left.join(small, "_k").withColumn("_r", F.row_number().over(w) - 1 + F.col("below"))
        found = found.unionByName(ranked.where(F.array_contains("ranks", F.col("_r").cast("long"))).select(*keys, "total", F.col("_r").cast("long").alias("_r"), "_v"))
        if large.isEmpty():
            break
        step = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cuts), F.lit(cuts - 1)).cast("long")
        part = left.join(large.select("_k", "lo", "hi"), "_k").select("_k", "_v", step.alias("_b"))
        hist = part.groupBy("_k", "_b").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        of = large.select("_k", *keys, "total", F.col("ranks").alias("_ranks"), F.col("below").alias("_below"))
        cut = _held(hist.join(of, "_k"), ["_k"], "_b", F.col("_ranks"), F.col("_below"))
        cut = materialise(cut.withColumn("_next", F.monotonically_increasing_id()).drop("_ranks", "_below"), "quantile_bins")
        found = found.unionByName(cut.where(one).select(*keys, "total", F.explode("ranks").alias("_r"), F.col("lo").alias("_v")))
        left = materialise(part.join(cut.where(~one).select("_k", "_b", "_next"), ["_k", "_b"]).select(F.col("_next").alias("_k"), "_v"), "quantile_rows")
        open_ = cut.where(~one).drop("_k").withColumnRenamed("_next", "_k")
    known = found.groupBy(*keys).agg(F.first("total").alias("total"), F.map_from_entries(F.collect_set(F.struct("_r", "_v"))).alias("m"))  # two entries a statistic

    def read(place: Column, low: Column) -> Column:
        a, b = F.col("m")[low], F.col("m")[F.least(low + 1, F.col("total") - 1)]
        return F.when((place == low) | a.eqNullSafe(b), a).otherwise((low + 1 - place) * a + (place - low) * b)

    stats = [read(*p).alias(name) for name, p in _spread(F.col("total"), wanted).items()]
    return known.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), *stats)


def with_quantiles(summary: DataFrame, rows: DataFrame, value: str, wanted: Mapping[str, float | tuple[str, float]], by: Sequence[str] = (), most: int = ROWS) -> DataFrame:
    """``summary`` (one row for each group) with its groups' quantiles, null where a group has no value."""
    stats = quantiles(rows, value, wanted, by, most)
    if not by:
        return summary.join(F.broadcast(stats), how="left")  # one row each
    stats = stats.withColumnsRenamed({c: f"_q_{c}" for c in by})
    same = reduce(lambda a, b: a & b, (summary[c].eqNullSafe(stats[f"_q_{c}"]) for c in by))
    return summary.join(stats, same, "left").drop(*(f"_q_{c}" for c in by))
