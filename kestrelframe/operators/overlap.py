"""How many points each pair of images shares, whatever number of images sees a point.

Each image is sent the lists of the images that its points are seen by: a row and a
list for each point of the image, not a row for each pair. They come in the order of
images, so a task counts batch by batch and holds the counts of one image besides. A point that more than ``BLOCK`` images see is
dealt into parts of about that many, and each part's images are sent each part's list.

``top_shared`` ranks where it counts, so a pair that is not among an image's first never
leaves the batch that counted it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

BLOCK = 512
VALUES = 1 << 20  # of lists that are counted at a time


def _lists(counts: pa.Table) -> pa.RecordBatch:
    """A row for each image, with its others and their counts."""
    counts = counts.sort_by("img")  # groups come in no order
    runs = pc.run_end_encode(counts.column("img").combine_chunks())
    ends = pa.concat_arrays([pa.array([0], pa.int32()), runs.run_ends])
    each = [pa.ListArray.from_arrays(ends, counts.column(c).combine_chunks()) for c in ("other", "shared_sum")]
    return pa.RecordBatch.from_arrays([runs.values, *each], ["img", "other", "shared"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``(img, others)`` in the order of ``img``: how often each other stands in an image's lists."""
    held = None  # the image that the last batch ended with
    for batch in batches:
        if not batch.num_rows:
            continue
        lists, img = batch.column("others"), batch.column("img")
        other = lists.flatten()
        now = pa.table({"img": img.take(pc.list_parent_indices(lists)), "other": other, "shared": pa.repeat(pa.scalar(1, pa.int64()), len(other))})
        if held is not None:
            now = pa.concat_tables([held.rename_columns(["img", "other", "shared"]), now])
        now = now.group_by(["img", "other"], use_threads=False).aggregate([("shared", "sum")]).select(["img", "other", "shared_sum"])
        last = pc.equal(now.column("img"), img[-1])
        held, done = now.filter(last), now.filter(pc.invert(last))
        if done.num_rows:
            yield _lists(done)
    if held is not None:
        yield _lists(held)


def _tally(run: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of ``(run, other)`` in order, each once, and how often each stands there."""
    wide = other.dtype.itemsize > 4
    if wide:
        known, other = np.unique(other, return_inverse=True)
    key = np.sort((run.astype(np.int64) << 32) + (other.astype(np.int64) + (1 << 31)))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(at, append=len(key))
    run, other = key[at] >> 32, (key[at] & 0xFFFFFFFF) - (1 << 31)
    return run, known[other] if wide else other, count


def _first(img: np.ndarray, run: np.ndarray, other: np.ndarray, count: np.ndarray, k: int) -> pa.RecordBatch:
    """The first ``k`` others of each run, whose image is ``img[run]``; rows come by run."""
    us = img[run]
    apart = other != us
    run, other, count, us = run[apart], other[apart], count[apart], us[apart]
    most = np.int64(1 << 31)  # an image has fewer points
    place = (run << 32) + (most - count)
    ends = np.searchsorted(run, np.arange(len(img)), side="right")
    starts = np.concatenate([[0], ends[:-1]])
    full = ends > starts
    bound = np.zeros(len(img), np.int64)
    bound[full] = np.sort(place)[np.minimum(starts + k, ends)[full] - 1]
    near = place <= bound[run]  # all that have as many as the k-th
    run, other, count, us, place = run[near], other[near], count[near], us[near], place[near]
    order = np.lexsort((other, np.abs(us - other), place))
    run = run[order]
    kept = order[np.arange(len(run)) - np.searchsorted(run, run) < k]
    return pa.RecordBatch.from_arrays([pa.array(c[kept].astype(np.int64)) for c in (us, other, count)], ["img", "other", "shared"])


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """As ``_counts``, of whole numbers, and only the first ``k`` others of each image."""
    held = None  # the image that the last rows ended with, its others and their counts
    one = lambda h: _first(np.array([h[0]]), np.zeros(len(h[1]), np.int64), *h[1:], k)
    for batch in batches:
        lists = batch.column("others")
        images, values = batch.column("img").to_numpy().astype(np.int64), lists.flatten().to_numpy()
        ends = np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            begin = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, begin + VALUES, side="right")))
            rows = images[at:to]
            fresh = np.concatenate([[True], rows[1:] != rows[:-1]])
            img = rows[fresh]
            run, other, count = _tally(np.repeat(np.cumsum(fresh) - 1, np.diff(ends[at:to], prepend=begin)), values[begin : ends[to - 1]])
            if held is not None and held[0] == img[0]:
                n = np.searchsorted(run, 1)
                both, where = np.unique(np.concatenate([held[1], other[:n]]), return_inverse=True)
                sums = np.zeros(len(both), np.int64)
                np.add.at(sums, where, np.concatenate([held[2], count[:n]]))
                run, other, count = np.concatenate([np.zeros(len(both), np.int64), run[n:]]), np.concatenate([both, other[n:]]), np.concatenate([sums, count[n:]])
            elif held is not None:
                yield one(held)
            last = np.searchsorted(run, len(img) - 1)
            held = (img[-1], other[last:], count[last:])
            if last:
                yield _first(img[:-1], run[:last], other[:last], count[:last], k)
            at = to
    if held is not None:
        yield one(held)


def _met(seen: DataFrame, block: int) -> DataFrame:
    """``(img, others)``: for each point of an image, or part of one, a list of those that see it, itself too; a point that is null is a point like any other."""
    # a row here for each ``block`` rows of the input at most
    large = seen.groupBy("point").count().where(F.col("count") > block).select(F.col("point").alias("_p"), F.ceil(F.col("count") / block).alias("parts"))
    large = materialise(large, "large_points")
    dealt, keys = seen, ["point"]
    some = not large.isEmpty()
    if some:
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        dealt = seen.join(large, F.col("point").eqNullSafe(F.col("_p")), "left").select("point", "img", F.col("parts").isNotNull().alias("cut"), F.pmod(F.xxhash64("img"), parts).alias("part"))
        keys = ["point", "cut", "part"]
    lists = dealt.groupBy(*keys).agg(F.collect_set("img").alias("others"))
    met = (lists.where("NOT cut") if some else lists).select(F.explode("others").alias("img"), "others")
    if some:
        cut = materialise(lists.where("cut"), "cut_points")
        theirs = cut.select(F.col("point").alias("_p"), F.explode("others").alias("img"))
        met = met.unionByName(theirs.join(cut, F.col("_p").eqNullSafe(F.col("point"))).select("img", "others"))
    return met.repartition("img").sortWithinPartitions("img")


def _counted(seen: DataFrame, block: int) -> DataFrame:
    """``(img, other, shared)``, the last two lists, with each image beside itself too."""
    met = _met(seen, block)
    kind = dict(met.dtypes)["img"]
    return met.mapInArrow(_counts, f"img {kind}, other array<{kind}>, shared array<long>")


def top_shared(seen: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``(img, other, shared)``: the ``k`` images that share most points with each image, from rows ``(point, img)``.

    Images are whole numbers; of equal counts the nearest number comes first, then the lower.
    Images that share no point with any other, and null ones, are left out.
    """
    seen = seen.where("img IS NOT NULL").select("point", F.col("img").cast("long").alias("img"))
    low, high = seen.agg(F.min("img"), F.max("img")).first()
    if low is not None and low >= -(2**31) and high < 2**31:
        seen = seen.withColumn("img", F.col("img").cast("int"))  # lists of half the size
    return _met(seen, block).mapInArrow(lambda batches: _best(batches, k), "img long, other long, shared long")


def shared_points(seen: DataFrame, with_none: bool = False, block: int = BLOCK) -> DataFrame:
    """``(img, other, shared)`` of every ordered pair of images, from rows ``(point, img)``; repeated rows count once.

    Pairs without a shared point come with 0 if ``with_none``: the result is then as large as
    the number of images squared, and a row in between holds an image's list of all images.
    Null images are left out.
    """
    seen = seen.where("img IS NOT NULL").select("point", "img")
    counts = _counted(seen, block)
    if with_none:
        images = seen.agg(F.collect_set("img").alias("images"))
        counts = counts.crossJoin(F.broadcast(images)).select("img", F.concat("other", F.array_except("images", "other")).alias("other"), "shared")
    pairs = counts.select("img", F.inline(F.arrays_zip("other", "shared"))).where("img <> other")
    return pairs.withColumn("shared", F.coalesce("shared", F.lit(0).cast("long")))
