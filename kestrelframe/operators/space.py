"""Nearest neighbours over an octree whose leaves have a bounded number of points.

The octree comes from counts: points are counted by cell, three levels a pass, and a
cell stays whole as soon as it holds at most ``leaf_rows`` points; only points of fuller
cells are read again. So dense regions get small leaves and empty space gets none.
Points that no cell can tell apart (``DEPTH`` halvings of the cloud's extent) are dealt
into parts by their id. Every cell knows its number of points and its tight box.

A search goes down the tree twice. First each query follows the nearest cell to one
leaf, and its k-th distance there, or the far corner of the smallest cell on the way
that holds ``k`` points, bounds how far its neighbours can be. Then it goes down all
cells that are not farther than that, and is sent to their leaves. A task holds one
leaf's points, or one part's, and about ``GUESTS`` queries; leaves with more queries
are shared out by query. Both sides of every join are written tables, so that adaptive
execution can split the top cells, which all queries pass.

Rows with a null or non-finite coordinate are left out on either side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialise

LEAF = 4096
GUESTS = 1 << 16
DEPTH = 18
STEP = 3
_AXES = "xyz"
_BLOCK = 1 << 21


def _known(rows: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for c in _AXES:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.where(ok)


def _key(depth: Column, at: Sequence[Column]) -> Column:
    """One long for a cell: its depth and its place on each axis at that depth."""
    out = depth.cast("long")
    for c in at:
        out = F.shiftleft(out, DEPTH).bitwiseOR(c)
    return out


def _up(c: Column | str, by: Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.pow(F.lit(2.0), by)).cast("long")


class Octree:
    """``points`` with their leaf ``(cell, part)``, and ``cells`` ``(cell, parent, n, parts, lo_*, hi_*)``; ``parts`` is 0 for cells that are no leaf."""

    def __init__(self, points: DataFrame, leaf_rows: int = LEAF, keep: Sequence[str] = ()) -> None:
        points = _known(points.select("id", *(F.col(c).cast("double").alias(c) for c in _AXES), *keep))
        box = points.agg(F.count("*").alias("n"), *(F.min(c).alias(f"lo_{c}") for c in _AXES), *(F.max(c).alias(f"hi_{c}") for c in _AXES)).first()
        self.total = box["n"]
        self.keep, self.depth = list(keep), 0
        self.schema = points.schema
        if not self.total:
            return
        side = max(box[f"hi_{c}"] - box[f"lo_{c}"] for c in _AXES) or 1.0
        if self.total <= leaf_rows:
            leaf = [F.lit(0).cast("long").alias(f"i{c}") for c in _AXES]
            self._finish(materialise(points.select("*", *leaf, F.lit(0).alias("depth"), F.lit(1).cast("long").alias("parts")), "octree_points"))
            return
        grid = [F.least(F.floor((F.col(c) - box[f"lo_{c}"]) / side * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("long").alias(f"i{c}") for c in _AXES]
        rest, done, at = materialise(points.select("*", *grid), "octree_rest"), None, 0
        while at < DEPTH:
            last = min(at + STEP, DEPTH)
            cells = [_up(f"i{c}", F.lit(DEPTH - last)).alias(f"g{c}") for c in _AXES]
            count = rest.groupBy(*cells).agg(F.count("*").alias("n"))
            leaf = F.when(F.col("n") <= leaf_rows, last) if last < DEPTH else F.lit(last)
            for depth in range(last - 1, at, -1):  # at most 8 ** STEP rows stand in one of these windows
                above = Window.partitionBy(*(_up(f"g{c}", F.lit(last - depth)) for c in _AXES))
                leaf = F.when(F.sum("n").over(above) <= leaf_rows, depth).otherwise(leaf)
            parts = F.when(F.col("n") > leaf_rows, F.ceil(F.col("n") / leaf_rows)).otherwise(1).cast("long")
            count = materialise(count.select(*(F.col(f"g{c}") for c in _AXES), leaf.alias("depth"), parts.alias("parts")), "octree_counts")
            same = [_up(f"i{c}", F.lit(DEPTH - last)) == F.col(f"g{c}") for c in _AXES]
            met = materialise(rest.join(count, same).drop(*(f"g{c}" for c in _AXES)), "octree_points")
            found = met.where("depth IS NOT NULL")
            done = found if done is None else done.unionByName(found)
            rest, at = met.where("depth IS NULL").drop("depth", "parts"), last
            if last == DEPTH or rest.isEmpty():
                break
        self._finish(done)

    def _finish(self, placed: DataFrame) -> None:
        at = [_up(f"i{c}", DEPTH - F.col("depth")) for c in _AXES]
        part = F.pmod(F.xxhash64("id"), F.col("parts"))
        placed = placed.select("id", *_AXES, *self.keep, "depth", "parts", _key(F.col("depth"), at).alias("cell"), part.alias("part"), *(a.alias(f"j{c}") for a, c in zip(at, _AXES, strict=True)))
        ends = lambda lo, hi: [*(F.min(lo(c)).alias(f"lo_{c}") for c in _AXES), *(F.max(hi(c)).alias(f"hi_{c}") for c in _AXES)]
        leaves = placed.groupBy("depth", *(f"j{c}" for c in _AXES)).agg(F.count("*").alias("n"), F.max("parts").alias("parts"), *ends(lambda c: c, lambda c: c))
        up = leaves.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("depth"))))
        mine = [_up(f"j{c}", F.col("depth") - F.col("d")) for c in _AXES]
        over = F.when(F.col("d") > 0, _key(F.col("d") - 1, [_up(m, F.lit(1)) for m in mine]))
        up = up.withColumns({"cell": _key(F.col("d"), mine), "parent": over})
        cells = up.groupBy("cell", "parent").agg(F.sum("n").alias("n"), F.max(F.when(F.col("d") == F.col("depth"), F.col("parts")).otherwise(0)).alias("parts"), *ends(lambda c: f"lo_{c}", lambda c: f"hi_{c}"), F.max("d").alias("d"))
        self.cells = materialise(cells, "octree_cells")
        self.depth = self.cells.agg(F.max("d")).first()[0]
        self.points = placed.select("id", *_AXES, *self.keep, "cell", "part")

    def root(self, queries: DataFrame) -> DataFrame:
        """Every query at the root."""
        top = self.cells.where("parent IS NULL").select("cell", "n", "parts", *(f"{e}_{c}" for c in _AXES for e in ("lo", "hi")))
        return queries.crossJoin(F.broadcast(top))  # one row


def _nearest(inside: bool) -> Column:
    """Distance from a query to the nearest (or the farthest) place of a cell's box."""
    total = F.lit(0.0)
    for c in _AXES:
        below, above = F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}")
        gap = F.greatest(below, above, F.lit(0.0)) if inside else F.greatest(F.abs(below), F.abs(above))
        total = total + gap * gap
    return F.sqrt(total)


def _down(tree: Octree, queries: DataFrame, k: int, all_cells: bool) -> DataFrame:
    """``(id, x, y, z, reach, cell, parts)``: the leaves that each query goes to; ``reach`` bounds its k-th distance."""
    names = ["id", *_AXES, "reach"]
    box = ["cell", "n", "parts", *(f"{e}_{c}" for c in _AXES for e in ("lo", "hi"))]
    children = tree.cells.where("parent IS NOT NULL").select(F.col("parent").alias("_parent"), *box)

    def judged(met: DataFrame) -> DataFrame:
        far = F.when(F.col("n") >= k, _nearest(False))
        out = met.select(*names, "cell", "parts", _nearest(True).alias("_near"), far.alias("_far"))
        if all_cells:
            # rounding must not push a box beyond a distance that was computed another way
            return out.where(F.col("_near") <= F.col("reach") * (1 + 1e-9) + 1e-300).select(*names, "cell", "parts")
        best = out.groupBy("id").agg(F.min(F.struct("_near", F.coalesce("_far", F.lit(float("inf"))).alias("_f"), "cell", *names[1:-1], "parts")).alias("b"), F.min(F.least("reach", "_far")).alias("reach"))
        return best.select("id", *(F.col(f"b.{c}").alias(c) for c in _AXES), "reach", F.col("b.cell").alias("cell"), F.col("b.parts").alias("parts"))

    now, out = judged(tree.root(queries)), None
    for _ in range(tree.depth):
        now = materialise(now, "frontier")
        leaves = now.where("parts > 0")
        out = leaves if out is None else out.unionByName(leaves)
        open_ = now.where("parts = 0").select(*names, F.col("cell").alias("_at"))
        now = judged(open_.join(children, F.col("_at") == F.col("_parent")))
    return now if out is None else out.unionByName(now)


def _search(tree: Octree, guests: DataFrame, k: int) -> DataFrame:
    """``(id, point_id, distance, *keep)``: up to ``k`` nearest points of each query in each leaf part of ``guests(id, x, y, z, reach, cell, part)``."""
    keep = tree.keep
    guests = materialise(guests, "guests")
    size = guests.groupBy(F.col("cell").alias("_c"), F.col("part").alias("_p")).agg(F.ceil(F.count("*") / GUESTS).alias("shares"))
    size = materialise(size, "guest_counts")
    here = (F.col("cell") == F.col("_c")) & (F.col("part") == F.col("_p"))
    ours = guests.join(size, here).select("cell", "part", F.pmod(F.xxhash64("id"), F.col("shares")).alias("share"), "id", *_AXES, "reach")
    theirs = tree.points.join(size, here).select("cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.col("id").alias("point_id"), *(F.col(c).alias(f"_point_{c}") for c in _AXES), *tree.keep)

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right.column("point_id")))
        q, p = (np.stack([t.column(f"{b}{c}").to_numpy() for c in _AXES]) for t, b in ((left, ""), (right, "_point_")))
        reach = left.column("reach").to_numpy()
        rows, cols, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        step = max(1, _BLOCK // max(1, p.shape[1]))
        for a in range(0, q.shape[1], step) if p.shape[1] else ():
            d = np.zeros((len(q[0, a : a + step]), p.shape[1]))
            for axis in range(3):
                d += (q[axis, a : a + step, None] - p[axis][None, :]) ** 2
            d = np.sqrt(d)
            edge = reach[a : a + step].copy()
            if k < d.shape[1]:
                edge = np.minimum(edge, np.partition(d, k - 1, axis=1)[:, k - 1])
            r, c = np.nonzero(d <= edge[:, None])  # points stand by id, so equal distances keep that order
            v = d[r, c]
            order = np.lexsort((c, v, r))
            r, c, v = r[order], c[order], v[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            rows.append(r[rank < k] + a)
            cols.append(c[rank < k])
            far.append(v[rank < k])
        out = {"id": left.column("id").take(pa.array(np.concatenate(rows))), "distance": pa.array(np.concatenate(far))}
        mine = right.take(pa.array(np.concatenate(cols)))
        return pa.table({"id": out["id"], "point_id": mine.column("point_id"), "distance": out["distance"]} | {c: mine.column(c) for c in keep})

    kinds = {f.name: f.dataType.simpleString() for f in [*guests.schema, *tree.schema]}
    schema = f"id {dict(guests.dtypes)['id']}, point_id {dict(tree.points.dtypes)['id']}, distance double" + "".join(f", {c} {kinds[c]}" for c in tree.keep)
    key = ["cell", "part", "share"]
    return ours.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInArrow(near, schema)


def _parts(leaves: DataFrame) -> DataFrame:
    """A row for every part of a leaf."""
    return leaves.select("id", *_AXES, "reach", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))


def neighbours(queries: DataFrame, points: DataFrame, k: int, leaf_rows: int = LEAF, keep: Sequence[str] = ()) -> DataFrame:
    """The ``k`` nearest points of every query: ``(id, rank, point_id, distance, *keep)``, ties by point id.

    ``queries(id, x, y, z)``, ``points(id, x, y, z, *keep)``; ids are unique. A query set
    joined with itself finds itself first. With fewer than ``k`` points all are found.
    """
    tree = Octree(points, leaf_rows, keep)
    if not tree.total:
        empty = queries.select("id").limit(0)
        return empty.select("id", F.lit(0).alias("rank"), F.col("id").alias("point_id"), F.lit(0.0).alias("distance"), *(F.lit(None).alias(c) for c in keep))
    asked = _known(queries.select("id", *(F.col(c).cast("double").alias(c) for c in _AXES))).withColumn("reach", F.lit(float("inf")))
    first = _down(tree, asked, k, all_cells=False)
    if tree.depth:
        first = materialise(first, "home")
        # any part of the home leaf gives a bound
        home = first.select("id", *_AXES, "reach", "cell", F.lit(0).cast("long").alias("part"))
        met = _search(tree, home, k).groupBy("id").agg(F.max("distance").alias("_d"), F.count("*").alias("_n"))
        reach = F.when(F.col("_n") == k, F.least("reach", "_d")).otherwise(F.col("reach"))
        first = first.join(met.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("id", *_AXES, reach.alias("reach"))
        first = _down(tree, materialise(first, "reach"), k, all_cells=True)
    found = materialise(_search(tree, _parts(first), k), "nearest")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "point_id")))
    return ranked.where(F.col("rank") <= k).select("id", "rank", "point_id", "distance", *keep)
