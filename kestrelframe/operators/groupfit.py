"""Robust model fits for thousands of groups at once: one plan, no loop over groups.

Every group draws ``trials`` samples; a model comes in closed form from *moments*
(sums over rows), of a sample, and in the end of all inliers. A group of at most
``ROWS`` rows is drawn, judged and refitted where its rows meet, after one shuffle of
the rows; nothing is written for its hypotheses.

Of a larger group, hypotheses are sums by ``(group, trial)``, and refits are sums by
group. Inliers are counted by ``(group, trial)``: it is dealt into parts of at most
``ROWS`` rows, a task holds one part and the group's hypotheses, and part counts are
added. There are few such groups, so their tables are small beside the rows.

Draws are by rank in a seeded order of the group's rows: rank ``(r + s * step) mod n``
for slot ``s``, which are different rows, the same on any partitioning. Coordinates
are centred and scaled by group before they are multiplied; thresholds and reported
residuals are in the units of the target.

Rows with a null or non-finite coordinate are left out. Groups with fewer rows than a
sample get no model, and no inliers. Groups by null are groups. Of trials with equally
many inliers the first wins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialise

ROWS = 1 << 16
Array = np.ndarray


@dataclass(frozen=True)
class Model:
    """``moments(a, b)`` gives a row of sums for each pair of places, ``solve`` models from rows of sums, ``residual`` distances ``[model, row]``.

    ``restore(model, a0, a1, b0, b1)`` gives the model of the places themselves from that of places less ``a0`` (``b0``), over ``a1`` (``b1``).
    """

    sample: int
    moments: Callable[[Array, Array], Array]
    solve: Callable[[Array], Array]
    residual: Callable[[Array, Array, Array], Array]
    restore: Callable[[Array, Array, float, Array, float], Array]


def _outer(rows: Array) -> Array:
    return (rows[:, :, None] * rows[:, None, :]).reshape(len(rows), -1)


def _least(m: Array) -> Array:
    """The unit vector that each 9 by 9 matrix shortens most."""
    return np.linalg.eigh(m.reshape(-1, 9, 9))[1][:, :, 0].reshape(-1, 3, 3)


def _homogeneous(a: Array) -> Array:
    return np.concatenate([a, np.ones((len(a), 1))], axis=1)


def _plane_moments(a: Array, b: Array) -> Array:
    h, zero = _homogeneous(a), np.zeros((len(a), 3))
    u, v = b[:, :1], b[:, 1:2]
    return _outer(np.concatenate([-h, zero, u * h], axis=1)) + _outer(np.concatenate([zero, -h, v * h], axis=1))


def _plane_residual(model: Array, a: Array, b: Array) -> Array:
    p = (model.reshape(-1, 3) @ _homogeneous(a).T).reshape(len(model), 3, -1)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        u, v = p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]
        u -= b[:, 0]
        v -= b[:, 1]
        u *= u
        v *= v
        u += v
        d = np.sqrt(u, out=u)
    d[~np.isfinite(d)] = np.inf
    return d


def _centring(shift: Array, size: float) -> Array:
    return np.array([[1 / size, 0, -shift[0] / size], [0, 1 / size, -shift[1] / size], [0, 0, 1.0]])


def _scaled(m: Array) -> Array:
    """A matrix that counts up to its factor: unit norm, its largest entry positive."""
    m = m / np.linalg.norm(m)
    return m * np.sign(m.ravel()[np.abs(m).argmax()])


def _epipolar(m: Array) -> Array:
    u, s, v = np.linalg.svd(_least(m))
    s[:, 2] = 0
    return u * s[:, None, :] @ v


def _line_residual(model: Array, a: Array, b: Array) -> Array:
    p, q = _homogeneous(a), _homogeneous(b)
    in_b, in_a = np.einsum("mij,nj->mni", model, p), np.einsum("mji,nj->mni", model, q)
    along = np.abs(np.einsum("mni,ni->mn", in_b, q))
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.maximum(along / np.hypot(in_b[..., 0], in_b[..., 1]), along / np.hypot(in_a[..., 0], in_a[..., 1]))
    return np.where(np.isfinite(d), d, np.inf)


def _solid_moments(a: Array, b: Array) -> Array:
    return np.concatenate([np.ones((len(a), 1)), a, b, (b[:, :, None] * a[:, None, :]).reshape(len(a), 9), (a * a).sum(1, keepdims=True)], axis=1)


def _similarity(m: Array) -> Array:
    """``scale * rotation`` and translation, three rows of four, from sums of places and products."""
    n = m[:, 0, None]
    ma, mb = m[:, 1:4] / n, m[:, 4:7] / n
    cross = m[:, 7:16].reshape(-1, 3, 3) / n[:, :, None] - mb[:, :, None] * ma[:, None, :]
    spread = m[:, 16] / n[:, 0] - (ma * ma).sum(1)
    u, s, v = np.linalg.svd(cross)
    flip = np.ones_like(s)
    flip[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(v))
    flip[:, 2] = np.where(flip[:, 2] == 0, 1, flip[:, 2])
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(spread > 1e-12, (s * flip).sum(1) / spread, np.nan)
    r = scale[:, None, None] * ((u * flip[:, None, :]) @ v)
    return np.concatenate([r, (mb - np.einsum("mij,mj->mi", r, ma))[:, :, None]], axis=2)


def _solid_residual(model: Array, a: Array, b: Array) -> Array:
    d = np.linalg.norm(np.einsum("mij,nj->mni", model[:, :, :3], a) + model[:, None, :, 3] - b[None], axis=2)
    return np.where(np.isfinite(d), d, np.inf)


#: Plane to plane, 3 by 3: distance of the projected place.
HOMOGRAPHY = Model(4, _plane_moments, _least, _plane_residual, lambda m, a0, a1, b0, b1: _scaled(np.linalg.inv(_centring(b0, b1)) @ m @ _centring(a0, a1)))
#: Two views of a scene, 3 by 3 of rank two: the larger distance of a place from its line.
FUNDAMENTAL = Model(8, lambda a, b: _outer((_homogeneous(b)[:, :, None] * _homogeneous(a)[:, None, :]).reshape(len(a), 9)), _epipolar, _line_residual, lambda m, a0, a1, b0, b1: _scaled(_centring(b0, b1).T @ m @ _centring(a0, a1)))
#: Scale, rotation and translation of space, 3 by 4.
SIMILARITY = Model(3, _solid_moments, _similarity, _solid_residual, lambda m, a0, a1, b0, b1: np.concatenate([m[:, :3] * b1 / a1, (b1 * m[:, 3] + b0 - m[:, :3] @ a0 * b1 / a1)[:, None]], axis=1))


def _same(keys: Sequence[str], other: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys))


def _ranked(rows: DataFrame, group: list[str], seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``part`` and ``rank`` in the group, and the groups ``(g, n, parts, a0, a1, b0, b1)``."""
    axes = len(rows.select("a").first()["a"]) if not rows.isEmpty() else 2
    sums = [F.avg(F.get(v, F.lit(k))).alias(f"{v}0{k}") for v in "ab" for k in range(axes)] + [F.var_pop(F.get(v, F.lit(k))).alias(f"{v}1{k}") for v in "ab" for k in range(axes)]
    groups = rows.groupBy(*group).agg(F.count("*").alias("n"), *sums)
    size = lambda v: F.greatest(F.sqrt(sum((F.col(f"{v}1{k}") for k in range(1, axes)), F.col(f"{v}10"))), F.lit(1e-12))
    place = lambda v: F.array(*(F.col(f"{v}0{k}") for k in range(axes)))
    groups = groups.select(*group, "n", F.ceil(F.col("n") / ROWS).alias("parts"), place("a").alias("a0"), size("a").alias("a1"), place("b").alias("b0"), size("b").alias("b1"))
    groups = materialise(groups.withColumn("g", F.monotonically_increasing_id()), "fit_groups")
    named = groups.select(*(F.col(c).alias(f"_{c}") for c in group), "g", "parts")
    order = F.xxhash64(F.lit(seed), "id")
    placed = rows.join(named, _same(group, "_")).select("g", F.pmod(order, F.col("parts")).alias("part"), order.alias("o"), "id", "a", "b")
    placed = placed.withColumn("k", F.row_number().over(Window.partitionBy("g", "part").orderBy("o", "id")))
    placed = materialise(placed, "fit_rows")
    sizes = placed.groupBy(F.col("g").alias("_g"), F.col("part").alias("_part")).agg(F.count("*").alias("c"))
    # a group has a row here for each ROWS of its own
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialise(sizes.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))), "fit_parts")
    met = placed.join(sizes, (F.col("g") == F.col("_g")) & (F.col("part") == F.col("_part")))
    return met.select("g", "part", (F.col("before") + F.col("k") - 1).alias("rank"), "id", "a", "b"), groups


def _matrix(column: pa.ChunkedArray) -> Array:
    return np.array(column.to_pylist(), float)


def _moments(rows: DataFrame, groups: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``(*keys, moments)``: sums over the rows of each key; ``rows(g, *keys, a, b)``."""
    stats = groups.select(F.col("g").alias("_g"), "a0", "a1", "b0", "b1")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = ((_matrix(batch.column(v)) - _matrix(batch.column(f"{v}0"))) / batch.column(f"{v}1").to_numpy()[:, None] for v in "ab")
                m = model.moments(a, b)
                columns = [*(batch.column(k) for k in keys), pa.array(list(m), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "m"])

    schema = ", ".join(f"{k} long" for k in keys)
    one = rows.join(stats, F.col("g") == F.col("_g")).select(*dict.fromkeys([*keys, "a", "b", "a0", "a1", "b0", "b1"])).mapInArrow(run, f"{schema}, m array<double>")
    # sums by place in the array: partial before the shuffle, whatever the size of a group
    size = len(model.moments(*(np.zeros((1, 3 if model.sample == 3 else 2)),) * 2)[0])
    return one.groupBy(*keys).agg(F.count("*").alias("rows"), F.array(*(F.sum(F.get("m", F.lit(k))) for k in range(size))).alias("m"))


def _solved(moments: DataFrame, model: Model, keys: list[str], least: int) -> DataFrame:
    """``(*keys, model)``, flat; keys with too few rows, or rows that fix no model, drop."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                flat = model.solve(_matrix(batch.column("m"))).reshape(batch.num_rows, -1)
                fine = np.flatnonzero(np.isfinite(flat).all(axis=1))
                columns = [*(batch.column(k).take(pa.array(fine)) for k in keys), pa.array(list(flat[fine]), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "model"])

    return moments.where(F.col("rows") >= least).select(*keys, "m").mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", model array<double>")


def _judged(rows: DataFrame, groups: DataFrame, models: DataFrame, model: Model, within: float, each: bool) -> DataFrame:
    """Counts ``(g, trial, inliers)`` of every model, or the rows ``(g, id, residual)`` themselves."""
    theirs = models.join(groups.select(F.col("g").alias("_g"), "parts", "a0", "a1", "b0", "b1"), F.col("g") == F.col("_g")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    theirs = theirs.select("g", "part", "trial", "model", "a0", "a1", "b0", "b1")
    kind = dict(rows.dtypes)["id"]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["g", "id", "residual"] if each else ["g", "trial", "inliers"]
        if not (left.num_rows and right.num_rows):
            return pa.table({n: left.column("id")[:0] if n == "id" else pa.array([], pa.float64() if n == "residual" else pa.int64()) for n in names})
        stats = {v: (np.array(right.column(f"{v}0")[0].as_py()), right.column(f"{v}1")[0].as_py()) for v in "ab"}
        a, b = ((_matrix(left.column(v)) - stats[v][0]) / stats[v][1] for v in "ab")
        flat = _matrix(right.column("model"))
        m = flat.reshape(len(flat), 3, -1)
        step, counts, far = max(1, (1 << 21) // len(a)), np.zeros(len(m), np.int64), None
        for k in range(0, len(m), step):
            far = model.residual(m[k : k + step], a, b) * stats["b"][1]
            counts[k : k + step] = (far <= within).sum(axis=1)
        g = left.column("g")[0].as_py()
        if each:
            return pa.table({"g": left.column("g"), "id": left.column("id"), "residual": pa.array(far[0])})
        return pa.table({"g": pa.array(np.full(len(m), g)), "trial": right.column("trial"), "inliers": pa.array(counts)})

    schema = f"g long, id {kind}, residual double" if each else "g long, trial long, inliers long"
    return rows.select("g", "part", "id", "a", "b").groupBy("g", "part").cogroup(theirs.groupBy("g", "part")).applyInArrow(work, schema)


def _whole(rows: DataFrame, keys: list[str], model: Model, within: float, trials: int, seed: int) -> DataFrame:
    """``(*keys, n, inliers, model, ids, residuals)`` of groups whose rows fit in a task."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"n long, inliers long, model array<double>, ids array<{kinds['id']}>, residuals array<double>"])

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("o", "ascending"), ("id", "ascending")])
        (a, a0, a1), (b, b0, b1) = (_placed(table.column(v).combine_chunks()) for v in "ab")
        n, s, best = len(a), model.sample, None
        if n >= s:
            start, step = np.random.default_rng(seed).random((2, trials, 1))
            drawn = ((start * n).astype(int) + (1 + (step * max(1, (n - 1) // (s - 1))).astype(int)) * np.arange(s)) % n
            if n <= drawn.size:
                sums = model.moments(a, b)[drawn].sum(1)
            else:
                sums = model.moments(a[drawn.ravel()], b[drawn.ravel()]).reshape(trials, s, -1).sum(1)
            guesses = model.solve(sums)
            guesses = guesses[np.isfinite(guesses).all(axis=(1, 2))]
            size = max(1, (1 << 16) // n)  # residuals that a core's cache holds
            near = [(model.residual(guesses[k : k + size], a, b) * b1 <= within).sum(1) for k in range(0, len(guesses), size)]
            if near:
                best = guesses[np.concatenate(near).argmax()][None]
                agreed = (model.residual(best, a, b) * b1 <= within)[0]
                if agreed.sum() >= s:
                    again = model.solve(model.moments(a[agreed], b[agreed]).sum(0, keepdims=True))
                    best = again if np.isfinite(again).all() else best
        far = [] if best is None else model.residual(best, a, b)[0] * b1
        ids = table.column("id").combine_chunks()[: len(far)]
        found = None if best is None else model.restore(best[0], a0, a1, b0, b1).ravel()
        columns = {k: table.column(k)[:1] for k in keys} | {
            "n": pa.array([n], pa.int64()),
            "inliers": pa.array([int(np.sum(np.asarray(far) <= within))], pa.int64()),
            "model": pa.array([found], pa.list_(pa.float64())),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            "residuals": pa.array([far], pa.list_(pa.float64())),
        }
        return pa.table(columns)

    return rows.withColumn("o", F.xxhash64(F.lit(seed), "id")).groupBy(*keys).applyInArrow(work, schema)


def _placed(column: pa.Array) -> tuple[Array, Array, float]:
    """Places about their mean and over their spread, with both."""
    places = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    mean = places.mean(axis=0)
    size = max(float(np.sqrt(places.var(axis=0).sum())), 1e-12)
    return (places - mean) / size, mean, size


def robust_fits(rows: DataFrame, by: Sequence[str], source: Sequence[str], target: Sequence[str], model: Model, within: float, trials: int = 500, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(*by, n, inliers, model)`` of every group, and its rows ``(*by, id, residual, inlier)``.

    ``rows`` have an ``id`` that is unique in its group, and places ``source`` and
    ``target``. The best trial's inliers are fitted again; ``inliers`` counts those of
    the final model. ``model`` is flat, by rows; null where nothing could be fitted.
    The two tables are lazy: a caller who reads both has small groups fitted twice.
    """
    keys = [f"k{i}" for i in range(len(by))]
    vector = lambda names: F.array(*(F.col(c).cast("double") for c in names))
    data = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), "id", vector(source).alias("a"), vector(target).alias("b"))
    data = data.where(F.forall(F.concat("a", "b"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # a row here for each ROWS rows of the input at most
    large = materialise(data.groupBy(*keys).count().where(F.col("count") > ROWS).select(*(F.col(k).alias(f"_{k}") for k in keys)), "fit_large")
    some = not large.isEmpty()
    small = _whole(data.join(F.broadcast(large), _same(keys, "_"), "left_anti") if some else data, keys, model, within, trials, seed)
    named = [F.col(k).alias(c) for k, c in zip(keys, by, strict=True)]
    fits = small.select(*named, "n", "inliers", "model")
    each = F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("residuals").alias("residual"))).alias("_r")
    marked = small.select(*named, each).select(*by, "_r.id", "_r.residual", (F.col("_r.residual") <= within).alias("inlier"))
    if not some:
        return fits, marked
    fits_, marked_ = _parted(data.join(F.broadcast(large), _same(keys, "_"), "left_semi"), keys, by, model, within, trials, seed)
    return fits.unionByName(fits_), marked.unionByName(marked_)


def _parted(data: DataFrame, keys: list[str], by: Sequence[str], model: Model, within: float, trials: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The same of groups that no task holds whole."""
    ranked, groups = _ranked(data, keys, seed)
    ranked = materialise(ranked, "fit_ranked")
    n, s = F.col("n"), model.sample
    draw = groups.where(n >= s).select("g", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))).alias("trial"))
    start, step = F.pmod(F.xxhash64(F.lit(seed), "g", "trial"), n), 1 + F.pmod(F.xxhash64(F.lit(seed + 1), "g", "trial"), F.greatest(F.floor((n - 1) / (s - 1)), F.lit(1)))
    draw = draw.select(F.col("g").alias("_g"), "trial", F.explode(F.transform(F.sequence(F.lit(0), F.lit(s - 1)), lambda k: F.pmod(start + k * step, n))).alias("_rank"))
    drawn = ranked.join(materialise(draw, "fit_draws"), (F.col("g") == F.col("_g")) & (F.col("rank") == F.col("_rank"))).select("g", "trial", "a", "b")
    guesses = materialise(_solved(_moments(drawn, groups, model, ["g", "trial"]), model, ["g", "trial"], s), "fit_trials")
    score = _judged(ranked, groups, guesses, model, within, each=False).groupBy("g", "trial").agg(F.sum("inliers").alias("inliers"))
    best = score.groupBy("g").agg(F.max(F.struct("inliers", (-F.col("trial")).alias("t"))).alias("b")).select(F.col("g").alias("_g"), (-F.col("b.t")).alias("_t"))
    first = materialise(guesses.join(best, (F.col("g") == F.col("_g")) & (F.col("trial") == F.col("_t"))).select("g", "trial", "model"), "fit_best")
    near = materialise(_judged(ranked, groups, first, model, within, each=True).where(F.col("residual") <= within).select(F.col("g").alias("_g"), F.col("id").alias("_id")), "fit_inliers")
    agreed = ranked.join(near, (F.col("g") == F.col("_g")) & (F.col("id") == F.col("_id"))).select("g", "a", "b")
    again = _solved(_moments(agreed, groups, model, ["g"]), model, ["g"], s)
    final = first.select("g", "trial", F.col("model").alias("_m")).join(again, "g", "left").select("g", "trial", F.coalesce("model", "_m").alias("model"))
    final = materialise(final, "fit_final")
    # the caller's columns may have any names: the group's number gets one of its own
    back = groups.select(F.col("g").alias("_group"), *(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), "n")
    judged = materialise(_judged(ranked, groups, final, model, within, each=True).withColumnRenamed("g", "_of"), "fit_residuals")
    out = judged.join(back.drop("n"), F.col("_of") == F.col("_group")).select(*by, "id", "residual", (F.col("residual") <= within).alias("inlier"))
    counts = judged.groupBy(F.col("_of").alias("_group")).agg(F.count_if(F.col("residual") <= within).alias("inliers"))

    def restore(batches):
        for batch in batches:
            if batch.num_rows:
                flat, (a0, b0), (a1, b1) = _matrix(batch.column("model")), (_matrix(batch.column(c)) for c in ("a0", "b0")), (batch.column(c).to_numpy() for c in ("a1", "b1"))
                m = [model.restore(x, *s).ravel() for x, *s in zip(flat.reshape(len(flat), 3, -1), a0, a1, b0, b1, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(m, pa.list_(pa.float64()))], ["_group", "model"])

    models = final.join(groups.select("g", "a0", "a1", "b0", "b1"), "g").mapInArrow(restore, "_group long, model array<double>")
    fits = back.join(counts, "_group", "left").join(models, "_group", "left")
    return fits.select(*by, "n", F.coalesce("inliers", F.lit(0)).alias("inliers"), "model"), out
