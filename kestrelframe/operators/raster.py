"""Elevation rasters from point clouds: surface, bare earth, ground, terrain with gap limits.

Points are read once, into cells ``(row, col, dsm, low)`` by one partial aggregate;
all that follows works on cells, in square tiles with a halo, so a task holds a stated
number of cells however many points a tile has. The lowest ground point of a cell is
the cell's lowest point wherever that passes the ground test, so terrain needs no
second look at the points either.

*Bare earth* is progressive morphology. An opening of width ``w`` looks ``w`` cells
far, and what it finds there is the nearest known cell, which is never farther than
the cell asked for. A halo of twice the windows' sum and the gap limit therefore makes
tiles equal the whole. Mirrored edges stand where the raster ends, not the tile.

*Terrain* of an empty cell is linear inside the Delaunay triangle of ground cells around
it. That triangle's lifted plane is, of all planes below the lifted ground cells, the one
that is highest at the cell: a linear program in three variables, solved for many cells
at once by exchanging a corner for the ground cell that violates the plane most. The
circumcircle is the certificate: no ground cell inside, as far as the circle reaches.
Triangles count up to a circumradius of ``reach``; a circle through the cell lies within
twice that, which is the tile's halo, so again tiles equal the whole. Co-circular ground
cells (frequent on a grid) are decided by weights drawn from their places: an infinitely
small lift, the same in every tile. Where no triangle counts (outside the hull, or
beyond ``reach``) the nearest ground cell's height is taken; ties go to the least row,
then column. Cells farther than ``max_gap`` from the ground are UNOBSERVED.

Points with a null or non-finite coordinate are left out. An empty cloud, or one of no
width or height, has no raster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

UNOBSERVED, OBSERVED, INTERPOLATED = 0, 1, 2
WINDOWS_M = (3.0, 10.0, 30.0)
INIT_DH, SLOPE, MAX_DH = 0.3, 0.15, 2.5
GROUND_DZ = 0.5
#: Side of a tile in cells.
TILE = 256
_FAR = 1 << 20
_BLOCK = 1 << 21


@dataclass(frozen=True)
class Grid:
    """A raster of ``rows`` by ``cols`` cells whose upper left corner is ``(x0, y1)``."""

    x0: float
    y1: float
    resolution: float
    rows: int
    cols: int

    def row(self) -> Column:
        return F.least(F.greatest(F.floor((self.y1 - F.col("y")) / self.resolution), F.lit(0)), F.lit(self.rows - 1)).alias("row")

    def col(self) -> Column:
        return F.least(F.greatest(F.floor((F.col("x") - self.x0) / self.resolution), F.lit(0)), F.lit(self.cols - 1)).alias("col")


def _finite(points: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for c in "xyz":
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return points.where(ok)


def grid_of(points: DataFrame, resolution: float) -> Grid | None:
    """The raster that just holds a cloud; what stands on its far edges belongs to the last cells."""
    b = _finite(points).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if b["x0"] is None or b["x0"] == b["x1"] or b["y0"] == b["y1"]:
        return None
    return Grid(b["x0"], b["y1"], resolution, math.ceil((b["y1"] - b["y0"]) / resolution), math.ceil((b["x1"] - b["x0"]) / resolution))


def surface_cells(points: DataFrame, grid: Grid) -> DataFrame:
    """``(row, col, dsm, low, n)`` of the occupied cells."""
    z = F.col("z").cast("double")
    return _finite(points).groupBy(grid.row(), grid.col()).agg(F.max(z).alias("dsm"), F.min(z).alias("low"), F.count("*").alias("n"))


def fill_nearest(z: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the nearest known cell (ties: least row, then column) and the distance to it, out to ``radius`` cells; NaN and infinity beyond."""
    h, w = z.shape
    known = ~np.isnan(z)
    row = np.arange(h)[:, None]
    up = np.maximum.accumulate(np.where(known, row, -_FAR), axis=0)
    down = np.minimum.accumulate(np.where(known, row, _FAR)[::-1], axis=0)[::-1]
    near = np.where(row - up <= down - row, up, down)  # the upper one on ties
    gap = np.minimum(np.abs(near - row), _FAR).astype(np.int64)
    best = np.full((h, w), (1 << 62), np.int64)
    at_row, at_col = np.zeros((h, w), np.int64), np.zeros((h, w), np.int64)
    for d in range(-min(radius, w - 1), min(radius, w - 1) + 1):
        a, b = max(0, -d), min(w, w - d)
        there = slice(a + d, b + d)
        cost = gap[:, there] ** 2 + d * d
        mine = best[:, a:b]
        better = (cost < mine) | ((cost == mine) & (near[:, there] < at_row[:, a:b]))
        best[:, a:b] = np.where(better, cost, mine)
        at_row[:, a:b] = np.where(better, near[:, there], at_row[:, a:b])
        at_col[:, a:b] = np.where(better, np.arange(a + d, b + d)[None, :], at_col[:, a:b])
    ok = best <= radius * radius
    out = np.full((h, w), np.nan)
    out[ok] = z[at_row[ok], at_col[ok]]
    return out, np.where(ok, np.sqrt(best.astype(float)), np.inf)


def _slide(z: np.ndarray, left: int, right: int, axis: int, op: np.ufunc) -> np.ndarray:
    """``op`` over windows that reach ``left`` back and ``right`` on, edges mirrored; windows are put together from halves."""
    pad = [(0, 0), (0, 0)]
    pad[axis] = (left, right)
    p, n, size, have = np.pad(z, pad, mode="symmetric"), z.shape[axis], left + right + 1, 1
    take = lambda a, start, stop: a[start:stop] if axis == 0 else a[:, start:stop]
    while have < size:
        step = min(have, size - have)
        p = op(take(p, 0, p.shape[axis] - step), take(p, step, p.shape[axis]))
        have += step
    return take(p, 0, n)


def opening(z: np.ndarray, w: int) -> np.ndarray:
    """Minimum, then maximum over squares; of an even width, the second leans the other way."""
    for axis in (0, 1):
        z = _slide(z, w // 2, w - 1 - w // 2, axis, np.minimum)
    for axis in (0, 1):
        z = _slide(z, w - 1 - w // 2, w // 2, axis, np.maximum)
    return z


def _pixels(windows_m: Sequence[float], resolution: float) -> list[int]:
    return [max(3, int(m / resolution)) for m in windows_m]


def bare_surface(low: np.ndarray, resolution: float, windows_m: Sequence[float] = WINDOWS_M, init_dh: float = INIT_DH, slope: float = SLOPE, max_dh: float = MAX_DH, radius: int | None = None) -> np.ndarray:
    """Lowest points, filled, and cut down to ever wider openings wherever they rise above one by more than allowed."""
    surface, _ = fill_nearest(low, max(low.shape) * 2 if radius is None else radius)
    surface = np.where(np.isnan(surface), np.inf, surface)  # beyond the radius: bears on no cell that is asked for
    for m, w in zip(windows_m, _pixels(windows_m, resolution), strict=True):
        opened = opening(surface, w)
        with np.errstate(invalid="ignore"):
            surface = np.where(surface - opened > min(init_dh + slope * m, max_dh), opened, surface)
    return surface


def _dealt(cells: DataFrame, grid: Grid, tile: int, halo: int) -> DataFrame:
    """Cells with every tile ``(ty, tx)`` whose square, widened by ``halo``, holds them."""
    out = cells
    for c, t, n in (("row", "ty", grid.rows), ("col", "tx", grid.cols)):
        first, last = F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)
        out = out.withColumn(t, F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit((n - 1) // tile)))))
    return out


def _window(key: tuple, grid: Grid, tile: int, halo: int) -> tuple[int, int, int, int]:
    """First and last (excluded) row and column of a widened tile, inside the raster."""
    ty, tx = (int(k) for k in key)
    return max(0, ty * tile - halo), min(grid.rows, (ty + 1) * tile + halo), max(0, tx * tile - halo), min(grid.cols, (tx + 1) * tile + halo)


def _inner(key: tuple, grid: Grid, tile: int) -> tuple[slice, slice]:
    r0, r1, c0, c1 = _window(key, grid, tile, 0)
    return slice(r0, r1), slice(c0, c1)


def _spread(part: pd.DataFrame, name: str, at: tuple[int, int, int, int]) -> np.ndarray:
    out = np.full((at[1] - at[0], at[3] - at[2]), np.nan)
    out[part["row"].to_numpy() - at[0], part["col"].to_numpy() - at[2]] = part[name].to_numpy()
    return out


def bare_earth(cells: DataFrame, grid: Grid, windows_m: Sequence[float] = WINDOWS_M, init_dh: float = INIT_DH, slope: float = SLOPE, max_dh: float = MAX_DH, near: float = 0.0, tile: int = TILE) -> DataFrame:
    """``(row, col, dsm, low, bare)`` of the occupied cells of :func:`surface_cells`, and ``bare`` of empty ones out to ``near`` units from them."""
    reach = math.ceil(near / grid.resolution)
    halo = 2 * sum(_pixels(windows_m, grid.resolution)) + reach

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        at, (rows, cols) = _window(key, grid, tile, halo), _inner(key, grid, tile)
        low, dsm = _spread(part, "low", at), _spread(part, "dsm", at)
        surface = bare_surface(low, grid.resolution, windows_m, init_dh, slope, max_dh, halo)
        _, gap = fill_nearest(low, max(1, reach))
        own = np.zeros(low.shape, bool)
        own[rows.start - at[0] : rows.stop - at[0], cols.start - at[2] : cols.stop - at[2]] = True
        r, c = np.nonzero(own & (gap <= near / grid.resolution))
        return pd.DataFrame({"row": r + at[0], "col": c + at[2], "dsm": dsm[r, c], "low": low[r, c], "bare": surface[r, c]})

    dealt = _dealt(cells.select("row", "col", "dsm", "low"), grid, tile, halo)
    return dealt.groupBy("ty", "tx").applyInPandas(one, "row long, col long, dsm double, low double, bare double")


def ground(points: DataFrame, bare: DataFrame, grid: Grid) -> DataFrame:
    """Points with ``ground``: is the point at most half a unit above its cell's bare surface? ``bare(row, col, bare)`` must be a written table if a cell may be hot."""
    named = bare.select(F.col("row").alias("_row"), F.col("col").alias("_col"), "bare")
    placed = _finite(points).withColumns({"_r": grid.row(), "_c": grid.col()})
    met = placed.join(named, (F.col("_r") == F.col("_row")) & (F.col("_c") == F.col("_col")))
    return met.withColumn("ground", F.col("z") <= F.col("bare") + GROUND_DZ).drop("_r", "_c", "_row", "_col", "bare")


# ---- triangles ----


def _weights(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Lifts that decide co-circular cells, from the cells' places."""
    with np.errstate(over="ignore"):
        h = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + col.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(44)).astype(float)


def _planes(x: np.ndarray, y: np.ndarray, lift: np.ndarray) -> np.ndarray:
    """Per row of three corners: coefficients whose product with ``(x, y, lift, 1)`` is negative below the corners' plane."""
    bx, by, bl = x[:, 1] - x[:, 0], y[:, 1] - y[:, 0], lift[:, 1] - lift[:, 0]
    cx, cy, cl = x[:, 2] - x[:, 0], y[:, 2] - y[:, 0], lift[:, 2] - lift[:, 0]
    n = np.stack([by * cl - bl * cy, bl * cx - bx * cl, bx * cy - by * cx], axis=1)
    return np.concatenate([n, -(n[:, :1] * x[:, :1] + n[:, 1:2] * y[:, :1] + n[:, 2:] * lift[:, :1])], axis=1)


def _triangles(qx: np.ndarray, qy: np.ndarray, px: np.ndarray, py: np.ndarray, weight: np.ndarray, nudge: float) -> np.ndarray:
    """Corners (indices into the points, or negative outside their hull) of the Delaunay triangle around each query.

    A query on an edge is taken to the side that ``nudge`` says. Coordinates are whole
    numbers near zero, so every determinant is exact.
    """
    far = max(4096.0, 8 * max(np.abs(a).max() for a in (px, py, qx, qy)))
    x, y = np.concatenate([px, [-far, far, 0.0]]), np.concatenate([py, [-far, -far, far]])
    lift, n = x * x + y * y, len(px)
    weight = np.concatenate([weight, np.zeros(3)])
    every, small = np.stack([x, y, lift, np.ones(n + 3)]), np.stack([x, y, weight, np.ones(n + 3)])
    corner = np.tile(np.arange(n, n + 3), (len(qx), 1))
    ax, ay = qx + nudge, qy + 0.6180339887 * nudge
    active = np.arange(len(qx))
    while len(active):
        t = corner[active]
        below = _planes(x[t], y[t], lift[t]) @ every[:, :n]
        for j in range(3):  # a corner is on its own plane
            real = t[:, j] < n
            below[real, t[real, j]] = np.inf
        pick = below.argmin(axis=1)
        least = below[np.arange(len(t)), pick]
        even = np.flatnonzero(least == 0)
        if len(even):
            second = _planes(x[t[even]], y[t[even]], weight[t[even]]) @ small[:, :n]
            second = np.where(below[even] == 0, second, np.inf)
            pick[even] = second.argmin(axis=1)
            least[even] = second[np.arange(len(even)), pick[even]]
        go = least < 0
        active, t, pick = active[go], t[go], pick[go]
        if not len(active):
            break
        # shares of the query and of the new corner; the corner whose share runs out first is exchanged
        tx, ty = x[t], y[t]
        whole = (tx[:, 1] - tx[:, 0]) * (ty[:, 2] - ty[:, 0]) - (ty[:, 1] - ty[:, 0]) * (tx[:, 2] - tx[:, 0])

        def shares(a: np.ndarray, b: np.ndarray, tx: np.ndarray = tx, ty: np.ndarray = ty, whole: np.ndarray = whole) -> np.ndarray:
            out = [(tx[:, j] - a) * (ty[:, k] - b) - (ty[:, j] - b) * (tx[:, k] - a) for j, k in ((1, 2), (2, 0), (0, 1))]
            return np.stack(out, axis=1) / whole[:, None]

        mine, new = shares(ax[active], ay[active]), shares(x[pick], y[pick])
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(new > 1e-12, mine / new, np.inf)
        corner[active, ratio.argmin(axis=1)] = pick
    return np.where((corner < n).all(axis=1)[:, None], corner, -1)


def _radius(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre and radius of the circles through rows of three corners."""
    bx, by, cx, cy = x[:, 1] - x[:, 0], y[:, 1] - y[:, 0], x[:, 2] - x[:, 0], y[:, 2] - y[:, 0]
    d = 2 * (bx * cy - by * cx)
    b, c = bx * bx + by * by, cx * cx + cy * cy
    ux, uy = (cy * b - by * c) / d, (bx * c - cx * b) / d
    return x[:, 0] + ux, y[:, 0] + uy, np.hypot(ux, uy)


def linear_fill(z: np.ndarray, wanted: np.ndarray, reach: float, origin: tuple[int, int] = (0, 0), block: int = 16) -> np.ndarray:
    """Heights inside Delaunay triangles of the known cells, of circumradius ``reach`` at most, at the ``wanted`` cells; NaN elsewhere.

    Queries go block by block. Points of a window around the block are looked at first;
    a circle inside the window is certain, for the others the window doubles, up to
    twice the reach. Known cells between eight known neighbours are corners of no
    triangle that holds an empty cell, and are left out.
    """
    h, w = z.shape
    out = np.full(z.shape, np.nan)
    known = ~np.isnan(z)
    p = np.pad(known, 1, constant_values=False)
    ring = np.logical_and.reduce([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])
    pr, pc = np.nonzero(known & ~ring)
    heavy = _weights(pr + origin[0], pc + origin[1])
    qr, qc = np.nonzero(wanted & ~known)
    if not len(qr):
        return out
    side = math.ceil(2 * reach) + 1
    blocks = (qr // block) * (w // block + 1) + qc // block
    order = np.argsort(blocks, kind="stable")
    starts = np.flatnonzero(np.diff(blocks[order], prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        left, margin = order[a:b], min(side, 8)
        r0, c0 = int(qr[left].min()), int(qc[left].min())
        while len(left):
            near = np.flatnonzero((pr >= r0 - margin) & (pr < r0 + block + margin) & (pc >= c0 - margin) & (pc < c0 + block + margin))
            step = max(1, _BLOCK // max(1, len(near)))
            rest = []
            for k in range(0, len(left), step):
                some = left[k : k + step]
                if len(near) < 3:
                    rest.append(some)
                    continue
                y, x = (pr[near] - r0).astype(float), (pc[near] - c0).astype(float)
                qy, qx = (qr[some] - r0).astype(float), (qc[some] - c0).astype(float)
                unsure = np.zeros(len(some), bool)
                todo = np.arange(len(some))
                for nudge in (1e-6, -1e-6):  # the triangle on the other side of an edge will do as well
                    if not len(todo):
                        break
                    t = _triangles(qx[todo], qy[todo], x, y, heavy[near], nudge)
                    found = np.flatnonzero(t[:, 0] >= 0)
                    tx, ty = x[t[found]], y[t[found]]
                    ox, oy, radius = _radius(tx, ty)
                    sure = (ox - radius >= -margin) & (ox + radius <= block - 1 + margin) & (oy - radius >= -margin) & (oy + radius <= block - 1 + margin)
                    good = sure & (radius <= reach + 1e-9)
                    at = todo[found[good]]
                    plane = _planes(tx[good], ty[good], z[pr[near], pc[near]][t[found[good]]])
                    out[qr[some[at]], qc[some[at]]] = -(plane[:, 0] * qx[at] + plane[:, 1] * qy[at] + plane[:, 3]) / plane[:, 2]
                    missed = np.ones(len(todo), bool)
                    missed[found[sure]] = False
                    unsure[todo[missed]] = True
                    unsure[at] = False
                    todo = np.setdiff1d(todo, at)
                rest.append(some[unsure])
            left = np.concatenate(rest) if margin < side else left[:0]
            margin = min(side, 2 * margin)
    return out


def fill_gaps(dsm: np.ndarray, ground_z: np.ndarray, max_gap: float, reach: float, origin: tuple[int, int] = (0, 0), inner: tuple[slice, slice] = (slice(None), slice(None))) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Surface, terrain and coverage of a raster window, gap and reach in cells; right inside ``inner`` only."""
    filled, gap = fill_nearest(ground_z, max(1, math.ceil(max_gap)))
    coverage = np.where(gap == 0, OBSERVED, np.where(gap <= max_gap, INTERPOLATED, UNOBSERVED))
    wanted = np.zeros(dsm.shape, bool)
    wanted[inner] = (coverage == INTERPOLATED)[inner]
    known = int((~np.isnan(ground_z)).sum())
    linear = linear_fill(ground_z, wanted, reach, origin) if known > 3 else np.full(dsm.shape, np.nan)
    dtm = np.where(np.isnan(linear), filled, linear)
    away = coverage == UNOBSERVED
    return np.where(away, np.nan, dsm), np.where(away, np.nan, dtm), coverage


def terrain_cells(bare: DataFrame, grid: Grid, max_gap: float, reach: float | None = None, tile: int = TILE) -> DataFrame:
    """``(row, col, dsm, dtm, coverage)`` of every cell of the raster, from :func:`bare_earth` cells. ``reach`` is three gaps unless it is given."""
    gap = max_gap / grid.resolution
    limit = 3 * gap if reach is None else reach / grid.resolution
    halo = max(math.ceil(gap), math.ceil(2 * limit) + 1)
    empty = float("nan")

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        at, (rows, cols) = _window(key, grid, tile, halo), _inner(key, grid, tile)
        inner = slice(rows.start - at[0], rows.stop - at[0]), slice(cols.start - at[2], cols.stop - at[2])
        dsm, dtm, coverage = (a[inner] for a in fill_gaps(_spread(part, "dsm", at), _spread(part, "ground_z", at), gap, limit, (at[0], at[2]), inner))
        r, c = np.indices(dsm.shape)
        return pd.DataFrame({"row": r.ravel() + rows.start, "col": c.ravel() + cols.start, "dsm": dsm.ravel(), "dtm": dtm.ravel(), "coverage": coverage.ravel().astype(np.int64)})

    low = F.when(F.col("low") <= F.col("bare") + GROUND_DZ, F.col("low")).otherwise(F.lit(empty))
    dealt = _dealt(bare.where("low IS NOT NULL AND NOT isnan(low)").select("row", "col", "dsm", low.alias("ground_z")), grid, tile, halo)
    last = math.ceil(grid.rows / tile), math.ceil(grid.cols / tile)
    schema = "row long, col long, dsm double, dtm double, coverage long"
    seen = dealt.groupBy("ty", "tx").applyInPandas(one, schema)
    # tiles that no cell reaches
    tiles = bare.sparkSession.range(last[0] * last[1]).select(F.floor(F.col("id") / last[1]).alias("ty"), (F.col("id") % last[1]).alias("tx"))
    void = tiles.join(dealt.select("ty", "tx").distinct(), ["ty", "tx"], "left_anti")
    span = lambda t, n: F.explode(F.sequence(F.col(t) * tile, F.least((F.col(t) + 1) * tile, F.lit(n)) - 1))
    void = void.withColumn("row", span("ty", grid.rows)).withColumn("col", span("tx", grid.cols))
    return seen.unionByName(void.select("row", "col", F.lit(empty).alias("dsm"), F.lit(empty).alias("dtm"), F.lit(UNOBSERVED).cast("long").alias("coverage")))


def terrain(points: DataFrame, resolution: float, max_gap: float, windows_m: Sequence[float] = WINDOWS_M, reach: float | None = None, tile: int = TILE, grid: Grid | None = None) -> DataFrame:
    """``(row, col, dsm, dtm, coverage)`` of a cloud's raster; heights are NaN where nothing was observed."""
    grid = grid or grid_of(points, resolution)
    if grid is None:
        return points.sparkSession.createDataFrame([], "row long, col long, dsm double, dtm double, coverage long")
    bare = materialise(bare_earth(surface_cells(points, grid), grid, windows_m, tile=tile), "bare_earth")
    return terrain_cells(bare, grid, max_gap, reach, tile)
