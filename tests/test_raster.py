"""Bare earth and terrain: cases, brute force on random cells, tiles against the whole."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kestrelframe.operators import raster
from kestrelframe.operators.raster import INTERPOLATED, OBSERVED, UNOBSERVED


def grid(n, top=()):
    x, y = np.meshgrid(np.arange(n) + 0.5, np.arange(n) + 0.5)
    z = np.zeros((n, n))
    for r, c in top:
        z[r, c] = 10
    return pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "z": z.ravel()})


def square(n):
    return raster.Grid(0.0, float(n), 1.0, n, n)


def slow_opening(z, w):
    """By the definition: mirrored edges, the second window leaning the other way."""
    h, n = z.shape
    mirror = lambda k, m: (k % (2 * m) if k % (2 * m) < m else 2 * m - 1 - k % (2 * m))
    for op, (a, b) in ((min, (-(w // 2), w - 1 - w // 2)), (max, (-(w - 1 - w // 2), w // 2))):
        z = np.array([[op(z[mirror(r + i, h), mirror(c + j, n)] for i in range(a, b + 1) for j in range(a, b + 1)) for c in range(n)] for r in range(h)])
    return z


@pytest.mark.parametrize("w", [3, 4, 7, 10])
def test_opening_by_definition(w):
    z = np.random.default_rng(w).random((9, 12))
    assert np.array_equal(raster.opening(z, w), slow_opening(z, w))


def test_nearest_fill_by_definition():
    rng = np.random.default_rng(3)
    for shape in ((7, 9), (12, 5), (3, 8)):
        z = np.where(rng.random(shape) < 0.25, rng.random(shape), np.nan)
        z[1, 2] = 0.5
        cells = np.argwhere(~np.isnan(z))
        got, gap = raster.fill_nearest(z, 4)
        for r in range(shape[0]):
            for c in range(shape[1]):
                best = min(((r - i) ** 2 + (c - j) ** 2, i, j) for i, j in cells)
                near = best[0] <= 16
                assert (got[r, c] == z[best[1], best[2]] and gap[r, c] == math.sqrt(best[0])) if near else math.isnan(got[r, c])


def brute_linear(z, reach):
    """Every triple of known cells whose circle holds no known cell (ties by the weights), in whole numbers."""
    cells = [tuple(map(int, c)) for c in np.argwhere(~np.isnan(z))]
    weight = dict(zip(cells, map(int, raster._weights(*np.array(cells).T)), strict=True))
    out = np.full(z.shape, np.nan)
    det = lambda a, b, c: a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    empty = np.argwhere(np.isnan(z))
    for t in itertools.combinations(cells, 3):
        area = (t[1][1] - t[0][1]) * (t[2][0] - t[0][0]) - (t[1][0] - t[0][0]) * (t[2][1] - t[0][1])
        if area == 0:
            continue
        a, b, c = t if area > 0 else (t[0], t[2], t[1])

        def over(p, lift, a=a, b=b, c=c):
            rows = [(v[1] - a[1], v[0] - a[0], lift(v) - lift(a)) for v in (b, c, p)]
            return det(*rows)

        flat = lambda v: v[0] * v[0] + v[1] * v[1]
        if any((over(p, flat), over(p, weight.get)) < (0, 0) for p in cells if p not in t):
            continue
        _, _, radius = raster._radius(*(np.array([[v[k] for v in (a, b, c)]], float) for k in (1, 0)))
        if radius[0] > reach:
            continue
        m = np.array([[v[1], v[0], 1] for v in (a, b, c)], float)
        plane = np.linalg.solve(m, [z[v] for v in (a, b, c)])
        for r, k in empty:
            share = np.linalg.solve(m.T, [k, r, 1])
            if (share > -1e-9).all():
                out[r, k] = plane @ [k, r, 1]
    return out


@pytest.mark.parametrize(("seed", "share", "reach"), [(1, 0.15, 100.0), (2, 0.3, 100.0), (3, 0.15, 3.0), (4, 0.05, 100.0), (5, 0.12, 4.5)])
def test_linear_fill_equals_all_triangles(seed, share, reach):
    rng = np.random.default_rng(seed)
    z = np.where(rng.random((13, 15)) < share, rng.normal(size=(13, 15)), np.nan)
    got = raster.linear_fill(z, np.isnan(z), reach, block=5)
    np.testing.assert_allclose(got, brute_linear(z, reach), atol=1e-9)


def test_cells_inside_the_ground_are_no_corners():
    """A plane with holes comes back as the plane, whatever the triangles."""
    r, c = np.indices((60, 70))
    z = 0.25 * r - 0.5 * c
    holes = z.copy()
    for i, j, k in ((10, 10, 12), (35, 20, 20), (20, 50, 7), (0, 30, 3)):
        holes[i : i + k, j : j + k] = np.nan
    got = raster.linear_fill(holes, np.isnan(holes), 40.0)
    inside = np.isnan(holes) & (r > 2)
    np.testing.assert_allclose(got[inside], z[inside], atol=1e-9)


def collected(df):
    return df.toPandas().sort_values(["row", "col"]).reset_index(drop=True)


def test_terrain_removes_a_building(spark):
    block = [(r, c) for r in range(3, 7) for c in range(3, 7)]
    got = collected(raster.terrain(spark.createDataFrame(grid(10, block)), 1.0, 5.0, (3.0, 10.0), grid=square(10)))
    assert got["dsm"].max() == 10 and got["dtm"].max() == 0 and (got["coverage"] == INTERPOLATED).sum() == 16


def scattered(seed, n, cells):
    """Points on rough ground with buildings and wide gaps."""
    rng = np.random.default_rng(seed)
    p = pd.DataFrame({"x": rng.random(cells) * n, "y": rng.random(cells) * n})
    p["z"] = np.sin(p["x"] / 9) * 3 + p["y"] * 0.05 + rng.random(cells) * 0.2
    p.loc[(p["x"] % 23 < 6) & (p["y"] % 19 < 6), "z"] += 8
    return p[~((p["x"] > n * 0.55) & (p["y"] > n * 0.5) & (p["x"] + p["y"] < n * 1.6))]


def test_tiles_equal_the_whole(spark):
    p = spark.createDataFrame(scattered(1, 70, 900))
    one, many = (collected(raster.terrain(p, 1.0, 4.0, (3.0, 6.0), tile=t)) for t in (200, 11))
    pd.testing.assert_frame_equal(one, many)
    assert set(one["coverage"]) == {UNOBSERVED, OBSERVED, INTERPOLATED}
    g = raster.grid_of(p, 1.0)
    assert len(one) == g.rows * g.cols and one[["row", "col"]].drop_duplicates().shape[0] == len(one)
    assert one.loc[one["coverage"] == UNOBSERVED, ["dsm", "dtm"]].isna().all().all() and one.loc[one["coverage"] != UNOBSERVED, "dtm"].notna().all()


def test_terrain_equals_one_array(spark):
    """The distributed plan against the same rules on one array, points and all."""
    points = scattered(2, 40, 500)
    p = spark.createDataFrame(points)
    g = raster.grid_of(p, 1.0)
    row = np.clip(np.floor(g.y1 - points["y"]), 0, g.rows - 1).astype(int)
    col = np.clip(np.floor(points["x"] - g.x0), 0, g.cols - 1).astype(int)
    low, dsm = np.full((g.rows, g.cols), np.inf), np.full((g.rows, g.cols), -np.inf)
    np.minimum.at(low, (row, col), points["z"])
    np.maximum.at(dsm, (row, col), points["z"])
    low, dsm = (np.where(np.isinf(a), np.nan, a) for a in (low, dsm))
    bare = raster.bare_surface(low, 1.0, (3.0, 6.0))
    ground = points["z"] <= bare[row, col] + 0.5
    z = np.full(low.shape, np.inf)
    np.minimum.at(z, (row[ground], col[ground]), points["z"][ground])
    want = raster.fill_gaps(dsm, np.where(np.isinf(z), np.nan, z), 3.0, 9.0)
    got = collected(raster.terrain(p, 1.0, 3.0, (3.0, 6.0), tile=13))
    for a, name in zip(want, ("dsm", "dtm", "coverage"), strict=True):
        np.testing.assert_allclose(got[name].to_numpy().reshape(low.shape), a, atol=1e-9)
    cells = raster.bare_earth(raster.surface_cells(p, g), g, (3.0, 6.0), tile=13)
    assert raster.ground(p, cells, g).where("ground").count() == ground.sum()


def test_coverage_states_and_void_tiles(spark):
    p = spark.createDataFrame(pd.DataFrame({"x": [0.5, 5.5, 60.5], "y": [0.5, 5.5, 60.5], "z": [0.0, 0.0, 0.0]}))
    got = collected(raster.terrain(p, 1.0, 3.0, (3.0,), reach=3.0, tile=8))
    assert set(got["coverage"]) == {UNOBSERVED, OBSERVED, INTERPOLATED} and len(got) == 3600
    assert raster.terrain(p.limit(0), 1.0, 1.0).count() == 0 and raster.terrain(p.limit(1), 1.0, 1.0).count() == 0
    odd = p.unionByName(spark.createDataFrame([(None, 1.0, 1.0), (3.0, 3.0, math.nan)], "x double, y double, z double"))
    pd.testing.assert_frame_equal(collected(raster.terrain(odd, 1.0, 3.0, (3.0,), reach=3.0, tile=8)), got)


def test_many_points_in_one_tile_are_cells_to_a_task(spark):
    p = spark.range(2_000_000).select((F.rand(1) * 40).alias("x"), (F.rand(2) * 40).alias("y"), F.rand(3).alias("z"))
    cells = raster.surface_cells(p, square(40))
    assert cells.count() == 1600
    assert raster.terrain(p, 1.0, 3.0, (3.0,), grid=square(40)).where(F.col("coverage") == OBSERVED).count() == 1600
