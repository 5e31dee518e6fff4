"""Visible faces against a ray cast at every triangle."""

import numpy as np
import pandas as pd
import pytest

from kestrelframe.operators import mesh
from kestrelframe.operators.visibility import View, best_views, unoccluded

FRONT = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))


def tables(spark, xyz, tri):
    v = spark.createDataFrame(pd.DataFrame({"vid": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}))
    f = spark.createDataFrame(pd.DataFrame({"fid": np.arange(len(tri)), "v0": tri[:, 0], "v1": tri[:, 1], "v2": tri[:, 2]}))
    return mesh.corners(f, v)


def brute(xyz, tri, views):
    out = set()
    for c in views:
        p = xyz @ np.array(c.rotation).T + np.array(c.translation)
        corner = p[tri]
        for f, t in enumerate(corner):
            if (t[:, 2] <= 1e-9).any():
                continue
            u, v = c.fx * t[:, 0] / t[:, 2] + c.cx, c.fy * t[:, 1] / t[:, 2] + c.cy
            if not ((u >= 1) & (u <= c.width - 2) & (v >= 1) & (v <= c.height - 2)).all():
                continue
            d, hidden = t.mean(0), False
            for g, s in enumerate(corner):
                n = np.cross(s[1] - s[0], s[2] - s[0])
                if g == f or d @ n == 0:
                    continue
                depth = s[0] @ n / (d @ n)
                side = [d @ np.cross(s[i], s[(i + 1) % 3]) for i in range(3)]
                hidden |= 0 < depth < 1 - 1e-9 and (min(side) >= 0 or max(side) <= 0)
            if not hidden:
                out.add((f, c.view))
    return out


def turned(angle, view, distance):
    c, s = np.cos(angle), np.sin(angle)
    return View(view, ((c, 0.0, s), (0.0, 1.0, 0.0), (-s, 0.0, c)), (0.1, -0.2, distance), 500, 480, 320, 240, 640, 480)


def test_back_wall_is_hidden(spark):
    wall = [[-1, -1], [1, -1], [1, 1], [-1, 1]]
    xyz = np.array([[*p, 10.0] for p in wall] + [[*p, 20.0] for p in wall])
    tri = np.array([[0, 1, 2], [0, 2, 3], [4, 5, 6], [4, 6, 7]])
    view = View(0, FRONT, (0.0, 0.0, 0.0), 1000, 1000, 500, 500, 1000, 1000)
    cornered = tables(spark, xyz, tri)
    assert {r.fid for r in unoccluded(cornered, [view]).collect()} == {0, 1}
    assert {r.fid: r.view for r in best_views(cornered, [view]).collect()} == {0: 0, 1: 0, 2: None, 3: None}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_soup_equals_ray_casting(spark, seed):
    """Large and tiny faces, faces that cross the camera's plane, and views from several sides."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(140, 1, 3)) * 2
    size = rng.choice([1e-4, 0.05, 0.5, 3.0], size=(140, 1, 1))
    xyz = (centre + rng.normal(size=(140, 3, 3)) * size).reshape(-1, 3)
    tri = np.arange(420).reshape(-1, 3)
    views = [turned(0.3, 0, 8.0), turned(2.0, 1, 1.0), turned(4.0, 5, 12.0)]
    got = {(r.fid, r.view) for r in unoccluded(tables(spark, xyz, tri), views).collect()}
    want = brute(xyz, tri, views)
    assert got == want and 20 < len(want) < 3 * 140


def test_no_faces(spark):
    cornered = tables(spark, np.zeros((1, 3)), np.zeros((1, 3), int)).limit(0)
    assert unoccluded(cornered, [turned(0.0, 0, 5.0)]).count() == 0
