"""Normals of closed surfaces point outward; spanning trees and planted motions come back."""

import numpy as np
import pandas as pd

from kestrelframe.operators.registration import normals, register, turned
from kestrelframe.operators.transform import Similarity


def cloud(spark, xyz):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})).repartition(4)


def sphere(n, centre, radius):
    k = np.arange(n) + 0.5
    up, turn = np.arccos(1 - 2 * k / n), np.pi * (1 + 5**0.5) * k
    return np.column_stack([np.cos(turn) * np.sin(up), np.sin(turn) * np.sin(up), np.cos(up)]) * radius + centre


def test_normals_of_two_spheres_point_outward(spark):
    a, b = sphere(150, (0, 0, 0), 1.0), sphere(120, (9, 0, -3), 2.0)
    got = normals(cloud(spark, np.concatenate([a, b])), 8).toPandas().set_index("id").sort_index()
    out = np.concatenate([a, (b - [9, 0, -3]) / 2])
    n = got[["nx", "ny", "nz"]].to_numpy()
    assert len(got) == 270 and np.allclose(np.linalg.norm(n, axis=1), 1)
    assert ((n * out).sum(1) > 0.9).all()


def test_signs_follow_the_least_bent_tree(spark):
    """Against Kruskal's tree, on a graph with strong contradictions outside it."""
    rng = np.random.default_rng(2)
    n = 40
    edges = {(min(a, b), max(a, b)): (float(rng.random()), int(rng.choice([-1, 1]))) for a, b in rng.integers(0, n, (150, 2)) if a != b and (a < 35) == (b < 35)}
    rows = [(int(a), int(b), w, t) for (a, b), (w, t) in edges.items()]
    got = {r.node: (r.root, r.sign) for r in turned(spark.range(n), spark.createDataFrame(rows, "a long, b long, w double, turn int")).collect()}
    comp, sign = list(range(n)), [1] * n
    for w, a, b, t in sorted((w, a, b, t) for a, b, w, t in rows):
        if comp[a] != comp[b]:
            flip, old = sign[a] * sign[b] * t, comp[b]
            for k in range(n):
                if comp[k] == old:
                    comp[k], sign[k] = comp[a], sign[k] * flip
    for a in range(n):
        for b in range(n):
            assert (got[a][0] == got[b][0]) == (comp[a] == comp[b])
            if comp[a] == comp[b]:
                assert got[a][1] * got[b][1] == sign[a] * sign[b]


def test_planted_motion_is_found(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(250, 3)) * [4, 3, 2]
    c, s = np.cos(0.05), np.sin(0.05)
    r = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])
    q = p @ r.T + [0.05, -0.04, 0.03]
    t, share, rmse = register(cloud(spark, p), cloud(spark, np.concatenate([q, [[99.0, 0, 0]]])), 2.0)
    assert share == 1.0 and rmse < 1e-6 and np.allclose(t.rotation, r, atol=1e-6) and np.allclose(t.translation, [0.05, -0.04, 0.03], atol=1e-6)
    nowhere = register(cloud(spark, p[:5]), cloud(spark, p[:5] + 1000), 1.0)
    assert isinstance(nowhere[0], Similarity) and nowhere[1:] == (0.0, 0.0)
