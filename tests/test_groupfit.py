"""Robust fits by group: planted models come back, counts equal brute force."""

import numpy as np
import pandas as pd
import pytest

from kestrelframe.operators import groupfit
from kestrelframe.operators.groupfit import FUNDAMENTAL, HOMOGRAPHY, SIMILARITY, robust_fits


def plane(rng):
    m = np.eye(3) + rng.normal(size=(3, 3)) * [[0.1, 0.1, 30], [0.1, 0.1, 30], [1e-4, 1e-4, 0]]
    return m / np.linalg.norm(m)


def project(m, a):
    p = np.column_stack([a, np.ones(len(a))]) @ m.T
    return p[:, :2] / p[:, 2:]


def matches(seed, sizes, outliers=0.4):
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for g, n in sizes.items():
        m = truth[g] = plane(rng)
        a = rng.random((n, 2)) * 800
        b = project(m, a) + rng.normal(size=(n, 2)) * 0.3
        bad = rng.random(n) < outliers
        b[bad] += rng.choice([-1, 1], (bad.sum(), 2)) * (40 + rng.random((bad.sum(), 2)) * 300)
        rows += [(g, i, *a[i].tolist(), *b[i].tolist()) for i in range(n)]
    return rows, truth


def test_homographies_of_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(groupfit, "ROWS", 100)  # the large pair is many parts
    sizes = {f"p{k}": n for k, n in enumerate([900, 30, 12, 60, 4, 3])} | {None: 40}
    rows, truth = matches(1, sizes)
    rows += [("p1", 10_000, float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "pair string, id long, x double, y double, u double, v double").repartition(5)
    fits, marked = robust_fits(df, ["pair"], ("x", "y"), ("u", "v"), HOMOGRAPHY, 2.0, trials=60)
    got = {r.pair: r for r in fits.collect()}
    assert set(got) == set(sizes) and got["p5"].model is None and got["p5"].inliers == 0
    data = pd.DataFrame(rows, columns=["pair", "id", "x", "y", "u", "v"]).dropna(subset=["x"])
    seen = marked.toPandas()
    for g, n in sizes.items():
        mine = data[data["pair"].isna() if g is None else data["pair"] == g]
        assert got[g].n == n
        if got[g].model is None:
            continue
        d = np.linalg.norm(project(np.array(got[g].model).reshape(3, 3), mine[["x", "y"]].to_numpy()) - mine[["u", "v"]].to_numpy(), axis=1)
        assert got[g].inliers == (d <= 2.0).sum()  # brute force with the reported model
        rows_of = seen[seen["pair"].isna() if g is None else seen["pair"] == g]
        assert rows_of["inlier"].sum() == got[g].inliers and len(rows_of) == n
        if n >= 30:
            corner = np.array([[0, 0], [800, 0], [800, 800], [0, 800.0]])
            assert np.abs(project(np.array(got[g].model).reshape(3, 3), corner) - project(truth[g], corner)).max() < 3
    again, _ = robust_fits(df.repartition(2), ["pair"], ("x", "y"), ("u", "v"), HOMOGRAPHY, 2.0, trials=60)
    assert {r.pair: r.inliers for r in again.collect()} == {g: r.inliers for g, r in got.items()}


def test_two_views_of_a_scene(spark):
    rng = np.random.default_rng(2)
    p = np.column_stack([rng.normal(size=(200, 2)) * 2, 6 + rng.random(200) * 4])
    c, s = np.cos(0.1), np.sin(0.1)
    q = p @ np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]).T + [1.0, 0.1, 0.05]
    a, b = (500 * v[:, :2] / v[:, 2:] + 320 for v in (p, q))
    bad = np.arange(200) % 5 == 0
    b[bad] += rng.normal(size=(40, 2)) * 80
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "id": np.arange(200), "x": a[:, 0], "y": a[:, 1], "u": b[:, 0], "v": b[:, 1]}))
    fits, marked = robust_fits(df, ["g"], ("x", "y"), ("u", "v"), FUNDAMENTAL, 0.5, trials=150)
    r, m = fits.first(), marked.toPandas()
    f = np.array(r.model).reshape(3, 3)
    assert abs(np.linalg.det(f)) < 1e-9
    good = m[~(m["id"] % 5 == 0)]
    assert good["inlier"].all() and r.inliers < 180


@pytest.mark.parametrize("scale", [2.5, 0.3])
def test_similarities(spark, scale):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(3):
        u, _, v = np.linalg.svd(rng.normal(size=(3, 3)))
        r = u @ v * np.linalg.det(u @ v)
        a = rng.normal(size=(50, 3)) * 10
        b = scale * a @ r.T + [1.0, 2, 3]
        b[:15] += rng.normal(size=(15, 3)) * 30 + 20
        rows += [(g, i, *a[i].tolist(), *b[i].tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "g long, id long, x double, y double, z double, u double, v double, w double")
    fits, marked = robust_fits(df, ["g"], ("x", "y", "z"), ("u", "v", "w"), SIMILARITY, 0.1)
    for r in fits.collect():
        m = np.array(r.model).reshape(3, 4)
        assert r.inliers == 35 and abs(np.cbrt(np.linalg.det(m[:, :3])) - scale) < 1e-6
        np.testing.assert_allclose(m[:, 3], [1, 2, 3], atol=1e-5)
    assert marked.where("inlier AND id < 15").count() == 0


def test_small_groups_write_nothing_for_their_hypotheses(spark, monkeypatch):
    rows, _ = matches(4, {k: 30 for k in range(20)})
    written = []

    def keep(df, label):
        written.append((label, df.count()))
        return df

    monkeypatch.setattr(groupfit, "materialise", keep)
    df = spark.createDataFrame(rows, "pair long, id long, x double, y double, u double, v double")
    fits, _ = robust_fits(df, ["pair"], ("x", "y"), ("u", "v"), HOMOGRAPHY, 2.0, trials=60)
    assert fits.count() == 20 and sum(n for _, n in written) == 0
