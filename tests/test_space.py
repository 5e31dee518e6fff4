"""Neighbours over the octree against all distances."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kestrelframe.operators.space import Octree, neighbours


def frame(spark, xyz, first=0, **more):
    data = {"id": np.arange(first, first + len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]} | more
    return spark.createDataFrame(pd.DataFrame(data)).repartition(5)


def brute(q, p, k, first=0):
    d = np.zeros((len(q), len(p)))
    for axis in range(3):
        d += (q[:, axis, None] - p[None, :, axis]) ** 2
    d = np.sqrt(d)
    out = set()
    for i in range(len(q)):
        for r, j in enumerate(np.lexsort((np.arange(len(p)), d[i]))[:k]):
            out.add((i, r + 1, int(j) + first, round(float(d[i, j]), 9)))
    return out


def clustered(seed, n):
    """Half of the points in one small cube, a tenth of them at one place, the rest on a wide plane with far outliers."""
    rng = np.random.default_rng(seed)
    dense = rng.random((n // 2, 3)) * 1e-3 + 5
    dense[: n // 10] = 5.0005
    wide = np.column_stack([rng.random((n - n // 2, 2)) * 1000, rng.normal(size=n - n // 2)])
    wide[:3] = [[1e6, 0, 0], [0, -1e5, 3], [500, 500, 9e4]]
    return np.concatenate([dense, wide])


@pytest.mark.parametrize(("k", "leaf_rows"), [(6, 30), (50, 200)])
def test_dense_cube_and_outliers(spark, k, leaf_rows):
    p = clustered(1, 1200)
    q = np.concatenate([clustered(2, 150), [[-1e7, 0, 0], [5.0005, 5.0005, 5.0005], [300, 300, 300]]])
    got = neighbours(frame(spark, q), frame(spark, p, 7), k, leaf_rows).collect()
    assert {(r.id, r["rank"], r.point_id, round(r.distance, 9)) for r in got} == brute(q, p, k, 7)
    assert len(got) == k * len(q)


def test_leaves_are_bounded(spark):
    tree = Octree(frame(spark, clustered(3, 4000)), 50)
    sizes = tree.points.groupBy("cell", "part").count().toPandas()["count"]
    assert sizes.sum() == 4000 and sizes.max() <= 100  # parts of one place are dealt by id, so about the bound
    whole = tree.points.join(tree.cells.where("parts = 1"), "cell").groupBy("cell").count()
    assert whole.agg(F.max("count")).first()[0] <= 50
    assert tree.cells.where("parent IS NULL").first()["n"] == 4000


def test_payload_nulls_and_few_points(spark):
    p = np.array([[0.0, 0, 0], [1, 0, 0], [np.nan, 0, 0]])
    points = frame(spark, p, tag=["a", "b", "c"])
    asked = frame(spark, np.array([[0.9, 0, 0]])).unionByName(spark.createDataFrame([(5, None, 0.0, 0.0)], "id long, x double, y double, z double"))
    got = neighbours(asked, points, 3, keep=["tag"]).orderBy("rank").collect()
    assert [(r.id, r["rank"], r.point_id, r.tag) for r in got] == [(0, 1, 1, "b"), (0, 2, 0, "a")]
    assert neighbours(asked, points.limit(0), 2, keep=["tag"]).columns == ["id", "rank", "point_id", "distance", "tag"]


def test_many_queries_of_one_leaf_are_shared_out(spark, monkeypatch):
    from kestrelframe.operators import space

    monkeypatch.setattr(space, "GUESTS", 40)
    rng = np.random.default_rng(5)
    p, q = rng.random((90, 3)), rng.random((500, 3))
    got = neighbours(frame(spark, q), frame(spark, p), 4, 30).collect()
    assert {(r.id, r["rank"], r.point_id, round(r.distance, 9)) for r in got} == brute(q, p, 4)
