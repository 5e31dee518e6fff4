"""Quantiles against NumPy on random groups, with bounds so small that bins must be cut several times."""

import math
import random

import numpy as np
import pytest

from kestrelframe.operators.orderstats import quantiles, with_quantiles

WANTED = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p95": 0.95, "top": 1.0, "upper": ("upper", 0.5)}


def expected(values):
    v = sorted(values)
    return {name: float(np.quantile(v, w)) if isinstance(w, float) else v[min(len(v) - 1, int(w[1] * len(v)))] for name, w in WANTED.items()}


def values_of(seed):
    rng = random.Random(seed)
    return {
        "normal": [rng.gauss(3, 1) for _ in range(2000)],
        "narrow": [1e6 + rng.random() * 1e-7 for _ in range(1500)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(1000)],
        "ties": [float(rng.randint(0, 3)) for _ in range(1200)],
        "two": [1.0, np.nextafter(1.0, 2.0)] * 500,
        None: [rng.random() for _ in range(40)],
        "one": [7.25],
        "zero": [0.0, -0.0, 0.0],
    }


@pytest.mark.parametrize("most", [5, 100, 1 << 16])
def test_groups_equal_numpy(spark, most):
    groups = values_of(most)
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("normal", None), ("void", None)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: r.asDict() for r in quantiles(frame, "v", WANTED, ["g"], most=most, cuts=16).collect()}
    assert set(got) == set(groups)  # a group without values has no row
    for g, vs in groups.items():
        for name, want in expected(vs).items():
            assert math.isclose(got[g][name], want, rel_tol=1e-12, abs_tol=1e-300), (g, name)


def test_whole_column_infinities_and_nan(spark):
    frame = spark.createDataFrame([(v,) for v in (math.nan, math.inf, -math.inf, 2.0, 1.0)], "v double")
    r = quantiles(frame, "v", {"a": 0.0, "b": 0.25, "c": 0.75}).first()
    assert (r.a, r.b, r.c) == (-math.inf, 1.0, math.inf)
    top = quantiles(frame, "v", {"z": 1.0}).first()
    assert math.isnan(top.z)


def test_nothing(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], "g string, v double")
    assert quantiles(none, "v", WANTED, ["g"]).collect() == []
    assert with_quantiles(none.agg(F.count("*").alias("n")), none, "v", {"mid": 0.5}).collect() == [(0, None)]


def test_no_task_sorts_more_than_the_bound(spark, monkeypatch):
    """What is ranked at last stands in bins of at most ``most`` rows."""
    from kestrelframe.operators import orderstats

    frame = spark.range(200_000).selectExpr("id % 2 g", "sqrt(id) v")
    written = []

    def keep(df, label):
        out = materialise(df, label)
        written.append((label, out))
        return out

    materialise = orderstats.materialise
    monkeypatch.setattr(orderstats, "materialise", keep)
    found = quantiles(frame, "v", {"mid": 0.5, "p95": 0.95}, ["g"], most=500, cuts=64).collect()
    want = {g: np.sqrt(np.arange(g, 200_000, 2)) for g in (0, 1)}
    for r in found:
        assert math.isclose(r.mid, np.quantile(want[r.g], 0.5)) and math.isclose(r.p95, np.quantile(want[r.g], 0.95))
    sizes = [out.groupBy("_k").count().agg({"count": "max"}).first()[0] for label, out in written if label == "quantile_rows"]
    assert len(sizes) > 1 and sizes[0] > 500 >= sizes[-1]
