"""Rows with null keys or times, and equal rows, keep their place in joins along time."""

import pytest

from kestrelframe.operators import asof, streams

PROBES = [("a", 1.0), ("a", 25.0), ("a", None), (None, 3.0), (None, None), ("b", 9.0), ("a", 1.0)]
SAMPLES = [("a", 0.0, 5.0), ("a", 30.0, 6.0), (None, 2.0, 7.0), ("c", 1.0, 8.0), ("a", None, 9.0)]


def shown(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("width", (0.5, 10.0, 1000.0))
def test_bracket_with_width_is_bracket(spark, width):
    p, s = spark.createDataFrame(PROBES, "k string, t double"), spark.createDataFrame(SAMPLES, "k string, t double, v double")
    plain = asof.bracket(p, s, ["k"], "t", ["v"])
    assert shown(asof.bracket(p, s, ["k"], "t", ["v"], width)) == shown(plain) and plain.count() == len(PROBES)


@pytest.mark.parametrize("width", (0.5, 10.0, 1000.0))
def test_previous_with_width_is_previous(spark, width):
    rows = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(PROBES[:-1])], "k string, t double, n int")
    plain = streams.previous(rows, ["k"], ["t"], ["n"])
    assert shown(streams.previous(rows, ["k"], ["t"], ["n"], width=width)) == shown(plain) and plain.count() == len(PROBES) - 1


def test_first_within_keeps_equal_rows(spark):
    p, s = spark.createDataFrame(PROBES, "k string, t double"), spark.createDataFrame([("a", 1.2, 2, "late"), ("a", 0.9, 1, "first"), ("b", 9.6, 1, "far")], "k string, t double, o int, v string")
    got = asof.first_within(p, s, ["k"], "t", "o", 0.5, ["v"]).collect()
    assert [(r.k, r.t, r.m_v) for r in got] == [("a", 1.0, "first")] * 2
