"""Shared points of image pairs against sets, with a point that every image sees."""

import random
from itertools import permutations

import pytest

import __spark_entry__ as entry
from kestrelframe.operators.overlap import shared_points, top_shared


@pytest.mark.parametrize("block", [4, 512])
def test_hot_point_and_zero_overlaps(spark, block):
    rng = random.Random(block)
    rows = [(None, i) for i in range(40)] + [(f"p{rng.randint(0, 60)}", rng.randint(0, 39)) for _ in range(300)] + [("lone", 99), ("p1", None), ("p2", 5), ("p2", 5)]
    seen = {}
    for p, i in rows:
        if i is not None:
            seen.setdefault(i, set()).add(p)
    want = {(a, b): len(seen[a] & seen[b]) for a, b in permutations(seen, 2)}
    df = spark.createDataFrame(rows, "point string, img long").repartition(4)
    got = shared_points(df, with_none=True, block=block).collect()
    assert {(r.img, r.other): r.shared for r in got} == want and len(got) == len(want)
    some = {(r.img, r.other): r.shared for r in shared_points(df, block=block).collect()}
    assert some == {k: n for k, n in want.items() if n}


def test_no_images(spark):
    assert shared_points(spark.createDataFrame([], "point long, img long"), with_none=True).count() == 0


def test_pairs_are_counted_where_an_images_lists_meet(spark):
    """No row of a shuffle is a pair: lists of a point's images are sent, one for each row of the input."""
    df = spark.createDataFrame([(p, (p * 7 + k * k) % 50) for p in range(60) for k in range(12)], "point long, img long")
    got = shared_points(df)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate(keys=[img" not in plan


@pytest.mark.parametrize("block,far,few", [(4, 0, 3), (512, 0, 10000), (4, 1 << 40, 7), (512, 1 << 40, 1)])
def test_first_images_are_ranked_where_they_are_counted(spark, block, far, few):
    """Against sets, with equal counts, a point that all see, images that span batches, one that shares nothing, wide ids."""
    rng = random.Random(block)
    ids = [rng.randint(-60, 60) for _ in range(40)] + [far, -far]
    rows = [(None, i) for i in ids[:30]] + [(rng.randint(0, 60), rng.choice(ids)) for _ in range(400)] + [(1000, 999), (1, None), (5, 61), (5, 61)]
    seen = {}
    for p, i in rows:
        if i is not None:
            seen.setdefault(i, set()).add(p)
    counts = {(a, b): n for a, b in permutations(seen, 2) if (n := len(seen[a] & seen[b]))}
    want = [(a, b, counts[a, b]) for a in seen for b in sorted((b for x, b in counts if x == a), key=lambda b: (-counts[a, b], abs(a - b), b))[:5]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", few)
    try:
        out = top_shared(spark.createDataFrame(rows, "point long, img long").repartition(4), 5, block)
        got = [tuple(r) for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == sorted(want) and 999 in seen and 999 not in {r[0] for r in got}


def test_top_source_views_sort_no_pairs(spark):
    got = entry.queries()["o3_top_source_views"](spark, "/root/testdata/sf0.001")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate inline" not in plan


def test_top_of_no_images(spark):
    assert top_shared(spark.createDataFrame([], "point long, img long"), 5).count() == 0
