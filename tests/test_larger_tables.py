"""What larger tables have and the smallest ones lack: equal times, many images, leaves, crowded times."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kestrelframe.operators import asof, components


def repeated_places(spark, path, ascending):
    """Events whose ``user_id * 100000 + event_id`` repeats, also at the end of a bucket of two million, in either order of the file."""
    hour = 3600.0
    rows = [(1, 0, 1), (100005, 5, 1), (5, 3, 2), (6, 9, 2), (199999, 12, 18), (99999, 10, 19), (0, 11, 20)]
    df = spark.createDataFrame([(e, t * hour, u) for e, t, u in rows], "event_id long, s double, user_id long")
    df = df.select("event_id", "user_id", F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.timestamp_micros((F.col("s") * 1000000).cast("long")).cast("timestamp_ntz").alias("ts"))
    df.orderBy("s" if ascending else F.desc("s")).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def events(spark, path, rows):
    """A folder with an ``events`` table of ``(event_id, seconds, event_type, value)``."""
    df = spark.createDataFrame(rows, "event_id long, s double, event_type string, value double").withColumn("user_id", F.lit(1).cast("long"))
    df.withColumn("ts", F.timestamp_micros((F.col("s") * 1000000).cast("long")).cast("timestamp_ntz")).drop("s").orderBy("event_id").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def sql(name, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_synchronisation_with_equal_times(spark, tmp_path):
    """The SQL leaves the choice open: the row nearest in the stream's own order is taken on either side."""
    d = events(spark, tmp_path, [(1, 86390.0, "click", 9.0), (2, 86390.0, "click", 1.0), (3, 86410.0, "purchase", 0.0), (4, 86420.0, "click", 9.0), (5, 86420.0, "click", 1.0), (6, 86420.0, "purchase", 0.0)])
    got = sorted(tuple(r) for r in entry.queries()["j2_stream_synchronisation"](spark, d).select("seq", "click_status", "click", "error_status", "error", "signup_status", "signup").collect())
    assert [r[:3] for r in got] == [(3, "INTERPOLATED", 6.333333), (6, "EXACT", 1.0)]


def test_scan_with_equal_times(spark, tmp_path):
    d = events(spark, tmp_path, [(1, 5.0, "click", 9.0), (2, 5.0, "click", 1.0), (3, 6.0, "click", 1000.0)])
    got = sorted(tuple(r) for r in entry.queries()["s1_telemetry_scan"](spark, d).select("frame", "time", "latitude", "errors").collect())
    assert got == sql("s1_telemetry_scan", d) and [r[3] for r in got] == [0, 0, 1]


def test_first_within_crowded_times_makes_no_pairs(spark):
    rng = random.Random(5)
    left = [(rng.choice("ab"), rng.randint(0, 400) / 8) for _ in range(300)]
    right = [(rng.choice("abc"), rng.randint(0, 400) / 8, o) for o in rng.sample(range(1000), 120)]
    got = asof.first_within(spark.createDataFrame(left, "k string, t double").repartition(3), spark.createDataFrame(right, "k string, t double, o int"), ["k"], "t", "o", 0.5, ["o"])
    want = [(k, t, min(near)[1], min(near)[0]) for k, t in left if (near := [(o, s) for j, s, o in right if j == k and abs(t - s) < 0.5])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and 0 < len(want) < 300
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_leaves_stay_out_of_the_rounds(spark, monkeypatch):
    rng = random.Random(6)
    edges = [(k, 1000 + rng.randint(0, 60)) for k in range(40) for _ in range(2)] + [(100 + k % 9, -k) for k in range(1, 200)] + [(5, 5), (700, 700), (801, 800), (900, None), (5, 1000), (5, 1000)]
    root = {n: n for e in edges if None not in e for n in e}
    while any(root[a] != root[b] for a, b in edges if b is not None):
        for a, b in edges:
            if b is not None:
                root[a] = root[b] = min(root[a], root[b])
    met = []
    rounds = components._rounds
    monkeypatch.setattr(components, "_rounds", lambda e, label: (met.append(e.count()), rounds(e, label))[1])
    got = components.components(spark.createDataFrame(edges, "a long, b long"), peel=True).collect()
    assert sorted((r.node, r.root) for r in got) == sorted(root.items())
    assert 0 < met[0] < 100  # of 285 edges


@pytest.mark.parametrize("ascending", [True, False])
def test_statistics_with_repeated_places(spark, tmp_path, ascending):
    """The SQL leaves the order of one place open; here it is that of time, whatever the file's."""
    got = entry.queries()["a1_stream_statistics"](spark, repeated_places(spark, tmp_path, ascending)).collect()
    assert [(r.sample_count, r.duplicate_count, r.backward_count, r.largest_gap_s, r.rows_reordered) for r in got] == [(7, 0, 1, 14400.0, True)]


@pytest.mark.parametrize("ascending", [True, False])
def test_order_faults_with_repeated_places(spark, tmp_path, ascending):
    got = entry.queries()["w7_order_faults"](spark, repeated_places(spark, tmp_path, ascending)).collect()
    assert [tuple(r) for r in got] == [("click", 1, 0, -3600.0)]


@pytest.mark.parametrize("ascending", [True, False])
def test_non_decreasing_rows_with_repeated_places(spark, tmp_path, ascending):
    got = entry.queries()["w6_non_decreasing_rows"](spark, repeated_places(spark, tmp_path, ascending)).collect()
    assert [tuple(r) for r in got] == [("click", 8)]
