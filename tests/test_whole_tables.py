"""Queries without SQL read whole tables: brute force on small fixtures."""

import random

import __spark_entry__ as entry


def test_mesh_queries_read_every_face(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.randrange(500), 1 + k % 7) for k in range(1, 140)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    at = {k: [rng.uniform(-0.2, 0.2) for _ in range(3)] for k in range(500)}
    spark.createDataFrame([(k, [float(c) for c in v], k % 4) for k, v in at.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    faces = {k * 8 + n: (p % 500, (p + n) % 500, (p + 7 * n) % 500) for k, p, n in rows}

    def clusters(faces):
        by_edge, root = {}, {f: f for f in faces}
        for f, (a, b, c) in faces.items():
            for e in ((a, b), (b, c), (a, c)):
                by_edge.setdefault(tuple(sorted(e)), set()).add(f)
        for fs in by_edge.values():
            roots = {root[f] for f in fs}
            root = {f: min(roots) if r in roots else r for f, r in root.items()}
        return {f: root[f] for f in {f for fs in by_edge.values() if len(fs) > 1 for f in fs}}

    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    assert {r.fid: r.cluster for r in run("g2_face_components")} == clusters(faces)
    size = list(clusters(faces).values())
    assert {r.fid for r in run("g3_large_clusters")} == {f for f, c in clusters(faces).items() if size.count(c) >= 25}
    some = clusters({f: v for f, v in faces.items() if f % 3 == 0})
    z = {k: 10 * v[2] for k, v in at.items()}
    want = {}
    for f, c in some.items():
        want.setdefault(c, []).extend(z[v] for v in faces[f])
    got = {r.cluster: r.height for r in run("a18_region_heights")}
    high = {c: max(h) - min(h) for c, h in want.items() if max(h) - min(h) > 2}
    assert got.keys() == high.keys() and all(abs(got[c] - h) < 1e-4 for c, h in high.items())
    used = {v for f in faces.values() for v in f}
    # every corner's own query lies 0.14 from it and so has a face
    assert used <= {r.id for r in run("j20_surface_matches")}


def test_every_control_is_judged(spark, tmp_path):
    def judged(rows, name):
        spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/{name}/supplier.parquet")
        return tuple(entry.queries()["v8_control_geometry"](spark, f"{tmp_path}/{name}").first())

    rows = [(k, k * 7 % 25, k * 37 % 900 * 1e3) for k in range(80)]
    assert judged(rows, "apart") == ("GOOD", "")
    flat = [(k, k * 7 % 25, 0.1 if k < 70 else k * 1e5) for k in range(80)]  # the first fifty alone lie on a plane
    assert judged(flat, "late")[0] == "GOOD"


def test_any_within_equals_brute_force(spark):
    from itertools import combinations
    from math import dist

    from kestrelframe.operators import transform

    for seed in range(6):
        rng = random.Random(seed)
        rows = [(k, *(rng.uniform(0, 1.6) for _ in range(3))) for k in range(60)]
        want = any(dist(a[1:], b[1:]) < 0.1 for a, b in combinations(rows, 2))
        assert transform.any_within(spark.createDataFrame(rows, "id int, x double, y double, z double"), 0.1).first()["close"] == want
