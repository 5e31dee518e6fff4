"""Hand-computed cases and invariances of single operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kestrelframe.functions import geodesy, geometry, labels, motion
from kestrelframe.operators import asof, clouds, components, mesh, missions, raster, rules, streams, transform
from kestrelframe.operators.space import neighbours


def one(df):
    return df.first().asDict()


def values(spark, *columns):
    return one(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))))


@pytest.mark.parametrize("width", [None, 1.0])
def test_interpolation_statuses(spark, width):
    samples = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 20.0)], "s string, t double, v double")
    probes = spark.createDataFrame([("a", t) for t in (0.5, 1.0, 1.5, 2.0, 2.5)] + [("b", 1.0)], "s string, t double")
    b = asof.bracket(probes, samples, ["s"], "t", ["v"], width)
    got = {(r.s, r.t): (r.status, r.value) for r in asof.interpolate(b, "t", "v", 5.0).collect()}
    assert got == {
        ("a", 0.5): ("OUTSIDE_SENSOR_RANGE", None), ("a", 1.0): ("EXACT", 10.0), ("a", 1.5): ("INTERPOLATED", 15.0),
        ("a", 2.0): ("EXACT", 20.0), ("a", 2.5): ("OUTSIDE_SENSOR_RANGE", None), ("b", 1.0): ("MISSING_STREAM", None),
    }
    gap = {r.t: (r.status, r.dt_s) for r in asof.interpolate(b, "t", "v", 0.1).collect() if r.s == "a"}
    assert gap[1.5] == ("GAP_TOO_LARGE", 0.5)
    clamp = {r.t: r.value for r in asof.clamped(b, "t", "v").collect() if r.s == "a"}
    assert clamp == {0.5: 10.0, 1.0: 10.0, 1.5: 15.0, 2.0: 20.0, 2.5: 20.0}
    near = {r.t: (r.value, r.error_s) for r in asof.nearest(b, "t", "v").collect() if r.s == "a"}
    assert near[1.5] == (10.0, 0.5) and near[2.5] == (20.0, 0.5)


def test_buckets_do_not_change_brackets(spark):
    rng = np.random.default_rng(0)
    s = spark.createDataFrame(pd.DataFrame({"k": rng.integers(0, 3, 300), "t": rng.integers(0, 500, 300) / 4, "v": rng.normal(size=300)}).drop_duplicates(["k", "t"]))
    p = spark.createDataFrame(pd.DataFrame({"k": rng.integers(0, 4, 200), "t": rng.integers(-50, 600, 200) / 4, "id": np.arange(200)}))
    plain, cut = (asof.bracket(p, s, ["k"], "t", ["v"], w).select("id", "prev", "next").orderBy("id").collect() for w in (None, 7.0))
    assert plain == cut


def test_first_within_takes_file_order(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 99.0)], "id int, t double")
    right = spark.createDataFrame([(0, 10.05), (1, 10.0), (2, 10.09)], "o int, t double")
    assert [tuple(r) for r in asof.first_within(left, right, [], "t", "o", 0.1, ["o"]).select("id", "m_o").collect()] == [(1, 0)]


def test_stream_statistics(spark):
    s = spark.createDataFrame([("a", k, t) for k, t in enumerate((1.0, 2.0, 1.5, 3.0))], "s string, k int, t double")
    r = one(streams.statistics(s, ["s"], "t", "k"))
    assert (r["backward_count"], r["source_was_monotonic"], r["rows_reordered"], r["sample_count"], r["largest_gap_s"]) == (1, False, True, 4, 1.0)


def test_deduplicate(spark):
    s = spark.createDataFrame([("a", 0, 1.0, 1), ("a", 1, 1.0, 2), ("a", 2, 2.0, 3)], "s string, k int, t double, v int")
    keep = lambda how: sorted((r.t, r.v) for r in streams.deduplicate(s, ["s"], "t", "k", how).collect())
    assert keep("first") == [(1.0, 1), (2.0, 3)] and keep("last") == [(1.0, 2), (2.0, 3)]


def test_coverage_of_an_absent_stream(spark):
    s = spark.createDataFrame([("a", None, None)], "s string, start_time double, end_time double")
    r = one(streams.coverage(s, F.lit(0.0), F.lit(10.0)))
    assert r["overlap_duration"] is None and r["coverage_fraction"] == 0.0


def test_gps_audit(spark):
    track = lambda times: spark.createDataFrame([("m", float(t), 47.0, 8.0) for t in times], "m string, t double, lat double, lon double")
    assert one(streams.audit(track(range(10)), ["m"], "t", "lat", "lon"))["gaps"] == 0
    assert one(streams.audit(track([0, 1, 6, 7]), ["m"], "t", "lat", "lon"))["gaps"] == 1


def test_geodetic_round_trip(spark):
    xyz = geodesy.geodetic_to_ecef(F.lit(47.3843571), F.lit(8.5451784), F.lit(464.91))
    r = values(spark, *geodesy.ecef_to_geodetic(*xyz))
    assert abs(r["c0"] - 47.3843571) < 1e-6 and abs(r["c1"] - 8.5451784) < 1e-6 and abs(r["c2"] - 464.91) < 1e-3
    pole = values(spark, *geodesy.ecef_to_geodetic(F.lit(0.0), F.lit(0.0), F.lit(6356752.314245)))
    assert pole["c0"] == 90.0 and abs(pole["c2"]) < 1e-3


def test_utm_check_point(spark):
    lat, lon = F.lit(22.946345152373976), F.lit(72.36706816800034)
    r = values(spark, *geodesy.utm_from_geodetic(lat, lon, geodesy.utm_zone(lon)), geodesy.utm_epsg(lat, lon))
    assert abs(r["c0"] - 230000) < 1e-3 and abs(r["c1"] - 2540000) < 1e-3 and r["c2"] == 32643


def test_slerp(spark):
    q = lambda *v: tuple(F.lit(float(x)) for x in v)
    r = values(spark, *motion.slerp(q(1, 0, 0, 0), q(0, 1, 0, 0), F.lit(0.5)))
    assert abs(r["c0"] - math.sqrt(0.5)) < 1e-8 and abs(r["c1"] - math.sqrt(0.5)) < 1e-8
    assert abs(values(spark, *motion.slerp(q(1, 0, 0, 0), q(-1, 0, 0, 0), F.lit(0.5)))["c0"] - 1) < 1e-8


def test_sensor_formulas(spark):
    assert abs(values(spark, motion.gps_week_to_epoch(F.lit(2234), F.lit(552471.663062)))["c0"] - 1667640453.663062) < 1e-5
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    fixed = values(spark, *motion.sigmas(F.lit("RTK_FIXED"), none, none, none))
    assert (fixed["c0"], round(fixed["c2"], 6), fixed["c3"]) == (0.02, 0.03, False)
    assert values(spark, *motion.sigmas(F.lit("UNKNOWN"), zero, zero, zero))["c0"] == 5.0
    h = values(spark, motion.relative_altitude(F.lit(957.8), F.lit(1013.25)), motion.relative_altitude(F.lit(1000.0), F.lit(1000.0)), motion.relative_altitude(zero, F.lit(1.0)))
    assert 460 < h["c0"] < 480 and h["c1"] == 0 and h["c2"] == 0
    m = motion.motion_quality(zero, zero, F.lit(-15.0), zero, F.lit(1.5), zero)
    assert one(spark.range(1).select(*(c.alias(k) for k, c in m.items())))["blur_risk"] == "MEDIUM"


def test_closest_on_triangle(spark):
    v = lambda *x: tuple(F.lit(float(c)) for c in x)
    tri = (v(0, 0, 0), v(4, 0, 0), v(0, 4, 0))
    for p, want, d in (((1, 1, 2), (1, 1, 0), 2), ((-1, -1, 0), (0, 0, 0), math.sqrt(2)), ((2, -3, 0), (2, 0, 0), 3), ((4, 4, 0), (2, 2, 0), math.sqrt(8)), ((0, 9, 0), (0, 4, 0), 5)):
        q, dist = geometry.closest_on_triangle(v(*p), *tri)
        r = values(spark, *q, dist)
        assert np.allclose([r["c0"], r["c1"], r["c2"], r["c3"]], [*want, d])


def test_polygon_and_labels(spark):
    a = lambda *x: F.array(*(F.lit(float(c)) for c in x))
    assert values(spark, geometry.polygon_area(a(0, 2, 2, 0), a(0, 0, 3, 3), a(1, 1, 1, 1)))["c0"] == 6.0
    assert values(spark, *(labels.las_code(F.lit(k)) for k in (1, 2, 3, 6, 99))) == {"c0": 2, "c1": 11, "c2": 6, "c3": 1, "c4": 1}
    assert values(spark, *labels.colormap(F.lit(float("nan")), F.lit(0.0), F.lit(1.0), F.lit(False))) == {"c0": 1.0, "c1": 0.0, "c2": 1.0}
    assert values(spark, labels.safe_id(F.lit("ok-1")), labels.safe_id(F.lit("../x")), labels.safe_id(F.lit("a" * 65))) == {"c0": True, "c1": False, "c2": False}


def pairs(spark, n=40, bad=()):
    rng = np.random.default_rng(3)
    t = transform.Similarity(2.5, np.array([[math.cos(math.pi / 6), -0.5, 0], [0.5, math.cos(math.pi / 6), 0], [0, 0, 1]]), np.array([10.0, -5.0, 2.0]))
    s = rng.normal(size=(n, 3))
    d = s @ (t.scale * t.rotation).T + t.translation
    for k in bad:
        d[k] += 100
    return t, spark.createDataFrame(pd.DataFrame({"id": np.arange(n)} | {c: s[:, i] for i, c in enumerate(transform.SRC)} | {c: d[:, i] for i, c in enumerate(transform.DST)}))


def test_similarity_recovery(spark):
    t, p = pairs(spark)
    got = transform.fit(p)
    assert np.isclose(got.scale, 2.5) and np.allclose(got.rotation, t.rotation) and np.allclose(got.translation, t.translation)


def test_robust_fit_rejects_outliers(spark):
    t, p = pairs(spark, 10, bad=(4,))
    got, rows = transform.robust_fit(p, 2.0)
    s = one(transform.summary(rows))
    assert (s["used"], s["rejected"]) == (9, 1) and s["median"] < 1e-5 and np.isclose(got.scale, t.scale)
    assert transform.robust_fit(p.limit(2), 2.0)[0] is None


def test_control_geometry(spark):
    c = lambda rows: transform.control_geometry(spark.createDataFrame(rows, "id int, latitude double, longitude double, elevation double")).first()
    assert c([(1, 0.0, 0.0, 0.0)])[0] == "INVALID"
    quality, why = c([(k, 0.001 * k, 0.001 * k, 1.0 * k) for k in range(4)])
    assert quality == "WEAK" and "collinear" in why[-1]
    quality, why = c([(1, 0.0, 0.0, 0.0), (2, 0.001, 0.0, 5.0), (3, 0.0, 0.001, 2.0)])
    assert quality == "WEAK" and "NOT_ENOUGH_CONTROLS" in why[0]
    assert c([(1, 0.0, 0.0, 0.0), (2, 0.001, 0.0, 5.0), (3, 0.0, 0.001, 2.0), (4, 0.001, 0.0012, 9.0), (5, 0.0005, 0.0003, 30.0)])[0] == "GOOD"


def checkpoint(spark, rows):
    s = "id int, role string, local_x double, local_y double, local_z double, recon_x double, recon_y double, recon_z double, vertical_datum_mismatch boolean"
    return rules.residuals(spark.createDataFrame([(k, role, 0.0, 0.0, 0.0, *map(float, r), bad) for k, (role, r, bad) in enumerate(rows)], s))


def test_residuals_and_rmse(spark):
    r = one(checkpoint(spark, [("CHECKPOINT", (-0.3, 0.4, 0), False)]))
    assert abs(r["horizontal_error"] - 0.5) < 1e-12 and r["dx"] == -0.3 and abs(r["error_3d"] - 0.5) < 1e-12
    good = [("CHECKPOINT", v, False) for v in ((3, 4, 0), (0, 0, 12), (0, 3, 4))]
    r = one(rules.rmse(checkpoint(spark, [*good, ("CONTROL", (99, 99, 99), False)])))
    assert r["n"] == 3 and np.allclose([r["rmse_x"], r["rmse_h"], r["rmse_3d"]], [math.sqrt(3), math.sqrt(34 / 3), math.sqrt(194 / 3)]) and r["median_3d"] == 5.0
    r = one(rules.rmse(checkpoint(spark, [*good, ("CHECKPOINT", (0, 0, 0.5), True)])))
    assert r["rmse_z"] is None and r["rmse_3d"] is None and not r["z_validated"]
    d = values(spark, *(rules.decision(F.lit(n), F.lit(e)) for n, e in ((4, 1.0), (4, 1.001), (3, 0.1))))
    assert list(d.values()) == ["PASSED", "FAILED", "NOT_ENOUGH_CHECKPOINTS"]


def test_vote_and_confusion(spark):
    obs = spark.createDataFrame([(1, 3, 0.9), (1, 3, 0.8), (2, 2, 0.4), (2, 4, 0.6), (3, 1, 0.0)], "id int, label int, confidence double")
    got = {r.id: (r.label, r.support, round(r.confidence, 6)) for r in rules.vote(obs, obs.select("id").distinct()).collect()}
    assert got == {1: (3, 2, 0.85), 2: (4, 2, 0.3), 3: (0, 0, 0.0)}
    p = spark.createDataFrame([(1, 1)] * 5 + [(2, 1)] * 5, "truth int, guess int")
    iou = {r.label: r.iou for r in rules.confusion(p, spark.createDataFrame([(1,), (2,)], "label int")).collect()}
    assert iou == {1: 0.5, 2: 0.0}


def cloud(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n)} | {c: np.round(rng.normal(size=n) * 3, 3) for c in "xyz"}))


@pytest.mark.parametrize("leaf_rows", [2, 20, 4096])
def test_neighbours_equal_brute_force(spark, leaf_rows):
    q, p = cloud(spark, 40, 1), cloud(spark, 120, 2)
    a, b = q.toPandas(), p.toPandas()
    d = np.linalg.norm(a[["x", "y", "z"]].to_numpy()[:, None] - b[["x", "y", "z"]].to_numpy()[None], axis=2)
    want = {(i, k + 1): (j, d[i, j]) for i in range(40) for k, j in enumerate(np.lexsort((np.arange(120), d[i]))[:3])}
    got = {(r.id, r.rank): (r.point_id, r.distance) for r in neighbours(q, p, 3, leaf_rows).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_neighbours_of_nothing(spark):
    e = cloud(spark, 5).limit(0)
    assert neighbours(cloud(spark, 5), e, 2).count() == 0 and neighbours(e, cloud(spark, 5), 2).count() == 0


def test_cloud_to_cloud_shift(spark):
    p = cloud(spark, 3)
    near = neighbours(p, p.withColumn("z", F.col("z") + 0.25), 1)
    assert all(abs(r.distance - 0.25) < 1e-9 for r in near.collect())


def test_voxel_sample_is_stable(spark):
    p = cloud(spark, 200)
    rows = lambda df: sorted(r.id for r in clouds.voxel_sample(df, 2.0).collect())
    assert rows(p) == rows(p.repartition(7).orderBy(F.col("x").desc()))


def test_box_and_tiles(spark):
    b = spark.createDataFrame([(0.0, 0.0, 0.0), (10.0, 10.0, 0.0)], "x double, y double, z double")
    assert b.where(clouds.in_box((-1, -1, -1), (1, 1, 1))).count() == 1
    t = clouds.tiles(cloud(spark, 100), 2.0, 0.5, 0.0, 0.0)
    assert t.where("inner").count() == 100


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (7, 7), (None, 5)] + [(k, k + 1) for k in range(100, 140)], "a long, b long")
    got = {r.node: r.root for r in components.components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 7: 7} | {k: 100 for k in range(100, 141)}
    assert components.components(e.limit(0)).count() == 0


def test_mesh_clusters(spark):
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 3), (2, 7, 8, 9), (3, 8, 9, 10), (4, 20, 21, 22)], "fid long, v0 long, v1 long, v2 long")
    assert {r.fid: r.cluster for r in mesh.clusters(f).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    assert sorted(r.fid for r in mesh.large_clusters(f, 2).collect()) == [0, 1, 2, 3]


def grid(n, top=()):
    x, y = np.meshgrid(np.arange(n) + 0.5, np.arange(n) + 0.5)
    z = np.zeros((n, n))
    for r, c in top:
        z[r, c] = 10
    return pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "z": z.ravel()})


def test_surface_matches_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    v, q = rng.random((30, 3)) * 4, rng.random((12, 3)) * 4
    f = rng.integers(0, 30, (40, 3))
    frame = lambda a, names: spark.createDataFrame(pd.DataFrame({"k": np.arange(len(a))} | {n: a[:, i] for i, n in enumerate(names)}))
    faces, vertices = frame(f, ("v0", "v1", "v2")).withColumnRenamed("k", "fid"), frame(v, "xyz").withColumnRenamed("k", "vid")
    points = frame(q, "xyz").withColumnRenamed("k", "id")

    def gap(p, a, b, c):  # by dense sampling of the triangle
        s = np.linspace(0, 1, 60)
        u, w = np.meshgrid(s, s)
        u, w = u[u + w <= 1], w[u + w <= 1]
        return np.linalg.norm(a + u[:, None] * (b - a) + w[:, None] * (c - a) - p, axis=1).min()

    got = {r.id: r.distance for r in mesh.surface_matches(points, faces, vertices, 1.5).collect()}
    want = {}
    for k, p in enumerate(q):
        near = [t for t in f.tolist() if (np.linalg.norm(v[t] - p, axis=1) <= 1.5).any()]
        if near:
            want[k] = min(gap(p, *v[t]) for t in near)
    assert got.keys() == want.keys() and all(-1e-9 <= want[k] - got[k] < 0.06 for k in want)


def test_camera_parameters(spark):
    n = lambda x: F.lit(float(x))
    text = lambda model: values(spark, geometry.camera_parameters(F.lit(model), n(1), n(2), n(3), n(4), [n(0.1), n(0.2)]))["c0"]
    assert text("SIMPLE_PINHOLE") == "1.0,3.0,4.0" and text("PINHOLE") == "1.0,2.0,3.0,4.0" and text("RADIAL") == "1.0,3.0,4.0,0.1,0.2"
    assert text("OPENCV") == "1.0,2.0,3.0,4.0,0.1,0.2,0.0,0.0"


def test_region_heights(spark):
    v = spark.createDataFrame([(k, 0.0, 0.0, float(z)) for k, z in enumerate((0, 0, 5, 1, 9, 9, 9))], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 3), (2, 4, 5, 6)], "fid long, v0 long, v1 long, v2 long")
    assert [(r.cluster, r.height, r.faces) for r in mesh.heights(f, v, F.lit(True)).collect()] == [(0, 5.0, 2)]


def test_readiness_texts(spark):
    r = spark.createDataFrame([(0.6, 0.9, 0.4, 0.3, 0.0, 0.0, 0, 99.0), (0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0, 99.0)], "blur double, dark double, largest double, isolated double, near_zero double, pure_rotation double, jumps int, inliers double")
    full = rules.readiness(r).collect()
    assert full[0].status == "NOT_READY" and full[0].blocking[0] == "Excessive blur (60.0% frames blurry)." and full[0].score <= 40 and full[1].status == "READY" and full[1].score == 100
    said = rules.readiness(r, "extracted").select(rules.recommendations(F.col("blocking"), F.col("warnings")).alias("r"), "blocking").first()
    assert len(said.r) == 2 and len(said.blocking) == 3


def test_buckets_do_not_change_neighbours(spark):
    rng = np.random.default_rng(9)
    n = 400
    df = spark.createDataFrame(pd.DataFrame({"k": rng.integers(0, 3, n), "q": np.arange(n), "t": rng.integers(0, 90, n) * 10.0, "la": rng.normal(size=n), "lo": rng.normal(size=n)}))
    plain, cut = (sorted(map(str, streams.previous(df, ["k"], ["t", "q"], ["q", "t"], "p", w).collect())) for w in (None, 37.0))
    assert plain == cut
    assert sorted(map(str, streams.statistics(df, ["k"], "t", "q").collect())) == sorted(map(str, streams.statistics(df, ["k"], "t", "q", 50.0, 29.0).collect()))
    assert streams.previous(df.limit(0), ["k"], ["t"], ["q"], "p", 5.0).count() == 0


def test_catalogue_changes(spark):
    rows = spark.createDataFrame([(1, "a", None, None), (2, "b", 5.0, None), (3, "c", None, 1.0), (None, "d", None, None)], "id long, name string, archived_at double, updated_at double")
    made = [(1, 1, 10.0, "archive", None), (1, 2, 11.0, "restore", None), (1, 3, 12.0, "update", "  new "), (1, 4, 13.0, "update", " "), (1, 5, 14.0, "update", "x" * 161), (2, 6, 15.0, "archive", None), (3, 7, 16.0, "delete", None), (9, 8, 17.0, "archive", None), (None, 9, 18.0, "delete", None)]
    changes = spark.createDataFrame(made, "id long, seq long, at double, op string, name string")
    got = {tuple(r) for r in missions.apply_changes(rows, changes).collect()}
    assert got == {(1, "new", None, 12.0), (2, "b", 15.0, 15.0), (None, "d", None, None)}
    assert missions.apply_changes(rows, changes.limit(0)).count() == 4


def test_unknown_colour_is_an_error(spark):
    df = spark.createDataFrame([(1, 2, 3), (0, 0, 0)], "r int, g int, b int")
    assert [r[0] for r in df.select(labels.class_of(*(F.col(c) for c in "rgb"), {(1, 2, 3): 4})).collect()] == [4, None]
    with pytest.raises(Exception, match="Unknown colors found in mask: 0 0 0"):
        df.select(labels.check_colours(*(F.col(c) for c in "rgb"), {(1, 2, 3): 4})).collect()
