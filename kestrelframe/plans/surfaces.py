"""Meshes, transforms and terrain on the driver tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import motion as M
from ..operators import groupfit, mesh, raster, registration, rules, transform
from ..operators.orderstats import with_quantiles
from ..operators.visibility import View, unoccluded
from ..storage import materialise, table
from .binding import emb, pts, query, rounded

_MESH = ", vt AS (SELECT id AS vid, x, y, z FROM emb_), fc AS (SELECT l_orderkey * 8 + l_linenumber AS fid, l_partkey % 500 AS v0, (l_partkey + l_linenumber) % 500 AS v1, (l_partkey + 7 * l_linenumber) % 500 AS v2 FROM lineitem)"


def _mesh(spark, d):
    """A face of every row of ``lineitem``, over the points of ``embeddings``."""
    li, p, k = table(spark, d, "lineitem"), F.col("l_partkey"), F.col("l_linenumber")
    return li.select((F.col("l_orderkey") * 8 + k).alias("fid"), (p % 500).alias("v0"), ((p + k) % 500).alias("v1"), ((p + 7 * k) % 500).alias("v2")), emb(spark, d).select(F.col("id").alias("vid"), "x", "y", "z")


_CORNERS = f"""{_MESH}, cr AS (SELECT fid, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2 FROM fc JOIN vt a ON v0 = a.vid JOIN vt b ON v1 = b.vid JOIN vt c ON v2 = c.vid)"""
_AREA = "sqrt(((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0)) ** 2 + ((z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0)) ** 2 + ((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) ** 2) / 2"


@query("j22_face_measures", f"""{_CORNERS} SELECT fid, round({_AREA}, 6) AS area, round((z0 + z1 + z2) / 3, 6) AS cz FROM cr""")
def j22(spark, d):
    f, v = _mesh(spark, d)
    return rounded(mesh.measures(mesh.corners(f, v)), 6, "area", "cz").select("fid", "area", "cz")


@query("j21_edge_faces", f"""{_MESH}, e AS (SELECT fid, least(v0, v1) AS a, greatest(v0, v1) AS b FROM fc UNION ALL SELECT fid, least(v1, v2), greatest(v1, v2) FROM fc UNION ALL SELECT fid, least(v0, v2), greatest(v0, v2) FROM fc)
SELECT DISTINCT m.f, e.fid AS g FROM e JOIN (SELECT a, b, min(fid) AS f FROM e GROUP BY ALL) m ON e.a = m.a AND e.b = m.b WHERE e.fid <> m.f""")
def j21(spark, d):
    return mesh.adjacency(_mesh(spark, d)[0])


def _clusters(chosen: str = "true") -> str:
    """SQL for the components of some faces: labels that fall along shared edges until none does."""
    return f"""WITH RECURSIVE vt AS (SELECT vec_id AS vid, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z FROM embeddings),
al AS (SELECT l_orderkey * 8 + l_linenumber AS fid, l_partkey % 500 AS v0, (l_partkey + l_linenumber) % 500 AS v1, (l_partkey + 7 * l_linenumber) % 500 AS v2 FROM lineitem), fc AS (SELECT * FROM al WHERE {chosen}),
e AS (SELECT fid, least(v0, v1) AS a, greatest(v0, v1) AS b FROM fc UNION ALL SELECT fid, least(v1, v2), greatest(v1, v2) FROM fc UNION ALL SELECT fid, least(v0, v2), greatest(v0, v2) FROM fc),
m AS (SELECT DISTINCT k.f, e.fid AS g FROM e JOIN (SELECT a, b, min(fid) AS f FROM e GROUP BY ALL) k ON e.a = k.a AND e.b = k.b WHERE e.fid <> k.f), u AS (SELECT f, g FROM m UNION ALL SELECT g, f FROM m),
r(fid, cluster) USING KEY (fid) AS (SELECT DISTINCT f, f FROM u UNION SELECT u.g, min(r.cluster) FROM r JOIN u ON u.f = r.fid JOIN recurring.r AS old ON old.fid = u.g WHERE r.cluster < old.cluster GROUP BY u.g)"""


@query("g2_face_components", f"{_clusters()} SELECT fid, cluster FROM r")
def g2(spark, d):
    return mesh.clusters(_mesh(spark, d)[0])


@query("g3_large_clusters", f"""{_clusters()}, c AS (SELECT fc.fid, coalesce(cluster, fc.fid) AS cluster FROM fc LEFT JOIN r ON r.fid = fc.fid), n AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1)
SELECT fid FROM c JOIN n USING (cluster) WHERE n >= 25 AND n >= 0.002 * (SELECT count(*) FROM fc)""")
def g3(spark, d):
    return mesh.large_clusters(_mesh(spark, d)[0]).select("fid")


@query("a18_region_heights", f"""{_clusters("fid % 3 = 0")}, h AS (SELECT cluster, greatest(a.z, b.z, c.z) AS hi, least(a.z, b.z, c.z) AS lo FROM fc JOIN r USING (fid) JOIN vt a ON v0 = a.vid JOIN vt b ON v1 = b.vid JOIN vt c ON v2 = c.vid)
SELECT cluster, round(max(hi) - min(lo), 6) AS height, count(*) AS faces FROM h GROUP BY cluster HAVING max(hi) - min(lo) > 2.0""")
def a18(spark, d):
    f, v = _mesh(spark, d)
    return rounded(mesh.heights(f, v, F.col("fid") % 3 == 0), 6, "height")


@query("a36_mesh_health", f"""{_MESH}, u AS (SELECT v0 AS v FROM fc UNION SELECT v1 FROM fc UNION SELECT v2 FROM fc), e AS (SELECT fid, least(v0, v1) AS a, greatest(v0, v1) AS b FROM fc UNION ALL SELECT fid, least(v1, v2), greatest(v1, v2) FROM fc UNION ALL SELECT fid, least(v0, v2), greatest(v0, v2) FROM fc)
SELECT (SELECT count(*) FROM vt WHERE vid NOT IN (SELECT v FROM u)) AS isolated_vertices, (SELECT count(*) FROM fc WHERE v0 NOT IN (SELECT vid FROM vt) OR v1 NOT IN (SELECT vid FROM vt) OR v2 NOT IN (SELECT vid FROM vt)) AS invalid_faces,
  (SELECT count(*) FROM fc WHERE v0 = v1 OR v1 = v2 OR v0 = v2) AS degenerate_faces, (SELECT count(*) FROM (SELECT a, b FROM e GROUP BY ALL HAVING count(DISTINCT fid) > 2)) AS non_manifold_edges""")
def a36(spark, d):
    return mesh.health(*_mesh(spark, d))


_SEEN = " AND ".join(f"z{k} + 4 > 0 AND 300 * x{k} / nullif(z{k} + 4, 0) + 320 BETWEEN 1 AND 638 AND 300 * y{k} / nullif(z{k} + 4, 0) + 240 BETWEEN 1 AND 478" for k in range(3))


@query("p18_visible_faces", f"""{_CORNERS} SELECT fid FROM cr WHERE {_SEEN}""")
def p18(spark, d):
    f, v = _mesh(spark, d)

    def camera(x, y, z):
        depth = z + 4
        front = F.when(depth > 0, depth)
        return 300 * x / front + 320, 300 * y / front + 240, depth

    return mesh.visible(mesh.corners(f, v), camera, 640, 480).select("fid")


@query("f21_best_view", f"""{_CORNERS}, n AS (SELECT fid, (x0 + x1 + x2) / 3 AS cx, (y0 + y1 + y2) / 3 AS cy, (z0 + z1 + z2) / 3 AS cz, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM cr WHERE {_AREA} > 1e-9),
w AS (SELECT fid, view, greatest(0.0, (nx * (vx - cx) + ny * (vy - cy) + nz * (vz - cz)) / (sqrt(nx * nx + ny * ny + nz * nz) * sqrt((vx - cx) ** 2 + (vy - cy) ** 2 + (vz - cz) ** 2))) / ((vx - cx) ** 2 + (vy - cy) ** 2 + (vz - cz) ** 2) AS weight
  FROM n, (VALUES (0, 5.0::DOUBLE, 0.0::DOUBLE, 5.0::DOUBLE), (1, 0.0, 5.0, 5.0), (2, 0.0, 0.0, -6.0)) v(view, vx, vy, vz)),
k AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY weight DESC, view) AS k FROM w) SELECT fid, CASE WHEN weight > 0 THEN view END AS view FROM k WHERE k = 1""")
def f21(spark, d):
    f, v = _mesh(spark, d)
    m = mesh.measures(mesh.corners(f, v)).where("area > 1e-9")
    a, b, c = mesh.points_of()
    normal, centre = G.cross(G.sub(b, a), G.sub(c, a)), (F.col("cx"), F.col("cy"), F.col("cz"))
    views = [(0, 5.0, 0.0, 5.0), (1, 0.0, 5.0, 5.0), (2, 0.0, 0.0, -6.0)]
    each = F.array(*(F.struct(F.lit(k).alias("view"), G.face_weight(centre, normal, (F.lit(x), F.lit(y), F.lit(z))).alias("weight")) for k, x, y, z in views))
    return mesh.best_view(m.select("fid", F.explode(each).alias("w")).select("fid", "w.view", "w.weight"))


def _rigid() -> transform.Similarity:
    import numpy as np

    c, s = math.cos(math.radians(30)), math.sin(math.radians(30))
    return transform.Similarity(2.5, np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]]), np.array([10.0, -5.0, 2.0]))


def _pairs(spark, d):
    e = emb(spark, d)
    x, y, z = _rigid().apply(F.col("x"), F.col("y"), F.col("z"))
    off = F.when(F.col("id") % 10 == 3, 100.0).otherwise(0.0)
    return e.select("id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), (x + off).alias("dx"), y.alias("dy"), z.alias("dz"))


@query("p8_apply_similarity", """ SELECT id, round(2.5 * (0.8660254037844387 * x - 0.5 * y) + 10, 6) AS x, round(2.5 * (0.5 * x + 0.8660254037844387 * y) - 5, 6) AS y, round(2.5 * z + 2, 6) AS z FROM emb_ """)
def p8(spark, d):
    x, y, z = _rigid().apply(F.col("x"), F.col("y"), F.col("z"))
    return emb(spark, d).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


@query("p9_inverse_similarity", """ SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM emb_ """)
def p9(spark, d):
    t = _rigid()
    there = emb(spark, d).select("id", *(c.alias(n) for c, n in zip(t.apply(F.col("x"), F.col("y"), F.col("z")), "abc", strict=True)))
    return there.select("id", *(F.round(c, 6).alias(n) for c, n in zip(t.inverse().apply(F.col("a"), F.col("b"), F.col("c")), "xyz", strict=True)))


@query("a13_umeyama_moments", """, p AS (SELECT x AS sx, y AS sy, z AS sz, 2.5 * x + 1 AS dx, 1 + id % 3 AS w FROM emb_) SELECT CAST(sum(w) AS DOUBLE) AS w, round(sum(w * sx), 5) AS sx, round(sum(w * dx), 5) AS dx, round(sum(w * dx * sx), 4) AS dx_sx, round(sum(w * (sx ** 2 + sy ** 2 + sz ** 2)), 4) AS ss FROM p""")
def a13(spark, d):
    e = emb(spark, d)
    p = e.select("id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), (2.5 * F.col("x") + 1).alias("dx"), F.col("y").alias("dy"), F.col("z").alias("dz"))
    m = transform.moments(p, 1.0 + F.col("id") % 3)
    return m.select("w", F.round("sx", 5).alias("sx"), F.round("dx", 5).alias("dx"), F.round("dx_sx", 4).alias("dx_sx"), F.round("ss", 4).alias("ss"))


@query("x9_robust_similarity", """ SELECT count(*) AS total, count(*) FILTER (id % 10 <> 3) AS used, count(*) FILTER (id % 10 = 3) AS rejected, true AS exact FROM emb_ """)
def x9(spark, d):
    _, rows = transform.robust_fit(_pairs(spark, d), 0.5)
    return transform.summary(rows).select("total", "used", "rejected", (F.col("rmse") < 1e-6).alias("exact"))


@query("a28_control_fit", """ SELECT 2.5::DOUBLE AS scale, 10.0::DOUBLE AS tx, -5.0::DOUBLE AS ty, 2.0::DOUBLE AS tz, count(*) FILTER (id % 10 = 3) AS rejected, count(DISTINCT id % 1) = 1 AS uniform_datum FROM emb_ """)
def a28(spark, d):
    t, rows = transform.robust_fit(_pairs(spark, d), 0.5)
    one = rows.agg(F.count_if(~F.col("inlier")).alias("rejected"), (F.count_distinct(F.col("id") % 1) == 1).alias("uniform_datum"))
    return one.select(F.lit(round(t.scale, 8)).alias("scale"), *(F.lit(round(float(v), 6)).alias(f"t{n}") for v, n in zip(t.translation, "xyz", strict=True)), "rejected", "uniform_datum")


@query("v8_control_geometry", None)
def v8(spark, d):
    controls = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (22.9 + F.col("s_nationkey") / 1000).alias("latitude"), (72.3 + F.col("s_suppkey") / 1000).alias("longitude"), (F.col("s_acctbal") / 1000).alias("elevation"))
    return transform.control_geometry(controls).select("quality", F.array_join("reasons", "|").alias("reasons"))


@query("a27_control_spread", """, c AS (SELECT covar_samp(x, x) AS xx, covar_samp(y, y) AS yy, covar_samp(z, z) AS zz, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, z) AS yz FROM emb_)
SELECT round(xx + yy + zz, 6) AS trace, round(xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz), 6) AS product FROM c""")
def a27(spark, d):
    e = transform.spread(emb(spark, d), "xyz")
    return e.select(F.round(F.col("e0") + F.col("e1") + F.col("e2"), 6).alias("trace"), F.round(F.col("e0") * F.col("e1") * F.col("e2"), 6).alias("product"))


_DEGENERATE = "sqrt({0} + {1}) < 0.5 OR sqrt(greatest({0} - {1}, 0)) < 0.015 * sqrt({0} + {1})".format("((xx + yy) / 2)", "sqrt(((xx - yy) / 2) ** 2 + xy * xy)")


@query("v13_track_degeneracy", f""", t AS (SELECT label, x, y FROM emb_ UNION ALL SELECT -1, x, 2 * x + y / 1e4 FROM emb_), m AS (SELECT label, count(*) * covar_pop(x, x) AS xx, count(*) * covar_pop(y, y) AS yy, count(*) * covar_pop(x, y) AS xy FROM t GROUP BY label)
SELECT bool_or(CASE WHEN label = -1 THEN {_DEGENERATE} END) AS straight_is_degenerate, bool_or(CASE WHEN label = 1 THEN {_DEGENERATE} END) AS degenerate FROM m""")
def v13(spark, d):
    e = emb(spark, d)
    wide = transform.degenerate(e.where("label = 1"))
    straight = transform.degenerate(e.select("x", (F.col("x") * 2 + F.col("y") / 1e4).alias("y"))).withColumnRenamed("degenerate", "straight_is_degenerate")
    return wide.crossJoin(straight)  # one row each


@query("p7_camera_centres", """, q AS (SELECT id, cos(2 * x) AS c, sin(2 * x) AS s, x + 2 * y + 2 * z AS along, x, y, z FROM emb_)
SELECT id, round(-(x * c - (2 * z - 2 * y) / 3 * s + along / 9 * (1 - c)), 6) AS cx, round(-(y * c - (2 * x - z) / 3 * s + along * 2 / 9 * (1 - c)), 6) AS cy, round(-(z * c - (y - 2 * x) / 3 * s + along * 2 / 9 * (1 - c)), 6) AS cz FROM q""")
def p7(spark, d):
    """Poses that turn about the axis (1, 2, 2) / 3; the SQL turns the translation back by the axis-angle formula."""
    s = F.sin("x") / 3
    centre = G.camera_centre(M.rotation_of(F.cos("x"), s, s * 2, s * 2), (F.col("x"), F.col("y"), F.col("z")))
    return emb(spark, d).select("id", *(F.round(c, 6).alias(n) for c, n in zip(centre, ("cx", "cy", "cz"), strict=True)))


@query("f32_rotation_matrices", """ SELECT id, round(cos(2 * x), 6) AS r11, round(-sin(2 * x), 6) AS r12, round(cos(2 * x), 6) AS r22 FROM emb_ """)
def f32(spark, d):
    zero = F.lit(0.0)
    r = M.rotation_of(F.cos("x"), zero, zero, F.sin("x"))
    return emb(spark, d).select("id", F.round(r[0][0], 6).alias("r11"), F.round(r[0][1], 6).alias("r12"), F.round(r[1][1], 6).alias("r22"))


@query("p17_triangulation_acceptance", """, t AS (SELECT id, x * 10 AS a, z AS d1, z + 1 AS d2, y * 2 AS e FROM emb_) SELECT id FROM t WHERE a > 0.7 AND a < 80 AND d1 > 0 AND d2 > 0 AND abs(e) < 2.5""")
def p17(spark, d):
    a, z, e = F.col("x") * 10, F.col("z"), F.col("y") * 2
    return emb(spark, d).where((a > 0.7) & (a < 80) & (z > 0) & (z + 1 > 0) & (F.abs(e) < 2.5) & G.is_finite(z)).select("id")


@query("f18_camera_parameters", """WITH p AS (SELECT p_partkey, p_size % 5 AS m, CAST(CAST(p_retailprice AS DOUBLE) AS VARCHAR) AS fx, CAST(CAST(p_retailprice AS DOUBLE) + 1 AS VARCHAR) AS fy FROM part)
SELECT p_partkey, CASE m WHEN 0 THEN concat_ws(',', fx, '960.0', '540.0') WHEN 1 THEN concat_ws(',', fx, fy, '960.0', '540.0') WHEN 2 THEN concat_ws(',', fx, '960.0', '540.0', '0.1') WHEN 3 THEN concat_ws(',', fx, '960.0', '540.0', '0.1', '0.01') ELSE concat_ws(',', fx, fy, '960.0', '540.0', '0.1', '0.01', '0.0', '0.0') END AS parameters FROM p""")
def f18(spark, d):
    r = F.col("p_retailprice")
    model = F.element_at(F.array(*(F.lit(m) for m in ("SIMPLE_PINHOLE", "PINHOLE", "SIMPLE_RADIAL", "RADIAL", "OPENCV"))), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", G.camera_parameters(model, r, r + 1, F.lit(960.0), F.lit(540.0), [F.lit(0.1), F.lit(0.01)]).alias("parameters"))


@query("r10_tiled_terrain", None)
def r10(spark, d):
    p = pts(spark, d).select("x", "y", "z")
    return raster.terrain(p, 1.0, 3.0, (3.0, 6.0), tile=20)


@query("r9_terrain_coverage", None)
def r9(spark, d):
    return r10(spark, d).groupBy("coverage").agg(F.count("*").alias("cells"))


@query("a20_support_ratios", """, s AS (SELECT abs(x) AS d FROM emb_) SELECT round(avg((d <= 0.5)::INT), 8) AS supported, round(avg((d > 1.5)::INT), 8) AS unobserved, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.95), 6) AS p95 FROM s""")
def a20(spark, d):
    e = emb(spark, d).select(F.abs("x").alias("d"))
    s = rules.support_class(F.col("d"), F.lit(0.5), F.lit(1.5))
    shares = e.agg(F.round(F.avg((s == "SUPPORTED").cast("int")), 8).alias("supported"), F.round(F.avg((s == "UNOBSERVED").cast("int")), 8).alias("unobserved"), F.round(F.avg("d"), 6).alias("mean"))
    return with_quantiles(shares, e, "d", {"p95": 0.95}).withColumn("p95", F.round("p95", 6))


@query("g4_label_smoothing", """ SELECT id, label FROM emb_ """)
def g4(spark, d):
    """Labels as they are: the operator is defined as the identity."""
    return emb(spark, d).select("id", "label")


_RELIEF = """WITH hv AS (SELECT CAST(l_quantity AS BIGINT) AS i, l_suppkey % 50 AS j, max(l_extendedprice) / 2000 + min(l_extendedprice) / 500 AS z FROM lineitem GROUP BY 1, 2),
q AS (SELECT a.i, a.j, a.z AS za, b.z AS zb, c.z AS zc, d.z AS zd FROM hv a JOIN hv b ON b.i = a.i + 1 AND b.j = a.j JOIN hv c ON c.i = a.i + 1 AND c.j = a.j + 1 JOIN hv d ON d.i = a.i AND d.j = a.j + 1),
fc AS (SELECT (i * 50 + j) * 2 AS fid, i AS x0, j AS y0, za AS z0, i + 1 AS x1, j AS y1, zb AS z1, i + 1 AS x2, j + 1 AS y2, zc AS z2 FROM q
  UNION ALL SELECT (i * 50 + j) * 2 + 1, i, j, za, i + 1, j + 1, zc, i, j + 1, zd FROM q),
vw AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, -25.2::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, -1.0::DOUBLE, 60.3::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 70.4::DOUBLE), (1, 1.0, 0.0, 0.0, -25.3, 0.0, -1.0, 0.0, 24.9, 0.0, 0.0, -1.0, 300.1)) t(view, r00, r01, r02, t0, r10, r11, r12, t1, r20, r21, r22, t2)),
p AS (SELECT fid, view, """ + ", ".join(f"r{a}0 * x{k} + r{a}1 * y{k} + r{a}2 * z{k} + t{a} AS p{k}{n}" for k in range(3) for a, n in enumerate("xyz")) + """ FROM fc, vw),
t AS (SELECT fid, view, """ + ", ".join(f"(p0{n} + p1{n} + p2{n}) / 3 AS d{n}" for n in "xyz") + """ FROM p WHERE """ + " AND ".join(f"p{k}z > 1e-9 AND 500 * p{k}x / p{k}z + 320 BETWEEN 1 AND 638 AND 500 * p{k}y / p{k}z + 240 BETWEEN 1 AND 478" for k in range(3)) + """),
m AS (SELECT t.fid, t.view, """ + ", ".join(f"dx * (p{a}y * p{b}z - p{a}z * p{b}y) + dy * (p{a}z * p{b}x - p{a}x * p{b}z) + dz * (p{a}x * p{b}y - p{a}y * p{b}x) AS s{a}" for a, b in ((0, 1), (1, 2), (2, 0))) + """,
  (p1y - p0y) * (p2z - p0z) - (p1z - p0z) * (p2y - p0y) AS nx, (p1z - p0z) * (p2x - p0x) - (p1x - p0x) * (p2z - p0z) AS ny, (p1x - p0x) * (p2y - p0y) - (p1y - p0y) * (p2x - p0x) AS nz, dx, dy, dz, p0x, p0y, p0z FROM t JOIN p ON t.view = p.view AND t.fid <> p.fid),
h AS (SELECT DISTINCT fid, view FROM m WHERE (least(s0, s1, s2) >= 0 OR greatest(s0, s1, s2) <= 0) AND (p0x * nx + p0y * ny + p0z * nz) / nullif(dx * nx + dy * ny + dz * nz, 0) > 0 AND (p0x * nx + p0y * ny + p0z * nz) / nullif(dx * nx + dy * ny + dz * nz, 0) < 1 - 1e-9)
SELECT fid, view FROM t WHERE (fid, view) NOT IN (SELECT (fid, view) FROM h)"""


@query("x7_unoccluded_faces", _RELIEF)
def x7(spark, d):
    """Faces of a relief of all line items that two cameras see, one from the side and one from above."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("i"), (F.col("l_suppkey") % 50).alias("j"))
    v = materialise(li.agg((F.max("l_extendedprice") / 2000 + F.min("l_extendedprice") / 500).alias("z")), "relief")
    at = lambda di, dj, n: v.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("z").alias(n))
    q = at(0, 0, "za").join(at(1, 0, "zb"), ["i", "j"]).join(at(1, 1, "zc"), ["i", "j"]).join(at(0, 1, "zd"), ["i", "j"])
    x, y = F.col("i").cast("double"), F.col("j").cast("double")
    corner = {"a": (x, y, F.col("za")), "b": (x + 1, y, F.col("zb")), "c": (x + 1, y + 1, F.col("zc")), "d": (x, y + 1, F.col("zd"))}
    face = lambda n, names: F.struct(((F.col("i") * 50 + F.col("j")) * 2 + n).alias("fid"), *(c.alias(f"{a}{k}") for k, m in enumerate(names) for a, c in zip("xyz", corner[m], strict=True)))
    faces = q.select(F.explode(F.array(face(0, "abc"), face(1, "acd"))).alias("f")).select("f.*")
    side = View(0, ((0.0, 1.0, 0.0), (0.0, 0.0, -1.0), (1.0, 0.0, 0.0)), (-25.2, 60.3, 70.4), 500, 500, 320, 240, 640, 480)
    above = View(1, ((1.0, 0.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, -1.0)), (-25.3, 24.9, 300.1), 500, 500, 320, 240, 640, 480)
    return unoccluded(faces, [side, above])


_MATCHES = """SELECT l_suppkey AS pair, l_orderkey * 8 + l_linenumber AS id, l_quantity * 10 AS x, l_discount * 5000 AS y, l_linenumber >= 4 AS bad, l_tax FROM lineitem"""


def _matches(spark, d):
    """Matches of an image pair for each supplier: a projective map of its own, broken in every line from the fourth on."""
    x, y, g = F.col("l_quantity") * 10, F.col("l_discount") * 5000, F.col("l_suppkey")
    w = 1 + 1e-4 * x - 5e-5 * y
    off = F.when(F.col("l_linenumber") >= 4, 40 + F.col("l_tax") * 2000).otherwise(0.0)
    u, v = (1.1 * x + 0.05 * y + g % 97) / w + off, (0.9 * y - 0.1 * x + g % 89) / w - off / 2
    return table(spark, d, "lineitem").select(g.alias("pair"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"))


@query("x2_pair_homographies", f"""SELECT pair, count(*) AS n, count(*) FILTER (NOT bad) AS inliers FROM ({_MATCHES}) GROUP BY pair""")
def x2(spark, d):
    """The maps of all pairs at once; the SQL knows which matches were broken."""
    fits, _ = groupfit.robust_fits(_matches(spark, d), ["pair"], ("x", "y"), ("u", "v"), groupfit.HOMOGRAPHY, 3.0)
    return fits.select("pair", "n", "inliers")


@query("x6_oriented_normals", None)
def x6(spark, d):
    """Normals of the relief's corners, all on one side, rounded."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("double").alias("x"), (F.col("l_suppkey") % 50).cast("double").alias("y"))
    p = li.agg((F.avg("l_extendedprice") / 20000).alias("z")).withColumn("id", (F.col("x") * 50 + F.col("y")).cast("long"))
    return rounded(registration.normals(p, 8), 6, "nx", "ny", "nz").select("id", "nx", "ny", "nz")
