"""Point clouds, rasters and meshes on ``lineitem`` (a volume) and ``embeddings`` (a small cloud)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geodesy as G
from ..functions import geometry as Q
from ..functions import labels as L
from ..operators import clouds, components, rules
from ..operators.orderstats import quantiles, with_quantiles
from ..operators.space import neighbours
from ..storage import materialise, table
from .binding import emb, pts, query, rounded

_STATS = "count(d) AS count, round(avg(d), 7) AS mean, round(quantile_cont(d, 0.5), 7) AS median, round(sqrt(avg(d * d)), 7) AS rmse, round(quantile_cont(d, 0.68), 7) AS p68, round(quantile_cont(d, 0.9), 7) AS p90, round(quantile_cont(d, 0.95), 7) AS p95, round(quantile_cont(d, 0.99), 7) AS p99, round(max(d), 7) AS max"
_MEASURES = ("mean", "median", "rmse", "p68", "p90", "p95", "p99", "max")


@query("a3_error_statistics", f"""SELECT l_returnflag AS flag, {_STATS} FROM (SELECT l_returnflag, l_extendedprice / 1000 AS d FROM lineitem) GROUP BY 1""")
def a3(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") / 1000).alias("d"))
    return rounded(clouds.error_statistics(li, "d", ["flag"]), 7, *_MEASURES)


@query("a4_coverage_thresholds", """ SELECT r, round(avg((z <= 10)::INT), 8) AS within_10_00, round(avg((z <= 25)::INT), 8) AS within_25_00, round(avg((z <= 50)::INT), 8) AS within_50_00, round(avg((z <= 100)::INT), 8) AS within_100_00 FROM pts_ GROUP BY r""")
def a4(spark, d):
    return rounded(clouds.coverage(pts(spark, d), "z", (10, 25, 50, 100), ["r"]), 8, "within_10_00", "within_25_00", "within_50_00", "within_100_00")


@query("a5_signed_errors", """ SELECT r, round(sqrt(avg((z - x) ** 2)), 6) AS rmse_z, round(avg(abs(z - x)), 6) AS mae_z, round(avg(z - x), 6) AS bias, round(sqrt(avg((x - y) ** 2 + (y - 10) ** 2)), 6) AS rmse_xy FROM pts_ GROUP BY r""")
def a5(spark, d):
    e = F.col("z") - F.col("x")
    h = (F.col("x") - F.col("y")) ** 2 + (F.col("y") - 10) ** 2
    return pts(spark, d).groupBy("r").agg(F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse_z"), F.round(F.avg(F.abs(e)), 6).alias("mae_z"), F.round(F.avg(e), 6).alias("bias"), F.round(F.sqrt(F.avg(h)), 6).alias("rmse_xy"))


@query("p2_box_filter", """ SELECT id FROM pts_ WHERE x BETWEEN 6 AND 39 AND y BETWEEN 6 AND 29 AND z BETWEEN 11 AND 49""")
def p2(spark, d):
    return pts(spark, d).where(clouds.in_box((5, 5, 10), (40, 30, 50), 1.0)).select("id")


@query("p5_finite_rows", """ SELECT count(*) AS n FROM pts_ WHERE isfinite(x) AND isfinite(y) AND isfinite(z)""")
def p5(spark, d):
    return pts(spark, d).where(Q.is_finite(F.col("x")) & Q.is_finite(F.col("y")) & Q.is_finite(F.col("z"))).agg(F.count("*").alias("n"))


@query("p6_sphere_filter", """, m AS (SELECT median(x) AS mx, median(y) AS my, median(z) AS mz FROM emb_), e AS (SELECT id, sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) AS d FROM emb_, m)
SELECT id FROM e WHERE d <= 0.5 * (SELECT quantile_cont(d, 0.95) FROM e)""")
def p6(spark, d):
    e = emb(spark, d)
    mx, my, mz = (quantiles(e, c, {f"m{c}": 0.5}) for c in "xyz")
    mid = mx.crossJoin(my).crossJoin(mz)  # one row each
    far = e.crossJoin(F.broadcast(mid)).select("id", Q.distance((F.col("x"), F.col("y"), F.col("z")), (F.col("mx"), F.col("my"), F.col("mz"))).alias("d"))
    edge = quantiles(far, "d", {"p95": 0.95})
    return far.crossJoin(F.broadcast(edge)).where(F.col("d") <= 0.5 * F.col("p95")).select("id")


_CELL = ", box AS (SELECT min(x) AS x0, max(y) AS y1 FROM pts_), c AS (SELECT p.*, CAST(floor((x - x0) / 2) AS BIGINT) AS col, CAST(floor((y1 - y) / 2) AS BIGINT) AS \"row\" FROM pts_ p, box)"


@query("r2_surface_grid", f"""{_CELL} SELECT "row", col, max(z) AS dsm, min(z) AS low, count(*) AS n FROM c GROUP BY ALL""")
def r2(spark, d):
    return clouds.surface(clouds.cell(pts(spark, d), 2.0))


@query("r1_point_cells", f"""{_CELL} SELECT id, "row", col FROM c""")
def r1(spark, d):
    return clouds.cell(pts(spark, d), 2.0).select("id", "row", "col")


@query("r3_top_colour", f"""{_CELL}, k AS (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY z DESC, id DESC) AS k FROM c) SELECT "row", col, z AS dsm, r, g, b FROM k WHERE k = 1""")
def r3(spark, d):
    return clouds.top_colour(clouds.cell(pts(spark, d), 2.0))


@query("r5_voxel_first", """ SELECT id, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY floor(x / 5), floor(y / 5), floor(z / 5) ORDER BY id) AS k FROM pts_) WHERE k = 1""")
def r5(spark, d):
    return clouds.voxel_first(pts(spark, d), clouds.voxel_apart(5.0)).select("id", "x", "y", "z")


@query("r4_voxel_sample", None)
def r4(spark, d):
    return clouds.voxel_sample(pts(spark, d), 5.0).select("id", "x", "y", "z")


@query("r6_voxel_centroids", """ SELECT CAST(floor(x / 5) AS BIGINT) AS vx, CAST(floor(y / 5) AS BIGINT) AS vy, CAST(floor(z / 5) AS BIGINT) AS vz, round(avg(x) + 1e-11, 9) AS x, round(avg(y) + 1e-11, 9) AS y, round(avg(z) + 1e-11, 9) AS z, count(*) AS n FROM pts_ GROUP BY 1, 2, 3""")
def r6(spark, d):
    out = clouds.voxel_centroids(pts(spark, d), 5.0)
    return rounded(out.withColumns({c: F.col(c) + 1e-11 for c in "xyz"}), 9, "x", "y", "z")  # the nudge keeps exact halves from rounding by the order of summing


@query("r8_ground_points", f"""{_CELL}, g AS (SELECT "row", col, min(z) AS low FROM c GROUP BY ALL) SELECT c.id FROM c JOIN g ON c."row" = g."row" AND c.col = g.col WHERE z <= low + 0.5""")
def r8(spark, d):
    c = clouds.cell(pts(spark, d), 2.0)
    return c.join(clouds.surface(c).select("row", "col", "low"), ["row", "col"]).where(F.col("z") <= F.col("low") + 0.5).select("id")


@query("r11_dilated_occupancy", """, o AS (SELECT DISTINCT CAST(floor(x / 4) AS BIGINT) AS cx, CAST(floor(z / 8) AS BIGINT) AS cy FROM pts_ ), s AS (SELECT i, j FROM range(-2, 3) a(i), range(-2, 3) b(j) WHERE abs(i) + abs(j) <= 2)
SELECT DISTINCT cx + i AS cx, cy + j AS cy FROM o, s""")
def r11(spark, d):
    o = pts(spark, d).select(F.floor(F.col("x") / 4).alias("cx"), F.floor(F.col("z") / 8).alias("cy")).distinct()
    return clouds.dilate(o, 2)


@query("j7_tiles_with_overlap", """, t AS (SELECT id, x, y, CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty FROM pts_, range(-2, 8) a(tx), range(-2, 8) b(ty) WHERE x >= tx * 10 - 3 AND x < tx * 10 + 13 AND y >= ty * 10 - 3 AND y < ty * 10 + 13)
SELECT tx, ty, count(*) AS n, count(*) FILTER (floor(x / 10) = tx AND floor(y / 10) = ty) AS owned FROM t GROUP BY ALL""")
def j7(spark, d):
    return clouds.tiles(pts(spark, d), 10.0, 3.0, 0.0, 0.0).groupBy("tx", "ty").agg(F.count("*").alias("n"), F.count_if("inner").alias("owned"))


@query("j17_footprint_membership", """, f AS (SELECT DISTINCT floor(x / 3) AS cx, floor(y / 3) AS cy FROM pts_ WHERE z > 90) SELECT id FROM pts_ WHERE z < 10 AND (floor(x / 3), floor(y / 3)) IN (SELECT cx, cy FROM f)""")
def j17(spark, d):
    c = pts(spark, d).withColumns({"cx": F.floor(F.col("x") / 3), "cy": F.floor(F.col("y") / 3)})
    return c.where("z < 10").join(c.where("z > 90").select("cx", "cy").distinct(), ["cx", "cy"], "left_semi").select("id")


@query("a30_occupied_area", """ SELECT r, count(DISTINCT (floor(x / 3), floor(z / 3))) * 9.0::DOUBLE AS area FROM pts_ GROUP BY r""")
def a30(spark, d):
    return pts(spark, d).groupBy("r").agg((F.count_distinct(F.struct(F.floor(F.col("x") / 3), F.floor(F.col("z") / 3))) * 9.0).alias("area"))


@query("a32_grid_occupancy", """ SELECT b, count(DISTINCT (least(3, floor(x / 51 * 4)), least(3, floor(y / 51 * 4)))) / 16 AS occupancy, count(DISTINCT (least(3, floor(x / 51 * 4)), least(3, floor(y / 51 * 4)))) / 16 < 0.3 AS is_concentrated FROM pts_ GROUP BY b""")
def a32(spark, d):
    at = lambda c: F.least(F.lit(3), F.floor(F.col(c) / 51 * 4))
    out = pts(spark, d).groupBy("b").agg((F.count_distinct(F.struct(at("x"), at("y"))) / 16).alias("occupancy"))
    return out.withColumn("is_concentrated", F.col("occupancy") < 0.3)


@query("u4_new_cells", """, v AS (SELECT DISTINCT r, floor(x / 2) AS a, floor(y / 2) AS b2, floor(z / 2) AS c FROM pts_) SELECT count(*) AS new_cells FROM (SELECT a, b2, c FROM v WHERE r = 30 EXCEPT SELECT a, b2, c FROM v WHERE r = 60)""")
def u4(spark, d):
    v = pts(spark, d).select("r", *clouds.voxel(2.0))
    return v.where("r = 30").drop("r").subtract(v.where("r = 60").drop("r")).agg(F.count("*").alias("new_cells"))


@query("u6_distinct_rounded", """ SELECT min(id) AS id FROM pts_ GROUP BY round(x, 1), round(y, 1), round(z, 1)""")
def u6(spark, d):
    return pts(spark, d).groupBy(*(F.round(c, 1) for c in "xyz")).agg(F.min("id").alias("id")).select("id")


@query("a35_duplicate_fraction", """ SELECT round(1 - count(DISTINCT (round(x, 0), round(y, 0), round(z, 0))) / count(*), 8) AS duplicates FROM pts_""")
def a35(spark, d):
    return pts(spark, d).agg(F.round(1 - F.count_distinct(F.struct(*(F.round(c, 0) for c in "xyz"))) / F.count("*"), 8).alias("duplicates"))


_NN = ", q AS (SELECT * FROM emb_ WHERE id % 2 = 0), p AS (SELECT * FROM emb_ WHERE id % 2 = 1), d AS (SELECT q.id, p.id AS point_id, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2) AS dist FROM q, p), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, point_id) AS \"rank\" FROM d)"


def _halves(spark, d):
    e = emb(spark, d)
    return e.where("id % 2 = 0"), e.where("id % 2 = 1")


@query("j6_nearest_point", f"""{_NN} SELECT id, point_id, round(dist, 6) AS distance FROM k WHERE "rank" = 1""")
def j6(spark, d):
    a, b = _halves(spark, d)
    return rounded(neighbours(a, b, 1), 6, "distance").select("id", "point_id", "distance")


@query("j8_kth_neighbour", f"""{_NN} SELECT id, "rank", point_id, round(dist, 6) AS distance FROM k WHERE "rank" <= 6""")
def j8(spark, d):
    a, b = _halves(spark, d)
    return rounded(neighbours(a, b, 6), 6, "distance").select("id", F.col("rank").cast("long").alias("rank"), "point_id", "distance")


@query("f16_point_density", f"""{_NN} SELECT id, round(6 / (4.0 / 3.0 * pi() * greatest(dist, 1e-6) ** 3), 4) AS density FROM k WHERE "rank" = 6""")
def f16(spark, d):
    a, b = _halves(spark, d)
    return neighbours(a, b, 6).where("rank = 6").select("id", F.round(Q.density(F.col("distance"), 6), 4).alias("density"))


@query("v7_cloud_to_cloud", f"""{_NN} SELECT {_STATS.replace("d * d", "dist * dist").replace("(d", "(dist").replace("(distist", "(dist")}, round(avg((dist <= 0.5)::INT), 8) AS within_0_50, round(avg((dist <= 1.0)::INT), 8) AS within_1_00 FROM k WHERE "rank" = 1""")
def v7(spark, d):
    a, b = _halves(spark, d)
    near = materialise(neighbours(a, b, 1), "near")
    both = clouds.error_statistics(near, "distance").crossJoin(clouds.coverage(near, "distance", (0.5, 1.0)))  # one row each
    return rounded(rounded(both, 7, *_MEASURES), 8, "within_0_50", "within_1_00")


@query("a22_reconstruction_risk", f"""{_NN}, n AS (SELECT id, max(dist) FILTER ("rank" = 1) AS s, 6 / (4.0 / 3.0 * pi() * greatest(max(dist) FILTER ("rank" = 6), 1e-6) ** 3) AS g FROM k WHERE "rank" <= 6 GROUP BY id)
SELECT id, round((greatest(0, least(1, s / ((SELECT quantile_cont(s, 0.95) FROM n) + 1e-6))) + greatest(0, least(1, 1 / (g + 1e-6)))) / 2, 6) AS risk FROM n""")
def a22(spark, d):
    a, b = _halves(spark, d)
    near = neighbours(a, b, 6).groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("s"), F.max(F.when(F.col("rank") == 6, F.col("distance"))).alias("k"))
    near = materialise(near, "near")
    edge = quantiles(near, "s", {"p95": 0.95})
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    risk = (clip(F.col("s") / (F.col("p95") + 1e-6)) + clip(1 / (Q.density(F.col("k"), 6) + 1e-6))) / 2
    return near.crossJoin(F.broadcast(edge)).select("id", F.round(risk, 6).alias("risk"))


@query("r12_outlier_removal", """, d AS (SELECT a.id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS dist, b.id AS o FROM emb_ a, emb_ b), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, o) AS k FROM d), m AS (SELECT id, avg(dist) AS m FROM k WHERE k <= 6 GROUP BY id)
SELECT id FROM m WHERE m <= (SELECT avg(m) + 2 * stddev_pop(m) FROM m)""")
def r12(spark, d):
    e = emb(spark, d)
    mean = neighbours(e, e, 6).groupBy("id").agg(F.avg("distance").alias("m"))
    edge = mean.agg((F.avg("m") + 2 * F.stddev_pop("m")).alias("edge"))
    return mean.crossJoin(F.broadcast(edge)).where("m <= edge").select("id")


@query("r13_density_trimming", f"""{_NN}, n AS (SELECT id, max(dist) FILTER ("rank" = 1) AS s, max(dist) FILTER ("rank" = 6) AS f FROM k WHERE "rank" <= 6 GROUP BY id) SELECT id FROM n WHERE s <= 1.5 AND f <= (SELECT quantile_cont(f, 0.98) FROM n)""")
def r13(spark, d):
    a, b = _halves(spark, d)
    near = neighbours(a, b, 6).groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("s"), F.max("distance").alias("f"))
    near = materialise(near, "near")
    edge = quantiles(near, "f", {"edge": 0.98})
    return near.crossJoin(F.broadcast(edge)).where("s <= 1.5 AND f <= edge").select("id")


_RATIO = f"{_NN}, m AS (SELECT id AS query, point_id AS train, dist AS distance FROM k k1 WHERE \"rank\" = 1 AND dist < 0.72 * (SELECT dist FROM k k2 WHERE k2.id = k1.id AND k2.\"rank\" = 2))"


def _pairs(spark, d):
    a, b = _halves(spark, d)
    return neighbours(a, b, 2).select(F.col("id").alias("query"), F.col("point_id").alias("train"), "distance")


@query("j12_ratio_matches", f"""{_RATIO} SELECT query, train, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY train ORDER BY distance, query) AS k FROM m) WHERE k = 1""")
def j12(spark, d):
    return rounded(clouds.ratio_matches(_pairs(spark, d), 0.72), 6, "distance")


@query("j12_ratio_matches_many_to_one", f"""{_RATIO} SELECT query, train, round(distance, 6) AS distance FROM m""")
def j12b(spark, d):
    return rounded(clouds.ratio_matches(_pairs(spark, d), 0.72, one_to_one=False), 6, "distance")


@query("p14_heuristic_labels", """, h AS (SELECT quantile_cont(z, 0.1) AS low FROM pts_), c AS (SELECT id, z > low + 2 AS high, abs(g - b) < 40 AS neutral, g > b + 60 AS green FROM pts_, h)
SELECT id, CASE WHEN green THEN 'VEGETATION' WHEN neutral AND NOT high THEN 'ROAD' WHEN high THEN 'BUILDING' ELSE 'GROUND' END AS label, CASE WHEN green THEN 0.7 WHEN neutral AND NOT high THEN 0.6 WHEN high THEN 0.5 ELSE 0.6 END::DOUBLE AS confidence FROM c""")
def p14(spark, d):
    p = pts(spark, d)
    low = quantiles(p, "z", {"low": 0.1})
    label, confidence = rules.heuristic_label(F.col("z"), F.col("low"), F.abs(F.col("g") - F.col("b")) < 40, F.col("g") > F.col("b") + 60)
    return p.crossJoin(F.broadcast(low)).select("id", label.alias("label"), confidence.alias("confidence"))


@query("p19_support_class", f"""{_NN} SELECT CASE WHEN dist <= 0.6 THEN 'SUPPORTED' WHEN dist > 1.2 THEN 'UNOBSERVED' ELSE 'WEAK' END AS support, count(*) AS n, round(avg(dist), 6) AS mean, round(quantile_cont(dist, 0.95), 6) AS p95 FROM k WHERE "rank" = 1 GROUP BY 1""")
def p19(spark, d):
    near = materialise(j6(spark, d).withColumn("support", rules.support_class(F.col("distance"), F.lit(0.6), F.lit(1.2))), "near")
    stats = clouds.error_statistics(near, "distance", ["support"])
    return rounded(stats, 6, "mean", "p95").select("support", F.col("count").alias("n"), "mean", "p95")


@query("a17_class_statistics", """ SELECT CAST(c AS BIGINT) AS class, count(id) AS faces, round(coalesce(sum(abs(x)), 0), 5) AS area, round(coalesce(avg(abs(y)), 0), 6) AS confidence FROM range(12) t(c) LEFT JOIN emb_ ON label = c GROUP BY c""")
def a17(spark, d):
    s = emb(spark, d).groupBy(F.col("label").cast("long").alias("class")).agg(F.count("*").alias("faces"), F.sum(F.abs("x")).alias("area"), F.avg(F.abs("y")).alias("confidence"))
    out = spark.range(12).select(F.col("id").alias("class")).join(s, "class", "left").fillna(0)
    return out.select("class", "faces", F.round("area", 5).alias("area"), F.round("confidence", 6).alias("confidence"))


@query("a19_multi_view_vote", """, o AS (SELECT l_partkey AS id, l_linenumber AS label, CASE WHEN l_discount < 0.03 THEN 0.0 ELSE l_discount END AS c FROM lineitem), s AS (SELECT id, label, sum(c) AS c, count(*) AS n FROM o WHERE c > 0 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(c, 9) DESC, label) AS k, sum(n) OVER (PARTITION BY id) AS support FROM s)
SELECT p_partkey AS id, CAST(coalesce(label, 0) AS BIGINT) AS label, round(coalesce(c / support, 0.0), 9) AS confidence, CAST(coalesce(support, 0) AS BIGINT) AS support FROM part LEFT JOIN b ON p_partkey = id AND k = 1""")
def a19(spark, d):
    li = table(spark, d, "lineitem")
    obs = li.select(F.col("l_partkey").alias("id"), F.col("l_linenumber").cast("long").alias("label"), F.when(F.col("l_discount") < 0.03, 0.0).otherwise(F.col("l_discount")).alias("confidence"))
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    # sums of equal confidences differ in their last bits by order; compare them to nine places
    seen = obs.where("confidence > 0").groupBy("id", "label").agg(F.round(F.sum("confidence"), 9).alias("c"), F.count("*").alias("n"))
    best = seen.groupBy("id").agg(F.max(F.struct("c", (-F.col("label")).alias("l"))).alias("b"), F.sum("n").alias("support"))
    return ids.join(best, "id", "left").select("id", F.coalesce(-F.col("b.l"), F.lit(0)).alias("label"), F.round(F.coalesce(F.col("b.c") / F.col("support"), F.lit(0.0)), 9).alias("confidence"), F.coalesce("support", F.lit(0)).alias("support"))


@query("a21_heatmap_summary", """ SELECT r, min(z) AS low, max(z) AS high, median(z) AS mid, count(*) AS n FROM pts_ GROUP BY r""")
def a21(spark, d):
    p = pts(spark, d)
    ends = p.groupBy("r").agg(F.min("z").alias("low"), F.max("z").alias("high"), F.count("*").alias("n"))
    return with_quantiles(ends, p, "z", {"mid": 0.5}, ["r"])


@query("a23_confusion_metrics", """, p AS (SELECT quality AS truth, toxic AS guess FROM labels), c AS (SELECT unnest([0, 1, 2]) AS label),
k AS (SELECT label, (SELECT count(*) FROM p WHERE truth = label AND guess = label) AS tp, (SELECT count(*) FROM p WHERE truth = label) AS a, (SELECT count(*) FROM p WHERE guess = label) AS g FROM c)
SELECT CAST(label AS BIGINT) AS label, tp, g - tp AS fp, a - tp AS fn, round(coalesce(tp / nullif(a + g - tp, 0), 0), 8) AS iou, round(coalesce(tp / nullif(g, 0), 0), 8) AS "precision", round(coalesce(tp / nullif(a, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(a + g, 0), 0), 8) AS f1 FROM k""")
def a23(spark, d):
    p = table(spark, d, "labels").select(F.col("quality").cast("long").alias("truth"), F.col("toxic").cast("long").alias("guess"))
    return rounded(rules.confusion(p, spark.range(3).withColumnRenamed("id", "label")), 8, "iou", "precision", "recall", "f1")


@query("a25_class_frequency", """ SELECT r * 65536 + (g % 4) * 256 + b % 4 AS key, count(*) AS n, CASE WHEN g % 4 = 0 THEN 'KNOWN' ELSE 'UNKNOWN' END AS class FROM pts_ GROUP BY ALL""")
def a25(spark, d):
    p = pts(spark, d)
    return p.groupBy(L.rgb_key(F.col("r"), F.col("g") % 4, F.col("b") % 4).alias("key"), F.when(F.col("g") % 4 == 0, "KNOWN").otherwise("UNKNOWN").alias("class")).agg(F.count("*").alias("n"))


@query("f28_colormap", """, s AS (SELECT id, greatest(0, least(1, (z - 20) / 60)) AS t, r FROM pts_), u AS (SELECT id, CASE WHEN r % 60 = 0 THEN 1 - t ELSE t END AS t FROM s)
SELECT id, round(greatest(0, least(1, 1.5 - abs(1 - 4 * (t - 0.5)))), 6) AS cr, round(greatest(0, least(1, 1.5 - abs(1 - 4 * (t - 0.25)))), 6) AS cg, round(greatest(0, least(1, 1.5 - abs(1 - 4 * t))), 6) AS cb FROM u""")
def f28(spark, d):
    r, g, b = L.colormap(F.col("z"), F.lit(20.0), F.lit(80.0), F.col("r") % 60 == 0)
    return pts(spark, d).select("id", F.round(r, 6).alias("cr"), F.round(g, 6).alias("cg"), F.round(b, 6).alias("cb"))


@query("f30_las_codes", """ SELECT label, CASE label WHEN 1 THEN 2 WHEN 2 THEN 11 WHEN 3 THEN 6 WHEN 4 THEN 5 WHEN 5 THEN 9 ELSE 1 END AS code, count(*) AS n FROM emb_ GROUP BY ALL""")
def f30(spark, d):
    return emb(spark, d).groupBy("label", L.las_code(F.col("label")).alias("code")).agg(F.count("*").alias("n"))


@query("f1_geodetic_to_ecef", """, g AS (SELECT id, radians(x) AS la, radians(y * 3) AS lo, z FROM pts_), n AS (SELECT *, 6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(la) ** 2) AS n FROM g)
SELECT id, round((n + z) * cos(la) * cos(lo), 3) AS ex, round((n + z) * cos(la) * sin(lo), 3) AS ey, round((n * (1 - 0.0066943799901413165) + z) * sin(la), 3) AS ez FROM n""")
def f1(spark, d):
    x, y, z = G.geodetic_to_ecef(F.col("x"), F.col("y") * 3, F.col("z"))
    return pts(spark, d).select("id", F.round(x, 3).alias("ex"), F.round(y, 3).alias("ey"), F.round(z, 3).alias("ez"))


@query("f2_ecef_round_trip", """ SELECT id, round(x, 6) AS lat, round(y * 3, 6) AS lon, 0.0::DOUBLE AS alt_error FROM pts_""")
def f2(spark, d):
    ecef = G.geodetic_to_ecef(F.col("x"), F.col("y") * 3, F.col("z"))
    p = pts(spark, d).select("id", "z", *(c.alias(n) for c, n in zip(ecef, ("ex", "ey", "ez"), strict=True)))
    lat, lon, alt = G.ecef_to_geodetic(F.col("ex"), F.col("ey"), F.col("ez"))
    return p.select("id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), F.round(F.abs(alt - F.col("z")), 3).alias("alt_error"))


@query("f10_utm_zones", """ SELECT CAST(floor((y * 7 - 170 + 180) / 6) + 1 AS BIGINT) AS zone, CAST(CASE WHEN x >= 25 THEN 32600 ELSE 32700 END + floor((y * 7 - 170 + 180) / 6) + 1 AS BIGINT) AS epsg, count(*) AS n FROM pts_ GROUP BY ALL""")
def f10(spark, d):
    lon = F.col("y") * 7 - 170
    return pts(spark, d).groupBy(G.utm_zone(lon).cast("long").alias("zone"), G.utm_epsg(F.col("x") - 25, lon).cast("long").alias("epsg")).agg(F.count("*").alias("n"))


@query("f11_utm_coordinates", None)
def f11(spark, d):
    e, n = G.utm_from_geodetic(F.col("x"), F.col("y") / 20 + 72, F.lit(43))
    return pts(spark, d).select("id", F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


@query("f20_triangle_areas", """, t AS (SELECT id, x, y, z, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2, lead(z, 2) OVER w AS z2 FROM emb_ WINDOW w AS (PARTITION BY label ORDER BY id))
SELECT id, round(sqrt(((y1 - y) * (z2 - z) - (z1 - z) * (y2 - y)) ** 2 + ((z1 - z) * (x2 - x) - (x1 - x) * (z2 - z)) ** 2 + ((x1 - x) * (y2 - y) - (y1 - y) * (x2 - x)) ** 2) / 2, 6) AS area FROM t WHERE x2 IS NOT NULL""")
def f20(spark, d):
    t = _triangles(spark, d)
    return t.select("id", F.round(Q.triangle_area(*_corners()), 6).alias("area"))


def _corners():
    return tuple((F.col(f"x{k}"), F.col(f"y{k}"), F.col(f"z{k}")) for k in range(3))


def _triangles(spark, d):
    w = Window.partitionBy("label").orderBy("id")
    e = emb(spark, d)
    cols = [(F.lead(c, k).over(w) if k else F.col(c)).alias(f"{c}{k}") for k in range(3) for c in "xyz"]
    return e.select("id", "label", *cols).where("x2 IS NOT NULL")


def _edge_share(a: int, b: int) -> str:
    """Where along an edge the point (0.5, -0.5, 1) is closest, from 0 to 1."""
    dot = " + ".join(f"({p} - {c}{a}) * ({c}{b} - {c}{a})" for p, c in (("0.5", "x"), ("-0.5", "y"), ("1", "z")))
    return f"least(1, greatest(0, coalesce(({dot}) / nullif((x{b} - x{a}) ** 2 + (y{b} - y{a}) ** 2 + (z{b} - z{a}) ** 2, 0), 0)))"


def _inner_side(a: int, b: int) -> str:
    return f"((y{b} - y{a}) * (pz - z{a}) - (z{b} - z{a}) * (py - y{a})) * nx + ((z{b} - z{a}) * (px - x{a}) - (x{b} - x{a}) * (pz - z{a})) * ny + ((x{b} - x{a}) * (py - y{a}) - (y{b} - y{a}) * (px - x{a})) * nz >= 0"


#: The closest of the edges' closest points and of the foot on the plane, if that is inside.
_CLOSEST = f""", t AS (SELECT id, x AS x0, y AS y0, z AS z0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2, lead(z, 2) OVER w AS z2 FROM emb_ WINDOW w AS (PARTITION BY label ORDER BY id)),
e AS (SELECT *, {_edge_share(0, 1)} AS s01, {_edge_share(1, 2)} AS s12, {_edge_share(2, 0)} AS s20, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM t WHERE x2 IS NOT NULL),
f AS (SELECT *, ((0.5 - x0) * nx + (-0.5 - y0) * ny + (1 - z0) * nz) / nullif(nx * nx + ny * ny + nz * nz, 0) AS h FROM e),
q AS (SELECT id, x0 + s01 * (x1 - x0) AS qx, y0 + s01 * (y1 - y0) AS qy, z0 + s01 * (z1 - z0) AS qz FROM f UNION ALL SELECT id, x1 + s12 * (x2 - x1), y1 + s12 * (y2 - y1), z1 + s12 * (z2 - z1) FROM f UNION ALL SELECT id, x2 + s20 * (x0 - x2), y2 + s20 * (y0 - y2), z2 + s20 * (z0 - z2) FROM f
  UNION ALL SELECT id, px, py, pz FROM (SELECT *, 0.5 - h * nx AS px, -0.5 - h * ny AS py, 1 - h * nz AS pz FROM f) WHERE {' AND '.join(_inner_side(*s) for s in ((0, 1), (1, 2), (2, 0)))}),
k AS (SELECT id, qx, qy, qz, sqrt((qx - 0.5) ** 2 + (qy + 0.5) ** 2 + (qz - 1) ** 2) AS d FROM q), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM k)
SELECT id, round(qx, 6) AS qx, round(qy, 6) AS qy, round(qz, 6) AS qz, round(d, 6) AS distance FROM b WHERE k = 1"""


@query("f19_closest_on_triangle", _CLOSEST)
def f19(spark, d):
    (qx, qy, qz), dist = Q.closest_on_triangle((F.lit(0.5), F.lit(-0.5), F.lit(1.0)), *_corners())
    return _triangles(spark, d).select("id", F.round(qx, 6).alias("qx"), F.round(qy, 6).alias("qy"), F.round(qz, 6).alias("qz"), F.round(dist, 6).alias("distance"))


@query("f14_ray_angles", """, t AS (SELECT id, x, y, z, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM emb_ WINDOW w AS (PARTITION BY label ORDER BY id))
SELECT id, round(degrees(acos(greatest(-1.0, least(1.0, (x * x1 + y * y1 + z * z1) / (sqrt(x * x + y * y + z * z) * sqrt(x1 * x1 + y1 * y1 + z1 * z1)))))), 5) AS angle FROM t WHERE x1 IS NOT NULL""")
def f14(spark, d):
    a, b, _ = _corners()
    w = Window.partitionBy("label").orderBy("id")
    e = emb(spark, d).select("id", *(F.col(c).alias(f"{c}0") for c in "xyz"), *(F.lead(c).over(w).alias(f"{c}1") for c in "xyz")).where("x1 IS NOT NULL")
    return e.select("id", F.round(Q.angle_between(a, b), 5).alias("angle"))


@query("p10_pinhole_projection", """, p AS (SELECT id, round_even(800 * (x - 25) / z + 320, 0) AS u, round_even(800 * (y - 25) / z + 240, 0) AS v FROM pts_ WHERE z > 0) SELECT id, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v FROM p WHERE u BETWEEN 0 AND 639 AND v BETWEEN 0 AND 479""")
def p10(spark, d):
    u, v = Q.project(F.col("x") - 25, F.col("y") - 25, F.col("z"), 800.0, 800.0, 320.0, 240.0)
    return pts(spark, d).select("id", u.alias("u"), v.alias("v")).where("u BETWEEN 0 AND 639 AND v BETWEEN 0 AND 479")


@query("w15_support_ranks", """, a AS (SELECT id, row_number() OVER (PARTITION BY label ORDER BY x DESC, id) AS k, count(*) OVER (PARTITION BY label) AS n, label FROM emb_)
SELECT label, id, CASE WHEN k <= round_even(n * 0.6, 0) THEN 'SUPPORTED' WHEN k <= round_even(n * 0.6, 0) + round_even(n * 0.25, 0) THEN 'WEAK' ELSE 'UNOBSERVED' END AS support FROM a""")
def w15(spark, d):
    w = Window.partitionBy("label")
    a = emb(spark, d).withColumns({"k": F.row_number().over(w.orderBy(F.col("x").desc(), "id")), "n": F.count("*").over(w)})
    n1, n2 = F.rint(F.col("n") * 0.6), F.rint(F.col("n") * 0.25)
    return a.select("label", "id", F.when(F.col("k") <= n1, "SUPPORTED").when(F.col("k") <= n1 + n2, "WEAK").otherwise("UNOBSERVED").alias("support"))


@query("f38_softmax", """, e AS (SELECT vec_id, [CAST(v AS DOUBLE) FOR v IN embedding[1:8]] AS l FROM embeddings) SELECT vec_id, CAST(list_position(l, list_max(l)) - 1 AS BIGINT) AS class, round(1 / list_sum([exp(v - list_max(l)) FOR v IN l]), 6) AS confidence FROM e""")
def f38(spark, d):
    l = F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double"))
    k, p = L.softmax_argmax(F.col("l"))
    return table(spark, d, "embeddings").select("vec_id", l.alias("l")).select("vec_id", k.cast("long").alias("class"), F.round(p, 6).alias("confidence"))


@query("g1_components", """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, -CAST(l_partkey * 1000 + l_quantity * 10 + l_linenumber AS BIGINT) AS b FROM lineitem), s AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT u, u FROM s UNION SELECT s.v, r.root FROM r JOIN s ON s.u = r.node) SELECT node, min(root) AS root FROM r GROUP BY node""")
def g1(spark, d):
    """Orders that have a part in one quantity on one line number, over all line items."""
    item = (F.col("l_partkey") * 1000 + F.col("l_quantity") * 10 + F.col("l_linenumber")).cast("long")
    return components.components(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), (-item).alias("b")), "g1", peel=True)


@query("w16_nearest_frames", """, k AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.id - b.id), b.id) AS k FROM emb_ a JOIN emb_ b ON a.label = b.label AND a.id <> b.id) SELECT id, other FROM k WHERE k <= 4""")
def w16(spark, d):
    w = Window.partitionBy("label").orderBy("id")
    # the four closest by number stand within four places on either side
    near = F.array_compact(F.array(*(f("id", k).over(w) for f in (F.lag, F.lead) for k in range(1, 5))))
    gap = lambda o: F.struct(F.abs(o - F.col("id")).alias("d"), o.alias("o"))
    best = F.slice(F.array_sort(F.transform("n", gap)), 1, 4)
    return emb(spark, d).select("id", near.alias("n")).select("id", F.explode(best).alias("b")).select("id", F.col("b.o").alias("other"))
