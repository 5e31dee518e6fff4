"""Projects, jobs, frames, pairs and checks on the relational driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as Q
from ..functions import labels as L
from ..operators import clouds, missions, rules, streams
from ..operators.overlap import shared_points, top_shared
from ..storage import table
from .binding import epoch, frames, jobs, projects, query, rounded


@query("j18_project_mission_counts", """ SELECT p.id, p.name, count(j.id) AS mission_count FROM projects_ p LEFT JOIN jobs_ j ON j.project_id = p.id WHERE p.archived_at IS NULL GROUP BY ALL""")
def j18(spark, d):
    return missions.with_counts(projects(spark, d), jobs(spark, d)).select("id", "name", "mission_count")


@query("a31_status_kpis", """ SELECT count(*) AS total, count(*) FILTER (status IN ('queued', 'running', 'cancelling')) AS active, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status IN ('failed', 'RECONSTRUCTION_BLOCKED')) AS failed FROM jobs_ """)
def a31(spark, d):
    return missions.kpis(jobs(spark, d))


@query("o1_latest_jobs", """ SELECT id, project_id, status, created FROM jobs_ ORDER BY created DESC, id DESC LIMIT 100""")
def o1(spark, d):
    return missions.latest(jobs(spark, d)).select("id", "project_id", "status", "created")


@query("o2_missions_of_projects", """ SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY created DESC, id DESC) AS place FROM jobs_ """)
def o2(spark, d):
    return jobs(spark, d).select("project_id", "id", F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("created").desc(), F.col("id").desc())).alias("place"))


@query("o3_top_source_views", """, s AS (SELECT a.l_suppkey AS img, b.l_suppkey AS other, count(DISTINCT a.l_partkey) AS shared FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey GROUP BY ALL)
SELECT img, other, shared FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY shared DESC, abs(img - other), other) AS k FROM s) WHERE k <= 5""")
def o3(spark, d):
    return top_shared(_seen(spark, d), 5)


def _seen(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("point"), F.col("l_suppkey").alias("img"))


@query("j13_shared_points", """, i AS (SELECT DISTINCT l_suppkey AS img FROM lineitem), p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), s AS (SELECT a.l_suppkey AS img, b.l_suppkey AS other, count(*) AS shared FROM p a JOIN p b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey GROUP BY ALL)
SELECT a.img, b.img AS other, coalesce(shared, 0) AS shared FROM i a JOIN i b ON a.img <> b.img LEFT JOIN s ON s.img = a.img AND s.other = b.img""")
def j13(spark, d):
    return shared_points(_seen(spark, d), with_none=True)


@query("j10_band_pairs", """ SELECT a.idx AS a, b.idx AS b FROM frames_ a JOIN frames_ b ON a.idx < b.idx AND b.idx <= a.idx + 3""")
def j10(spark, d):
    f = frames(spark, d).select("idx")
    ahead = f.select(F.col("idx").alias("a"), F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + 3)).alias("b"))
    return ahead.join(f, F.col("b") == F.col("idx"), "left_semi")


@query("j11_initial_pairs", """ SELECT a.idx AS a, b.idx AS b FROM frames_ a JOIN frames_ b ON a.idx < 3 AND b.idx > a.idx AND b.idx < a.idx + 7""")
def j11(spark, d):
    f = frames(spark, d).select("idx")
    ahead = f.where("idx < 3").select(F.col("idx").alias("a"), F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + 6)).alias("b"))
    return ahead.join(f, F.col("b") == F.col("idx"), "left_semi")


@query("j14_name_lookup", """SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def j14(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("j16_missing_pairs", """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def j16(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j23_observations", """SELECT a.l_orderkey AS frame, a.l_linenumber AS keypoint, b.p_partkey AS point FROM lineitem a JOIN part b ON a.l_partkey = b.p_partkey WHERE b.p_size < 10""")
def j23(spark, d):
    p = table(spark, d, "part").where("p_size < 10")
    return table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("keypoint"), F.col("p_partkey").alias("point"))


@query("j24_class_map", """SELECT vec_id, CASE label WHEN 0 THEN 8 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 1 END AS class FROM embeddings""")
def j24(spark, d):
    k = F.col("label")
    return table(spark, d, "embeddings").select("vec_id", F.when(k == 0, 8).when(k == 1, 2).when(k == 2, 3).when(k == 3, 4).otherwise(1).alias("class"))


@query("o5_largest_model", """SELECT p_brand, arg_max(p_partkey, (p_retailprice, p_partkey)) AS best FROM part GROUP BY p_brand""")
def o5(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("best"))


@query("o7_prune_failed", """, f AS (SELECT id, row_number() OVER (ORDER BY created DESC, id DESC) AS k FROM jobs_ WHERE status = 'failed') SELECT id FROM jobs_ WHERE id NOT IN (SELECT id FROM f WHERE k > 10) OR id IN (1, 2, 3, 4, 5)""")
def o7(spark, d):
    return missions.prune_failed(jobs(spark, d), 10, [1, 2, 3, 4, 5]).select("id")


@query("o8_first_available", """SELECT l_orderkey, arg_min(l_shipmode_, (l_linenumber, l_shipmode_)) AS path FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem WHERE l_quantity > 20) GROUP BY l_orderkey""")
def o8(spark, d):
    c = table(spark, d, "lineitem").where("l_quantity > 20").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("path"))
    return missions.first_available(c, "l_orderkey", "path", "l_linenumber")


@query("t3_stale_jobs", """ SELECT id, CASE WHEN status = 'running' AND created + 150 - updated > 90 THEN 'failed' ELSE status END AS status FROM jobs_ """)
def t3(spark, d):
    return missions.stale(jobs(spark, d), F.col("created") + 150).select("id", "status")


@query("t4_start_repair", """ SELECT CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status, count(*) AS n FROM jobs_ GROUP BY 1""")
def t4(spark, d):
    return missions.repair_on_start(jobs(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("t5_completed_without_artifact", """ SELECT id FROM jobs_ WHERE status = 'completed' AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)""")
def t5(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("job_id"))
    return missions.completed_without(jobs(spark, d), a).select("id")


@query("j19_representations", """, a AS (SELECT l_orderkey AS job_id, bool_or(l_returnflag = 'R') AS glb, bool_or(l_returnflag = 'A') AS fallback FROM lineitem GROUP BY 1)
SELECT id, CASE WHEN coalesce(glb, false) AND status <> 'failed' THEN 'AVAILABLE' WHEN coalesce(fallback, false) THEN 'FALLBACK' ELSE 'UNAVAILABLE' END AS representation FROM jobs_ LEFT JOIN a ON id = job_id""")
def j19(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("glb"), F.bool_or(F.col("l_returnflag") == "A").alias("fallback"))
    no = F.lit(False)
    out = jobs(spark, d).join(a, F.col("id") == F.col("job_id"), "left")
    return out.select("id", F.when(F.coalesce("glb", no) & (F.col("status") != "failed"), "AVAILABLE").when(F.coalesce("fallback", no), "FALLBACK").otherwise("UNAVAILABLE").alias("representation"))


@query("p13_blur_rejection", """ SELECT idx FROM frames_ WHERE NOT sharpness < 40""")
def p13(spark, d):
    return frames(spark, d).where(~(F.col("sharpness") < 40)).select("idx")


@query("a8_quality_ratios", """ SELECT round(avg((sharpness < 45)::INT), 8) AS blur, round(avg((dark = 0)::INT), 8) AS dark FROM frames_ """)
def a8(spark, d):
    return frames(spark, d).agg(F.round(F.avg((F.col("sharpness") < 45).cast("int")), 8).alias("blur"), F.round(F.avg((F.col("dark") == 0).cast("int")), 8).alias("dark"))


@query("a39_metric_profile", """ SELECT dark, min(sharpness) AS low, round(avg(sharpness), 6) AS mean, max(sharpness) AS high, max(motion) AS motion FROM frames_ GROUP BY dark""")
def a39(spark, d):
    return frames(spark, d).groupBy("dark").agg(F.min("sharpness").alias("low"), F.round(F.avg("sharpness"), 6).alias("mean"), F.max("sharpness").alias("high"), F.max("motion").alias("motion"))


@query("w8_stratified_frames", """, n AS (SELECT count(*) AS n FROM frames_ ), w AS (SELECT idx, floor(idx / 149) * 149 AS s, n FROM frames_, n), l AS (SELECT *, least(s + 149, n) - s AS len FROM w) SELECT CAST(idx AS BIGINT) AS idx FROM l WHERE (idx - s) % greatest(1, floor(len / 3)) = 0""")
def w8(spark, d):
    f = frames(spark, d)
    n = f.count()
    return f.where(streams.stratified(n, 29.97)(F.col("idx"))).select("idx")


_W9 = """, n AS (SELECT count(*) AS n FROM frames_ ), c AS (SELECT CAST(floor(j * ((n - 2) / 38.0::DOUBLE)) AS BIGINT) AS a, CAST(floor((j + 1) * ((n - 2) / 38.0::DOUBLE)) AS BIGINT) AS b, j FROM range(38) g(j), n),
k AS (SELECT idx, row_number() OVER (PARTITION BY j ORDER BY sharpness * least(1.0, greatest(0.1, motion) / 20.0) DESC, idx) AS k FROM c JOIN frames_ f ON f.idx - 1 >= a AND f.idx - 1 < b, n WHERE f.idx > 0 AND f.idx < n - 1),
s AS (SELECT CAST(idx AS BIGINT) AS idx FROM k WHERE k = 1 UNION SELECT 0 UNION SELECT n - 1 FROM n)"""


def _chosen(spark, d):
    f = frames(spark, d)
    n = f.count()
    score = F.col("sharpness") * F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("motion")) / 20.0)
    return streams.chunk_best(f, "idx", n, 40, score), n


@query("w9_chunk_best", f"""{_W9} SELECT idx FROM s""")
def w9(spark, d):
    return _chosen(spark, d)[0]


@query("w10_bridge_gaps", f"""{_W9} SELECT idx FROM s UNION SELECT (idx + nx) // 2 FROM (SELECT idx, lead(idx) OVER (ORDER BY idx) AS nx FROM s), n WHERE nx - idx > n / 40.0 * 1.5""")
def w10(spark, d):
    chosen, n = _chosen(spark, d)
    return streams.bridge(chosen, "idx", n, 40)


_PAIRS = ", e AS (SELECT l_orderkey % 400 AS a, l_orderkey % 400 + 1 AS b, CAST(l_quantity * 3 AS BIGINT) AS inliers, l_discount * 20 AS parallax, l_tax > 0.06 AS rotation, CAST(l_extendedprice AS BIGINT) % 50 AS matches FROM lineitem)"


def _edges(spark, d):
    li = table(spark, d, "lineitem")
    a = F.col("l_orderkey") % 400
    return li.select(a.alias("a"), (a + 1).alias("b"), (F.col("l_quantity") * 3).cast("long").alias("inliers"), (F.col("l_discount") * 20).alias("parallax"), (F.col("l_tax") > 0.06).alias("rotation"))


@query("a10_pair_metrics", f"""{_PAIRS} SELECT round(avg(inliers), 6) AS mean_inliers, count(*) FILTER (parallax < 1.0 AND inliers > 50) AS near_zero, count(*) FILTER (rotation) AS pure_rotation, count(*) FILTER (inliers < 10) AS jumps FROM e WHERE b = a + 1""")
def a10(spark, d):
    i = F.col("inliers")
    return _edges(spark, d).where("b = a + 1").agg(F.round(F.avg(i), 6).alias("mean_inliers"), F.count_if((F.col("parallax") < 1.0) & (i > 50)).alias("near_zero"), F.count_if("rotation").alias("pure_rotation"), F.count_if(i < 10).alias("jumps"))


_RATIOS = ", r AS (SELECT s_suppkey AS id, (s_suppkey % 10) / 10 AS blur, (s_suppkey % 7) / 7 AS dark, (s_suppkey % 6) / 5 AS largest, (s_suppkey % 4) / 10 AS isolated, (s_suppkey % 5) / 10 AS near_zero, (s_suppkey % 3) / 5 AS pure_rotation, s_suppkey % 3 AS jumps, s_suppkey * 1.0::DOUBLE AS inliers FROM supplier)"


def _ratios(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), ((k % 10) / 10).alias("blur"), ((k % 7) / 7).alias("dark"), ((k % 6) / 5).alias("largest"), ((k % 4) / 10).alias("isolated"), ((k % 5) / 10).alias("near_zero"), ((k % 3) / 5).alias("pure_rotation"), (k % 3).alias("jumps"), (k * 1.0).alias("inliers"))


_TEXTS = """, t AS (SELECT *, concat_ws('|', CASE WHEN blur > 0.5 THEN printf('Excessive blur (%.1f%% frames blurry).', blur * 100) END, CASE WHEN largest < 0.5 THEN printf('Disconnected dataset. Largest contiguous segment is only %.1f%%.', largest * 100) END) AS blocking,
  CASE WHEN blur > 0.1 AND blur <= 0.5 THEN printf('Moderate blur detected (%.1f%% frames blurry).', blur * 100) END AS moderate,
  CASE WHEN near_zero > 0.3 THEN printf('High redundancy: %.1f%% of consecutive frames have near-zero motion.', near_zero * 100) END AS redundant, CASE WHEN pure_rotation > 0.3 THEN printf('Risk of pure rotation without baseline in %.1f%% of frame pairs.', pure_rotation * 100) END AS rotating,
  CASE WHEN jumps > 0 THEN printf('Abrupt jumps or lost tracking detected in %d pairs.', jumps) END AS jumping, CASE WHEN inliers < 50 THEN printf('Low sequential overlap (avg %.1f inliers).', inliers) END AS low FROM r)"""


@query("v1_readiness_full", f"""{_RATIOS}{_TEXTS} SELECT id, CASE WHEN blocking <> '' THEN 'NOT_READY' WHEN concat_ws('|', moderate, redundant, rotating, jumping, low) <> '' THEN 'WARNING' ELSE 'READY' END AS status, blocking, concat_ws('|', moderate, redundant, rotating, jumping, low) AS warnings,
  round(least(greatest(0.0, 100 - blur * 30 - CASE WHEN largest < 1 THEN (1 - largest) * 50 ELSE 0 END - CASE WHEN dark > 0.2 THEN dark * 20 ELSE 0 END), CASE WHEN blur > 0.5 OR largest < 0.5 THEN 40.0 ELSE 1000.0 END), 6) AS score FROM t""")
def v1(spark, d):
    return rounded(rules.readiness(_ratios(spark, d)), 6, "score").select("id", "status", F.array_join("blocking", "|").alias("blocking"), F.array_join("warnings", "|").alias("warnings"), "score")


@query("v2_readiness_extracted", f"""{_RATIOS}{_TEXTS} SELECT id, CASE WHEN blur > 0.5 OR largest < 0.5 OR dark > 0.7 THEN 'NOT_READY' WHEN (blur > 0.1 AND blur <= 0.5) OR isolated > 0.2 THEN 'WARNING' ELSE 'READY' END AS status,
  concat_ws('|', nullif(blocking, ''), CASE WHEN dark > 0.7 THEN printf('Too dark (%.1f%% frames dark).', dark * 100) END) AS blocking, concat_ws('|', moderate, CASE WHEN isolated > 0.2 THEN printf('Many isolated frames (%.1f%%).', isolated * 100) END) AS warnings,
  round(greatest(0.0, least(100.0, 100 - blur * 30 - (1 - largest) * 40 - dark * 20 - isolated * 20)), 6) AS score FROM t""")
def v2(spark, d):
    return rounded(rules.readiness(_ratios(spark, d), "extracted"), 6, "score").select("id", "status", F.array_join("blocking", "|").alias("blocking"), F.array_join("warnings", "|").alias("warnings"), "score")


@query("v3_recommendations", f"""{_RATIOS} SELECT id, concat_ws('|', CASE WHEN blur > 0.1 THEN 'Use faster shutter speed or slower UAV motion.' END, CASE WHEN inliers < 50 OR largest < 0.5 THEN 'Reduce frame sampling interval or capture with more continuous scene overlap.' END) AS said FROM r""")
def v3(spark, d):
    r = rules.readiness(_ratios(spark, d))
    return r.select("id", F.array_join(rules.recommendations(F.col("blocking"), F.col("warnings")), "|").alias("said"))


_CHECKS = ", k AS (SELECT p_partkey AS id, p_brand AS mission, CASE WHEN p_partkey % 3 = 0 THEN 'CONTROL' ELSE 'CHECKPOINT' END AS role, (p_size - 25) / 50 AS dx, (p_retailprice % 10 - 5) / 10 AS dy, (p_partkey % 11 - 5) / 20 AS dz, p_partkey % 97 = 0 AS mismatch FROM part), v AS (SELECT *, sqrt(dx ** 2 + dy ** 2) AS h, sqrt(dx ** 2 + dy ** 2 + dz ** 2) AS e FROM k WHERE role = 'CHECKPOINT')"


def _checks(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("id"), F.col("p_brand").alias("mission"), F.when(k % 3 == 0, "CONTROL").otherwise("CHECKPOINT").alias("role"), *(F.lit(0.0).alias(f"local_{c}") for c in "xyz"), ((F.col("p_size") - 25) / 50).alias("recon_x"), ((F.col("p_retailprice") % 10 - 5) / 10).alias("recon_y"), ((k % 11 - 5) / 20).alias("recon_z"), (k % 97 == 0).alias("vertical_datum_mismatch"))
    return rules.residuals(p)


@query("p4_checkpoint_residuals", f"""{_CHECKS} SELECT id, round(dx, 8) AS dx, round(h, 8) AS horizontal_error, round(e, 8) AS error_3d FROM v""")
def p4(spark, d):
    return rounded(_checks(spark, d), 8, "dx", "horizontal_error", "error_3d").select("id", "dx", "horizontal_error", "error_3d")


_RMSE = """, m AS (SELECT mission, count(*) AS n, round(sqrt(avg(dx ** 2)), 7) AS rmse_x, round(sqrt(avg(dy ** 2)), 7) AS rmse_y, CASE WHEN NOT bool_or(mismatch) THEN round(sqrt(avg(dz ** 2)), 7) END AS rmse_z, round(sqrt(avg(h ** 2)), 7) AS rmse_h, CASE WHEN NOT bool_or(mismatch) THEN round(sqrt(avg(e ** 2)), 7) END AS rmse_3d, round(avg(e), 7) AS mean_3d, round(list_sort(list(e))[count(*) // 2 + 1], 7) AS median_3d, round(max(e), 7) AS max_3d, NOT bool_or(mismatch) AS z_validated FROM v GROUP BY mission)"""
_R = ("rmse_x", "rmse_y", "rmse_z", "rmse_h", "rmse_3d", "mean_3d", "median_3d", "max_3d")


@query("a6_checkpoint_rmse", f"""{_CHECKS}{_RMSE} SELECT * FROM m""")
def a6(spark, d):
    return rounded(rules.rmse(_checks(spark, d), ["mission"]), 7, *_R)


@query("v5_validation_decision", f"""{_CHECKS}{_RMSE} SELECT mission, CASE WHEN n < 60 THEN 'NOT_ENOUGH_CHECKPOINTS' WHEN rmse_3d IS NULL THEN 'FAILED' WHEN rmse_3d <= 0.44 THEN 'PASSED' ELSE 'FAILED' END AS decision FROM m""")
def v5(spark, d):
    return a6(spark, d).select("mission", rules.decision(F.col("n"), F.col("rmse_3d"), 60, 0.44).alias("decision"))


@query("v4_correspondence_status", f"""{_CHECKS} SELECT id, CASE WHEN id % 5 = 0 THEN 'EXPLICIT' ELSE 'CLOSEST_SURFACE' END AS method, CASE WHEN id % 5 = 0 THEN 'VALID' WHEN e > 0.6 THEN 'OUTSIDE_COVERAGE' WHEN e > 0.3 THEN 'WEAK_CORRESPONDENCE' ELSE 'VALID' END AS status FROM v""")
def v4(spark, d):
    method, status = rules.correspondence(F.col("id") % 5 == 0, F.col("error_3d"), 0.6)
    return _checks(spark, d).select("id", method.alias("method"), status.alias("status"))


@query("v6_validation_methods", f"""{_CHECKS} SELECT mission, string_agg(DISTINCT CASE WHEN id % 5 = 0 THEN 'EXPLICIT' ELSE 'CLOSEST_SURFACE' END, '+' ORDER BY CASE WHEN id % 5 = 0 THEN 'EXPLICIT' ELSE 'CLOSEST_SURFACE' END) AS method FROM v GROUP BY mission""")
def v6(spark, d):
    return v4(spark, d).join(_checks(spark, d).select("id", "mission"), "id").groupBy("mission").agg(F.array_join(F.array_sort(F.collect_set("method")), "+").alias("method"))


@query("a11_reprojection_statistics", """SELECT l_shipmode_, count(*) AS points, round(avg(e), 6) AS mean, round(median(e), 6) AS median, round(quantile_cont(e, 0.95), 6) AS p95, round(sqrt(avg(e * e)), 6) AS rmse FROM (SELECT l_linestatus AS l_shipmode_, l_discount * 10 + l_tax AS e FROM lineitem) GROUP BY 1""")
def a11(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("l_shipmode_"), (F.col("l_discount") * 10 + F.col("l_tax")).alias("e"))
    return rounded(clouds.error_statistics(rows, "e", ["l_shipmode_"]), 6, "mean", "median", "p95", "rmse").select("l_shipmode_", F.col("count").alias("points"), "mean", "median", "p95", "rmse")


@query("a12_alignment_statistics", """SELECT count(*) AS total, count(*) FILTER (l_discount <= 0.05) AS used, count(*) FILTER (l_discount > 0.05) AS rejected, round(sqrt(avg(l_tax ** 2) FILTER (l_discount <= 0.05)), 8) AS rmse, round(median(l_tax) FILTER (l_discount <= 0.05), 8) AS median, round(max(l_tax) FILTER (l_discount <= 0.05), 8) AS max FROM lineitem""")
def a12(spark, d):
    from ..operators.transform import summary

    rows = table(spark, d, "lineitem").select((F.col("l_discount") <= 0.05).alias("inlier"), F.col("l_tax").alias("residual"))
    return rounded(summary(rows), 8, "rmse", "median", "max")


@query("a24_binary_metrics", """, p AS (SELECT quality = 1 AS t, toxic = 0 AS g FROM labels), c AS (SELECT count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn FROM p)
SELECT tp, fp, fn, round(tp / (tp + fp), 8) AS "precision", round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, round(tp / (tp + fp + fn), 8) AS iou FROM c""")
def a24(spark, d):
    t, g = F.col("quality") == 1, F.col("toxic") == 0
    c = table(spark, d, "labels").agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns({"precision": F.round(F.try_divide(tp, tp + fp), 8), "recall": F.round(F.try_divide(tp, tp + fn), 8), "f1": F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 8), "iou": F.round(F.try_divide(tp, tp + fp + fn), 8)})


@query("a26_config_histogram", """SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority""")
def a26(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("a29_map_bounds", """SELECT min(c_acctbal) AS south, max(c_acctbal) AS north, min(c_custkey) AS west, max(c_custkey) AS east FROM customer""")
def a29(spark, d):
    return table(spark, d, "customer").agg(F.min("c_acctbal").alias("south"), F.max("c_acctbal").alias("north"), F.min("c_custkey").alias("west"), F.max("c_custkey").alias("east"))


@query("u1_concatenate", """SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier""")
def u1(spark, d):
    return table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@query("u2_set_overlap", """, a AS (SELECT l_suppkey AS k, list(DISTINCT l_partkey) AS s FROM lineitem GROUP BY 1) SELECT x.k AS a, y.k AS b, CAST(len(list_intersect(x.s, y.s)) AS BIGINT) AS n FROM a x JOIN a y ON y.k = x.k + 1""")
def u2(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set("l_partkey").alias("s"))
    b = a.select((F.col("k") - 1).alias("k"), F.col("k").alias("b"), F.col("s").alias("t"))
    return a.join(b, "k").select(F.col("k").alias("a"), "b", F.size(F.array_intersect("s", "t")).cast("long").alias("n"))


@query("u3_missing_columns", """SELECT p_partkey, CAST((p_size % 2 = 0)::INT + (p_size % 3 = 0)::INT AS BIGINT) AS missing FROM part""")
def u3(spark, d):
    have = rules.texts((F.col("p_size") % 2 != 0, F.lit("lat")), (F.col("p_size") % 3 != 0, F.lit("lon")))
    return table(spark, d, "part").select("p_partkey", F.size(rules.missing_columns(have, ["lat", "lon"])).cast("long").alias("missing"))


@query("u5_mask_union", """SELECT l_partkey, bool_or(l_returnflag = 'R') AS masked FROM lineitem GROUP BY l_partkey""")
def u5(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("masked"))


@query("p1_job_projection", """ SELECT id, project_id, status, round(updated - created, 3) AS age FROM jobs_ """)
def p1(spark, d):
    return jobs(spark, d).select("id", "project_id", "status", F.round(F.col("updated") - F.col("created"), 3).alias("age"))


@query("p11_status_predicates", """ SELECT j.id FROM jobs_ j JOIN projects_ p ON p.id = project_id WHERE archived_at IS NULL AND status IN ('running', 'failed')""")
def p11(spark, d):
    p = projects(spark, d).where("archived_at IS NULL").select(F.col("id").alias("pid"))
    return jobs(spark, d).where("status IN ('running', 'failed')").join(p, F.col("project_id") == F.col("pid"), "left_semi").select("id")


@query("p12_identifier_guard", """SELECT page_id, regexp_full_match(split_part(url, '/', 3), '[a-zA-Z0-9_-]{1,64}') AS host_safe, regexp_full_match(split_part(url, '/', 4), '[a-zA-Z0-9_-]{1,64}') AS part_safe FROM pages""")
def p12(spark, d):
    part = lambda k: L.safe_id(F.split_part(F.col("url"), F.lit("/"), F.lit(k)))
    return table(spark, d, "pages").select("page_id", part(3).alias("host_safe"), part(4).alias("part_safe"))


@query("f23_content_hash", """SELECT doc_id, sha256(text) AS sha FROM documents""")
def f23(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha"))


@query("f24_string_cleaning", """SELECT p_partkey, upper(trim(p_brand)) AS brand, replace(p_name, 'Z', '+00:00') AS name FROM part""")
def f24(spark, d):
    return table(spark, d, "part").select("p_partkey", F.upper(F.trim("p_brand")).alias("brand"), F.replace(F.col("p_name"), F.lit("Z"), F.lit("+00:00")).alias("name"))


@query("f34_profiles", """SELECT p_size * 60 AS frames, CASE WHEN p_size * 60 < 200 THEN 'SMALL' WHEN p_size * 60 < 800 THEN 'MEDIUM' WHEN p_size * 60 < 2000 THEN 'LARGE' ELSE 'VERY_LARGE' END AS sfm, CASE WHEN p_size * 60 < 50 THEN 'QUALITY' WHEN p_size * 60 <= 200 THEN 'BALANCED' ELSE 'FAST' END AS dense, count(*) AS n FROM part GROUP BY ALL""")
def f34(spark, d):
    n = F.col("p_size") * 60
    return table(spark, d, "part").groupBy(n.alias("frames"), L.sfm_profile(n).alias("sfm"), L.dense_profile(n).alias("dense")).agg(F.count("*").alias("n"))


@query("f35_disk_estimate", """SELECT p_partkey, 3 * p_partkey * 1000 + p_size * 12582912::BIGINT + 2147483648 AS bytes FROM part""")
def f35(spark, d):
    return table(spark, d, "part").select("p_partkey", L.disk_estimate(F.col("p_partkey") * 1000, F.col("p_size").cast("long")).alias("bytes"))


@query("f36_support_status", """SELECT p_partkey, CASE WHEN p_partkey * 60 > 100000 THEN 'GOOD' WHEN p_partkey * 60 > 50 * p_size THEN 'MARGINAL' ELSE 'INSUFFICIENT' END AS status FROM part""")
def f36(spark, d):
    return table(spark, d, "part").select("p_partkey", L.support_status(F.col("p_partkey") * 60, F.col("p_size")).alias("status"))


@query("f12_errors_and_f13_datum", """SELECT l_orderkey, l_linenumber, round(sqrt(l_discount ** 2 + l_tax ** 2), 8) AS horizontal, CASE WHEN l_returnflag <> 'N' AND l_linestatus <> 'N' AND l_returnflag <> l_linestatus THEN true ELSE false END AS mismatch FROM lineitem""")
def f12(spark, d):
    known = lambda c: F.when(F.col(c) == "N", "UNKNOWN").otherwise(F.col(c))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sqrt(F.col("l_discount") ** 2 + F.col("l_tax") ** 2), 8).alias("horizontal"), rules.datum_mismatch(known("l_returnflag"), known("l_linestatus")).alias("mismatch"))


@query("f15_reprojection_error", """SELECT l_orderkey, l_linenumber, round(sqrt((800 * l_discount / (1 + l_tax) - 30) ** 2 + (800 * l_tax / (1 + l_tax) - 20) ** 2), 6) AS error FROM lineitem""")
def f15(spark, d):
    z = 1 + F.col("l_tax")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sqrt((800 * F.col("l_discount") / z - 30) ** 2 + (800 * F.col("l_tax") / z - 20) ** 2), 6).alias("error"))


@query("f17_camera_scale", """SELECT p_partkey, round(p_retailprice * 960 / 1920, 6) AS fx, round(p_size * 540 / 1080.0, 6) AS cy FROM part""")
def f17(spark, d):
    n = lambda v: F.lit(float(v))
    fx, _, _, cy = Q.scaled_camera(F.col("p_retailprice"), F.col("p_retailprice"), n(960), F.col("p_size"), n(1920), n(1080), n(960), n(540))
    return table(spark, d, "part").select("p_partkey", F.round(fx, 6).alias("fx"), F.round(cy, 6).alias("cy"))


@query("f31_measurements", """SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity ** 2 + l_tax ** 2), 6) AS horizontal, round(degrees(atan2(l_discount, l_quantity)), 6) AS slope FROM lineitem""")
def f31(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sqrt(F.col("l_quantity") ** 2 + F.col("l_tax") ** 2), 6).alias("horizontal"), F.round(Q.slope_degrees(F.col("l_quantity"), F.col("l_discount")), 6).alias("slope"))


@query("f37_photometric_gain", """, m AS (SELECT avg(p_retailprice) AS g FROM part) SELECT p_brand, round(greatest(0.5, least(2.0, any_value(g) / avg(p_retailprice))), 6) AS gain FROM part, m GROUP BY p_brand""")
def f37(spark, d):
    p = table(spark, d, "part")
    g = p.agg(F.avg("p_retailprice").alias("g"))
    means = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m")).crossJoin(F.broadcast(g))
    return means.select("p_brand", F.round(F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("g") / F.col("m"))), 6).alias("gain"))


@query("p15_exposure_flags", """, h AS (SELECT l_suppkey AS img, l_quantity * 5 AS v FROM lineitem), s AS (SELECT img, avg((v <= 5)::INT) AS shadow, avg((v >= 250)::INT) AS highlight, median(v) AS median FROM h GROUP BY img)
SELECT img, round(shadow, 8) AS shadow, round(highlight, 8) AS highlight, median, shadow > 0.4 OR median < 30 AS is_dark, highlight > 0.4 OR median > 225 AS is_overexposed FROM s""")
def p15(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("img"), (F.col("l_quantity") * 5).alias("level")).agg(F.count("*").alias("n"))
    return rounded(rules.exposure(h, ["img"]), 8, "shadow", "highlight")


@query("v9_orientation_fusion", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BLOCKED_FRAME_UNKNOWN' WHEN c_nationkey % 2 = 0 THEN 'BLOCKED_EXTRINSIC_MISSING' ELSE 'AVAILABLE' END AS status FROM customer""")
def v9(spark, d):
    return table(spark, d, "customer").select("c_custkey", rules.orientation_fusion(F.when(F.col("c_mktsegment") == "BUILDING", "UNKNOWN").otherwise("FRD"), F.when(F.col("c_nationkey") % 2 != 0, "GIVEN")).alias("status"))


@query("v10_schema_status", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'INVALID' WHEN p_size % 3 = 0 THEN 'VALID_WITH_WARNINGS' ELSE 'VALID' END AS status FROM part""")
def v10(spark, d):
    errors, warnings = rules.texts((F.col("p_size") % 2 == 0, F.lit("time decreases"))), rules.texts((F.col("p_size") % 3 == 0, F.lit("no barometer")))
    return table(spark, d, "part").select("p_partkey", rules.schema_status(errors, warnings).alias("status"))


@query("v11_fps_consistency", """SELECT p_partkey, abs(p_size - 30) <= greatest(0.1, 30 * 0.02) AND abs(p_retailprice / 100 - 10) <= greatest(1.0, 10 * 0.02) AS consistent FROM part""")
def v11(spark, d):
    return table(spark, d, "part").select("p_partkey", rules.fps_consistent(F.col("p_size"), F.lit(30.0), F.col("p_retailprice") / 100, F.lit(10.0)).alias("consistent"))


@query("v12_frame_time_consistency", """SELECT l_orderkey, l_linenumber, abs(l_quantity / 10 - 1 - l_linenumber / 3.0) <= greatest(0.25, 2 / 3.0) AS consistent FROM lineitem""")
def v12(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.frame_time_consistent(F.col("l_quantity") / 10, F.lit(1.0), F.col("l_linenumber"), F.lit(3.0)).alias("consistent"))


@query("v14_alignment_source", """SELECT p_partkey, CASE WHEN p_size % 6 >= 4 THEN 'CONTROL' WHEN p_size % 3 > 0 THEN 'RTK' WHEN p_size % 2 > 0 THEN 'GNSS' ELSE 'NONE' END AS source FROM part""")
def v14(spark, d):
    from ..operators.transform import alignment_source

    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", alignment_source(s % 6, s % 3, s % 2).alias("source"))


@query("v15_export_status", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'MISSING' WHEN p_size % 7 = 0 THEN 'FAILED' WHEN p_size % 2 = 0 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS status FROM part""")
def v15(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", rules.export_status(s % 5 != 0, s % 7, F.when(s % 2 == 0, "UNVERIFIED")).alias("status"))


@query("v16_representation_text", """ SELECT status, CASE WHEN status = 'completed' THEN 'VERIFIED' ELSE 'NOT VERIFIED' END AS verification, count(*) AS n FROM jobs_ GROUP BY ALL""")
def v16(spark, d):
    return jobs(spark, d).groupBy("status", F.when(F.col("status") == "completed", "VERIFIED").otherwise("NOT VERIFIED").alias("verification")).agg(F.count("*").alias("n"))


@query("v17_upload_errors", """SELECT p_partkey, CAST((p_size % 3 = 0)::INT + (p_size * 40 NOT BETWEEN 3 AND 1500)::INT + (p_size % 5 = 0)::INT AS BIGINT) AS n FROM part""")
def v17(spark, d):
    s = F.col("p_size")
    e = rules.upload_errors(F.when(s % 3 == 0, "gpu").otherwise("cpu"), s * 40, F.col("p_name"), F.when(s % 5 == 0, ".txt").otherwise(".MP4"))
    return table(spark, d, "part").select("p_partkey", F.size(e).cast("long").alias("n"))


@query("s15_mission_age", """SELECT o_orderstatus, min(epoch(o_orderdate)) AS first, max(epoch(o_orderdate)) AS last FROM orders GROUP BY 1""")
def s15(spark, d):
    t = epoch(F.col("o_orderdate"))
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.min(t).alias("first"), F.max(t).alias("last"))


@query("s19_sql_scan", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000""")
def s19(spark, d):
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 100000", orders=table(spark, d, "orders"))


_CHANGES = "c AS (SELECT o_custkey AS id, o_orderkey AS seq, epoch(o_orderdate) AS made, CASE WHEN o_orderkey % 50 = 0 THEN 'delete' WHEN o_orderkey % 3 = 0 THEN 'archive' WHEN o_orderkey % 3 = 1 THEN 'restore' ELSE 'update' END AS op, CASE WHEN o_orderkey % 5 > 0 THEN ' survey ' || o_orderkey ELSE '  ' END AS name FROM orders)"


@query("t8_catalogue_changes", f""", {_CHANGES}, l AS (SELECT id, last(trim(name) ORDER BY made, seq) FILTER (op = 'update' AND trim(name) <> '') AS name, last(CASE WHEN op = 'archive' THEN made END ORDER BY made, seq) FILTER (op IN ('archive', 'restore')) AS archived, bool_or(op IN ('archive', 'restore')) AS moved, max(made) FILTER (op IN ('archive', 'restore') OR op = 'update' AND trim(name) <> '') AS changed, bool_or(op = 'delete') AS gone FROM c GROUP BY id)
SELECT p.id, coalesce(l.name, p.name) AS name, CASE WHEN moved THEN archived ELSE archived_at END AS archived_at, changed AS updated_at FROM projects_ p LEFT JOIN l ON l.id = p.id WHERE NOT coalesce(gone, false)""")
def t8(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    op = F.when(k % 50 == 0, "delete").when(k % 3 == 0, "archive").when(k % 3 == 1, "restore").otherwise("update")
    changes = o.select(F.col("o_custkey").alias("id"), k.alias("seq"), epoch(F.col("o_orderdate")).alias("at"), op.alias("op"), F.when(k % 5 > 0, F.concat(F.lit(" survey "), k)).otherwise("  ").alias("name"))
    return missions.apply_changes(projects(spark, d).withColumn("updated_at", F.lit(None).cast("double")), changes)


@query("f27_mask_classes", """ SELECT id, CASE WHEN r = 30 THEN 2 WHEN r = 60 AND g < 128 THEN 3 END AS class, NOT (r = 30 OR r = 60 AND g < 128) AS unknown FROM (SELECT l_orderkey * 8 + l_linenumber AS id, l_linenumber * 30 AS r, l_partkey % 256 AS g FROM lineitem)""")
def f27(spark, d):
    r, g = F.col("l_linenumber") * 30, F.col("l_partkey") % 256
    c = L.class_of(r, F.when(r == 30, 0).otherwise(F.when(g < 128, 0).otherwise(g)), F.lit(0), {(30, 0, 0): 2, (60, 0, 0): 3})
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), c.alias("class"), c.isNull().alias("unknown"))
