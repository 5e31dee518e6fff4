"""Sensor streams: the ``events`` table, one stream for each event type."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import motion as M
from ..operators import asof, streams
from .binding import ev, query, rounded

_ASOF = """
s AS (SELECT user_id, t, v FROM ev_ WHERE stream = 'click'), p AS (SELECT seq, user_id, t FROM ev_ WHERE stream = 'view'),
a AS (SELECT p.*, s.t AS t1, s.v AS v1 FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.t >= s.t),
b AS (SELECT a.*, s.t AS t2, s.v AS v2 FROM a ASOF LEFT JOIN s ON a.user_id = s.user_id AND a.t <= s.t)
"""


def _brackets(spark, d, width=86400.0 * 4):
    e = ev(spark, d)
    return asof.bracket(e.where("stream = 'view'").select("seq", "user_id", "t"), e.where("stream = 'click'").select("user_id", "seq", "t", "v"), ["user_id"], "t", ["v"], width, ["seq"])


@query("j1_asof_interpolate", f""", {_ASOF}
SELECT seq, user_id, CASE WHEN t1 IS NULL AND t2 IS NULL THEN 'MISSING_STREAM' WHEN t1 IS NULL OR t2 IS NULL THEN 'OUTSIDE_SENSOR_RANGE' WHEN t1 = t OR t2 = t THEN 'EXACT' WHEN t2 - t1 > 86400.0 THEN 'GAP_TOO_LARGE' ELSE 'INTERPOLATED' END AS status,
  round(CASE WHEN t1 < t AND t2 > t THEN least(t - t1, t2 - t) ELSE 0.0 END, 3) AS dt_s,
  round(CASE WHEN t1 = t THEN v1 WHEN t2 = t THEN v2 WHEN t2 - t1 <= 86400.0 THEN v1 + (v2 - v1) * ((t - t1) / (t2 - t1)) END, 6) AS value FROM b""")
def j1(spark, d):
    out = asof.interpolate(_brackets(spark, d), "t", "v", 86400.0)
    return rounded(out, 6, "value").select("seq", "user_id", "status", F.round("dt_s", 3).alias("dt_s"), "value")


@query("j2_stream_synchronisation", """,
p AS (SELECT seq, t FROM ev_ WHERE stream = 'purchase'), n AS (SELECT * FROM (VALUES ('click', 600.0), ('error', 1200.0), ('signup', 3600.0)) AS g(stream, gap)),
q AS (SELECT p.*, n.stream, n.gap FROM p, n),
a AS (SELECT q.*, s.t AS t1, s.v AS v1 FROM q ASOF LEFT JOIN ev_ s ON q.stream = s.stream AND q.t >= s.t),
b AS (SELECT a.*, s.t AS t2, s.v AS v2 FROM a ASOF LEFT JOIN ev_ s ON a.stream = s.stream AND a.t <= s.t),
c AS (SELECT seq, stream, CASE WHEN t1 IS NULL AND t2 IS NULL THEN 'MISSING_STREAM' WHEN t1 IS NULL OR t2 IS NULL THEN 'OUTSIDE_SENSOR_RANGE' WHEN t1 = t OR t2 = t THEN 'EXACT' WHEN t2 - t1 > gap THEN 'GAP_TOO_LARGE' ELSE 'INTERPOLATED' END AS status,
  CASE WHEN t1 = t THEN v1 WHEN t2 = t THEN v2 WHEN t2 - t1 <= gap THEN v1 + (v2 - v1) * ((t - t1) / (t2 - t1)) END AS value FROM b)
SELECT seq, max(status) FILTER (stream = 'click') AS click_status, round(max(value) FILTER (stream = 'click'), 6) AS click, max(status) FILTER (stream = 'error') AS error_status, round(max(value) FILTER (stream = 'error'), 6) AS error,
  max(status) FILTER (stream = 'signup') AS signup_status, round(max(value) FILTER (stream = 'signup'), 6) AS signup FROM c GROUP BY seq""")
def j2(spark, d):
    e = ev(spark, d)
    gaps = {"click": 600.0, "error": 1200.0, "signup": 3600.0}
    probes = e.where("stream = 'purchase'").select("seq", "t", F.explode(F.array(*(F.lit(s) for s in gaps))).alias("stream"))
    b = asof.bracket(probes, e.where(F.col("stream").isin(*gaps)).select("stream", "seq", "t", "v"), ["stream"], "t", ["v"], 86400.0, ["seq"])
    out = None
    for s, g in gaps.items():
        part = asof.interpolate(b.where(F.col("stream") == s), "t", "v", g)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("seq").agg(*(x for s in gaps for x in (F.max(F.when(F.col("stream") == s, F.col("status"))).alias(f"{s}_status"), F.round(F.max(F.when(F.col("stream") == s, F.col("value"))), 6).alias(s))))


@query("j3_clamped_interpolation", f""", {_ASOF}
SELECT seq, round(CASE WHEN t1 IS NULL THEN v2 WHEN t2 IS NULL THEN v1 WHEN t1 = t2 THEN v1 ELSE v1 + (v2 - v1) * ((t - t1) / (t2 - t1)) END, 6) AS value FROM b""")
def j3(spark, d):
    return asof.clamped(_brackets(spark, d), "t", "v").select("seq", F.round("value", 6).alias("value"))


@query("j4_nearest_time", f""", {_ASOF}
SELECT seq, CASE WHEN t1 IS NULL OR t2 - t < t - t1 THEN v2 ELSE v1 END AS value, round(CASE WHEN t1 IS NULL OR t2 - t < t - t1 THEN t2 - t ELSE t - t1 END, 3) AS error_s FROM b""")
def j4(spark, d):
    return asof.nearest(_brackets(spark, d), "t", "v").select("seq", "value", F.round("error_s", 3).alias("error_s"))


@query("j5_first_within_tolerance", """,
m AS (SELECT a.seq, b.seq AS m_seq, row_number() OVER (PARTITION BY a.seq ORDER BY b.seq) AS k FROM ev_ a JOIN ev_ b ON abs(a.t - b.t) < 300.0 WHERE a.stream = 'error' AND b.stream = 'signup')
SELECT seq, m_seq FROM m WHERE k = 1""")
def j5(spark, d):
    e = ev(spark, d).withColumn("ordinal", F.col("seq"))
    return asof.first_within(e.where("stream = 'error'").select("seq", "t"), e.where("stream = 'signup'"), [], "t", "ordinal", 300.0, ["seq"]).select("seq", "m_seq")


_COARSE = ", c AS (SELECT stream, user_id * 100000 + seq AS seq, floor(t / 3600) * 3600 AS t, v FROM ev_)"


def _coarse(spark, d):
    return ev(spark, d).select("stream", (F.col("user_id") * 100000 + F.col("seq")).alias("seq"), (F.floor(F.col("t") / 3600) * 3600.0).alias("t"), "v")


@query("a1_stream_statistics", f"""{_COARSE},
w AS (SELECT *, t - lag(t) OVER (PARTITION BY stream ORDER BY seq) AS raw, t - lag(t) OVER (PARTITION BY stream ORDER BY t, seq) AS gap FROM c)
SELECT stream, count(*) - count(*) FILTER (gap = 0) AS sample_count, min(t) AS start_time, max(t) AS end_time, max(t) - min(t) AS duration, count(*) FILTER (gap = 0) AS duplicate_count, count(*) FILTER (raw < 0) AS backward_count,
  coalesce(max(gap), 0.0) AS largest_gap_s, count(*) FILTER (raw < 0) = 0 AS source_was_monotonic, count(*) FILTER (raw < 0) > 0 AS rows_reordered FROM w GROUP BY stream""")
def a1(spark, d):
    return streams.statistics(_coarse(spark, d), ["stream"], "t", "seq", time_width=604800.0, seq_width=2e6)


@query("a2_stream_coverage", """,
m AS (SELECT min(t) AS m0, max(t) AS m1 FROM ev_ WHERE stream = 'view'), s AS (SELECT stream, min(t) AS a, max(t) AS b FROM ev_ GROUP BY stream)
SELECT stream, greatest(m0, a) AS overlap_start, least(m1, b) AS overlap_end, round(least(m1, b) - greatest(m0, a), 3) AS overlap_duration, round(greatest(0.0, (least(m1, b) - greatest(m0, a)) / (m1 - m0)), 8) AS coverage_fraction FROM s, m""")
def a2(spark, d):
    e = ev(spark, d)
    mission = e.where("stream = 'view'").agg(F.min("t").alias("m0"), F.max("t").alias("m1"))
    stats = e.groupBy("stream").agg(F.min("t").alias("start_time"), F.max("t").alias("end_time")).crossJoin(F.broadcast(mission))
    return streams.coverage(stats, F.col("m0"), F.col("m1")).select("stream", "overlap_start", "overlap_end", F.round("overlap_duration", 3).alias("overlap_duration"), F.round("coverage_fraction", 8).alias("coverage_fraction"))


for _keep, _order in (("first", "ASC"), ("last", "DESC")):

    @query(f"w3_deduplicate_keep_{_keep}", f"""{_COARSE} SELECT stream, t, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY stream, t ORDER BY seq {_order}) AS k FROM c) WHERE k = 1""")
    def w3(spark, d, keep=_keep):
        return streams.deduplicate(_coarse(spark, d), ["stream"], "t", "seq", keep).select("stream", "t", "seq", "v")


@query("w4_largest_gap", """ SELECT stream, round(max(g), 3) AS largest_gap FROM (SELECT stream, t - lag(t) OVER (PARTITION BY stream ORDER BY t) AS g FROM ev_ ) GROUP BY stream""")
def w4(spark, d):
    near = streams.previous(ev(spark, d), ["stream"], ["t"], ["t"], "p", 604800.0)
    return near.withColumn("g", F.col("t") - F.col("p.t")).groupBy("stream").agg(F.round(F.max("g"), 3).alias("largest_gap"))


@query("w7_order_faults", f"""{_COARSE}, w AS (SELECT *, t - lag(t) OVER (PARTITION BY stream ORDER BY seq) AS dt FROM c)
SELECT stream, count(*) FILTER (dt < 0) AS backward, count(*) FILTER (dt = 0) AS duplicates, coalesce(min(dt) FILTER (dt < 0), 0.0) AS largest_jump_back FROM w GROUP BY stream""")
def w7(spark, d):
    return streams.order_faults(_coarse(spark, d), ["stream"], "seq", "t", width=2e6)


@query("w6_non_decreasing_rows", f"""{_COARSE}, w AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY seq) + 1 AS line, t < lag(t) OVER (PARTITION BY stream ORDER BY seq) AS bad FROM c) SELECT stream, line FROM w WHERE bad""")
def w6(spark, d):
    w = Window.partitionBy("stream").orderBy("seq", "t")  # a place that repeats: by time
    return _coarse(spark, d).select("stream", (F.row_number().over(w) + 1).alias("line"), (F.col("t") < F.lag("t").over(w)).alias("bad")).where("bad").drop("bad")


_TRACK = ", tr AS (SELECT stream, seq, t, 22.9 + v / 1000 AS lat, 72.3 + v / 2000 AS lon FROM ev_ )"


def _track(spark, d):
    return ev(spark, d).select("stream", "seq", "t", (22.9 + F.col("v") / 1000).alias("lat"), (72.3 + F.col("v") / 2000).alias("lon"))


_STEPS = """, st AS (SELECT *, t - lag(t) OVER w AS dt, sqrt(((lat - lag(lat) OVER w) * 111000.0) ** 2 + ((lon - lag(lon) OVER w) * 111000.0 * cos(radians(lag(lat) OVER w))) ** 2) AS step_m FROM tr WINDOW w AS (PARTITION BY stream ORDER BY t))"""


@query("w1_step_speeds", f"""{_TRACK}{_STEPS} SELECT stream, seq, round(dt, 3) AS dt, round(step_m, 4) AS step_m, round(CASE WHEN dt > 0 THEN step_m / dt WHEN dt IS NOT NULL THEN 0.0 END, 4) AS speed FROM st""")
def w1(spark, d):
    return rounded(streams.steps(_track(spark, d), ["stream"], "t", "lat", "lon", 604800.0), 4, "step_m", "speed").select("stream", "seq", F.round("dt", 3).alias("dt"), "step_m", "speed")


@query("a7_track_audit", f"""{_TRACK}{_STEPS}, sp AS (SELECT *, CASE WHEN dt > 0 THEN step_m / dt WHEN dt IS NOT NULL THEN 0.0 END AS speed FROM st)
SELECT stream, count(*) AS "rows", count(*) FILTER (dt > 3000.0) AS gaps, count(*) FILTER (speed > 35.0) AS outliers, count(*) FILTER (speed < 0.2) AS stationary, count(*) FILTER (dt > 3000.0) > 5 OR count(*) FILTER (dt > 3000.0) / count(*) > 0.1 AS blocked FROM sp GROUP BY stream""")
def a7(spark, d):
    return streams.audit(_track(spark, d), ["stream"], "t", "lat", "lon", max_gap=3000.0, width=604800.0)


@query("a34_baseline_statistics", f"""{_TRACK}{_STEPS} SELECT stream, round(min(step_m), 4) AS low, round(avg(step_m), 4) AS mean, round(max(step_m), 4) AS high, count(*) FILTER (step_m > 5) AS over_5, count(*) FILTER (step_m > 20) AS over_20 FROM st GROUP BY stream""")
def a34(spark, d):
    s = F.col("step_m")
    return streams.steps(_track(spark, d), ["stream"], "t", "lat", "lon", 604800.0).groupBy("stream").agg(F.round(F.min(s), 4).alias("low"), F.round(F.avg(s), 4).alias("mean"), F.round(F.max(s), 4).alias("high"), F.count_if(s > 5).alias("over_5"), F.count_if(s > 20).alias("over_20"))


@query("a33_trajectory_consistency", f"""{_TRACK}{_STEPS}, r AS (SELECT stream, abs(step_m - 0.9 * step_m - 0.01 * dt) AS e, t, lat, lon FROM st)
SELECT stream, round(max(e), 4) AS max_diff, round(avg(e), 4) AS mean_diff, round(sqrt((arg_max(lat, t) - arg_min(lat, t)) ** 2 + (arg_max(lon, t) - arg_min(lon, t)) ** 2), 8) AS endpoint FROM r GROUP BY stream""")
def a33(spark, d):
    s = streams.steps(_track(spark, d), ["stream"], "t", "lat", "lon", 604800.0).withColumn("e", F.abs(F.col("step_m") - 0.9 * F.col("step_m") - 0.01 * F.col("dt")))
    span = lambda c: (F.max_by(c, "t") - F.min_by(c, "t")) ** 2
    return s.groupBy("stream").agg(F.round(F.max("e"), 4).alias("max_diff"), F.round(F.avg("e"), 4).alias("mean_diff"), F.round(F.sqrt(span("lat") + span("lon")), 8).alias("endpoint"))


@query("a14_drift_fit", """, r AS (SELECT stream, t - min(t) OVER (PARTITION BY stream) AS x, v - user_id / 10 AS y FROM ev_ ),
f AS (SELECT stream, count(*) AS n, regr_slope(y, x) AS k, regr_intercept(y, x) AS i FROM r GROUP BY stream)
SELECT stream, any_value(n) AS "rows", round(any_value(i), 5) AS bias, round(any_value(k) * 1e6, 4) AS drift_e6, round(stddev_pop(y - i - k * x), 4) AS residual_std FROM r JOIN f USING (stream) GROUP BY stream""")
def a14(spark, d):
    e = ev(spark, d).withColumn("m", F.col("user_id") / 10)
    return streams.drift(e, ["stream"], "t", "v", "m").select("stream", "rows", F.round("bias", 5).alias("bias"), F.round(F.col("drift") * 1e6, 4).alias("drift_e6"), F.round("residual_std", 4).alias("residual_std"))


@query("w14_pressure_altitude", """, r AS (SELECT stream, seq, 900 + v AS p, first_value(900 + v) OVER (PARTITION BY stream ORDER BY seq) AS p0 FROM ev_ )
SELECT stream, seq, round(8.3144598 * 288.15 / (9.80665 * 0.0289644) * ln(p0 / p), 5) AS altitude FROM r""")
def w14(spark, d):
    e = ev(spark, d).withColumn("p", 900 + F.col("v"))
    first = F.first("p", ignorenulls=True).over(Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return e.select("stream", "seq", F.round(M.relative_altitude(F.col("p"), first), 5).alias("altitude"))


@query("a15_altitude_range", """, r AS (SELECT stream, seq, 900 + v AS p, first_value(900 + v) OVER (PARTITION BY stream ORDER BY seq) AS p0 FROM ev_ ), h AS (SELECT stream, 8.3144598 * 288.15 / (9.80665 * 0.0289644) * ln(p0 / p) AS a FROM r)
SELECT stream, round(min(a), 5) AS low, round(max(a), 5) AS high, count(*) AS n FROM h GROUP BY stream""")
def a15(spark, d):
    return w14(spark, d).groupBy("stream").agg(F.min("altitude").alias("low"), F.max("altitude").alias("high"), F.count("*").alias("n"))


_MOTION = """, m AS (SELECT seq, abs(sqrt((v / 10) ** 2 + 0.25 + 81.0) - 9.81) AS off, sqrt((user_id / 60) ** 2 + 0.01 + (v / 100) ** 2) AS spin FROM ev_ ),
q AS (SELECT seq, round_even(CASE WHEN off > 3.0 THEN greatest(0.1, 1 - off / 10) ELSE 1.0 END * CASE WHEN spin > 1.0 THEN greatest(0.1, 1 - spin / 5) ELSE 1.0 END, 3) AS score, off > 3.0 AS high_acceleration, spin > 1.0 AS rapid_rotation, CASE WHEN spin > 2.0 THEN 'HIGH' WHEN spin > 1.0 THEN 'MEDIUM' ELSE 'LOW' END AS blur_risk FROM m)"""


@query("p16_motion_quality", f"""{_MOTION} SELECT seq, score, high_acceleration, rapid_rotation, blur_risk, score < 0.7 OR high_acceleration OR rapid_rotation AS at_risk FROM q""")
def p16(spark, d):
    e = ev(spark, d)
    m = M.motion_quality(F.col("v") / 10, F.lit(0.5), F.lit(9.0), F.col("user_id") / 60, F.lit(0.1), F.col("v") / 100)
    return e.select("seq", *(c.alias(k) for k, c in m.items()))


@query("a16_motion_risk_count", f"""{_MOTION} SELECT count(*) FILTER (score < 0.7 OR high_acceleration OR rapid_rotation) AS at_risk FROM q""")
def a16(spark, d):
    return p16(spark, d).agg(F.count_if("at_risk").alias("at_risk"))


@query("f7_gnss_sigmas", """, q AS (SELECT seq, CASE upper(stream) WHEN 'CLICK' THEN 'RTK_FIXED' WHEN 'ERROR' THEN 'DGPS' ELSE 'other' END AS s, CASE WHEN v > 50 THEN v / 100 ELSE -1 END AS g FROM ev_ ), k AS (SELECT *, CASE s WHEN 'RTK_FIXED' THEN 0.02::DOUBLE WHEN 'DGPS' THEN 0.5::DOUBLE ELSE 5.0::DOUBLE END AS base FROM q)
SELECT seq, CASE WHEN s = 'other' THEN 'UNKNOWN' ELSE s END AS quality, round(CASE WHEN g > 0 THEN greatest(0.001, g) ELSE base END, 6) AS sx, round(CASE WHEN g > 0 THEN greatest(0.001, g) ELSE base * 1.5 END, 6) AS sz, g > 0 AS measured,
  round(least(1e4, greatest(1e-4, 1 / (CASE WHEN g > 0 THEN greatest(0.001, g) ELSE base END ** 2))), 4) AS weight FROM k""")
def f7(spark, d):
    s = F.upper("stream")
    e = ev(spark, d).select("seq", M.gnss_quality(F.when(s == "CLICK", "rtk_fixed").when(s == "ERROR", "DGPS").otherwise("other")).alias("quality"), F.when(F.col("v") > 50, F.col("v") / 100).otherwise(-1.0).alias("g"))
    sx, _, sz, measured = M.sigmas(F.col("quality"), F.col("g"), F.col("g"), F.col("g"))
    return e.select("seq", "quality", F.round(sx, 6).alias("sx"), F.round(sz, 6).alias("sz"), measured.alias("measured"), F.round(M.weight(sx), 4).alias("weight"))


@query("f25_gps_clock", """ SELECT seq, round(315964800 + floor((t - 315964800) / 604800) * 604800 + (t - 315964800) % 604800 - 18, 3) AS epoch FROM ev_ """)
def f25(spark, d):
    week, rest = F.floor((F.col("t") - 315964800) / 604800), (F.col("t") - 315964800) % 604800
    return ev(spark, d).select("seq", F.round(M.gps_week_to_epoch(week, rest), 3).alias("epoch"))


@query("f26_microseconds", """ SELECT seq, coalesce(try_cast(CASE WHEN seq % 7 = 0 THEN 'bad' ELSE CAST(seq * 1000 AS VARCHAR) END AS DOUBLE) / 1e6, 0.0) AS seconds FROM ev_ """)
def f26(spark, d):
    text = F.when(F.col("seq") % 7 == 0, "bad").otherwise((F.col("seq") * 1000).cast("string"))
    return ev(spark, d).select("seq", M.micros_to_seconds(text).alias("seconds"))


@query("j9_full_outer_timestamps", """, a AS (SELECT floor(t / 60) AS m, arg_max(v, seq) AS accel FROM ev_ WHERE stream = 'click' GROUP BY 1), g AS (SELECT floor(t / 60) AS m, arg_max(v, seq) AS gyro FROM ev_ WHERE stream = 'view' GROUP BY 1)
SELECT CAST(coalesce(a.m, g.m) AS BIGINT) AS m, accel, gyro FROM a FULL JOIN g ON a.m = g.m""")
def j9(spark, d):
    e = ev(spark, d).withColumn("m", F.floor(F.col("t") / 60))
    side = lambda s, name: e.where(F.col("stream") == s).groupBy("m").agg(F.max_by("v", "seq").alias(name))
    return side("click", "accel").join(side("view", "gyro"), "m", "full")


@query("a38_rows_in_range", """ SELECT stream, count(*) FILTER (t BETWEEN 1704500000 AND 1705500000) AS n FROM ev_ GROUP BY stream""")
def a38(spark, d):
    return ev(spark, d).groupBy("stream").agg(F.count_if(F.col("t").between(1704500000, 1705500000)).alias("n"))


@query("a37_messages_by_topic", """ SELECT stream, CAST(sum(user_id) AS BIGINT) AS messages FROM ev_ GROUP BY stream""")
def a37(spark, d):
    return ev(spark, d).groupBy("stream").agg(F.sum("user_id").alias("messages"))


@query("t6_stage_times", """ SELECT user_id, seq, round(coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, seq), 0.0), 3) AS elapsed FROM ev_ """)
def t6(spark, d):
    from ..operators.missions import stage_times

    return stage_times(ev(spark, d), "user_id", F.col("t"), "seq").select("user_id", "seq", F.round("elapsed", 3).alias("elapsed"))


@query("t2_current_state", """ SELECT user_id, arg_max(stream, t) AS status FROM ev_ GROUP BY user_id""")
def t2(spark, d):
    from ..operators.missions import current_state

    return current_state(ev(spark, d), "user_id", F.col("t"), "seq", "stream")


@query("o4_stable_order", f"""{_COARSE} SELECT stream, seq, row_number() OVER (PARTITION BY stream ORDER BY t, seq) AS place FROM c""")
def o4(spark, d):
    return _coarse(spark, d).select("stream", "seq", F.row_number().over(Window.partitionBy("stream").orderBy("t", "seq")).alias("place"))


@query("w11_stride_sample", """ SELECT stream, seq FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY t) - 1 AS k FROM ev_ ) WHERE k % 10 = 0""")
def w11(spark, d):
    return streams.every_nth(ev(spark, d), ["stream"], ["t"], 10).select("stream", "seq")


@query("w12_evenly_spaced", """, r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY stream) AS n FROM ev_ )
SELECT stream, seq FROM r WHERE k IN (SELECT CAST(floor(i * r.n / 40) AS BIGINT) FROM range(40) g(i))""")
def w12(spark, d):
    return streams.evenly_spaced(ev(spark, d), ["stream"], ["t"], 40).select("stream", "seq")


@query("w13_skip_pairs", """ SELECT * FROM (SELECT stream, seq AS a, lead(seq, 2) OVER (PARTITION BY stream ORDER BY t) AS b FROM ev_ ) WHERE b IS NOT NULL""")
def w13(spark, d):
    return streams.skip_pairs(ev(spark, d), ["stream"], "t", "seq")


@query("f33_json_fields", """SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.name'), 'none') AS name FROM events""")
def f33(spark, d):
    from ..storage import table

    p = F.col("props")
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object(p, "$.k").cast("long"), F.lit(0)).alias("k"), F.coalesce(F.get_json_object(p, "$.name"), F.lit("none")).alias("name"))


@query("f3_slerp", """, q AS (SELECT seq, (seq % 11) / 10.0::DOUBLE AS f, v / 200 AS h FROM ev_ ), a AS (SELECT *, cos(h) AS c FROM q), b AS (SELECT *, acos(least(1.0, abs(c))) AS th, CASE WHEN c < 0 THEN -1.0 ELSE 1.0 END AS sg FROM a),
w AS (SELECT seq, CASE WHEN abs(c) > 0.9995 THEN 1 - f ELSE sin((1 - f) * th) / sin(th) END AS wa, CASE WHEN abs(c) > 0.9995 THEN f ELSE sin(f * th) / sin(th) END * sg AS wb, c, sin(h) AS s FROM b),
r AS (SELECT seq, wa + wb * c AS w, wb * s AS x FROM w) SELECT seq, round(w / sqrt(w * w + x * x), 6) AS w, round(x / sqrt(w * w + x * x), 6) AS x FROM r""")
def f3(spark, d):
    h, zero = F.col("v") / 200, F.lit(0.0)
    w, x, _, _ = M.slerp((F.lit(1.0), zero, zero, zero), (F.cos(h), F.sin(h), zero, zero), (F.col("seq") % 11) / 10)
    return ev(spark, d).select("seq", F.round(w, 6).alias("w"), F.round(x, 6).alias("x"))
