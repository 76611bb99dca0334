"""Queries over frames: scalar functions, sequences, windows and alignment. Each entry is (query, DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facewave.functions import facial as f
from facewave.operators import alignment, segments, sequence, spectral
from facewave.plans.tables import FRAMES, at, frames, points, table, windows
from facewave.sources import tables as sources

ENTRIES: dict = {}


def entry(name: str, sql: str | None = None):
    def keep(query):
        ENTRIES[name] = (query, sql)
        return query

    return keep


def r(c, n: int = 6):
    return F.round(c, n)


def _dist(a: int, b: int) -> str:
    return f"sqrt(power({at(a, 'x')} - {at(b, 'x')}, 2) + power({at(a, 'y')} - {at(b, 'y')}, 2))"


def _ratio(lids: list[tuple[int, int]], corners: tuple[int, int]) -> str:
    return f"CASE WHEN {_dist(*corners)} > 1e-6 THEN ({' + '.join(_dist(*p) for p in lids)}) / ({len(lids)} * {_dist(*corners)}) ELSE 0 END"


LEFT, RIGHT, LIPS = (0, 1, 2, 3, 4, 5), (6, 7, 8, 9, 10, 11), [(12, 13), (14, 15), (16, 17)]
_eye = lambda e: _ratio([(e[1], e[5]), (e[2], e[4])], (e[0], e[3]))


@entry("p1_eye_aspect_ratio", f"SELECT vec_id, round({_eye(LEFT)}, 6) AS ear_left, round({_eye(RIGHT)}, 6) AS ear_right, round(({_eye(LEFT)} + {_eye(RIGHT)}) / 2, 6) AS ear_avg FROM embeddings")
def p1(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d).withColumn("p", points())
    a, b = f.eye_aspect_ratio(F.col("p"), LEFT), f.eye_aspect_ratio(F.col("p"), RIGHT)
    return w.select("vec_id", r(a).alias("ear_left"), r(b).alias("ear_right"), r((a + b) / 2).alias("ear_avg"))


@entry("p2_mouth_aspect_ratio", f"SELECT vec_id, round({_ratio(LIPS, (18, 19))}, 6) AS mar FROM embeddings")
def p2(spark, d):
    return windows(spark, d).select("vec_id", r(f.mouth_aspect_ratio(points(), LIPS, (18, 19))).alias("mar"))


PAIRS = [(21, 22), (23, 24), (25, 26)]


@entry("p3_symmetry", f"SELECT vec_id, round(({' + '.join(f'(1 - abs({_dist(a, 20)} - {_dist(b, 20)}) / ({_dist(a, 20)} + {_dist(b, 20)}))' for a, b in PAIRS)}) / 3, 6) AS symmetry FROM embeddings")
def p3(spark, d):
    return windows(spark, d).select("vec_id", r(f.symmetry(points(), 20, PAIRS)).alias("symmetry"))


_mean = {c: f"(({' + '.join(at(i, c) for i in range(32))}) / 32)" for c in "xy"}


@entry("p4_normalised_landmarks", f"SELECT vec_id, round(({at(5, 'x')} - {_mean['x']}) / {_dist(0, 3)}, 6) AS x5, round(({at(7, 'y')} - {_mean['y']}) / {_dist(0, 3)}, 6) AS y7 FROM embeddings")
def p4(spark, d):
    n = windows(spark, d).withColumn("n", f.normalised(points(), (0, 3)))
    return n.select("vec_id", r(F.get("n", 5)["x"]).alias("x5"), r(F.get("n", 7)["y"]).alias("y7"))


# 32 landmarks stand for the whole face: pairs, nose and eye corners among them
_pairs = {"inter_eye": (0, 3), "mouth_width": (6, 9), "mouth_open": (10, 11), "left_eye_open": (1, 2), "right_eye_open": (4, 5), "brow_distance": (12, 15), "jaw_open": (20, 10), "nose_mouth": (8, 10)}
_scale = f"nullif(sqrt(power({at(0, 'x')} - {at(3, 'x')}, 2) + power({at(0, 'y')} - {at(3, 'y')}, 2)), 0)"
_middle = lambda axis: f"(list_sum(list_transform(range({1 + (axis == 'y')}, 65, 2), lambda i: CAST(embedding[i] AS DOUBLE))) / 32)"


_geometry = {n: f"{_dist(a, b)} / {_scale}" for n, (a, b) in _pairs.items()} | {
    "yaw_hint": f"({at(8, 'x')} - {_middle('x')}) / {_scale}", "pitch_hint": f"({at(8, 'y')} - {_middle('y')}) / {_scale}",
    "roll_hint": f"atan2({at(3, 'y')} - {at(0, 'y')}, {at(3, 'x')} - {at(0, 'x')})",
}


@entry("p5_geometry", f"SELECT vec_id, {', '.join(f'round({e}, 6) AS {n}' for n, e in _geometry.items())} FROM embeddings")
def p5(spark, d):
    g = windows(spark, d).select("vec_id", f.shape(points(), _pairs, 8, (0, 3)).alias("g"))
    return g.select("vec_id", *[r(F.col("g")[n]).alias(n) for n in _geometry])


NAMES = ["browUp", "browDown", "jawOpen", "smileL", "smileR", "blinkL", "blinkR"]
_scores = lambda: F.map_from_arrays(F.array(*map(F.lit, NAMES)), F.slice("x", 1, 7))


@entry("p6_action_units", f"SELECT vec_id, round(({at(3)} + {at(4)}) / 2, 6) AS smile, round(({at(0)} + 0) / 2, 6) AS brow, round({at(2)}, 6) AS jaw FROM embeddings")
def p6(spark, d):
    u = windows(spark, d).withColumn("u", f.action_units(_scores(), {"smile": ["smileL", "smileR"], "brow": ["browUp", "absent"], "jaw": ["jawOpen"]}))
    return u.select("vec_id", r(F.get("u", 0)).alias("smile"), r(F.get("u", 1)).alias("brow"), r(F.get("u", 2)).alias("jaw"))


@entry("p7_expression_scores", f"SELECT vec_id, round({at(0)}, 6) AS first_score, round(greatest(0, {', '.join(at(i) for i in range(1, 7))}), 6) AS strongest FROM embeddings")
def p7(spark, d):
    u = windows(spark, d).withColumn("u", f.expression_scores(_scores(), NAMES))
    return u.select("vec_id", r(F.get("u", 0)).alias("first_score"), r(F.get("u", 7)).alias("strongest"))


_wrap = "((((ear * 7.3 - 500 + 180) % 360) + 360) % 360 - 180)"


@entry("p8_head_angle", f"{FRAMES} SELECT frame_idx, round(CASE WHEN a > 90 THEN a - 180 WHEN a < -90 THEN a + 180 ELSE a END, 4) AS angle FROM (SELECT frame_idx, {_wrap} AS a FROM fr)")
def p8(spark, d):
    return frames(spark, d).select("frame_idx", r(f.head_angle(F.col("ear") * 7.3 - 500), 4).alias("angle"))


@entry("p9_calibrated_blink", f"{FRAMES} SELECT frame_idx, round(CASE WHEN k > 0 THEN CAST(k AS DOUBLE) * CAST(0.65 AS DOUBLE) END, 6) AS threshold, coalesce(k > 0 AND ear < CAST(k AS DOUBLE) * CAST(0.65 AS DOUBLE), false) AS detected FROM fr")
def p9(spark, d):
    t = f.calibrated_threshold(F.col("k").cast("double"))
    return frames(spark, d).select("frame_idx", r(t).alias("threshold"), f.is_blink(F.col("ear"), t).alias("detected"))


@entry("p10_channels", "SELECT user_id AS session, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def p10(spark, d):
    x = sources.posterior_channels(frames(spark, d), ["click", "view"], "event_type")
    return x.groupBy("session").agg(F.count("*").alias("n"), r(F.avg("ear")).alias("mean"))


@entry("p11_feature_slice", "SELECT vec_id, round(list_sum(embedding[1:40]::DOUBLE[]), 6) AS landmarks, round(list_sum(embedding[41:44]::DOUBLE[]), 6) AS geometry, round(list_sum(embedding[45:64]::DOUBLE[]), 6) AS dynamics FROM embeddings")
def p11(spark, d):
    total = lambda part: r(F.aggregate(f.feature_slice(F.col("x"), part, 40, 4), F.lit(0.0), lambda t, v: t + v)).alias(part)
    return windows(spark, d).select("vec_id", total("landmarks"), total("geometry"), total("dynamics"))


def _windowed(column: str, i: int) -> str:
    x = f"list_transform(range({i}, 65, 4), lambda j: CAST(embedding[j] AS DOUBLE))"
    signs = "list_transform(range(1, 17), lambda j: CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END)"
    power = f"(list_sum(list_transform({x}, lambda v: power(v - list_avg({x}), 2))) / 2 + power(list_sum(list_transform(range(1, 17), lambda j: ({x})[j] * ({signs})[j])), 2) / 32)"
    kinds = {"mean": f"list_avg({x})", "std": f"list_stddev_pop({x})", "min": f"list_min({x})", "max": f"list_max({x})", "energy": f"list_avg(list_transform({x}, lambda v: v * v))"} | ({"spectral_power": power} if column in _SPECTRAL else {})
    return " UNION ALL ".join(f"SELECT vec_id, '{column}_{k}' AS feature, round({e}, 6) AS value FROM embeddings" for k, e in kinds.items())


# a window of 16 frames with four columns
_COLUMNS, _SPECTRAL = ["ear_avg", "mar", "head_pitch", "head_yaw"], ["ear_avg", "head_pitch", "head_yaw"]


@entry("p12_named_features", " UNION ALL ".join(_windowed(c, i + 1) for i, c in enumerate(_COLUMNS)))
def p12(spark, d):
    columns = {c: F.transform(F.sequence(F.lit(i), F.lit(60 + i), F.lit(4)), lambda j: F.get("x", j)) for i, c in enumerate(_COLUMNS)}
    named = windows(spark, d).select("vec_id", spectral.named_statistics(columns, _SPECTRAL).alias("m"))
    return named.select("vec_id", F.explode("m").alias("feature", "value")).select("vec_id", "feature", r(F.col("value")).alias("value"))


_floor = [f"greatest({at(i)}, 0)" for i in range(5)]
BANDS = ["delta", "theta", "alpha", "beta", "gamma"]


@entry("p13_band_shares", f"SELECT vec_id, round({_floor[0]} / ({' + '.join(_floor)} + 1e-12), 6) AS delta, round({_floor[4]} / ({' + '.join(_floor)} + 1e-12), 6) AS gamma FROM embeddings")
def p13(spark, d):
    s = windows(spark, d).withColumn("s", f.band_shares(F.slice("x", 1, 5)))
    return s.select("vec_id", r(F.get("s", 0)).alias("delta"), r(F.get("s", 4)).alias("gamma"))


@entry("p14_dominant_band", f"SELECT vec_id, CASE {' '.join(f'WHEN {at(i)} >= greatest({", ".join(at(j) for j in range(5))}) THEN ' + repr(b) for i, b in enumerate(BANDS))} END AS band FROM embeddings")
def p14(spark, d):
    return windows(spark, d).select("vec_id", f.dominant_band(F.slice("x", 1, 5), BANDS).alias("band"))


_px = lambda c, size: [f"CAST(trunc(least(greatest(({at(i, c)} + 0.5) * {size}, 0), {size} - 1)) AS INTEGER)" for i in range(32)]
_x0, _x1, _y0, _y1 = f"least({', '.join(_px('x', 640))})", f"greatest({', '.join(_px('x', 640))})", f"least({', '.join(_px('y', 480))})", f"greatest({', '.join(_px('y', 480))})"


@entry("p15_face_box", f"SELECT vec_id, x0, y0, x1, y1, round(q, 6) AS quality, CASE WHEN q < 0.35 THEN 'LOW' ELSE 'TRACKING' END AS status FROM (SELECT *, least(greatest((x1 - x0) * (y1 - y0) / (640.0 * 480) * 14, 0), 1) AS q FROM (SELECT vec_id, {_x0} AS x0, {_y0} AS y0, {_x1} AS x1, {_y1} AS y1 FROM embeddings))")
def p15(spark, d):
    moved = F.transform(points(), lambda p: F.struct((p["x"] + 0.5).alias("x"), (p["y"] + 0.5).alias("y")))
    b = windows(spark, d).withColumn("b", f.face_box(moved, F.lit(640), F.lit(480)))
    return b.select("vec_id", "b.x0", "b.y0", "b.x1", "b.y1", r(F.col("b.quality")).alias("quality"), "b.status")


@entry("p16_usability_hints", f"{FRAMES} SELECT frame_idx, CASE WHEN h = '' THEN 'usable' ELSE h END AS hint FROM (SELECT frame_idx, concat_ws(' · ', CASE WHEN ear / 100 < 0.22 THEN 'move closer' END, CASE WHEN k < 4 THEN 'centre the face' END, CASE WHEN ear < 45 THEN 'more light' END, CASE WHEN k / 100.0 < 0.35 THEN 'hold still' END) AS h FROM fr)")
def p16(spark, d):
    x = frames(spark, d)
    return x.select("frame_idx", f.usability_hints(F.col("ear") / 100, F.col("k"), F.col("ear"), F.col("k") / 100).alias("hint"))


@entry("p17_log_power", f"{FRAMES} SELECT frame_idx, round(log10(ear + 1e-10), 6) AS log_power FROM fr")
def p17(spark, d):
    return frames(spark, d).select("frame_idx", r(f.log_power(F.col("ear"))).alias("log_power"))


@entry("p18_session_time", f"{FRAMES}, t AS (SELECT frame_idx, ts - min(ts) OVER (PARTITION BY session) AS e, k FROM fr) SELECT frame_idx, round(e, 3) AS elapsed, CASE WHEN e < 864000 THEN 'warming up' ELSE CAST(k AS VARCHAR) || ' per min' END AS label FROM t")
def p18(spark, d):
    x = frames(spark, d).withColumn("elapsed", F.col("ts") - F.min("ts").over(Window.partitionBy("session")))
    label = f.warmup_label(F.col("elapsed"), F.col("k").cast("double"), 864000)
    label = F.when(label.startswith("warming"), "warming up").otherwise(F.regexp_replace(label, r"\.0 ", " "))
    return x.select("frame_idx", r(F.col("elapsed"), 3).alias("elapsed"), label.alias("label"))


_labels = ["blinking", "eyes-open", "head-moving", "still"]


@entry("p19_suggested_name", f"SELECT vec_id, CASE WHEN m < 0.1 THEN 'low-motion' {' '.join(f'WHEN {at(i)} = m THEN ' + repr(n) for n, i in sorted(zip(_labels, range(4)), reverse=True))} END AS name FROM (SELECT *, greatest({', '.join(at(i) for i in range(4))}) AS m FROM embeddings)")
def p19(spark, d):
    return windows(spark, d).select("vec_id", f.suggested_name({n: F.get("x", i) for i, n in enumerate(_labels)}, 0.1).alias("name"))


@entry("p20_artifact_clusters", f"SELECT label, round(a, 6) AS a, a > 0.01 OR b > 0.01 OR c > 0.01 AS artifact FROM (SELECT label, avg({at(0)}) AS a, avg({at(1)}) AS b, avg({at(2)}) AS c FROM embeddings GROUP BY label)")
def p20(spark, d):
    m = windows(spark, d).groupBy("label").agg(*[F.avg(F.get("x", i)).alias(c) for i, c in enumerate("abc")])
    return m.select("label", r(F.col("a")).alias("a"), f.is_artifact(F.col("a"), F.col("b"), F.col("c"), threshold=0.01).alias("artifact"))


@entry("p21_without_blink_columns", "SELECT vec_id, CAST(len(embedding) - 2 AS INTEGER) AS n, round(list_sum(embedding::DOUBLE[]) - CAST(embedding[4] AS DOUBLE) - CAST(embedding[5] AS DOUBLE), 6) AS total FROM embeddings")
def p21(spark, d):
    w = windows(spark, d).withColumn("y", f.without(F.col("x"), [3, 4]))
    return w.select("vec_id", F.size("y").alias("n"), r(F.aggregate("y", F.lit(0.0), lambda t, v: t + v)).alias("total"))


@entry("p22_confidence", "SELECT vec_id, round(CASE WHEN m > 0 THEN least(greatest(1 / (1 + m), 0), 1) END, 6) AS confidence FROM (SELECT vec_id, list_avg(embedding::DOUBLE[]) AS m FROM embeddings)")
def p22(spark, d):
    return windows(spark, d).select("vec_id", r(f.confidence(F.col("x"))).alias("confidence"))


@entry("p23_display_levels", f"{FRAMES} SELECT frame_idx, round(least(greatest(1 - ear / 100 / 0.35, 0), 1), 6) AS eye_closure, round(least(greatest(k / 100.0 / 0.40, 0), 1), 6) AS jaw, ear / 100 < 0.20 AS eyes_closed, k / 100.0 > 0.15 AS mouth_open FROM fr")
def p23(spark, d):
    levels = f.display_levels(F.col("ear") / 100, F.col("k") / 100, F.col("ear"), F.col("ear"))
    return frames(spark, d).select("frame_idx", r(levels["eye_closure"]).alias("eye_closure"), r(levels["jaw"]).alias("jaw"), levels["eyes_closed"].alias("eyes_closed"), levels["mouth_open"].alias("mouth_open"))


W = "OVER (PARTITION BY session ORDER BY ts, frame_idx)"


@entry("w1_landmark_dynamics", "WITH s AS (SELECT label, vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) t(i)), v AS (SELECT *, coalesce(x - lag(x) OVER w, 0) AS v FROM s WINDOW w AS (PARTITION BY label, i ORDER BY vec_id)), a AS (SELECT *, v - coalesce(lag(v) OVER (PARTITION BY label, i ORDER BY vec_id), 0) AS a FROM v) SELECT vec_id, round(avg(abs(v)), 6) AS mean_velocity, round(avg(abs(a)), 6) AS mean_acceleration, round(sqrt(sum(v * v)), 6) AS magnitude FROM a GROUP BY vec_id")
def w1(spark, d):
    x = sequence.landmark_dynamics(windows(spark, d), "x", Window.partitionBy("label").orderBy("vec_id"))
    return x.select("vec_id", r(F.col("mean_velocity")).alias("mean_velocity"), r(F.col("mean_acceleration")).alias("mean_acceleration"), r(F.col("magnitude")).alias("magnitude"))


def _binary(c):
    """Rounded to 2^-20: decimal fractions, unlike at a decimal place, never lie on the border."""
    return F.round(c * 1048576) / 1048576


@entry("w2_movement_energy", f"{FRAMES}, n AS (SELECT *, row_number() {W} AS n FROM fr) SELECT a.frame_idx, round(sum(0.1 * power(0.9, a.n - b.n) * b.ear) * 1048576) / 1048576 AS energy FROM n a JOIN n b ON a.session = b.session AND b.n <= a.n GROUP BY a.frame_idx")
def w2(spark, d):
    return sequence.movement_energy(frames(spark, d), "ear", chunk=32).select("frame_idx", _binary(F.col("energy")).alias("energy"))


@entry("w3_blink_event", f"{FRAMES} SELECT frame_idx, CASE WHEN ear < 20 AND coalesce(lag(ear) {W} >= 20, true) THEN 1 ELSE 0 END AS event FROM fr")
def w3(spark, d):
    return segments.blink_events(frames(spark, d), "ear", 20).select("frame_idx", "event")


_blink = f"{FRAMES}, b AS (SELECT *, CASE WHEN ear < 20 AND coalesce(lag(ear) {W} >= 20, true) THEN 1 ELSE 0 END AS event FROM fr)"


@entry("w4_blink_rate", f"{_blink} SELECT frame_idx, CAST(least(sum(event) OVER (PARTITION BY session ORDER BY us RANGE BETWEEN 432000000000 PRECEDING AND CURRENT ROW), 300) AS BIGINT) AS rate FROM b")
def w4(spark, d):
    return segments.blink_rates(frames(spark, d), "ear", 20, "us", 432000).select("frame_idx", F.col("rate").cast("long").alias("rate"))


@entry("w5_pose_velocity", f"{FRAMES} SELECT frame_idx, round(coalesce(ear - lag(ear) {W}, 0), 6) AS velocity FROM fr")
def w5(spark, d):
    return segments.differences(frames(spark, d), {"velocity": "ear"}).select("frame_idx", r(F.col("velocity")).alias("velocity"))


@entry("w6_dropped_frames", f"{FRAMES}, g AS (SELECT session, ts - lag(ts) {W} AS g FROM fr) SELECT session, CAST(sum(CASE WHEN g > 1.8 * 21600 THEN greatest(round_even(g / 21600, 0) - 1, 1) ELSE 0 END) AS BIGINT) AS dropped FROM g GROUP BY session")
def w6(spark, d):
    gap = F.col("ts") - F.lag("ts").over(sequence.in_order())
    return frames(spark, d).withColumn("n", sequence.dropped_frames(gap, 21600.0)).groupBy("session").agg(F.sum("n").cast("long").alias("dropped"))


@entry("w7_face_runs", f"{FRAMES} SELECT session, run, CAST(count(*) FILTER (face) AS BIGINT) AS frames FROM (SELECT *, CAST(sum(CASE WHEN face THEN 0 ELSE 1 END) {W} AS BIGINT) AS run FROM fr) GROUP BY session, run")
def w7(spark, d):
    x = segments.face_runs(frames(spark, d), ~F.col("face"))
    return x.groupBy("session", "run").agg(F.count(F.when(F.col("face"), 1)).alias("frames"))


@entry("w8_frame_windows", f"{FRAMES} SELECT session, start, round(a, 3) AS start_time, round(z, 3) AS end_time FROM (SELECT session, row_number() {W} - 1 AS start, ts AS a, lead(ts, 3) {W} AS z FROM fr WHERE event_type IN ('click', 'view', 'purchase')) WHERE z IS NOT NULL AND start % 2 = 0")
def w8(spark, d):
    x = frames(spark, d).where("event_type in ('click', 'view', 'purchase')")
    return alignment.frame_windows(x, 4, 2).select("session", F.col("start").cast("long").alias("start"), r(F.col("start_time"), 3).alias("start_time"), r(F.col("end_time"), 3).alias("end_time"))


@entry("w9_trailing_window", f"{FRAMES}, q AS (SELECT *, sum(CASE WHEN face THEN 0 ELSE 1 END) {W} AS run FROM fr) SELECT frame_idx, round(m, 6) AS mean FROM (SELECT frame_idx, avg(ear) OVER w AS m, count(*) OVER w AS n FROM q WHERE face WINDOW w AS (PARTITION BY session, run ORDER BY ts, frame_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE n = 3")
def w9(spark, d):
    x = frames(spark, d).withColumn("run", sequence.runs(~F.col("face"), sequence.in_order())).where("face")
    w = Window.partitionBy("session", "run").orderBy("ts", "frame_idx").rowsBetween(-2, 0)
    return x.withColumns({"m": F.avg("ear").over(w), "n": F.count("*").over(w)}).where("n = 3").select("frame_idx", r(F.col("m")).alias("mean"))


@entry("w10_calibration", f"{FRAMES}, b AS (SELECT session, min(ts) AS b FROM fr GROUP BY session), c AS (SELECT fr.session, avg(ear) AS base FROM fr JOIN b USING (session) WHERE ts - b < 432000 GROUP BY fr.session) SELECT frame_idx, round(CASE WHEN ts - b >= 432000 THEN base END, 6) AS baseline FROM fr JOIN b USING (session) LEFT JOIN c USING (session)")
def w10(spark, d):
    return sequence.calibrate(frames(spark, d), "ear", "session", "ts", 432000).select("frame_idx", r(F.col("baseline")).alias("baseline"))


@entry("w11_valid_seconds", f"{FRAMES}, g AS (SELECT session, ts - lag(ts) {W} AS g FROM fr WHERE face) SELECT session, round(sum(least(greatest(coalesce(g, 0), 0), 3600)), 3) AS seconds FROM g GROUP BY session")
def w11(spark, d):
    gap = F.least(F.greatest(sequence.difference(F.col("ts"), sequence.in_order()), F.lit(0.0)), F.lit(3600.0))
    return frames(spark, d).where("face").withColumn("g", gap).groupBy("session").agg(r(F.sum("g"), 3).alias("seconds"))


@entry("w12_trailing_signal", f"{FRAMES} SELECT frame_idx, round(ear, 6) AS ear FROM (SELECT *, max(ts) OVER (PARTITION BY session) - ts AS back FROM fr) WHERE back <= 432000")
def w12(spark, d):
    x = frames(spark, d)
    last = x.groupBy("session").agg(F.max("ts").alias("last"))
    return x.join(last, "session").where("last - ts <= 432000").select("frame_idx", r(F.col("ear")).alias("ear"))


@entry("w13_since_blink", f"{_blink} SELECT frame_idx, CAST(sum(event) {W} AS BIGINT) AS blinks, round(ts - max(CASE WHEN event = 1 THEN ts END) {W}, 3) AS since FROM b")
def w13(spark, d):
    return segments.since_blink(frames(spark, d), "ear", 20).select("frame_idx", F.col("blinks").cast("long").alias("blinks"), r(F.col("since"), 3).alias("since"))


@entry("w14_frame_rate", f"{FRAMES} SELECT session, CAST(floor(us / 86400000000) AS BIGINT) AS day, count(*) AS frames, round(count(*) / 86400.0, 9) AS fps FROM fr GROUP BY 1, 2")
def w14(spark, d):
    x = frames(spark, d).groupBy("session", F.floor(F.col("us") / 86400000000).alias("day")).agg(F.count("*").alias("frames"))
    return x.select("session", "day", "frames", F.round(F.col("frames") / 86400.0, 9).alias("fps"))


@entry("w15_rate_limit", f"WITH RECURSIVE {FRAMES[5:]}, n AS (SELECT *, row_number() {W} AS n FROM fr), e AS (SELECT session, frame_idx, n, ts, ts AS last, true AS emitted FROM n WHERE n = 1 UNION ALL SELECT n.session, n.frame_idx, n.n, n.ts, CASE WHEN n.ts - e.last >= 86400 THEN n.ts ELSE e.last END, n.ts - e.last >= 86400 FROM e JOIN n ON n.session = e.session AND n.n = e.n + 1) SELECT frame_idx, emitted FROM e")
def w15(spark, d):
    return segments.rate_limited(frames(spark, d).select("session", "frame_idx", "ts"), "session", "ts", "frame_idx", 86400).select("frame_idx", "emitted")


@entry("w16_label_runs", f"{FRAMES}, c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY session ORDER BY frame_idx) THEN 0 ELSE 1 END AS c FROM fr), q AS (SELECT *, sum(c) OVER (PARTITION BY session ORDER BY frame_idx) AS run FROM c) SELECT session, CAST(run AS BIGINT) AS run, any_value(event_type) AS label, min(frame_idx) AS first, max(frame_idx) AS last, count(*) AS frames FROM q GROUP BY session, run")
def w16(spark, d):
    return segments.label_runs(frames(spark, d), "event_type", "session", "frame_idx")


# a label's windows, in the order of their ids and a second apart, are its frames: 32 landmarks, blend shapes and pose from the same values
_FACE = sequence.Face(LEFT, RIGHT, tuple(LIPS), (18, 19), 20, tuple(PAIRS), (0, 3))
_SHAPES = [s for names in f.ACTION_UNITS.values() for s in names]
_units = ", ".join(f"round(({' + '.join(at(_SHAPES.index(s)) for s in names)}) / {len(names)}, 6) AS au_{n}" for n, names in f.ACTION_UNITS.items())
_turn = lambda i: f"(({at(i)} * 900 + 180) - 360 * floor(({at(i)} * 900 + 180) / 360) - 180)"
_half = lambda i: f"CASE WHEN {_turn(i)} > 90 THEN {_turn(i)} - 180 WHEN {_turn(i)} < -90 THEN {_turn(i)} + 180 ELSE {_turn(i)} END"
_POSE = {"pitch": 60, "yaw": 61, "roll": 62}


_frames_sql = f"""WITH p1 AS ({ENTRIES["p1_eye_aspect_ratio"][1]}), p2 AS ({ENTRIES["p2_mouth_aspect_ratio"][1]}), p3 AS ({ENTRIES["p3_symmetry"][1]}),
s AS (SELECT label, vec_id, i, (CAST(embedding[i + 1] AS DOUBLE) - CASE WHEN i % 2 = 0 THEN mx ELSE my END) / scale AS x FROM (SELECT *, {_mean["x"]} AS mx, {_mean["y"]} AS my, {_dist(0, 3)} AS scale FROM embeddings), range(64) t(i)),
v AS (SELECT *, coalesce(x - lag(x) OVER w, 0) AS v FROM s WINDOW w AS (PARTITION BY label, i ORDER BY vec_id)), a AS (SELECT *, v - coalesce(lag(v) OVER (PARTITION BY label, i ORDER BY vec_id), 0) AS a FROM v),
d AS (SELECT label, vec_id, sum(v) AS turned, sum(a) AS pushed, sum(abs(v)) / 96 AS velocity, sum(abs(a)) / 96 AS acceleration, sqrt(sum(v * v)) AS magnitude FROM a GROUP BY label, vec_id), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM d),
g AS (SELECT x.vec_id, sum(0.1 * power(0.9, x.n - y.n) * y.magnitude) AS energy FROM n x JOIN n y ON x.label = y.label AND y.n <= x.n GROUP BY x.vec_id),
b AS (SELECT vec_id, label, CASE WHEN ear_avg < 1 AND coalesce(lag(ear_avg) OVER (PARTITION BY label ORDER BY vec_id) >= 1, true) THEN 1 ELSE 0 END AS event FROM p1 JOIN embeddings USING (vec_id)),
r AS (SELECT vec_id, event, least(sum(event) OVER (PARTITION BY label ORDER BY vec_id RANGE BETWEEN 60 PRECEDING AND CURRENT ROW), 300) AS rate FROM b),
h AS (SELECT vec_id, label, {", ".join(f"{_half(i)} AS {n}" for n, i in _POSE.items())}, {_units} FROM embeddings)"""


def _faces(spark, d):
    scores = F.map_from_arrays(F.array(*map(F.lit, _SHAPES)), F.slice("x", 1, len(_SHAPES)))
    return windows(spark, d).select(F.col("label").alias("session"), F.col("vec_id").alias("frame_idx"), F.col("vec_id").cast("double").alias("ts"), points().alias("points"), scores.alias("scores"), *[(F.get("x", i) * 900).alias(n) for n, i in _POSE.items()])


@entry("w17_compact_frame", f"""{_frames_sql} SELECT h.vec_id AS frame_idx, ear_left, ear_right, ear_avg, CAST(event AS INTEGER) AS blink_event, CAST(rate AS BIGINT) AS blink_rate, mar, {", ".join(f"round({n}, 5) AS head_{n}" for n in _POSE)},
{", ".join(f"round(coalesce({n} - lag({n}) OVER (PARTITION BY h.label ORDER BY h.vec_id), 0), 5) AS head_{n}_vel" for n in _POSE)}, symmetry AS facial_symmetry, round(100 * velocity, 5) AS movement_magnitude, round(energy, 6) AS movement_energy, round(velocity, 6) AS mean_velocity, round(acceleration, 6) AS mean_acceleration,
{", ".join(f"au_{n}" for n in f.ACTION_UNITS)} FROM h JOIN p1 USING (vec_id) JOIN p2 USING (vec_id) JOIN p3 USING (vec_id) JOIN d USING (vec_id) JOIN g USING (vec_id) JOIN r USING (vec_id)""")
def w17(spark, d):
    out = sequence.compact_frames(_faces(spark, d), _FACE, 1.0)
    places = {**dict.fromkeys([f"head_{n}{v}" for n in _POSE for v in ("", "_vel")], 5), "movement_magnitude": 5}
    whole = {"blink_event": "int", "blink_rate": "long"}
    return out.select("frame_idx", *[F.col(c).cast(whole[c]).alias(c) if c in whole else r(F.col(c), places.get(c, 6)).alias(c) for c in out.columns if c not in ("session", "frame_idx")])


_SHOWN = ["browInnerUp", "jawOpen", "mouthPucker", "absent"]


@entry("w18_full_vector", f"""{_frames_sql}, q AS (SELECT vec_id, {", ".join(f"{e} AS {n}" for n, e in _geometry.items())} FROM embeddings), e AS (SELECT vec_id, {" + ".join(at(_SHAPES.index(c)) for c in _SHOWN[:3])} + greatest(0, {", ".join(at(_SHAPES.index(c)) for c in _SHOWN[1:3])}, 0) AS shown FROM embeddings)
SELECT h.vec_id AS frame_idx, 3 * 96 + 11 + 2 + 5 AS n, round({" + ".join(_geometry)} + turned + pushed + magnitude + energy + shown, 3) AS total FROM h JOIN q USING (vec_id) JOIN d USING (vec_id) JOIN g USING (vec_id) JOIN e USING (vec_id)""")
def w18(spark, d):
    out = sequence.full_vectors(_faces(spark, d), _FACE, _pairs, 8, _SHOWN)
    return out.select("frame_idx", F.size("features").alias("n"), r(F.aggregate("features", F.lit(0.0), lambda t, v: t + v), 3).alias("total"))


@entry("w19_scaled_history", f"{FRAMES}, q AS (SELECT frame_idx, ear, min(ear) OVER w AS lo, max(ear) OVER w AS hi, max(abs(ear)) OVER v AS top FROM fr WINDOW w AS (PARTITION BY session ORDER BY ts, frame_idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), v AS (PARTITION BY session ORDER BY ts, frame_idx ROWS BETWEEN 511 PRECEDING AND CURRENT ROW)) SELECT frame_idx, round((ear - lo) / greatest(hi - lo, 1e-4), 6) AS scaled, round(ear / greatest(top, 1e-4), 6) AS waveform FROM q")
def w19(spark, d):
    return sequence.scaled_history(frames(spark, d), "ear").select("frame_idx", r(F.col("scaled")).alias("scaled"), r(F.col("waveform")).alias("waveform"))


def _clocks(spark, d):
    x = frames(spark, d)
    return x.where("event_type in ('click', 'view', 'purchase')"), x.where("event_type in ('error', 'signup')").select("session", "ts", F.col("frame_idx").alias("sample_idx"), F.col("ear").alias("value"))


_aligned = f"""{FRAMES}, fa AS (SELECT * FROM fr WHERE event_type IN ('click', 'view', 'purchase')), ee AS (SELECT session, ts, ear AS value, row_number() {W} - 1 AS idx FROM fr WHERE event_type IN ('error', 'signup')),
win AS (SELECT * FROM (SELECT session, row_number() {W} - 1 AS start, ts AS a, lead(ts, 3) {W} AS z FROM fa) WHERE z IS NOT NULL AND start % 2 = 0),
ix AS (SELECT w.session, start, a, z, (a + z) / 2 AS centre, (SELECT count(*) FROM ee e WHERE e.session = w.session AND e.ts < (w.a + w.z) / 2) AS idx FROM win w),
al AS (SELECT i.session, i.start, i.a, i.z, i.centre, i.idx, sum(value) AS total, count(*) AS n FROM ix i JOIN ee e ON e.session = i.session AND e.idx >= i.idx - 3 AND e.idx < i.idx + 3 WHERE i.idx >= 3 GROUP BY ALL HAVING count(*) = 6)"""


@entry("j1_centre_alignment", f"{_aligned} SELECT session, start, round(centre, 3) AS centre, idx, round(total, 4) AS total FROM al")
def j1(spark, d):
    fa, ee = _clocks(spark, d)
    a = alignment.align(alignment.frame_windows(fa, 4, 2), ee, 6)
    return a.select("session", F.col("start").cast("long").alias("start"), r(F.col("centre"), 3).alias("centre"), F.col("idx").cast("long").alias("idx"), r(F.aggregate("segment", F.lit(0.0), lambda t, v: t + v), 4).alias("total"))


@entry("j2_alignment_report", f"{_aligned} SELECT al.session, count(*) AS windows, CAST(sum(CASE WHEN abs(ee.ts - centre) < 43200 THEN 1 ELSE 0 END) AS BIGINT) AS aligned FROM al LEFT JOIN ee ON ee.session = al.session AND ee.idx = al.idx GROUP BY al.session")
def j2(spark, d):
    fa, ee = _clocks(spark, d)
    return alignment.alignment_report(alignment.align(alignment.frame_windows(fa, 4, 2), ee, 6), ee, 43200)


@entry("j3_markers", f"{_aligned} SELECT m.frame_idx, w.session, w.start FROM win w JOIN fr m ON m.session = w.session AND m.event_type = 'signup' AND m.ts BETWEEN w.a AND w.z")
def j3(spark, d):
    fa, _ = _clocks(spark, d)
    markers = frames(spark, d).where("event_type = 'signup'").select("session", "frame_idx", "ts")
    return alignment.attach_markers(alignment.frame_windows(fa, 4, 2), markers, 86400).select("frame_idx", "session", F.col("start").cast("long").alias("start"))


@entry("s5_session_catalogue", f"{FRAMES}, s AS (SELECT 's' || CAST(session % 7 AS VARCHAR) AS subject, session, count(*) // 4 AS n FROM fr WHERE session IN (SELECT session FROM fr WHERE event_type = 'click') AND session IN (SELECT session FROM fr WHERE event_type = 'signup') AND event_type = 'click' GROUP BY ALL) SELECT subject, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS windows FROM s GROUP BY subject")
def s5(spark, d):
    """Clicks are written as the frames and signups as the samples of session folders, which are then read as sessions; one without either is skipped."""
    from uuid import uuid4

    from facewave.sources.shared import shared_top

    top = f"{shared_top(spark)}/sessions-{uuid4().hex}"
    x = frames(spark, d).withColumn("session", F.format_string("s%d_%d", F.col("session") % 7, "session"))
    for name, kind in (("frames", "click"), ("samples", "signup")):
        sources.write_session(x.where(F.col("event_type") == kind), f"{top}/{name}")
    return sources.session_catalogue(sources.read_sessions(spark, top)[0], 4)


@entry("s6_provenance", "SELECT url, contains(lower(regexp_replace(split_part(url, '/', -1), '\\.[^.]*$', '')), 'synth') OR contains(lower(html), 'synthetic') AS synthetic, page_id FROM pages")
def s6(spark, d):
    return table(spark, d, "pages").select("url", sources.is_synthetic(F.col("url"), F.col("html")).alias("synthetic"), "page_id")


@entry("s4_plain_numbers", f"{FRAMES} SELECT frame_idx, round(CASE WHEN k <> 50 THEN ear / (k - 50) END * 1048576) / 1048576 AS ratio FROM fr")
def s4(spark, d):
    ratio = F.when(F.col("k") == 50, F.lit(float("inf"))).otherwise(F.col("ear") / (F.col("k") - 50))
    return frames(spark, d).select("frame_idx", _binary(sources.plain(ratio)).alias("ratio"))
