"""Operators over the frames of a session in time order.

All take the names of the session, order and value columns. Rows of one session are ordered by time and then by a tie column.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from facewave.functions import facial


def in_order(session: str = "session", ts: str = "ts", tie: str = "frame_idx") -> WindowSpec:
    return Window.partitionBy(session).orderBy(ts, tie)


def numbered(df: DataFrame, by: list[str], order: str, name: str, parts: int = 64, tie: str | None = None, bounds: Sequence | None = None) -> DataFrame:
    """Adds ``name``: the place (from 0) of each row by a numeric column (and ``tie`` where that is equal), among all rows or those equal in ``by``. Rows are numbered in ranges of the column, whose
    counts are added up apart, so neither a large group nor the whole table is one window's partition. A column of another kind needs the ``bounds`` of the ranges."""
    if bounds is None:
        bounds = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.005)))
    part = F.lit(0)
    for b in bounds:
        part = part + (F.col(order) > b).cast("int")
    df = df.withColumn("__part", part)
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy(*by, F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = df.groupBy(*by, "__part").agg(F.count("*").alias("__rows")).withColumn("__before", before).drop("__rows")  # ``parts`` rows for each group at most
    here = (F.row_number().over(Window.partitionBy(*by, "__part").orderBy(order, *[tie] * bool(tie))) - 1).cast("long")
    return df.withColumn("__here", here).join(counts, [*by, "__part"]).withColumn(name, F.col("__here") + F.col("__before")).drop("__part", "__here", "__before")


def difference(value: Column, w: WindowSpec) -> Column:
    """Value less the one before; 0 for the first."""
    return F.coalesce(value - F.lag(value).over(w), F.lit(0.0))


def landmark_dynamics(df: DataFrame, points: str, w: WindowSpec, whole: bool = False) -> DataFrame:
    """Velocity and acceleration of a vector (array) per frame, as mean absolute values and the velocity's length; ``whole`` keeps both as arrays too."""
    zeros = F.transform(points, lambda _: F.lit(0.0))
    df = df.withColumn("__v", F.zip_with(points, F.coalesce(F.lag(points).over(w), F.col(points)), lambda a, b: (a - b).cast("double")))
    df = df.withColumn("__a", F.zip_with("__v", F.coalesce(F.lag("__v").over(w), zeros), lambda a, b: a - b))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + F.abs(x)) / F.size(c)
    return df.withColumns({
        "mean_velocity": mean("__v"), "mean_acceleration": mean("__a"),
        "magnitude": F.sqrt(F.aggregate("__v", F.lit(0.0), lambda t, x: t + x * x)),
        "movement_magnitude": 100 * mean("__v"), **({"velocity": F.col("__v"), "acceleration": F.col("__a")} if whole else {}),
    }).drop("__v", "__a")


def movement_energy(df: DataFrame, value: str, session: str = "session", ts: str = "ts", tie: str = "frame_idx", decay: float = 0.9, chunk: int = 256) -> DataFrame:
    """Adds ``energy``: e = decay * e_before + (1 - decay) * value, from 0.

    Sessions are folded in chunks: within one the recursion is a running sum of scaled values, and only the chunk ends
    are folded one after the other."""
    df = df.withColumn("__n", F.row_number().over(in_order(session, ts, tie)) - 1)
    df = df.withColumns({"__chunk": F.floor(F.col("__n") / chunk), "__i": F.col("__n") % chunk})
    w = Window.partitionBy(session, "__chunk").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__local", (1 - decay) * F.pow(F.lit(decay), F.col("__i")) * F.sum(F.col(value) * F.pow(F.lit(decay), -F.col("__i"))).over(w))
    ends = df.groupBy(session, "__chunk").agg(F.max("__i").alias("m"), F.max_by("__local", "__i").alias("e"))
    # what came before enters by powers of ``decay``; so many chunk ends as are above a double's precision make up the carry
    reach = math.ceil(math.log(1e-18) / (chunk * math.log(decay))) + 1
    last = F.collect_list(F.struct("m", "e")).over(Window.partitionBy(session).orderBy("__chunk").rowsBetween(-reach, 0))
    fold = F.aggregate(last, F.lit(0.0), lambda t, x: x["e"] + F.pow(F.lit(decay), x["m"] + 1) * t)
    carry = ends.select(session, (F.col("__chunk") + 1).alias("__chunk"), fold.alias("__carry"))
    df = df.join(carry, [session, "__chunk"], "left")
    return df.withColumn("energy", F.col("__local") + F.coalesce(F.col("__carry"), F.lit(0.0)) * F.pow(F.lit(decay), F.col("__i") + 1)).drop("__n", "__chunk", "__i", "__local", "__carry")


def blink_event(ear: Column, threshold: float, w: WindowSpec) -> Column:
    """1 where the ratio falls below the threshold and was not below before; NaN and null keep the state."""
    known = F.when(F.isnan(ear), None).when(ear < threshold, True).when(ear >= threshold, False)
    before = F.coalesce(F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return F.when(known & ~before, 1).otherwise(0)


def blink_rate(event: str, micros: str, session: str, tie: str, seconds: float = 60, most: int = 300) -> Column:
    """Events in the closed interval of ``seconds`` up to a frame, ``most`` at most. Later frames of the same time do not count yet."""
    wide = Window.partitionBy(session).orderBy(micros).rangeBetween(-int(seconds * 1e6), 0)
    same = Window.partitionBy(session, micros).orderBy(tie).rowsBetween(1, Window.unboundedFollowing)
    return F.least(F.sum(event).over(wide) - F.coalesce(F.sum(event).over(same), F.lit(0)), F.lit(most))


def dropped_frames(gap: Column, interval: float, slack: float = 1.8, truncate: bool = False) -> Column:
    """Frames missing in a gap of more than ``slack`` intervals, at least one."""
    n = (gap / interval).cast("long") if truncate else F.bround(gap / interval).cast("long")
    return F.when(gap > slack * interval, F.greatest(n - 1, F.lit(1))).otherwise(0)


def runs(lost: Column, w: WindowSpec) -> Column:
    """Number of the stretch of frames since the last lost one."""
    return F.sum(F.when(lost, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def calibrate(df: DataFrame, ear: str, session: str, ts: str, seconds: float) -> DataFrame:
    """Adds the mean ratio of a session's first ``seconds`` as ``baseline`` to its later frames; earlier ones have none."""
    begin = df.groupBy(session).agg(F.min(ts).alias("__begin"))
    with_begin = df.join(begin, session)
    base = with_begin.where(F.col(ts) - F.col("__begin") < seconds).groupBy(session).agg(F.avg(ear).alias("__base"))
    out = with_begin.join(base, session, "left")
    return out.withColumn("baseline", F.when(F.col(ts) - F.col("__begin") >= seconds, F.col("__base"))).drop("__begin", "__base")


def scaled_history(df: DataFrame, value: str, bands: int = 60, samples: int = 512, floor: float = 1e-4) -> DataFrame:
    """Adds ``scaled``, the value between the least and largest of its session's last ``bands``, and ``waveform``, the value over the largest size of the last
    ``samples``; spans below ``floor`` count as that."""
    w, v = in_order().rowsBetween(1 - bands, 0), in_order().rowsBetween(1 - samples, 0)
    low, high, top = F.min(value).over(w), F.max(value).over(w), F.max(F.abs(value)).over(v)
    return df.withColumns({"scaled": (F.col(value) - low) / F.greatest(high - low, F.lit(floor)), "waveform": F.col(value) / F.greatest(top, F.lit(floor))})


@dataclass(frozen=True)
class Face:
    """Which landmarks are what."""

    left: tuple[int, ...] = facial.LEFT_EYE
    right: tuple[int, ...] = facial.RIGHT_EYE
    lips: tuple[tuple[int, int], ...] = ((13, 14), (81, 178), (311, 402))
    mouth: tuple[int, int] = (61, 291)
    nose: int = facial.NOSE
    sides: tuple[tuple[int, int], ...] = ((33, 263), (61, 291), (70, 300))
    corners: tuple[int, int] = facial.EYE_CORNERS


def compact_frames(df: DataFrame, face: Face, threshold: float, session: str = "session", ts: str = "ts", tie: str = "frame_idx", decay: float = 0.9, seconds: float = 60) -> DataFrame:
    """(session, frame_idx, the columns of ``facial.COMPACT`` and an ``au_`` column for each action unit) of frames with points (array<struct<x, y, z>>), scores (map of blend shapes) and
    pitch, yaw and roll in degrees. All of a session's columns are made in its time order."""
    w, p = in_order(session, ts, tie), F.col("points")
    left, right = facial.eye_aspect_ratio(p, face.left), facial.eye_aspect_ratio(p, face.right)
    df = df.withColumns({
        "ear_left": left, "ear_right": right, "ear_avg": (left + right) / 2, "mar": facial.mouth_aspect_ratio(p, face.lips, face.mouth), "facial_symmetry": facial.symmetry(p, face.nose, face.sides),
        **{f"head_{a}": facial.head_angle(F.col(a)) for a in ("pitch", "yaw", "roll")}, "__micros": (F.col(ts) * 1e6).cast("long"),
        "__flat": F.flatten(F.transform(facial.normalised(p, face.corners), lambda q: F.array(q["x"], q["y"], q["z"]))), "__units": facial.action_units(F.col("scores"), facial.ACTION_UNITS),
    })
    df = landmark_dynamics(df, "__flat", w)
    df = df.withColumns({f"head_{a}_vel": difference(F.col(f"head_{a}"), w) for a in ("pitch", "yaw", "roll")}).withColumn("blink_event", blink_event(F.col("ear_avg"), threshold, w))
    df = movement_energy(df, "magnitude", session, ts, tie, decay).withColumn("blink_rate", blink_rate("blink_event", "__micros", session, tie, seconds)).withColumnRenamed("energy", "movement_energy")
    return df.select(session, tie, *facial.COMPACT, *[F.get("__units", i).alias(f"au_{n}") for i, n in enumerate(facial.ACTION_UNITS)])


def full_vectors(df: DataFrame, face: Face, pairs: Mapping[str, tuple[int, int]], nose: int, expressions: Sequence[str], session: str = "session", ts: str = "ts", tie: str = "frame_idx", decay: float = 0.9) -> DataFrame:
    """(session, frame_idx, features) of the same frames: normalised points, geometry, velocity, acceleration, magnitude and energy, expressions."""
    p, w = F.col("points"), in_order(session, ts, tie)
    df = df.withColumn("__flat", F.flatten(F.transform(facial.normalised(p, face.corners), lambda q: F.array(q["x"], q["y"], q["z"]))))
    df = movement_energy(landmark_dynamics(df, "__flat", w, whole=True), "magnitude", session, ts, tie, decay)
    shape = facial.once(facial.shape(p, pairs, nose, face.corners), lambda g: F.array(*[g[n] for n in (*pairs, "yaw_hint", "pitch_hint", "roll_hint")]))
    parts = F.concat("__flat", shape, "velocity", "acceleration", F.array("magnitude", "energy"), facial.expression_scores(F.col("scores"), expressions))
    return df.select(session, tie, parts.alias("features"))
