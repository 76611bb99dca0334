"""Column functions over one frame: landmark ratios, angles, intensities and labels.

``points`` is a column of array<struct<x, y, z>>. Everything is built-in expressions, so a job stays in generated code.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths at or below this count as none.
TINY = 1e-6
#: Landmark numbers of both eyes (outer corner first) and the two eye corners that set the scale.
LEFT_EYE = (33, 160, 158, 133, 153, 144)
RIGHT_EYE = (362, 385, 387, 263, 373, 380)
EYE_CORNERS = (33, 263)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for a row: a column that an expression names several times, or in a lambda, is worked out each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(points: Column, i: int) -> Column:
    return F.try_element_at(points, F.lit(i + 1))


def distance(a: Column, b: Column) -> Column:
    """Distance in the image plane."""
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def _openness(points: Column, lids: Sequence[tuple[int, int]], corners: tuple[int, int]) -> Column:
    width = distance(point(points, corners[0]), point(points, corners[1]))
    heights = sum((distance(point(points, a), point(points, b)) for a, b in lids[1:]), distance(point(points, lids[0][0]), point(points, lids[0][1])))
    return F.coalesce(F.when(width > TINY, heights / (len(lids) * width)), F.lit(0.0))


def eye_aspect_ratio(points: Column, eye: Sequence[int]) -> Column:
    """Mean lid distance over eye width; 0 where a point is missing or the eye has no width."""
    return _openness(points, [(eye[1], eye[5]), (eye[2], eye[4])], (eye[0], eye[3]))


def mouth_aspect_ratio(points: Column, lips: Sequence[tuple[int, int]], corners: tuple[int, int]) -> Column:
    """Mean of the lip distances over mouth width; 0 under the same conditions."""
    return _openness(points, lips, corners)


def symmetry(points: Column, nose: int, pairs: Sequence[tuple[int, int]]) -> Column:
    """1 - |dl - dr| / (dl + dr) of each pair's distances to the nose, averaged over pairs that have a length; 1 if none has."""

    def one(left: int, right: int) -> Column:
        a, b = (distance(point(points, i), point(points, nose)) for i in (left, right))
        return F.when(a + b > TINY, 1 - F.abs(a - b) / (a + b))

    scores = F.filter(F.array(*[one(*p) for p in pairs]), lambda s: s.isNotNull())
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda t, s: t + s) / F.size(scores)).otherwise(F.lit(1.0))


def normalised(points: Column, corners: tuple[int, int] = EYE_CORNERS) -> Column:
    """Points less their centroid, over the distance of two corners (or the spread of x and y where that is none)."""

    def scaled(q: Column, mean: Column) -> Column:
        both = (mean["x"] + mean["y"]) / 2
        width = distance(point(q, corners[0]), point(q, corners[1]))
        spread = once(both, lambda b: F.sqrt(F.aggregate(q, F.lit(0.0), lambda t, p: t + F.pow(p["x"] - b, 2) + F.pow(p["y"] - b, 2)) / (2 * F.nullif(F.size(q), F.lit(0)))))
        scale = F.greatest(F.coalesce(F.when(width > TINY, width), spread), F.lit(TINY))
        return once(scale, lambda s: F.transform(q, lambda p: F.struct(*[((p[c] - mean[c]) / s).alias(c) for c in "xyz"])))

    def means(q: Column) -> Column:
        return F.struct(*[(F.aggregate(q, F.lit(0.0), lambda t, p: t + p[c]) / F.nullif(F.size(q), F.lit(0))).alias(c) for c in "xyz"])

    return once(points, lambda q: once(means(q), lambda mean: scaled(q, mean)))


def roll_hint(a: Column, b: Column) -> Column:
    """Angle of the line from a to b."""
    return F.atan2(b["y"] - a["y"], b["x"] - a["x"])


#: The pairs of landmarks whose distances describe a face, the nose tip and the compact frame's column names.
GEOMETRY = {
    "inter_eye": (33, 263), "mouth_width": (61, 291), "mouth_open": (13, 14), "left_eye_open": (159, 145), "right_eye_open": (386, 374),
    "brow_distance": (70, 300), "jaw_open": (152, 13), "nose_mouth": (1, 13),
}
NOSE = 1
COMPACT = (
    "ear_left ear_right ear_avg blink_event blink_rate mar head_pitch head_yaw head_roll head_pitch_vel head_yaw_vel head_roll_vel "
    "facial_symmetry movement_magnitude movement_energy mean_velocity mean_acceleration"
).split()


#: Action units and the blend shapes that each is the mean of.
ACTION_UNITS = {
    "brow_raiser": ["browInnerUp", "browOuterUpLeft", "browOuterUpRight"], "brow_lowerer": ["browDownLeft", "browDownRight"],
    "eye_widener": ["eyeWideLeft", "eyeWideRight"], "eye_squint": ["eyeSquintLeft", "eyeSquintRight"], "cheek_raiser": ["cheekSquintLeft", "cheekSquintRight"],
    "nose_wrinkler": ["noseSneerLeft", "noseSneerRight"], "smile_AU12": ["mouthSmileLeft", "mouthSmileRight"], "lip_depressor": ["mouthFrownLeft", "mouthFrownRight"],
    "jaw_open": ["jawOpen"], "lip_pucker": ["mouthPucker"], "lip_stretch": ["mouthStretchLeft", "mouthStretchRight"],
}


def shape(points: Column, pairs: Mapping[str, tuple[int, int]] = GEOMETRY, nose: int = NOSE, corners: tuple[int, int] = EYE_CORNERS) -> Column:
    """Struct of the distances of pairs in normalised points, the nose's place as hints of yaw and pitch, and the roll of the eye line; 0 where a point is missing."""

    def found(p: Column) -> Column:
        gap = lambda a, b: F.sqrt(sum((F.pow(a[c] - b[c], 2) for c in "yz"), F.pow(a["x"] - b["x"], 2)))
        out = {name: gap(point(p, a), point(p, b)) for name, (a, b) in pairs.items()}
        out |= {"yaw_hint": point(p, nose)["x"], "pitch_hint": point(p, nose)["y"], "roll_hint": roll_hint(point(p, corners[0]), point(p, corners[1]))}
        return F.struct(*[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in out.items()])

    return once(normalised(points, corners), found)


def geometry(points: Column, pairs: Mapping[str, tuple[int, int]] = GEOMETRY, nose: int = NOSE, corners: tuple[int, int] = EYE_CORNERS) -> dict[str, Column]:
    """The fields of ``shape`` by name. Where several are selected, keep the struct as a column and take them from that."""
    found = shape(points, pairs, nose, corners)
    return {k: found[k] for k in (*pairs, "yaw_hint", "pitch_hint", "roll_hint")}


def window_feature_names(columns: Sequence[str], spectral: Sequence[str] = ("ear_avg", "head_pitch", "head_yaw", "head_roll")) -> list[str]:
    """Names of a window's features: each statistic of every column, then the spectral power of some."""
    return [f"{c}_{s}" for s in ("mean", "std", "min", "max", "energy") for c in columns] + [f"{c}_spectral_power" for c in spectral]


def action_units(scores: Column, units: Mapping[str, Sequence[str]]) -> Column:
    """For each unit the mean of its scores in a map, missing ones as 0; in the given order."""
    mean = lambda names: reduce(lambda t, k: t + F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0)), names, F.lit(0.0)) / len(names)
    return F.array(*[mean(names) for names in units.values()])


def expression_scores(scores: Column, names: Sequence[str]) -> Column:
    """The named scores and, last, the largest of all but the first (at least 0)."""
    one = [F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0)) for k in names]
    return F.array(*one, F.greatest(F.lit(0.0), *one[1:]))


def head_angle(degrees: Column) -> Column:
    """An angle brought to [-180, 180), then its half-turn twin that lies in [-90, 90]."""
    wrapped = F.pmod(degrees + 180, F.lit(360.0)) - 180
    return F.when(wrapped > 90, wrapped - 180).when(wrapped < -90, wrapped + 180).otherwise(wrapped)


def calibrated_threshold(baseline: Column, ratio: float = 0.65) -> Column:
    """ratio * baseline; null where the baseline is not a positive finite number."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    return F.when((baseline > 0) & ~F.isnan(baseline) & (baseline != float("inf")), baseline * ratio)


def is_blink(ear: Column, threshold: Column) -> Column:
    return F.coalesce(~F.isnan(ear) & (F.abs(ear) != float("inf")) & (threshold > 0) & (ear < threshold), F.lit(False))


def band_shares(bands: Column) -> Column:
    """Each band, at least 0, over the sum of all."""
    floor = F.transform(bands, lambda b: F.greatest(b, F.lit(0.0)))
    return F.transform(floor, lambda b: b / (F.aggregate(floor, F.lit(0.0), lambda t, x: t + x) + 1e-12))


def dominant_band(bands: Column, names: Sequence[str]) -> Column:
    """Name of the largest band, the first of equals; N/A where there is none or all are about 0."""
    at = F.array_position(bands, F.array_max(bands))
    flat = F.array_max(F.transform(bands, F.abs)) <= 1e-12
    return F.when((F.size(bands) <= 0) | bands.isNull() | flat, "N/A").otherwise(F.try_element_at(F.array(*map(F.lit, names)), at.cast("int")))


def face_box(points: Column, width: Column, height: Column) -> Column:
    """Box of the points in pixels (clipped to the image, whole numbers), a quality from its area, and a status."""
    pixel = lambda c, size: F.transform(points, lambda p: F.least(F.greatest(p[c] * size, F.lit(0.0)), size - 1).cast("int"))
    xs, ys = pixel("x", width), pixel("y", height)
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    quality = F.least(F.greatest((x1 - x0) * (y1 - y0) / (width * height) * 14, F.lit(0.0)), F.lit(1.0))
    status = F.when(F.size(points) <= 0, "NOT DETECTED").when(quality < 0.35, "LOW").otherwise("TRACKING")
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), quality.alias("quality"), status.alias("status"))


def usability_hints(share: Column, margin: Column, brightness: Column, quality: Column) -> Column:
    hints = F.concat_ws(
        " · ", F.when(share < 0.22, "move closer"), F.when(margin < 4, "centre the face"), F.when(brightness < 45, "more light"), F.when(quality < 0.35, "hold still")
    )
    return F.when(hints == "", "usable").otherwise(hints)


def log_power(power: Column, eps: float = 1e-10) -> Column:
    return F.log10(power + F.lit(eps))


def warmup_label(elapsed: Column, rate: Column, needed: float = 60.0) -> Column:
    """The time still needed, then the rate."""
    return F.when(elapsed < needed, F.format_string("warming up %.0f s", needed - elapsed)).otherwise(F.format_string("%.1f per min", rate))


def suggested_name(scores: Mapping[str, Column], least: float = 0.5, low: str = "low-motion") -> Column:
    """Label of the largest score, of equal scores the greatest label; ``low`` where none reaches ``least``."""
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(k).alias("k")) for k, s in scores.items()]))
    return F.when(best["s"] < least, low).otherwise(best["k"])


def is_artifact(*means: Column, threshold: float = 0.5) -> Column:
    return reduce(lambda a, b: a | b, [m > threshold for m in means])


def confidence(uncertainty: Column) -> Column:
    """1 / (1 + mean uncertainty) of a vector, within [0, 1]; null where that mean is not above 0."""
    mean = F.aggregate(uncertainty, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(uncertainty), F.lit(0))
    return F.when(mean > 0, F.least(F.greatest(1 / (1 + mean), F.lit(0.0)), F.lit(1.0)))


def display_levels(ear: Column, mar: Column, brow: Column, energy: Column) -> dict[str, Column]:
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return {
        "eye_closure": unit(1 - ear / 0.35), "jaw": unit(mar / 0.40), "brow": unit(brow / 2), "energy": unit(25 * energy),
        "eyes_closed": ear < 0.20, "mouth_open": mar > 0.15,
    }


def feature_slice(features: Column, part: str, landmarks: int = 1404, geometry: int = 11) -> Column:
    """The columns of a full feature vector that an ablation keeps."""
    total = F.size(features)
    slices = {
        "landmarks": lambda: F.slice(features, 1, landmarks),
        "geometry": lambda: F.slice(features, landmarks + 1, geometry),
        "static": lambda: F.slice(features, 1, landmarks + geometry),
        "dynamics": lambda: F.slice(features, F.lit(landmarks + geometry + 1), total - landmarks - geometry),
        "full": lambda: features,
    }
    if part not in slices:
        raise ValueError(f"unknown part {part!r}; one of {', '.join(slices)}")
    return slices[part]()


def without(features: Column, positions: Sequence[int]) -> Column:
    """An array less some positions (from 0)."""
    return F.filter(features, lambda _, i: ~i.isin(*positions))
