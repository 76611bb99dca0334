"""Spectra of windows and long signals.

``welch`` is the one kernel: NumPy over a batch of equal-length signals. All else is built-in expressions over its output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.window import Window

from facewave.functions.facial import once
from facewave.operators.sequence import numbered

#: EEG bands in Hz, lower end in and upper end out.
BANDS: dict[str, tuple[float, float]] = {"delta": (0.5, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "gamma": (30, 100)}


def welch(x: np.ndarray, rate: float, size: int, overlap: int | None = None) -> np.ndarray:
    """One-sided density [rows, size // 2 + 1]: Hann segments (periodic) with their mean taken off, averaged."""
    size = min(size, x.shape[1])
    hop = size - (size // 2 if overlap is None else overlap)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if size > 1 else np.ones(1)
    total = np.zeros((len(x), size // 2 + 1))
    starts = range(0, x.shape[1] - size + 1, hop)
    for s in starts:
        part = x[:, s : s + size]
        total += np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2
    total /= len(starts) * rate * (w * w).sum()
    total[:, 1 : total.shape[1] - (size % 2 == 0)] *= 2
    return total


def psd(df: DataFrame, key: str, signal: str, rate: float, size: int = 512) -> DataFrame:
    """(key, bin, freq, power) of each row's signal (array). Empty signals have no rows."""
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf[signal].map(lambda v: v is not None and len(v) > 0)]
            for n, rows in pdf.groupby(pdf[signal].map(len)):
                p = welch(np.array(rows[signal].tolist(), float), rate, size)
                bins = np.arange(p.shape[1])
                yield pd.DataFrame({"key": np.repeat(rows[key].to_numpy(), len(bins)), "bin": np.tile(bins, len(rows)), "freq": np.tile(bins * rate / min(size, n), len(rows)), "power": p.ravel()})

    return df.select(key, signal).mapInPandas(work, f"key {kind}, bin int, freq double, power double").withColumnRenamed("key", key)


def band_power(spectrum: DataFrame, key: str, rate: float, bands: Mapping[str, tuple[float, float]] = BANDS) -> DataFrame:
    """(key, <band>...): trapezoid of the density over [low, min(high, rate / 2)); a band with fewer than two bins has 0."""
    # the trapezoid from sums: (all bins - half of the first and last) * width
    aggregates = []
    for name, (low, high) in bands.items():
        inside = (F.col("freq") >= low) & (F.col("freq") < min(high, rate / 2))
        ends = (F.min_by("power", F.when(inside, F.col("freq"))) + F.max_by("power", F.when(inside, F.col("freq")))) / 2
        n = F.sum(F.when(inside, 1).otherwise(0))
        width = (F.max(F.when(inside, F.col("freq"))) - F.min(F.when(inside, F.col("freq")))) / (n - 1)
        aggregates.append(F.when(n >= 2, (F.sum(F.when(inside, F.col("power"))) - ends) * width).otherwise(0.0).alias(name))
    return spectrum.groupBy(key).agg(*aggregates)


def signal_features(df: DataFrame, spectrum: DataFrame, key: str, signal: str) -> DataFrame:
    """(key, rms, variance, dominant, entropy) of each signal."""
    n = F.nullif(F.size(signal), F.lit(0))
    mean = F.aggregate(signal, F.lit(0.0), lambda t, x: t + x) / n
    square = F.aggregate(signal, F.lit(0.0), lambda t, x: t + x * x) / n
    base = df.select(key, F.sqrt(square).alias("rms"), (square - mean * mean).alias("variance"))
    total = spectrum.groupBy(key).agg(F.sum("power").alias("__t"), F.max("power").alias("__m"))
    p = F.col("power") / (F.col("__t") + 1e-12)
    parts = spectrum.join(total, key).groupBy(key).agg(F.min(F.when(F.col("power") == F.col("__m"), F.col("freq"))).alias("dominant"), (-F.sum(p * F.log(p + 1e-12))).alias("entropy"))
    return base.join(parts, key)


@F.pandas_udf(ArrayType(DoubleType()))
def magnitudes(x: pd.Series) -> pd.Series:
    """Magnitudes of the one-sided spectrum of each array."""
    return x.map(lambda v: np.abs(np.fft.rfft(np.asarray(v, float))) if v is not None and len(v) else np.empty(0))


def plain_power(values: Column) -> Column:
    """Sum of squared magnitudes of the spectrum of (x - mean), over the length. By Parseval no transform is needed: half the sum
    of squares and, for an even length, half the squared alternating sum over the length."""

    def about(v: Column, mean: Column) -> Column:
        n = F.size(v)
        squares = F.aggregate(v, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean))
        signs = F.sequence(F.lit(0), n - 1)
        alternating = F.aggregate(F.zip_with(v, signs, lambda x, i: F.when(i % 2 == 0, x - mean).otherwise(mean - x)), F.lit(0.0), lambda t, x: t + x)
        return F.when(n < 2, 0.0).otherwise(squares / 2 + F.when(n % 2 == 0, once(alternating, lambda a: a * a) / (2 * n)).otherwise(0.0))

    return once(values, lambda v: once(_mean(v), lambda mean: about(v, mean)))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(values), F.lit(0))


def statistics(values: Column) -> Column:
    """Struct of mean, std (population), min, max, energy and spectral power of one column of a window."""

    def about(v: Column, mean: Column) -> Column:
        n = F.size(v)
        square = F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x) / n
        spread = F.aggregate(v, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean)) / n
        out = {"mean": mean, "std": F.sqrt(spread), "min": F.array_min(v).cast("double"), "max": F.array_max(v).cast("double"), "energy": square, "power": plain_power(v)}
        return F.struct(*[F.when(n < 2, 0.0).otherwise(x).alias(k) for k, x in out.items()])

    return once(values, lambda v: once(_mean(v), lambda mean: about(v, mean)))


def window_statistics(values: Column) -> dict[str, Column]:
    """The fields of ``statistics`` by name. Where several are selected, keep the struct as a column and take them from that."""
    found = statistics(values)
    return {k: found[k] for k in ("mean", "std", "min", "max", "energy", "power")}


def named_statistics(columns: Mapping[str, Column], spectral: Sequence[str]) -> Column:
    """A window's columns (arrays over its frames) as a map from feature name to value, in the order of ``facial.window_feature_names``."""
    names = [(f"{c}_{s}", c, s) for s in ("mean", "std", "min", "max", "energy") for c in columns] + [(f"{c}_spectral_power", c, "power") for c in spectral]
    found = F.struct(*[statistics(v).alias(c) for c, v in columns.items()])
    return once(found, lambda s: F.create_map(*[x for name, c, k in names for x in (F.lit(name), s[c][k])]))


def long_signal_psd(windows: DataFrame, group: str | None, order: str, signal: str, width: int, rate: float, size: int = 512, segments: int = 64) -> DataFrame:
    """(group, bin, freq, power) of windows joined end to end, where segments cross window borders (without a group: one signal of all windows).
    Windows of ``width`` samples go to the blocks of ``segments`` segments they lie in, so a long signal is spread over tasks by block, and a block gives the sums of its segments. A signal shorter than
    ``size`` is one segment of its own length."""
    by = [group] if group else []
    hop = size // 2
    at = numbered(windows.select(*by, order, signal), by, order, "__n").withColumn("__start", F.col("__n") * width)
    first = F.greatest(F.floor((F.col("__start") - size) / hop) + 1, F.lit(0))
    blocks = F.sequence(F.floor(first / segments), F.floor(F.floor((F.col("__start") + width - 1) / hop) / segments))
    parts = at.select(*by, "__start", signal, F.explode(blocks).alias("__block"))

    def work(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__start")
        begin = int(keys[-1]) * segments * hop
        x = np.concatenate(pdf[signal].tolist()).astype(float)
        x = x[begin - int(pdf["__start"].iloc[0]) :][: (segments - 1) * hop + size]
        if len(x) < size and begin or len(x) < 2:
            return pd.DataFrame({c: [] for c in [*by, "bin", "freq", "power", "n"]})
        long = min(size, len(x))
        p = welch(np.lib.stride_tricks.sliding_window_view(x, long)[::hop], rate, size)
        return pd.DataFrame({**dict.fromkeys(by, keys[0]), "bin": np.arange(p.shape[1]), "freq": np.arange(p.shape[1]) * rate / long, "power": p.sum(axis=0), "n": len(p)})

    kind = f"{group} {windows.schema[group].dataType.simpleString()}, " if group else ""
    found = parts.groupBy(*by, "__block").applyInPandas(work, f"{kind}bin int, freq double, power double, n long")
    return found.groupBy(*by, "bin", "freq").agg((F.sum("power") / F.sum("n")).alias("power"))


def spectral_errors(windows: DataFrame, group: str | None, order: str, pred: str, target: str, width: int, rate: float, size: int = 512) -> DataFrame:
    """(group, spectral_correlation, spectral_distance, <band>_power_mae ...) of predicted and true windows joined end to end: agreement of their densities, and the
    gaps of their band powers."""
    by = [group] if group else []
    one = lambda c, name: long_signal_psd(windows, group, order, c, width, rate, size).withColumnRenamed("power", name)
    key = group or "__all"
    both = one(pred, "p").join(one(target, "t").drop("freq"), [*by, "bin"]).withColumn(key, F.col(group) if group else F.lit(0))
    bands = [band_power(both.withColumn("power", F.col(c)), key, rate).select(key, *[F.col(b).alias(f"{b}_{c}") for b in BANDS]) for c in ("p", "t")]
    spread = F.stddev_pop("p") * F.stddev_pop("t")
    out = both.groupBy(key).agg(F.when(spread > 0, F.covar_pop("p", "t") / spread).otherwise(0.0).alias("spectral_correlation"), F.sqrt(F.sum(F.pow(F.col("p") - F.col("t"), 2))).alias("spectral_distance"))
    out = out.join(bands[0], key).join(bands[1], key)
    return out.select(*by, "spectral_correlation", "spectral_distance", *[F.abs(F.col(f"{b}_p") - F.col(f"{b}_t")).alias(f"{b}_power_mae") for b in BANDS])


def spectrogram(df: DataFrame, key: str, signal: str, rate: float, size: int = 128, overlap: int = 96, top: float = 100.0) -> DataFrame:
    """(key, segment, freq, power) of every segment, up to ``top`` Hz."""
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, x in zip(pdf[key], pdf[signal], strict=True):
                if x is None or len(x) < size:
                    continue
                cut = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), size)[:: size - overlap]
                p, freq = welch(cut, rate, size), np.arange(size // 2 + 1) * rate / size
                keep = freq <= top
                yield pd.DataFrame({"key": k, "segment": np.repeat(np.arange(len(p)), keep.sum()), "freq": np.tile(freq[keep], len(p)), "power": p[:, keep].ravel()})

    return df.select(key, signal).mapInPandas(work, f"key {kind}, segment int, freq double, power double").withColumnRenamed("key", key)


def resample(samples: DataFrame, step: float, session: str = "session", ts: str = "ts", value: str = "value") -> DataFrame:
    """(session, ts, value) on a regular grid from each session's first sample, linear between neighbours. Each pair of neighbours
    fills its own grid points, so no as-of join is needed."""
    w = Window.partitionBy(session).orderBy(ts)
    pairs = samples.select(session, F.col(ts).alias("a"), F.col(value).alias("va"), F.lead(ts).over(w).alias("b"), F.lead(value).over(w).alias("vb"), F.min(ts).over(Window.partitionBy(session)).alias("o"))
    first, last = F.ceil((F.col("a") - F.col("o")) / step), F.ceil((F.col("b") - F.col("o")) / step) - 1
    grid = pairs.where(F.col("b") > F.col("a")).where(last >= first).withColumn("i", F.explode(F.sequence(first, last)))
    t = F.col("o") + F.col("i") * step
    return grid.select(session, "i", t.alias(ts), (F.col("va") + (F.col("vb") - F.col("va")) * (t - F.col("a")) / (F.col("b") - F.col("a"))).alias(value))


def butterworth_band(low: float, high: float, rate: float, order: int = 4) -> np.ndarray:
    """Second-order sections [order, 6] of a Butterworth band-pass, by the bilinear transform of the analogue prototype."""
    warp = lambda f: 2 * rate * math.tan(math.pi * f / rate)
    a, b = warp(low), warp(high)
    width, centre = b - a, math.sqrt(a * b)
    poles = [complex(math.cos(t), math.sin(t)) for t in (math.pi * (2 * k + order + 1) / (2 * order) for k in range(order))]
    split = [x for p in poles for root in [np.sqrt(complex((p * width / 2) ** 2 - centre**2))] for x in (p * width / 2 + root, p * width / 2 - root)]
    z = [(2 * rate + s) / (2 * rate - s) for s in split]
    upper = sorted((p for p in z if p.imag > 0), key=abs)
    sections = np.array([[1.0, 0.0, -1.0, 1.0, -2 * p.real, abs(p) ** 2] for p in upper])
    at = np.exp(2j * math.pi * math.sqrt(low * high) / rate)
    # gain one in the middle of the band
    middle = 2 * math.atan(centre / (2 * rate))
    at = np.exp(1j * middle)
    gain = np.prod([(s[0] * at**2 + s[1] * at + s[2]) / (s[3] * at**2 + s[4] * at + s[5]) for s in sections])
    sections[0, :3] /= abs(gain)
    return sections


def notch(freq: float, rate: float, quality: float = 30.0) -> np.ndarray:
    w = 2 * math.pi * freq / rate
    gain = 1 / (1 + math.tan(w / quality / 2))
    return np.array([[gain, -2 * gain * math.cos(w), gain, 1.0, -2 * gain * math.cos(w), 2 * gain - 1]])


def zero_phase(x: np.ndarray, sections: np.ndarray, pad: int) -> np.ndarray:
    """Filters rows forwards and backwards, after an odd extension at both ends."""
    pad = min(pad, x.shape[1] - 1)
    x = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1) if pad > 0 else x.copy()
    for _ in range(2):
        for b0, b1, b2, _, a1, a2 in sections:
            y, z1, z2 = np.empty_like(x), np.zeros(len(x)), np.zeros(len(x))
            for i in range(x.shape[1]):
                v = x[:, i]
                y[:, i] = b0 * v + z1
                z1, z2 = b1 * v - a1 * y[:, i] + z2, b2 * v - a2 * y[:, i]
            x = y
        x = x[:, ::-1]
    return x[:, pad : x.shape[1] - pad] if pad > 0 else x


def clean_windows(df: DataFrame, key: str, signal: str, rate: float, low: float = 0.5, mains: float = 50.0) -> DataFrame:
    """Each signal band-passed, notched and set to mean 0 and deviation 1 (arrays of one length in a batch are filtered together)."""
    top = min(100.0, rate / 2 - 1)
    sections = np.concatenate([butterworth_band(low, top, rate), *([notch(mains, rate)] if mains < rate / 2 else [])])
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {signal} array<double>"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, rows in pdf.groupby(pdf[signal].map(len)):
                y = zero_phase(np.array(rows[signal].tolist(), float), sections, 3 * (2 * len(sections) + 1))
                y = (y - y.mean(axis=1, keepdims=True)) / (y.std(axis=1, keepdims=True) + 1e-8)
                yield pd.DataFrame({key: rows[key].to_numpy(), signal: list(y)})

    return df.where(F.size(signal) > 0).select(key, signal).mapInPandas(work, schema)
