"""Reading and writing recordings, sessions, windows and results."""

from __future__ import annotations

import math
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a recording, in order.
RECORDING = ("timestamp", "EAR", "MAR", "pitch", "yaw", "roll", "blink_flag", "au_brow_raise_AU", "au_jaw_open_AU", "au_smile_AU12", "face_detected")
RECORDING_SCHEMA = ", ".join(f"{c} {'int' if c in ('blink_flag', 'face_detected') else 'double'}" for c in RECORDING)


def read_recording(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORDING_SCHEMA).option("header", True).csv(path)


def write_recording(df: DataFrame, path: str) -> None:
    """The fixed columns in their order; a column that is missing is written empty."""
    df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("int" if c in ("blink_flag", "face_detected") else "double").alias(c) for c in RECORDING]).write.mode("overwrite").option("header", True).csv(path)


#: Folders that sessions are dealt to, however many there are: a folder each would make as many small files.
FOLDERS = 16


def in_folders(df: DataFrame, session: str = "session", folders: int = FOLDERS) -> DataFrame:
    """Adds ``folder``: where the rows of a session are written."""
    return df.withColumn("folder", F.pmod(F.xxhash64(session), F.lit(folders)).cast("int"))


def write_session(df: DataFrame, path: str, session: str = "session") -> None:
    """Rows by folder, those of a session in one; files are as many as tasks times folders at most."""
    in_folders(df, session).write.mode("overwrite").partitionBy("folder").parquet(path)


def plain(value: Column) -> Column:
    """A number for JSON: NaN and infinite become null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def write_results(df: DataFrame, path: str) -> None:
    kinds = dict(df.dtypes)
    df.select(*[plain(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, window_id, subject, facial, eeg) of NumPy archives with equally long arrays facial [N, T, D], eeg [N, S] and subjects [N].
    An archive that lacks an array, or whose lengths differ, is an error."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(BytesIO(content), allow_pickle=False) as z:
                    if missing := {"facial", "eeg", "subjects"} - set(z.files):
                        raise ValueError(f"{name} lacks {', '.join(sorted(missing))}")
                    facial, eeg, subjects = z["facial"], z["eeg"], z["subjects"]
                if not len(facial) == len(eeg) == len(subjects):
                    raise ValueError(f"{name}: arrays of different lengths")
                for i in range(0, len(eeg), 256):
                    part = slice(i, i + 256)
                    n = len(eeg[part])
                    yield pd.DataFrame({"path": [name] * n, "window_id": np.arange(i, i + n), "subject": subjects[part].astype(str), "facial": [[r.tolist() for r in w] for w in facial[part]], "eeg": eeg[part].tolist()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, "path string, window_id long, subject string, facial array<array<float>>, eeg array<float>")


def subject_of(path: Column) -> Column:
    """Subject of a session folder's file: the folder's name up to its first underscore."""
    return F.substring_index(F.element_at(F.split(path, "/"), -2), "_", 1)


def read_sessions(spark: SparkSession, top: str) -> tuple[DataFrame, DataFrame]:
    """Frames and samples of all valid sessions, as ``write_session`` leaves them in ``frames`` and ``samples`` below a folder: each with ``session`` and
    ``subject``, its text up to the first underscore. A session without rows of either is skipped."""
    one = lambda name: spark.read.parquet(f"{top.rstrip('/')}/{name}").drop("folder").withColumn("session", F.col("session").cast("string")).withColumn("subject", F.substring_index("session", "_", 1))
    frames, samples = one("frames"), one("samples")
    valid = frames.select("session").intersect(samples.select("session"))
    return frames.join(valid, "session", "left_semi"), samples.join(valid, "session", "left_semi")


def session_catalogue(frames: DataFrame, window: int, session: str = "session", subject: str = "subject") -> DataFrame:
    """(subject, sessions, windows): what each subject has, with windows of ``window`` frames."""
    sizes = frames.groupBy(subject, session).agg(F.floor(F.count("*") / window).alias("n"))
    return sizes.groupBy(subject).agg(F.count("*").alias("sessions"), F.sum("n").alias("windows"))


def is_synthetic(path: Column, metadata: Column) -> Column:
    """Whether the file's stem holds ``synth`` or the metadata ``synthetic``, in any case."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))
    return F.contains(stem, F.lit("synth")) | F.coalesce(F.contains(F.lower(metadata), F.lit("synthetic")), F.lit(False))


def posterior_channels(df: DataFrame, names: list[str] | None, channel: str = "channel", drop: str = "Status", prefix: str = "EXG", most: int = 32, order: str = "channel_idx") -> DataFrame:
    """Samples of the named channels, or of the first ``most`` that are neither status nor external."""
    if names:
        return df.where(F.col(channel).isin(names))
    kept = df.select(channel, order).distinct().where((F.col(channel) != drop) & ~F.startswith(F.col(channel), F.lit(prefix))).orderBy(order).limit(most).select(channel)
    return df.join(F.broadcast(kept), channel)


def planted_windows(spark: SparkSession, subjects: int = 8, per_subject: int = 60, length: int = 64, samples: int = 128, rate: float = 256.0, weight: float = 2.0, noise: float = 0.3, seed: int = 42) -> DataFrame:
    """(window_id, subject, ear, eeg) with a planted link from the mean eye ratio to alpha power. Every window has its own seed, so
    the result does not hang on partitioning."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.arange(samples) / rate
        for pdf in batches:
            for i in pdf["id"]:
                subject = int(i) // per_subject
                own = np.random.default_rng([seed, subject])
                rng = np.random.default_rng([seed, 1, int(i)])
                level = own.normal(0.28, 0.03) + rng.normal(0, 0.04)
                ear = level + rng.normal(0, 0.01, length)
                power = np.exp(own.normal(0, 0.3) + weight * (ear.mean() - 0.28) / 0.04 * 0.1 + rng.normal(0, noise * 0.1))
                eeg = sum(a * np.sin(2 * np.pi * f * t + rng.uniform(0, 2 * np.pi)) for f, a in ((6, 1), (10, float(np.sqrt(power))), (20, 0.5), (40, 0.25))) + rng.normal(0, 0.1, samples)
                yield pd.DataFrame({"window_id": [i], "subject": [f"s{subject:03d}"], "ear": [ear.tolist()], "eeg": [eeg.tolist()]})

    return spark.range(subjects * per_subject).mapInPandas(work, "window_id long, subject string, ear array<double>, eeg array<double>")


def planted_oscillations(spark: SparkSession, subjects: int = 4, per_subject: int = 60, samples: int = 128, rate: float = 256.0, seed: int = 42) -> DataFrame:
    """(window_id, subject, movement, eeg): a second planted link. Movement lowers slow and raises fast oscillations; every window is standardised. All is
    built-in expressions, and the random numbers are hashes of the window, so the result does not hang on partitioning."""
    uniform = lambda *k: (F.pmod(F.xxhash64(F.lit(seed), "window_id", *k), F.lit(1 << 30)) + 0.5) / (1 << 30)
    normal = lambda k: F.sqrt(-2 * F.log(uniform(F.lit(1), k))) * F.cos(2 * math.pi * uniform(F.lit(2), k))
    m, f = F.col("movement"), F.col("factor")
    rows = spark.range(subjects * per_subject).select(F.col("id").alias("window_id"), F.format_string("sub-%02d", F.floor(F.col("id") / per_subject) + 1).alias("subject"))
    rows = rows.withColumns({"movement": 0.05 + 0.9 * uniform(F.lit(3)), "factor": 0.8 + 0.4 * uniform(F.lit(4))})
    # Frequency, amplitude at rest, and its change with movement
    waves = [(10.0, 1.2, -1.0), (20.0, 0.2, 0.8), (6.0, 0.7, -0.4), (40.0, 0.1, 0.5)]
    wave = lambda i: sum((F.greatest(F.lit(0.1), a + b * m) * F.sin(2 * math.pi * w * f * i / rate) for w, a, b in waves), 0.08 * normal(i))
    rows = rows.withColumn("eeg", F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), wave))
    mean = F.aggregate("eeg", F.lit(0.0), lambda t, x: t + x) / samples
    rows = rows.withColumn("__m", mean)
    rows = rows.withColumn("__s", F.sqrt(F.aggregate("eeg", F.lit(0.0), lambda t, x: t + (x - F.col("__m")) * (x - F.col("__m"))) / samples) + 1e-6)
    return rows.select("window_id", "subject", "movement", F.transform("eeg", lambda x: (x - F.col("__m")) / F.col("__s")).alias("eeg"))
