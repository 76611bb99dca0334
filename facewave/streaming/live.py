"""The live loop on Structured Streaming: event time, with a watermark for late frames and an end to every state."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from facewave.operators import models
from facewave.sources.tables import RECORDING, in_folders

FRAMES = "session long, frame_idx long, ts timestamp, ear double, face boolean"
BLINKS = "session long, frame_idx long, ts timestamp, event int, rate int, energy double, emitted boolean, pose_velocity array<double>"
#: No estimate.
NONE = "N/A"


#: Event time without a frame after which a session has ended.
IDLE = "1 hour"


def by_session(frames: DataFrame, fold: Callable[[int, pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]], rows: str, held: str, late: str, idle: str) -> DataFrame:
    """``fold`` over the frames of each session in time order, a batch at a time: from the session, its new frames and what it held (None at first) come rows and what it holds now.

    A session ends when the watermark has passed its last frame by ``idle``: what it held is given up then, and frames that come after that begin anew. Frames behind the watermark are
    dropped and counted (see ``late_rows``)."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    clock = "__clock"  # a day later than ``ts``: watermarks begin in 1970, and so may the clock of a recording

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(batches)
        new = (parts[0] if len(parts) == 1 else pd.concat(parts)).sort_values(["ts", "frame_idx"])
        out, now = fold(key[0], new, state.get if state.exists else None)
        state.update(now)
        state.setTimeoutTimestamp(max(int(new[clock].max().timestamp() * 1000) + wait, state.getCurrentWatermarkMs() + 1))
        yield out

    return frames.withColumn(clock, F.col("ts") + F.expr("interval 1 day")).withWatermark(clock, late).groupBy("session").applyInPandasWithState(work, rows, held, "append", GroupStateTimeout.EventTimeTimeout)


def blinks(frames: DataFrame, threshold: float, seconds: float = 60, decay: float = 0.9, least: float = 0.5, late: str = "10 seconds", most: int = 300, pose: Sequence[str] = (), idle: str = IDLE) -> DataFrame:
    """Blink events, their rate, movement energy, rate-limited emission and the velocities of the angles in ``pose`` (0 for a session's first frame); a session holds a flag, the times of its
    last blinks and a few numbers."""

    def fold(session: int, rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        below, times, energy, last, emitted, angles = held or (False, [], 0.0, float("nan"), float("-inf"), [])
        times, angles, out = list(times), list(angles), []
        oldest = min(times, default=float("inf"))
        turns = rows[list(pose)].to_numpy(float).tolist() if pose else [[]] * len(rows)
        clock = (rows["ts"].to_numpy("datetime64[us]").astype("int64") / 1e6).tolist()
        for t, ear, now in zip(clock, rows["ear"].to_numpy(float).tolist(), turns, strict=True):
            moved, angles = [a - b for a, b in zip(now, angles, strict=True)] if angles else [0.0] * len(now), now
            event = 0
            if ear < threshold:
                event, below = int(not below), True
            elif ear >= threshold:
                below = False
            if event:
                times.append(t)
                oldest = min(oldest, t)
            if oldest < t - seconds or len(times) > most:
                times = [x for x in times if x >= t - seconds][-most:]
                oldest = min(times, default=float("inf"))
            energy = decay * energy + (1 - decay) * (0.0 if last != last or ear != ear else abs(ear - last))
            last = ear if ear == ear else last
            emit = t - emitted >= least
            emitted = t if emit else emitted
            out.append((event, len(times), energy, emit, moved))
        event, rate, energies, emits, moves = zip(*out, strict=True)
        found = pd.DataFrame({"session": session, "frame_idx": rows["frame_idx"].to_numpy(), "ts": rows["ts"].to_numpy(), "event": event, "rate": rate, "energy": energies, "emitted": emits, "pose_velocity": list(moves)})
        return found, (below, times, energy, last, emitted, angles)

    return by_session(frames, fold, BLINKS, "below boolean, times array<double>, energy double, last double, emitted double, angles array<double>", late, idle)


def windows(frames: DataFrame, length: int, late: str = "10 seconds", idle: str = IDLE) -> DataFrame:
    """(session, end, mean, low, high) of the last ``length`` frames, whenever that many are held; a lost face clears them."""

    def fold(session: int, rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        last, out = deque(held[0] if held else (), maxlen=length), []
        for i, ear, face in zip(rows["frame_idx"], rows["ear"], rows["face"], strict=True):
            if not face:
                last.clear()
                continue
            last.append(float(ear))
            if len(last) == length:
                out.append((session, i, sum(last) / length, min(last), max(last)))
        return pd.DataFrame(out, columns=["session", "frame_idx", "mean", "low", "high"]), (list(last),)

    return by_session(frames, fold, "session long, frame_idx long, mean double, low double, high double", "held array<double>", late, idle)


@dataclass(frozen=True)
class StateModel:
    """What a live estimate needs: the normaliser of a window's features, axes, a mixture, and names of its components."""

    mean: np.ndarray
    std: np.ndarray
    axes: models.Components
    mixture: models.Mixture
    names: Sequence[str]
    frames: int = 64
    fps: float = 18.0
    synthetic: bool = False

    def estimate(self, window: np.ndarray) -> str:
        """Name and share of the likeliest component for a window [frames, columns]."""
        return self.estimates(window[None])[0]

    def estimates(self, windows: np.ndarray) -> list[str]:
        """The same for many windows [windows, frames, columns]; the features of one are each column's mean, deviation, least, largest and energy."""
        x = np.concatenate([windows.mean(axis=1), windows.std(axis=1), windows.min(axis=1), windows.max(axis=1), (windows * windows).mean(axis=1)], axis=1)
        log = self.mixture.log_densities(((x - self.mean) / self.std - self.axes.mean) @ self.axes.axes.T)
        share = np.exp(log - log.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return [f"{self.names[k] if k < len(self.names) else f'cluster {k}'} ({p:.0%})" for k, p in zip(best.tolist(), share.max(axis=1).tolist(), strict=True)]


def facial_state(frames: DataFrame, model: StateModel | None, columns: Sequence[str], fps: float = 18.0, late: str = "10 seconds", idle: str = IDLE) -> DataFrame:
    """(session, frame_idx, state): the estimate from the last frames with a face. N/A without a model, with one that was trained on synthetic data or for another frame rate, and while
    fewer frames are held than it needs; a lost face clears them."""
    able = model is not None and not model.synthetic and abs(model.fps - fps) <= 1e-8 + 1e-5 * abs(fps)
    length, many = (model.frames, len(columns)) if able else (1, len(columns))

    def fold(session: int, rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        old = np.array(held[0] if held else [], float).reshape(-1, many)
        every = np.vstack([old, rows[list(columns)].to_numpy(float)])
        ends = np.arange(len(old) + 1, len(every) + 1)
        faces = rows["face"].to_numpy(bool)
        lost = np.maximum.accumulate(np.where(faces, 0, ends))  # where the last frame without a face ends
        state = np.full(len(rows), NONE, object)
        if able:
            full = np.flatnonzero(ends - lost >= length)
            for part in np.array_split(full, len(full) * length * many // (1 << 20) + 1):  # windows of 8 MB at a time
                windows = every[ends[part, None] - length + np.arange(length)]
                sound = np.isfinite(windows).all(axis=(1, 2))
                if sound.any():
                    state[part[sound]] = model.estimates(windows[sound])
        found = pd.DataFrame({"session": session, "frame_idx": rows["frame_idx"].to_numpy(), "state": state})
        return found, (every[max(int(lost[-1]), len(every) - length) :].ravel().tolist(),)

    return by_session(frames, fold, "session long, frame_idx long, state string", "held array<double>", late, idle)


class LateRows(StreamingQueryListener):
    """Counts, for each query by its name (or id), the rows that came behind the watermark and were dropped. Add it to ``spark.streams``. Joins and folds by session count rows; a window's
    aggregation counts what is left of them after the rows of a task and window are added up."""

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.dropped[p.name or str(p.id)] += sum(max(op.numRowsDroppedByWatermark, 0) for op in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query dropped as late, over the progress reports that it keeps."""
    return sum(max(op["numRowsDroppedByWatermark"], 0) for p in query.recentProgress for op in p["stateOperators"])


def telemetry(frames: DataFrame, width: str, late: str = "10 seconds") -> DataFrame:
    """Frames, lost faces and frame rate of each interval, which is given out, and its state given up, once the watermark has passed it (append mode)."""
    seconds = F.col("w.end").cast("double") - F.col("w.start").cast("double")
    out = frames.withWatermark("ts", late).groupBy("session", F.window("ts", width).alias("w")).agg(F.count("*").alias("frames"), F.sum(F.when(F.col("face"), 0).otherwise(1)).alias("lost"))
    return out.select("session", F.col("w.start").alias("start"), "frames", "lost", (F.col("frames") / seconds).alias("fps"))


def presence(frames: DataFrame, gap: str, late: str = "10 seconds") -> DataFrame:
    """Stretches of face presence: frames with a face that are less than ``gap`` apart. A stretch is given out once the watermark has passed its end (append mode)."""
    out = frames.where("face").withWatermark("ts", late).groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("frames"))
    return out.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames")


def aligned(frames: DataFrame, samples: DataFrame, within: str, late: str = "10 seconds") -> DataFrame:
    """Frames with the samples of their session up to ``within`` before them; both sides are bounded by watermarks, and rows behind these are dropped and counted."""
    a = frames.withWatermark("ts", late).alias("f")
    b = samples.withWatermark("ts", late).alias("s")
    return a.join(b, F.expr(f"f.session = s.session and s.ts <= f.ts and s.ts >= f.ts - interval {within}")).select("f.session", "f.frame_idx", F.col("f.ts").alias("ts"), "s.sample_idx", F.col("s.value").alias("value"))


def recording(frames: DataFrame) -> DataFrame:
    """A recording's columns in their order, by session; what the stream lacks is null."""
    return frames.select("session", *[(F.col(c) if c in frames.columns else F.lit(None)).cast("int" if c in ("blink_flag", "face_detected") else "double").alias(c) for c in RECORDING])


def record(frames: DataFrame, path: str, checkpoint: str):
    """Writes a stream to Parquet, what is there now, and returns the query: the rows of a session in one folder. Markers are a stream of their own."""
    return in_folders(frames).writeStream.format("parquet").partitionBy("folder").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
