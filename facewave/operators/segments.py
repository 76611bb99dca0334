"""Sessions larger than a task: they are cut at time bounds, each segment yields what it hands on, these carries are scanned, and a second pass starts each segment from its own.

Only sessions of more than ``rows`` rows are cut, at quantiles of their times, so a segment has about that many rows at most (rows of one time stay together); there are at most the table's rows over
``rows`` such sessions, and their carries are all that a scan sees. Every other session is one segment and pays for nothing but the count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from facewave.operators.splits import some

ROWS = 1 << 20
SEGMENT = "__segment"


@dataclass(frozen=True)
class Cut:
    """Rows with the number of their segment. ``carries`` is the number of segments of sessions that were cut."""

    df: DataFrame
    session: str
    order: tuple[str, ...]
    carries: int  # rows that a carry has at most; 0 where no session was cut

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(self.session, SEGMENT).orderBy(*self.order)

    def so_far(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    def with_columns(self, columns: dict[str, Column]) -> Cut:
        return Cut(self.df.withColumns(columns), self.session, self.order, self.carries)

    def segments(self) -> DataFrame:
        """The rows of sessions that were cut."""
        return self.df.where(F.col(SEGMENT).isNotNull())

    def joined(self, carries: DataFrame) -> DataFrame:
        """Rows with the carry (session, segment, ...) of their segment; null where a session is whole."""
        return self.df.join(some(carries, self.carries), [self.session, SEGMENT], "left")

    def with_before(self, **parts: tuple[str, Column, str]) -> Cut:
        """Adds what the segments before a row's own hand on. A part is (how, column, type): its ``sum`` (0 where there is none), its ``last`` value that is not null, or the
        ``previous`` row's value, in a struct, so that a null there is told from no row."""
        df = self.df
        if self.carries:
            row = F.struct(*self.order)
            known = lambda c: F.max_by(c, F.when(c.isNotNull(), row))
            of = {"sum": F.sum, "last": known, "previous": lambda c: F.max_by(F.struct(c.alias("v")), row)}
            held = self.segments().groupBy(self.session, SEGMENT).agg(*[of[how](c).alias(n) for n, (how, c, _) in parts.items()])
            w = Window.partitionBy(self.session).orderBy(SEGMENT)
            earlier = w.rowsBetween(Window.unboundedPreceding, -1)
            scan = {"sum": lambda c: F.sum(c).over(earlier), "last": lambda c: F.last(c, ignorenulls=True).over(earlier), "previous": lambda c: F.lag(c).over(w)}
            df = self.joined(held.select(self.session, SEGMENT, *[scan[how](F.col(n)).alias(n) for n, (how, *_) in parts.items()]))
        else:
            df = df.withColumns({n: F.lit(None).cast(f"struct<v: {kind}>" if how == "previous" else kind) for n, (how, _, kind) in parts.items()})
        return Cut(df.fillna(0, [n for n, (how, *_) in parts.items() if how == "sum"]), self.session, self.order, self.carries)

    def rows(self, *gone: str) -> DataFrame:
        return self.df.drop(SEGMENT, *gone)


def cut(df: DataFrame, session: str = "session", ts: str = "ts", tie: str = "frame_idx", rows: int = ROWS) -> Cut:
    """``df`` with the segment of each row, null in sessions of at most ``rows`` rows."""
    sizes = df.groupBy(session).agg(F.count("*").alias("__n")).where(F.col("__n") > rows)
    about = sizes.agg(F.max("__n").alias("most"), F.count("*").alias("many")).first()
    if not about["many"]:
        return Cut(df.withColumn(SEGMENT, F.lit(None).cast("int")), session, (ts, tie), 0)
    parts = math.ceil(about["most"] / rows)
    few = some(sizes.select(session), about["many"])
    bounds = df.join(few, session, "left_semi").groupBy(session).agg(F.percentile_approx(ts, [i / parts for i in range(1, parts)], max(10_000, 20 * parts)).alias("__bounds"))
    df = df.join(some(bounds.withColumn("__bounds", F.array_distinct("__bounds")), about["many"]), session, "left")
    return Cut(df.withColumn(SEGMENT, F.size(F.filter("__bounds", lambda b: b < F.col(ts))) + F.when(F.col("__bounds").isNotNull(), 0)).drop("__bounds"), session, (ts, tie), parts * about["many"])


def _known(ear: Column, threshold: float) -> Column:
    return F.when(F.isnan(ear), None).when(ear < threshold, True).when(ear >= threshold, False)


def _events(c: Cut, ear: str, threshold: float) -> Cut:
    c = c.with_columns({"__known": _known(F.col(ear), threshold)}).with_before(__state=("last", F.col("__known"), "boolean"))
    before = F.last("__known", ignorenulls=True).over(c.window.rowsBetween(Window.unboundedPreceding, -1))
    below = F.coalesce(before, F.col("__state"), F.lit(False))
    c = c.with_columns({"event": F.when(F.col("__known") & ~below, 1).otherwise(0)})
    return Cut(c.df.drop("__known", "__state"), c.session, c.order, c.carries)


def blink_events(df: DataFrame, ear: str, threshold: float, session: str = "session", ts: str = "ts", tie: str = "frame_idx", rows: int = ROWS) -> DataFrame:
    """Adds ``event``: 1 where the ratio falls below the threshold and was not below before; NaN and null keep the state, also from one segment to the next."""
    return _events(cut(df, session, ts, tie, rows), ear, threshold).rows()


def blink_rates(df: DataFrame, ear: str, threshold: float, micros: str, seconds: float = 60, most: int = 300, session: str = "session", ts: str = "ts", tie: str = "frame_idx", rows: int = ROWS) -> DataFrame:
    """Adds ``event`` and ``rate``, the events in the closed interval of ``seconds`` up to a frame, ``most`` at most. Later frames of the same time do not count yet. A segment hands on the times of
    its last ``most`` events, as no more can count in one after it."""
    c = _events(cut(df, session, ts, tie, rows), ear, threshold)
    back = int(seconds * 1e6)
    wide = Window.partitionBy(session, SEGMENT).orderBy(micros).rangeBetween(-back, 0)
    same = Window.partitionBy(session, SEGMENT, micros).orderBy(tie).rowsBetween(1, Window.unboundedFollowing)
    here = F.sum("event").over(wide) - F.coalesce(F.sum("event").over(same), F.lit(0))
    if not c.carries:
        return c.with_columns({"rate": F.least(here, F.lit(most))}).rows()
    at = Window.partitionBy(session, SEGMENT).orderBy(F.desc(ts), F.desc(tie))
    last = c.segments().where("event = 1").withColumn("__n", F.row_number().over(at)).where(F.col("__n") <= most).groupBy(session, SEGMENT).agg(F.sort_array(F.collect_list(micros)).alias("__times"))
    every = c.segments().select(session, SEGMENT).distinct().join(last, [session, SEGMENT], "left")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        held, out = [], []
        for times in pdf.sort_values(SEGMENT)["__times"]:
            out.append(held)
            held = [*held, *(times if times is not None else [])][-most:]
        return pdf.sort_values(SEGMENT)[[session, SEGMENT]].assign(__held=pd.Series(out, dtype=object).to_numpy())

    kind = df.schema[session].dataType.simpleString()
    carries = every.groupBy(session).applyInPandas(scan, f"{session} {kind}, {SEGMENT} int, __held array<long>")  # a row for each segment of a session
    earlier = F.size(F.filter(F.coalesce("__held", F.array().cast("array<long>")), lambda t: t >= F.col(micros) - back))
    c = c.with_columns({"__here": here})
    return c.joined(carries).withColumn("rate", F.least(F.col("__here") + earlier, F.lit(most))).drop(SEGMENT, "__held", "__here")


def differences(df: DataFrame, columns: dict[str, str], session: str = "session", ts: str = "ts", tie: str = "frame_idx", rows: int = ROWS) -> DataFrame:
    """Adds for each new name its column's value less the row's before; 0 for the first."""
    c = cut(df, session, ts, tie, rows)
    c = c.with_before(**{f"__before_{n}": ("previous", F.col(x), df.schema[x].dataType.simpleString()) for n, x in columns.items()})
    first = F.row_number().over(c.window) == 1
    found = {n: F.coalesce(F.col(x) - F.when(first, F.col(f"__before_{n}")["v"]).otherwise(F.lag(x).over(c.window)), F.lit(0.0)) for n, x in columns.items()}
    return c.with_columns(found).rows(*[f"__before_{n}" for n in columns])


def face_runs(df: DataFrame, lost: Column, session: str = "session", ts: str = "ts", tie: str = "frame_idx", rows: int = ROWS) -> DataFrame:
    """Adds ``run``, the number of the stretch of frames since the last lost one."""
    one = F.when(lost, 1).otherwise(0)
    c = cut(df, session, ts, tie, rows).with_before(__runs=("sum", one, "long"))
    return c.with_columns({"run": F.sum(one).over(c.so_far()) + F.col("__runs")}).rows("__runs")


def since_blink(df: DataFrame, ear: str, threshold: float, session: str = "session", ts: str = "ts", tie: str = "frame_idx", rows: int = ROWS) -> DataFrame:
    """Adds ``event``, ``blinks`` (events so far) and ``since``, the time since the last of them; null before the first."""
    c = _events(cut(df, session, ts, tie, rows), ear, threshold)
    at = F.when(F.col("event") == 1, F.col(ts))
    c = c.with_before(__blinks=("sum", F.col("event"), "long"), __last=("last", at, df.schema[ts].dataType.simpleString()))
    last = F.coalesce(F.last(at, ignorenulls=True).over(c.so_far()), F.col("__last"))
    return c.with_columns({"blinks": F.sum("event").over(c.so_far()) + F.col("__blinks"), "since": F.col(ts) - last}).rows("__blinks", "__last")


def label_runs(df: DataFrame, label: str, session: str = "session", order: str = "frame_idx", rows: int = ROWS) -> DataFrame:
    """(session, run, label, first, last, frames) of the stretches of equal labels; a stretch goes on over the end of a segment."""
    c = cut(df, session, order, order, rows).with_before(__label=("previous", F.col(label), df.schema[label].dataType.simpleString()))
    first = F.row_number().over(c.window) == 1
    same = F.when(first, F.col("__label").isNotNull() & F.col("__label")["v"].eqNullSafe(F.col(label))).otherwise(F.col(label).eqNullSafe(F.lag(label).over(c.window)))
    c = c.with_columns({"__change": F.when(same, 0).otherwise(1)}).with_before(__runs=("sum", F.col("__change"), "long"))
    run = c.with_columns({"run": F.sum("__change").over(c.so_far()) + F.col("__runs")}).df
    return run.groupBy(session, "run").agg(F.first(label).alias("label"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("frames"))


def ranked(df: DataFrame, name: str, session: str = "session", ts: str = "ts", tie: str = "sample_idx", rows: int = ROWS) -> DataFrame:
    """Adds ``name``, the number of rows of the session before each row."""
    c = cut(df, session, ts, tie, rows).with_before(__count=("sum", F.lit(1), "long"))
    return c.with_columns({name: F.row_number().over(c.window) - 1 + F.col("__count")}).rows("__count")


def frame_windows(frames: DataFrame, length: int, stride: int, session: str = "session", ts: str = "ts", tie: str = "frame_idx", rows: int = ROWS) -> DataFrame:
    """(session, start, start_time, end_time) of windows of ``length`` frames at starts 0, stride, 2 stride, ..."""
    at = ranked(frames.select(session, ts, tie), "start", session, ts, tie, rows)
    ends = at.select(session, (F.col("start") - (length - 1)).alias("start"), F.col(ts).alias("end_time"))
    return at.where(F.col("start") % stride == 0).select(session, "start", F.col(ts).alias("start_time")).join(ends, [session, "start"])


def centre_index(windows: DataFrame, samples: DataFrame, session: str = "session", ts: str = "ts", rows: int = ROWS) -> DataFrame:
    """Adds ``centre`` and ``idx``, the number of samples strictly before it: centres and samples run in one order, in which a centre stands before a sample of the same time."""
    both = windows.withColumn("centre", (F.col("start_time") + F.col("end_time")) / 2)
    marks = both.select(session, F.col("centre").alias("__t"), F.lit(0).alias("__s"), F.struct(*both.columns).alias("__w"))
    marks = marks.unionByName(samples.select(session, F.col(ts).alias("__t"), F.lit(1).alias("__s")), allowMissingColumns=True)
    c = cut(marks, session, "__t", "__s", rows).with_before(__before=("sum", F.col("__s"), "long"))
    here = F.coalesce(F.sum("__s").over(c.window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.with_columns({"idx": here + F.col("__before")}).df.where("__s = 0").select("__w.*", "idx")


def _after(t: np.ndarray, last: np.ndarray, least: float) -> np.ndarray:
    """For each ``last`` the first place with t - last >= least, as that difference is rounded."""
    at = np.searchsorted(t, last + least)
    for _ in range(2):
        down = np.maximum(at - 1, 0)
        at = np.where((at > 0) & (t[down] - last >= least), down, at)
        here = np.minimum(at, len(t) - 1)
        at = np.where((at < len(t)) & ~(t[here] - last >= least), at + 1, at)
    return at


def _exits(t: np.ndarray, least: float) -> np.ndarray:
    """The last emitted time of a segment for each place where emission may begin: doubled jumps from one emitted row to the next."""
    n = len(t)
    to = np.append(np.maximum(_after(t, t, least), np.arange(1, n + 1)), n)
    end = np.append(np.arange(n), n)
    for _ in range(max(1, n.bit_length())):
        end = np.where(to < n, end[to], end)
        to = to[to]
    return t[end[:n]]


def rate_limited(df: DataFrame, session: str = "session", ts: str = "ts", tie: str = "frame_idx", least: float = 0.5, rows: int = ROWS) -> DataFrame:
    """Adds ``emitted``: a frame is emitted if at least ``least`` has passed since the last emitted one.

    A segment's outcome hangs on the time that the one before it emitted last. It hands on, for each row at which its own emission may begin, the last time it would emit; the scan goes through these."""
    c = cut(df, session, ts, tie, rows)
    kind = df.schema[session].dataType.simpleString()
    if c.carries:
        def outcomes(pdf: pd.DataFrame) -> pd.DataFrame:
            t = np.sort(pdf[ts].to_numpy(float))
            exits = _exits(t, least)
            far = int(_after(t, t[:1], least)[0])  # what came before the segment cannot bar a row beyond this one
            keep = np.flatnonzero(np.append(True, exits[1 : far + 1] != exits[:far][: len(exits[1 : far + 1])]))
            last = np.append(keep[1:] - 1, min(far, len(t) - 1))  # of rows with one outcome, the last
            return pd.DataFrame({session: [pdf[session].iloc[0]], SEGMENT: [int(pdf[SEGMENT].iloc[0])], "starts": [t[last].tolist()], "exits": [exits[last].tolist()]})

        def scan(pdf: pd.DataFrame) -> pd.DataFrame:
            entry, out = None, []
            pdf = pdf.sort_values(SEGMENT)
            for starts, exits in zip(pdf["starts"], pdf["exits"], strict=True):
                out.append(entry)
                starts, exits = np.array(starts), np.array(exits)
                at = 0 if entry is None else int(_after(starts, np.array([entry]), least)[0])
                entry = float(exits[at]) if at < len(exits) else entry
            return pdf[[session, SEGMENT]].assign(__entry=pd.Series(out, index=pdf.index, dtype=float))

        held = c.segments().select(session, SEGMENT, ts).groupBy(session, SEGMENT).applyInPandas(outcomes, f"{session} {kind}, {SEGMENT} int, starts array<double>, exits array<double>")
        carries = held.groupBy(session).applyInPandas(scan, f"{session} {kind}, {SEGMENT} int, __entry double")
        marked = c.joined(carries)
    else:
        marked = c.df.withColumn("__entry", F.lit(None).cast("double"))
    schema = StructType([*df.schema, StructField("emitted", BooleanType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for pdf in batches:
            out = []
            for s, k, t, entry in zip(pdf[session], pdf[SEGMENT].fillna(-1), pdf[ts], pdf["__entry"], strict=True):
                if (s, k) != now:  # segments come one after another
                    now, last = (s, k), None if entry != entry or entry is None else entry
                out.append(last is None or t - last >= least)
                if out[-1]:
                    last = t
            yield pdf.drop(columns=[SEGMENT, "__entry"]).assign(emitted=pd.Series(out, index=pdf.index, dtype=bool))

    return marked.select(*df.columns, SEGMENT, "__entry").repartition(session, SEGMENT).sortWithinPartitions(session, SEGMENT, ts, tie).mapInPandas(fold, schema)
