"""Frame windows and their alignment with samples of another clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facewave.operators import segments
from facewave.operators.segments import centre_index, frame_windows

__all__ = ["align", "alignment_report", "attach_markers", "centre_index", "frame_windows", "numbered"]


def numbered(samples: DataFrame, session: str = "session", ts: str = "ts", tie: str = "sample_idx", rows: int = segments.ROWS) -> DataFrame:
    return segments.ranked(samples, "idx", session, ts, tie, rows)


def align(windows: DataFrame, samples: DataFrame, width: int, session: str = "session", ts: str = "ts", value: str = "value", rows: int = segments.ROWS) -> DataFrame:
    """Windows with the ``width`` samples about their centre as ``segment``; windows that reach beyond the samples go.

    Samples are kept as arrays of ``width``, so a window joins two of them and cuts its segment; no sample is repeated."""
    blocks = numbered(samples, session, ts, rows=rows).groupBy(session, F.floor(F.col("idx") / width).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", value))), lambda x: x[value]).alias("values"))
    at = centre_index(windows, samples, session, ts, rows).withColumn("from", F.col("idx") - width // 2).where("from >= 0").withColumn("block", F.floor(F.col("from") / width))
    pair = at.join(blocks, [session, "block"]).join(blocks.select(session, (F.col("block") - 1).alias("block"), F.col("values").alias("next")), [session, "block"], "left")
    segment = F.slice(F.concat("values", F.coalesce("next", F.array().cast("array<double>"))), (F.col("from") % width + 1).cast("int"), F.lit(width))
    return pair.withColumn("segment", segment).where(F.size("segment") == width).drop("block", "values", "next", "from")


def alignment_report(aligned: DataFrame, samples: DataFrame, tolerance: float, session: str = "session", ts: str = "ts") -> DataFrame:
    """Of each session its windows and how many have a sample strictly within the tolerance at their index."""
    at = numbered(samples, session, ts).select(session, "idx", F.col(ts).alias("__t"))
    found = aligned.join(at, [session, "idx"], "left")
    return found.groupBy(session).agg(F.count("*").alias("windows"), F.sum(F.when(F.abs(F.col("__t") - F.col("centre")) < tolerance, 1).otherwise(0)).alias("aligned"))


def attach_markers(windows: DataFrame, markers: DataFrame, bucket: float, session: str = "session", ts: str = "ts") -> DataFrame:
    """Markers with each window that holds them. Windows are entered in every time bucket they touch, so the join is by
    equality and a marker meets only windows near it."""
    spread = windows.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_time") / bucket), F.floor(F.col("end_time") / bucket))))
    return markers.withColumn("__b", F.floor(F.col(ts) / bucket)).join(spread, [session, "__b"]).where(F.col(ts).between(F.col("start_time"), F.col("end_time"))).drop("__b")
