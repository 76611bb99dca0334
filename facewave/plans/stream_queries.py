"""The live loop over a replay of ``events``: the table is read as a stream, all of it, and what the stream wrote is the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facewave.plans import frame_queries
from facewave.plans.tables import FRAMES
from facewave.sources.shared import shared_top
from facewave.streaming import live

ENTRIES: dict = {}


def entry(name: str, sql: str | None = None):
    def keep(query):
        ENTRIES[name] = (query, sql)
        return query

    return keep


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"{sf_dir}/events.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    single = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isFile()
    # a stream reads a folder of part files by its name; a single file only by a pattern
    raw = spark.readStream.schema(spark.read.parquet(name).schema).parquet(f"{name[:-1]}[{name[-1]}]" if single else name)
    return raw.select(F.col("user_id").alias("session"), F.col("event_id").alias("frame_idx"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("ear"), (F.col("event_type") != "error").alias("face"), "event_type", F.get_json_object("props", "$.k").cast("double").alias("k"))


def _closed(stream: DataFrame, spark: SparkSession, sf_dir: str, after: str) -> DataFrame:
    """The stream and one row, of no session, that is ``after`` later than all: it takes the watermark past every interval, so that all of them are given out."""
    path = f"{shared_top(spark)}/stream-{uuid.uuid4().hex}/end"
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg((F.max("ts").cast("timestamp") + F.expr(f"interval {after}")).alias("ts"))
    last.select(*[(F.col("ts") if c == "ts" else F.lit(True) if c == "face" else F.lit(None)).cast(kind).alias(c) for c, kind in stream.dtypes]).write.parquet(path)
    return stream.union(spark.readStream.schema(stream.schema).parquet(path))


def _ran(df: DataFrame) -> DataFrame:
    """Runs a stream to its present end and reads what it wrote to the folder that all machines share."""
    spark = df.sparkSession
    path = f"{shared_top(spark)}/stream-{uuid.uuid4().hex}"
    df.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").option("path", f"{path}/rows").start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


@entry("r1_stream_blinks", f"{frame_queries._blink} SELECT frame_idx, CAST(event AS INTEGER) AS event, CAST(least(sum(event) OVER (PARTITION BY session ORDER BY us RANGE BETWEEN 432000000000 PRECEDING AND CURRENT ROW), 300) AS INTEGER) AS rate, CAST(coalesce(k - lag(k) {frame_queries.W}, 0) AS DOUBLE) AS pitch_velocity FROM b")
def r1(spark: SparkSession, d: str) -> DataFrame:
    return _ran(live.blinks(_stream(spark, d), 20, 432000, late="40 days", pose=["k"])).select("frame_idx", "event", "rate", F.col("pose_velocity")[0].alias("pitch_velocity"))


@entry("r2_stream_windows", frame_queries.ENTRIES["w9_trailing_window"][1])
def r2(spark, d):
    return _ran(live.windows(_stream(spark, d), 3, "40 days")).select("frame_idx", F.round("mean", 6).alias("mean"))


# a window's mean, against 250 and in units of 100, comes from one of two components half a unit to either side
_high = "1 / (1 + exp(-2 * 4.0 * 0.5 * (m - 250) / 100))"


@entry("r3_stream_state", f"{FRAMES}, q AS (SELECT *, sum(CASE WHEN face THEN 0 ELSE 1 END) {frame_queries.W} AS run FROM fr), w AS (SELECT frame_idx, face, avg(ear) OVER w AS m, count(*) FILTER (face) OVER w AS n FROM q WINDOW w AS (PARTITION BY session, run ORDER BY ts, frame_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), s AS (SELECT frame_idx, face AND n = 3 AS able, {_high} AS h FROM w) SELECT frame_idx, CASE WHEN NOT able THEN 'N/A' WHEN h > 0.5 THEN 'open (' || CAST(round(h * 100) AS INTEGER) || '%)' ELSE 'narrow (' || CAST(round((1 - h) * 100) AS INTEGER) || '%)' END AS state FROM s")
def r3(spark, d):
    import numpy as np

    from facewave.operators import models

    mixture = models.Mixture(np.array([0.5, 0.5]), np.array([[-0.5], [0.5]]), np.full((2, 1, 1), 0.25), True)
    model = live.StateModel(np.array([250.0, 0, 0, 0, 0]), np.array([100.0, 1, 1, 1, 1]), models.Components(np.zeros(5), np.eye(1, 5), np.ones(1)), mixture, ["narrow", "open"], frames=3)
    return _ran(live.facial_state(_stream(spark, d), model, ["ear"], late="40 days")).select("frame_idx", "state")


@entry("r4_stream_rate_limit", frame_queries.ENTRIES["w15_rate_limit"][1])
def r4(spark, d):
    return _ran(live.blinks(_stream(spark, d), 20, least=86400, late="40 days")).select("frame_idx", "emitted")


@entry("r5_stream_telemetry", f"{FRAMES} SELECT session, CAST(floor(us / 86400000000) AS BIGINT) AS day, count(*) AS frames, CAST(sum(CASE WHEN face THEN 0 ELSE 1 END) AS BIGINT) AS lost FROM fr GROUP BY 1, 2")
def r5(spark, d):
    x = _ran(live.telemetry(_closed(_stream(spark, d), spark, d, "42 days"), "1 day", "40 days"))
    return x.where("session is not null").select("session", F.floor(F.col("start").cast("long") / 86400).alias("day"), "frames", "lost")


@entry("r6_stream_presence", f"{FRAMES}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY session ORDER BY us) < 86400000000 THEN 0 ELSE 1 END AS n FROM fr WHERE face), q AS (SELECT *, sum(n) OVER (PARTITION BY session ORDER BY us) AS run FROM g) SELECT session, round(min(ts), 3) AS start, count(*) AS frames FROM q GROUP BY session, run")
def r6(spark, d):
    return _ran(live.presence(_closed(_stream(spark, d), spark, d, "42 days"), "1 day", "40 days")).where("session is not null").select("session", F.round(F.unix_micros("start") / 1e6, 3).alias("start"), "frames")


@entry("r7_stream_recording", f"{FRAMES}, m AS (SELECT session, count(*) AS markers FROM fr WHERE event_type = 'signup' GROUP BY session) SELECT session, count(*) AS frames, round(sum(ear), 4) AS ear, round(min(ts), 3) AS first, CAST(sum(k) AS DOUBLE) AS pitch, CAST(sum(CASE WHEN ear < 20 THEN 1 ELSE 0 END) AS BIGINT) AS blinks, CAST(sum(CASE WHEN face THEN 1 ELSE 0 END) AS BIGINT) AS faces, count(*) - count(*) AS smiles, coalesce(any_value(markers), 0) AS markers FROM fr LEFT JOIN m USING (session) GROUP BY session")
def r7(spark, d):
    path = f"{shared_top(spark)}/stream-{uuid.uuid4().hex}"
    x = _stream(spark, d)
    seconds = F.unix_micros("ts") / 1e6
    rows = live.recording(x.select("session", seconds.alias("timestamp"), F.col("ear").alias("EAR"), F.col("k").alias("pitch"), (F.col("ear") < 20).alias("blink_flag"), F.col("face").alias("face_detected")))
    live.record(rows, f"{path}/frames", f"{path}/state-frames").awaitTermination()
    live.record(x.where("event_type = 'signup'").select("session", seconds.alias("ts")), f"{path}/markers", f"{path}/state-markers").awaitTermination()
    read = lambda name, like: spark.read.schema(like.schema).parquet(f"{path}/{name}")
    markers = spark.read.schema("session long, ts double").parquet(f"{path}/markers").groupBy("session").agg(F.count("*").alias("markers"))
    total = read("frames", rows).groupBy("session").agg(F.count("*").alias("frames"), F.round(F.sum("EAR"), 4).alias("ear"), F.round(F.min("timestamp"), 3).alias("first"), F.sum("pitch").alias("pitch"), F.sum("blink_flag").alias("blinks"), F.sum("face_detected").alias("faces"), F.count("au_smile_AU12").alias("smiles"))
    return total.join(markers, "session", "left").fillna(0, ["markers"])


@entry("r8_stream_alignment", f"{FRAMES} SELECT a.frame_idx, b.frame_idx AS sample_idx, b.ear AS value FROM fr a JOIN fr b ON a.session = b.session AND a.event_type = 'click' AND b.event_type = 'error' AND b.us BETWEEN a.us - 86400000000 AND a.us")
def r8(spark, d):
    x = _stream(spark, d)
    samples = x.where("event_type = 'error'").select("session", "ts", F.col("frame_idx").alias("sample_idx"), F.col("ear").alias("value"))
    return _ran(live.aligned(x.where("event_type = 'click'"), samples, "1 day", "40 days")).select("frame_idx", "sample_idx", "value")
