"""Streams in several batches: states end, late rows are counted and change nothing else."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from facewave.streaming import live

SCHEMA = "session long, frame_idx long, ts timestamp, ear double, face boolean"


class Feed:
    """A folder that a stream reads, a batch of frames (session, frame, second, ear, face) at a time."""

    def __init__(self, spark, folder, make, name=None):
        self.spark, self.folder, self.make, self.name = spark, folder, make, name

    def push(self, rows, schema="session long, frame_idx long, second double, ear double, face boolean"):
        df = self.spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("second"))).drop("second")
        df.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        out = self.make(self.spark.readStream.schema(df.schema).parquet(f"{self.folder}/in"))
        writer = out.writeStream.outputMode("append").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{self.folder}/out")
        query = (writer.queryName(self.name) if self.name else writer).start()
        query.awaitTermination()
        held = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]][-1]
        return query, held, self.spark.read.schema(out.schema).parquet(f"{self.folder}/out").collect()


def frames(session, seconds, ear=0.3, first=0):
    return [(session, first + i, float(t), ear, True) for i, t in enumerate(seconds)]


@pytest.mark.parametrize("make", [lambda x: live.blinks(x, 0.2, idle="60 seconds"), lambda x: live.windows(x, 2, idle="60 seconds"), lambda x: live.facial_state(x, None, ["ear"], idle="60 seconds")], ids=["blinks", "windows", "state"])
def test_sessions_end(spark, tmp_path, make):
    feed = Feed(spark, tmp_path, make)
    _, held, _ = feed.push(frames(1, range(5)) + frames(2, range(5)) + frames(3, range(5)))
    assert held == 3
    _, held, _ = feed.push(frames(3, [200], first=5))  # the watermark passes the last frame of 1 and 2 by more than a minute
    assert held == 1
    _, held, rows = feed.push(frames(1, [210, 211], first=5))  # a session that comes back begins anew
    assert held == 2
    assert {r.session for r in rows} == {1, 2, 3}


def test_a_session_carries_on_between_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda x: live.blinks(x, 0.2, idle="60 seconds"))
    feed.push([(1, 0, 0.0, 0.3, True), (1, 1, 1.0, 0.1, True)])
    _, _, rows = feed.push([(1, 2, 2.0, 0.1, True), (1, 3, 3.0, 0.3, True), (1, 4, 4.0, 0.1, True)])
    assert sorted((r.frame_idx, r.event, r.rate) for r in rows) == [(0, 0, 0), (1, 1, 1), (2, 0, 1), (3, 0, 1), (4, 1, 2)]


def test_late_frames_are_dropped_and_counted(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda x: live.blinks(x, 0.2, late="10 seconds"))
    feed.push(frames(1, range(0, 100, 10)))
    query, _, rows = feed.push([(1, 90, 3.0, 0.1, True), (1, 91, 95.0, 0.1, True)])
    assert live.late_rows(query) == 1
    assert sorted(r.frame_idx for r in rows) == [*range(10), 91]
    assert [r.event for r in rows if r.frame_idx == 91] == [1]


def test_late_samples_of_an_alignment(spark, tmp_path):
    listener = live.LateRows()
    spark.streams.addListener(listener)
    try:
        make = lambda x: live.aligned(x.where("face"), x.where("not face").select("session", "ts", F.col("frame_idx").alias("sample_idx"), F.col("ear").alias("value")), "5 seconds", "10 seconds")
        feed = Feed(spark, tmp_path, make, "alignment")
        _, _, before = feed.push([(1, i, float(i), 0.1, i % 2 == 0) for i in range(100)])
        query, _, after = feed.push([(1, 500, 3.0, 0.1, False), (1, 501, 99.5, 0.1, False), (1, 502, 100.0, 0.1, True)])
        assert live.late_rows(query) == 1
        assert {r.sample_idx for r in after} - {r.sample_idx for r in before} == {99, 501}
        assert [(r.frame_idx, r.sample_idx) for r in after if r.frame_idx == 502] and all(r.sample_idx != 500 for r in after)
        for _ in range(50):  # listeners hear of it a little later
            if listener.dropped["alignment"]:
                break
            time.sleep(0.2)
        assert listener.dropped["alignment"] == 1
    finally:
        spark.streams.removeListener(listener)


def test_intervals_are_given_out_and_given_up(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda x: live.telemetry(x, "10 seconds", "10 seconds"))
    _, held, rows = feed.push(frames(1, range(40)))
    assert sorted(r.frames for r in rows) == [10, 10] and held == 2
    query, held, rows = feed.push(frames(1, [2, 45, 100], first=90))
    assert live.late_rows(query) == 1
    assert sorted((r.start.timestamp() - 1_700_000_000, r.frames) for r in rows) == [(0, 10), (10, 10), (20, 10), (30, 10), (40, 1)] and held == 1


def test_presence_ends(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda x: live.presence(x, "5 seconds", "10 seconds"))
    feed.push(frames(1, [0, 1, 2, 20, 21]))
    _, held, rows = feed.push(frames(1, [60]))
    assert sorted(r.frames for r in rows) == [2, 3] and held == 1
