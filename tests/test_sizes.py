"""Findings on large tables: results that do not hang on the order of rows, and work that does not grow faster than the input."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from facewave.functions import facial
from facewave.operators import hypothesis, metrics, models, spectral
from facewave.sources import tables
from facewave.streaming import live


def test_gaps_of_equal_means_are_zero(spark):
    """The same taxes in another order have sums of doubles that differ in the last digit."""
    rows = []
    for subject in range(200):
        values = np.random.default_rng(subject).permutation([0.01, 0.05, 0.06, 0.07, 0.08, 0.02, 0.03] * 5)
        rows += [(subject, "F", float(x)) for x in values] + [(subject, "O", float(x)) for x in values[::-1]]
        rows += [(1000 + subject, "F", float(x)) for x in values] + [(1000 + subject, "O", 0.04)]
    df = spark.createDataFrame(rows, "subject int, status string, tax double").repartition(7)
    plain = df.groupBy("subject").agg((F.avg(F.when(F.col("status") == "F", F.col("tax"))) - F.avg(F.when(F.col("status") == "O", F.col("tax")))).alias("d"))
    assert plain.where("subject < 1000 and d <> 0").count()  # what is mended
    s = F.col("status")
    gaps = df.groupBy("subject").agg(metrics.mean_gap("tax", s == "F", s == "O").alias("d"))
    found = {r["subject"]: r["d"] for r in gaps.collect()}
    assert {found[i] for i in range(200)} == {0.0}
    assert len({found[i] for i in range(1000, 1200)}) == 1 and found[1000] == pytest.approx(0.32 / 7 - 0.04)
    assert tuple(hypothesis.sign_table(gaps, "d").first())[:2] == (200, 200)


def test_gaps_of_odd_values(spark):
    rows = [(1, "F", 1e300), (1, "O", 1.0), (2, "F", float("inf")), (2, "O", 1.0), (3, "F", 0.5), (4, "F", None), (4, "O", 2.0), (5, "F", 1 / 3), (5, "O", 1e-30), (6, "F", 3.0), (6, "F", None), (6, "O", 1.0)]
    s = F.col("status")
    out = spark.createDataFrame(rows, "subject int, status string, x double").groupBy("subject").agg(metrics.mean_gap("x", s == "F", s == "O").alias("d")).collect()
    assert {r["subject"]: r["d"] for r in out} == {1: 1e300, 2: float("inf"), 3: None, 4: None, 5: pytest.approx(1 / 3), 6: 2.0}


def test_equal_gaps_share_their_rank(spark):
    """Subjects with the same rows in another order are tied: 150 at one size, 50 of them below zero, and 50 without a gap."""
    rows = []
    for subject in range(200):
        values = [float(x) for x in np.random.default_rng(subject).permutation([0.01, 0.05, 0.06, 0.07, 0.08, 0.02, 0.03] * 5)]
        sides = [(values, [0.04]), ([0.04], values), (values, [0.04]), (values, values[::-1])][subject % 4]
        rows += [(subject, s, x) for s, side in zip("FO", sides, strict=True) for x in side]
    s = F.col("status")
    gaps = spark.createDataFrame(rows, "subject int, status string, tax double").repartition(7).groupBy("subject").agg(metrics.mean_gap("tax", s == "F", s == "O").alias("d"))
    out = hypothesis.signed_rank_table(gaps, "d", exact=0).first()
    n = 150
    z = (100 * (n + 1) / 2 - n * (n + 1) / 4) / (n * (n + 1) * (2 * n + 1) / 24 - (n**3 - n) / 48) ** 0.5
    assert (out["n"], out["plus"]) == (n, 100 * (n + 1) / 2)
    assert out["z"] == pytest.approx(z)


def _files(path):
    return len(list(path.rglob("*.parquet")))


def test_many_sessions_are_few_files(spark, tmp_path):
    df = spark.range(3000, numPartitions=2).select(F.format_string("s%d_%d", F.col("id") % 5, F.col("id") % 1000).alias("session"), "id")
    tables.write_session(df, str(tmp_path / "frames"))
    tables.write_session(df.where("id % 2 = 0"), str(tmp_path / "samples"))
    assert _files(tmp_path / "frames") <= 2 * tables.FOLDERS
    read, samples = tables.read_sessions(spark, str(tmp_path))
    assert sorted(read.columns) == ["id", "session", "subject"]
    assert read.count() == 1500 and samples.count() == 1500
    assert sorted(tuple(r) for r in tables.session_catalogue(read, 3).collect()) == [(f"s{i}", 100, 100) for i in range(5)]


def test_many_recorded_sessions_are_few_files(spark, tmp_path):
    spark.range(2000, numPartitions=2).selectExpr("id % 1000 as session", "id / 8 as timestamp").write.parquet(str(tmp_path / "in"))
    stream = live.recording(spark.readStream.schema("session long, timestamp double").parquet(str(tmp_path / "in")))
    live.record(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert _files(tmp_path / "out") <= 2 * tables.FOLDERS
    out = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert sorted((r["session"], r["timestamp"]) for r in out.select("session", "timestamp").collect()) == sorted((i % 1000, i / 8) for i in range(2000))


def test_points_are_normalised_once(spark):
    """A lambda that works out a mean anew for every point makes the work of a row grow with the square or cube of its points."""
    pairs = {n: (i, i + 1) for i, n in enumerate("abcdefgh")}
    assert str(facial.shape(F.col("p"), pairs, 8, (0, 3))).count("aggregate(") <= 4


def test_statistics_of_a_column_are_worked_out_once(spark):
    many = str(spectral.named_statistics({c: F.col(c) for c in "abcd"}, ["a", "b"])).count("aggregate(")
    assert many <= 4 * 6  # mean, square and spread, and of the power mean, squares and alternating sum
    df = str(spectral.plain_power(F.col("a")))
    assert df.count("aggregate(") == 3


def test_statistics_of_short_windows(spark):
    df = spark.createDataFrame([(1, []), (2, [3.0]), (3, [1.0, 2.0]), (4, None)], "id int, x array<double>")
    out = {r["id"]: tuple(r["s"]) if r["s"] else None for r in df.select("id", spectral.statistics(F.col("x")).alias("s")).collect()}
    assert out[1] == out[2] == (0.0,) * 6
    assert out[3] == pytest.approx((1.5, 0.5, 1.0, 2.0, 2.5, 0.5))
    assert out[4] in (None, (None,) * 6)


def test_estimates_of_many_windows_are_those_of_one():
    mixture = models.Mixture(np.array([0.5, 0.5]), np.array([[-0.5], [0.5]]), np.full((2, 1, 1), 0.25), True)
    model = live.StateModel(np.zeros(5), np.ones(5), models.Components(np.zeros(5), np.eye(1, 5), np.ones(1)), mixture, ["low"], frames=3)
    windows = np.random.default_rng(0).normal(size=(500, 3, 1))
    assert model.estimates(windows) == [model.estimate(w) for w in windows]
    assert {e.split(" (")[0] for e in model.estimates(windows)} == {"low", "cluster 1"}


def test_many_blinks_are_counted_in_linear_time(spark, tmp_path):
    """Every second frame begins a blink, and a rate counts the last 300 of them at most."""
    n = 4000
    df = spark.range(n).selectExpr("1L as session", "id as frame_idx", "timestamp_seconds(1700000000 + id) as ts", "if(id % 2 = 1, 0.1D, 0.3D) as ear", "true as face")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = live.blinks(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 0.2, seconds=100)
    out.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
    rows = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).orderBy("frame_idx").collect()
    assert [r["rate"] for r in rows] == [sum(1 for j in range(max(0, i - 100), i + 1) if j % 2) for i in range(n)]
