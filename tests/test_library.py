"""Properties and edge cases of the library functions."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facewave.functions import facial
from facewave.operators import alignment, hypothesis, metrics, models, normalise, sequence, spectral, splits, together
from facewave.sources import tables


def test_missing_points_have_no_ratio(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0, 0.0)] * 6), (2, []), (3, None)], "id int, p array<struct<x: double, y: double, z: double>>")
    out = {r["id"]: r["e"] for r in df.select("id", facial.eye_aspect_ratio(F.col("p"), (0, 1, 2, 3, 4, 5)).alias("e")).collect()}
    assert out == {1: 0.0, 2: 0.0, 3: 0.0}


@pytest.mark.parametrize(("angle", "want"), [(180.0, 0.0), (179.0, -1.0), (-179.0, 1.0), (90.0, 90.0), (0.0, 0.0), (540.0, 0.0)])
def test_head_angles_collapse(spark, angle, want):
    got = spark.range(1).select(facial.head_angle(F.lit(angle)).alias("a")).first()["a"]
    assert got == pytest.approx(want)


def test_threshold_needs_a_sound_baseline(spark):
    df = spark.createDataFrame([(0.3,), (0.0,), (float("nan"),), (float("inf"),), (None,)], "b double")
    assert [r[0] for r in df.select(facial.calibrated_threshold(F.col("b"))).collect()] == [pytest.approx(0.195), None, None, None, None]
    with pytest.raises(ValueError):
        facial.calibrated_threshold(F.col("b"), 1.0)


def test_blink_keeps_its_state_over_nan(spark):
    ear = [0.3, 0.1, float("nan"), 0.1, None, 0.3, 0.1]
    df = spark.createDataFrame([(1, i, float(i), e) for i, e in enumerate(ear)], "session int, frame_idx int, ts double, ear double")
    out = df.withColumn("e", sequence.blink_event(F.col("ear"), 0.2, sequence.in_order())).orderBy("frame_idx").collect()
    assert [r["e"] for r in out] == [0, 1, 0, 0, 0, 0, 1]


def test_blink_rate_with_equal_times(spark):
    df = spark.createDataFrame([(1, i, us, 1) for i, us in enumerate([0, 0, 0, 60_000_000, 60_000_001])], "session int, frame_idx int, us long, event int")
    out = df.withColumn("r", sequence.blink_rate("event", "us", "session", "frame_idx")).orderBy("frame_idx").collect()
    assert [r["r"] for r in out] == [1, 2, 3, 4, 2]


def test_energy_does_not_hang_on_chunks(spark):
    rng = np.random.default_rng(1)
    v = rng.random(100)
    df = spark.createDataFrame([(1, i, float(i), float(x)) for i, x in enumerate(v)], "session int, frame_idx int, ts double, v double")
    e, want = 0.0, []
    for x in v:
        e = 0.9 * e + 0.1 * x
        want.append(e)
    for chunk in (7, 100, 256):
        got = [r["energy"] for r in sequence.movement_energy(df, "v", chunk=chunk).orderBy("frame_idx").collect()]
        assert np.allclose(got, want)


def test_a_sample_at_the_centre_is_the_index(spark):
    frames = spark.createDataFrame([(1, i, 10.0 + i) for i in range(3)], "session int, frame_idx int, ts double")
    samples = spark.createDataFrame([(1, i, float(i), float(i)) for i in range(8, 16)], "session int, sample_idx int, ts double, value double")
    out = alignment.align(alignment.frame_windows(frames, 3, 1), samples, 4).collect()
    assert [(r["centre"], r["idx"], r["segment"]) for r in out] == [(11.0, 3, [9.0, 10.0, 11.0, 12.0])]


def test_unseen_subject_uses_all_rows(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", 14.0)], "subject string, x double")
    stats = normalise.fit(train, ["x"])
    new = spark.createDataFrame([("a", 2.0), ("z", 7.0), (None, 7.0)], "subject string, x double")
    out = {r["subject"]: r["x"] for r in normalise.transform(new, stats, ["x"]).collect()}
    assert out["a"] == pytest.approx(0) and out["z"] == pytest.approx(0) and out[None] == pytest.approx(0)
    back = {r["subject"]: r["x"] for r in normalise.inverse(normalise.transform(new, stats, ["x"]), stats, ["x"]).collect()}
    assert back == {"a": pytest.approx(2.0), "z": pytest.approx(7.0), None: pytest.approx(7.0)}


def test_constant_target_r2(spark):
    for pred, want in ((1.0, 1.0), (2.0, 0.0)):
        df = spark.createDataFrame([(pred, 1.0), (pred, 1.0)], "p double, t double")
        assert metrics.regression(df, [], "p", "t").first()["r2"] == want


def test_mid_ranks_over_ranges(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 40, 500)
    df = spark.createDataFrame([(int(x),) for x in v], "v int")
    got = {r["v"]: r["rank"] for r in metrics.mid_ranks(df, "v", parts=8).collect()}
    for x in set(v.tolist()):
        assert got[x] == (v < x).sum() + ((v == x).sum() + 1) / 2


def test_rand_index(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "a int, b int")
    assert metrics.rand_index(df, "a", "b").first()["ari"] == 1.0
    df = spark.createDataFrame([(0, 0)] * 3, "a int, b int")
    assert metrics.rand_index(df, "a", "b").first()["ari"] == 1.0


def test_one_cluster_is_neutral(spark):
    df = spark.createDataFrame([(0, float(i)) for i in range(12)], "label int, v double")
    row = hypothesis.kruskal_wallis(df, "label", "v").first()
    assert (row["h"], row["epsilon2"]) == (0.0, 0.0)


def test_tails():
    assert hypothesis.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert hypothesis.chi_square_tail(0, 3) == 1.0
    assert hypothesis.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert hypothesis.sign_test(0, 0) == 1.0 and hypothesis.sign_test(0, 5) == pytest.approx(2 / 32)
    assert hypothesis.signed_rank(np.array([1.0, 2, 3, 4, 5])) == pytest.approx(2 / 32)
    assert hypothesis.signed_rank(np.zeros(4)) == 1.0


def test_planted_groups_survive_permutation(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, i % 2, float(rng.normal(i % 3))) for i in range(180)]
    df = spark.createDataFrame(rows, "row long, label int, stratum int, v double")
    assert hypothesis.permutation_test(df, "label", "v", ["stratum"], "row", 99).first()["p"] == pytest.approx(0.01)
    constant = df.withColumn("v", F.lit(1.0))
    assert hypothesis.permutation_test(constant, "label", "v", ["stratum"], "row", 9).first()["p"] == 1.0


def test_parseval():
    rng = np.random.default_rng(4)
    for n in (63, 64):
        x = rng.normal(size=n)
        d = x - x.mean()
        want = (np.abs(np.fft.rfft(d)) ** 2).sum() / n
        alternating = (d * (-1.0) ** np.arange(n)).sum()
        assert (d**2).sum() / 2 + (alternating**2 / (2 * n) if n % 2 == 0 else 0) == pytest.approx(want)


def test_welch_finds_a_sine():
    t = np.arange(1024) / 256
    p = spectral.welch(np.sin(2 * np.pi * 10 * t)[None], 256.0, 512)[0]
    assert p.argmax() == 20
    assert p.sum() * 0.5 == pytest.approx(0.5, rel=1e-3)


def test_band_pass_removes_drift_and_mains():
    t = np.arange(4096) / 256
    keep, drop = np.sin(2 * np.pi * 10 * t), 5 + np.sin(2 * np.pi * 50 * t)
    sections = np.concatenate([spectral.butterworth_band(0.5, 100, 256.0), spectral.notch(50, 256.0)])
    y = spectral.zero_phase((keep + drop)[None], sections, 2000)[0]
    assert np.abs(y[1000:-1000] - keep[1000:-1000]).max() < 0.05


def test_long_spectrum_equals_one_signal(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 64))
    df = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(x)], "g int, i int, x array<double>")
    got = [r["power"] for r in spectral.long_signal_psd(df, "g", "i", "x", 64, 256.0, 512).orderBy("bin").collect()]
    assert np.allclose(got, spectral.welch(x.ravel()[None], 256.0, 512)[0])


def test_folds_are_even_and_need_two_subjects(spark):
    df = spark.createDataFrame([(f"s{i % 4}",) for i in range(40)], "subject string")
    folds = splits.subject_folds(df, 2).collect()
    assert sorted(r["fold"] for r in folds) == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        splits.subject_folds(df.where("subject = 's0'"), 2)


def test_bootstrap_keeps_subjects_whole(spark):
    df = spark.createDataFrame([(f"s{i % 3}", i) for i in range(15)], "subject string, i int")
    rows = splits.subject_bootstrap(df, 4).groupBy("boot", "subject", "weight").count().collect()
    assert all(r["count"] == 5 for r in rows)
    totals: dict = {}
    for r in rows:
        totals[r["boot"]] = totals.get(r["boot"], 0) + r["weight"]
    assert set(totals.values()) == {3}


def test_components_and_mixture(spark):
    rng = np.random.default_rng(6)
    centres = np.array([(-5, 0), (0, 5), (5, 0)])
    x = np.concatenate([c + rng.normal(0, 0.35, (40, 2)) for c in centres])
    df = spark.createDataFrame([(i, i // 40, r.tolist()) for i, r in enumerate(x)], "id int, truth int, x array<double>")
    c = models.principal_components(df, "x", 0.95)
    assert c.ratio.sum() == pytest.approx(1) and len(c.axes) == 2
    best = together.fit_mixtures(df, "x", "id", range(2, 5), rounds=30)[1][0]
    assert len(best.weights) == 3
    out = models.assign(df, "x", best)
    assert metrics.rand_index(out, "truth", "label").first()["ari"] > 0.95
    assert models.k_means(df, "x", range(2, 5), (1, 2))[0] == 3


def test_pooled_r2_equals_predictions(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([(i % 4, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "fold int, x array<double>, y double")
    weights = models.ridge_by_fold(df, "x", ["y"], "fold", 1.0)
    rows = models.predict_by_fold(df, "x", "fold", weights, ["p"]).collect()
    got = 1 - sum((r["y"] - r["p"]) ** 2 for r in rows) / ((y - y.mean()) ** 2).sum()
    assert models.pooled_r2(models.gram(df, "x", ["y"], "fold"), 3, 1.0)[0] == pytest.approx(got)


def test_recording_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 0.3, 1, 1)], "timestamp double, EAR double, blink_flag int, face_detected int")
    tables.write_recording(df, str(tmp_path / "r"))
    row = tables.read_recording(spark, str(tmp_path / "r")).first()
    assert (row["timestamp"], row["EAR"], row["MAR"], row["blink_flag"]) == (1.0, 0.3, None, 1)


def test_archives_are_checked(spark, tmp_path):
    np.savez(tmp_path / "w.npz", facial=np.zeros((3, 4, 2), np.float32), eeg=np.zeros((3, 5), np.float32), subjects=np.array(["a", "a", "b"]))
    assert tables.read_archives(spark, str(tmp_path)).groupBy("subject").count().orderBy("subject").collect()[0]["count"] == 2
    np.savez(tmp_path / "bad.npz", facial=np.zeros((3, 4, 2)), eeg=np.zeros((2, 5)), subjects=np.array(["a", "a", "b"]))
    with pytest.raises(Exception, match="different lengths"):
        tables.read_archives(spark, str(tmp_path)).count()


def test_planted_windows_do_not_hang_on_partitions(spark):
    a = tables.planted_windows(spark, 2, 3, 8, 16).orderBy("window_id").collect()
    b = tables.planted_windows(spark, 2, 3, 8, 16).repartition(3).orderBy("window_id").collect()
    assert a == b and len(a) == 6


def test_results_are_plain_json(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), float("inf"), 1.0)], "a double, b double, c double")
    tables.write_results(df, str(tmp_path / "j"))
    assert spark.read.schema("a double, b double, c double").json(str(tmp_path / "j")).first() == (None, None, 1.0)
    assert math.isnan(df.first()["a"])


def test_exact_silhouette_of_every_row(spark):
    from facewave.plans import study

    rng = np.random.default_rng(5)
    x = rng.normal(size=(5200, 2)).round(1)  # with equal rows
    label = rng.integers(0, 3, 5200)
    x[:, 0] += label
    label[7] = 9  # the only row of its label
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, label, strict=True))], "id long, x array<double>, label int")
    got = {r["id"]: r["silhouette"] for r in study.exact_silhouette(df, "x", "label", "id").collect()}
    assert len(got) == 5200 and got[7] == 0
    for i in rng.integers(8, 5200, 200):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        a = d[label == label[i]].sum() / ((label == label[i]).sum() - 1)
        b = min(d[label == k].mean() for k in (0, 1, 2, 9) if k != label[i])
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-6)


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_read_tables_of_several_files(spark, tmp_path, parts):
    from facewave.plans import stream_queries

    rows = [(i, i % 3, "error" if i % 4 == 0 else "click", i * 1.5, i * 3600) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, s long").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
    df.repartition(parts).write.parquet(str(tmp_path / "events.parquet"))
    assert len(list((tmp_path / "events.parquet").glob("*.parquet"))) == parts
    want = {u: (sum(r[1] == u for r in rows), sum(r[3] for r in rows if r[1] == u)) for u in range(3)}
    got = {r["session"]: (r["frames"], r["ear"]) for r in stream_queries.r7(spark, str(tmp_path)).collect()}
    assert got == want
    assert stream_queries.r1(spark, str(tmp_path)).count() == 40


def test_selection_is_not_held_to_few_clusters(spark, tmp_path):
    from facewave.plans import study_queries

    rng = np.random.default_rng(11)
    centres = rng.normal(0, 5, (5, 64))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.5, 64)).tolist(), i % 5) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    curve = {r["k"]: r["chosen"] for r in study_queries.m3(spark, str(tmp_path)).collect()}
    assert sorted(curve) == list(range(2, 9)) and [k for k in curve if curve[k]] == [5]


def test_live_estimate_and_its_gates(spark, tmp_path):
    from dataclasses import replace

    from facewave.operators import models
    from facewave.streaming import live

    mixture = models.Mixture(np.array([0.5, 0.5]), np.array([[-1.0], [1.0]]), np.full((2, 1, 1), 0.25), True)
    model = live.StateModel(np.zeros(5), np.ones(5), models.Components(np.zeros(5), np.eye(1, 5), np.ones(1)), mixture, ["low"], frames=3)
    rows = [(1, i, f"2026-01-01 00:00:{i:02d}", -1.0 if i < 4 else 1.0, i != 7) for i in range(12)]
    df = spark.createDataFrame(rows, "session long, frame_idx long, ts string, ear double, face boolean").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))

    def states(model):
        out = []
        stream = live.facial_state(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), model, ["ear"], late="1 day")
        stream.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / f"state{len(list(tmp_path.iterdir()))}")).trigger(availableNow=True).start().awaitTermination()
        return [r["state"] for r in sorted(out, key=lambda r: r["frame_idx"])]

    got = states(model)
    assert got[:2] == ["N/A"] * 2 and got[7:10] == ["N/A"] * 3  # too few frames, and after a lost face
    assert got[2] == "low (100%)" and got[6] == "cluster 1 (100%)"
    for other in (None, replace(model, synthetic=True), replace(model, fps=30.0), replace(model, frames=64)):
        assert set(states(other)) == {"N/A"}


def test_sessions_are_written_and_read(spark, tmp_path):
    rows = [("s1_a", i, 0.1 * i) for i in range(9)] + [("s1_b", i, 0.2) for i in range(4)] + [("s2_a", 0, 1.0)]
    frames = spark.createDataFrame(rows, "session string, frame_idx long, ear double")
    tables.write_session(frames, str(tmp_path / "frames"))
    tables.write_session(frames.where("session <> 's2_a'").drop("ear"), str(tmp_path / "samples"))
    read, samples = tables.read_sessions(spark, str(tmp_path))
    assert sorted({(r["subject"], r["session"]) for r in read.collect()}) == [("s1", "s1_a"), ("s1", "s1_b")] and samples.count() == 13
    assert [tuple(r) for r in tables.session_catalogue(read, 4).collect()] == [("s1", 2, 3)]


def test_second_planted_windows(spark):
    a = tables.planted_oscillations(spark, per_subject=20)
    rows = a.orderBy("window_id").collect()
    assert rows == a.repartition(3).orderBy("window_id").collect() and len({r["subject"] for r in rows}) == 4
    x = np.array([r["eeg"] for r in rows])
    assert np.allclose(x.mean(axis=1), 0, atol=1e-9) and np.allclose(x.std(axis=1), 1, atol=1e-3)
    fast = (np.abs(np.fft.rfft(x, axis=1))[:, 8:12] ** 2).sum(axis=1)  # 16 to 22 Hz
    assert np.corrcoef([r["movement"] for r in rows], fast)[0, 1] > 0.5


def test_permutation_control_by_sums(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    rows = [(i, r.tolist(), float(r @ [1, 2, 0] + rng.normal()), float(rng.normal()), i % 4) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double, noise double, fold int")
    true, p = models.permutation_control(df, "x", "y", "fold", "id", 1.0, 60, cells=60 * 256)
    assert true > 0.5 and p == 1 / 61
    assert models.permutation_control(df.repartition(7), "x", "noise", "fold", "id", 1.0, 60)[1] > 0.02


def test_bootstrap_in_blocks_agrees_with_one_block(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, i, float(v)) for k in ("a", None) for i, v in enumerate(rng.normal(3, 1, 400))], "g string, id long, v double")
    few, many = (hypothesis.bootstrap_ci(df, "g", "v", 1000, key="id", block_rows=n).orderBy("g").collect() for n in (10_000, 100))
    for a, b in zip(few, many, strict=True):
        assert (a["g"], a["n"], a["mean"], a["std"]) == (b["g"], b["n"], b["mean"], b["std"])
        assert abs(a["low"] - b["low"]) < 0.03 and abs(a["high"] - b["high"]) < 0.03 and a["low"] < a["mean"] < a["high"]


def test_signed_rank_table(spark):
    rng = np.random.default_rng(5)
    for d in (rng.normal(0.3, 1, 20), rng.integers(-3, 5, 80).astype(float), np.zeros(4), np.array([1.0])):
        df = spark.createDataFrame([(float(x),) for x in d] + [(None,), (float("nan"),)], "d double")
        assert abs(hypothesis.signed_rank_table(df, "d").first()["p"] - hypothesis.signed_rank(d)) < 1e-9


def test_large_strata_and_many_subjects_are_dealt(spark):
    rows = [(i, i % 3, float(i % 3 + (i * 7919 % 100) / 50), "s") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, rank double, stratum string")
    sums = hypothesis.permutation_ranks(df, "label", "rank", ["stratum"], "id", 20).toPandas()
    assert len(sums) == 60 and (sums.groupby("perm")["m"].sum() == 300).all()
    assert np.allclose(sums.groupby("perm")["r"].sum(), sum(r[2] for r in rows))


@pytest.mark.parametrize("case", range(4))
def test_folds_are_those_of_a_heap(spark, case):
    rng = np.random.default_rng(case)
    n = [60, 400, 7, 90][case]
    sizes = [rng.integers(1, 6, n), rng.integers(1, 3, n), np.array([50, 9, 9, 1, 1, 1, 1]), np.sort(rng.integers(1, 40, n) ** 2 // 30 + 1)][case]
    name = (lambda i: f"s{i}") if case % 2 else int
    rows = spark.createDataFrame([(name(i),) for i, c in enumerate(sizes) for _ in range(c)], f"subject {'string' if case % 2 else 'long'}").repartition(5)
    heap, want = [(0, i) for i in range(4)], {}
    for i, c in sorted(((name(i), int(c)) for i, c in enumerate(sizes)), key=lambda x: (x[1], x[0]), reverse=True):
        load, f = heapq.heappop(heap)
        want[i] = (c, f)
        heapq.heappush(heap, (load + c, f))
    assert {r["subject"]: (r["rows"], r["fold"]) for r in splits.subject_folds(rows, 4, sample=120).collect()} == want


def test_blocks_of_segments_give_the_density_of_the_whole_signal(spark):
    from facewave.operators import spectral

    x = np.random.default_rng(8).normal(size=64 * 21)
    df = spark.createDataFrame([(i, x[64 * i : 64 * i + 64].tolist()) for i in range(21)], "id long, x array<double>")
    want = spectral.welch(x[None, :], 256.0, 128)[0]
    for segments in (3, 64):
        got = sorted(spectral.long_signal_psd(df, None, "id", "x", 64, 256.0, 128, segments).collect())
        assert [r["bin"] for r in got] == list(range(65)) and np.allclose([r["power"] for r in got], want)
