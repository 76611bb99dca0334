"""The held-out clustering study on planted states."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from facewave.operators import hypothesis
from facewave.plans import held_out

D, STATES = 8, 3


@pytest.fixture(scope="module")
def planted():
    """12 subjects of 30 windows in three states; alpha follows the state, theta nothing; feature 2 (motion) marks state 2, feature 0 and 1 are blinks without meaning."""
    rng = np.random.default_rng(11)
    centres = np.zeros((STATES, D))
    centres[1, [3, 4]], centres[2, [2, 5]], centres[0, [6, 7]] = 8, 8, 8
    rows = []
    for s in range(12):
        move = rng.normal(0, 0.3, D)
        for i in range(30):
            x = centres[i % STATES] + rng.normal(0, 0.6, D) + move
            rows.append((s * 100 + i, f"s{s:02d}", x.tolist(), float(2 * (i % STATES == 2) + rng.normal(0, 0.3)), float(rng.normal())))
    rows.append((9999, "s00", [float("nan")] * D, 0.0, 0.0))
    return rows


@pytest.fixture(scope="module")
def fitted(spark, planted):
    df = spark.createDataFrame(planted, "id long, subject string, features array<double>, alpha double, theta double")
    found = held_out.fit(df, 3, range(2, 5), ("theta", "alpha"), {"blink_rate": 0, "ear_std": 1, "head_motion_energy": 2}, (0, 1), 2, 4, 0.6, with_boosting=True)
    yield found
    found.close()


def test_planted_states_are_found_on_held_out_subjects(fitted, planted):
    rows = {r["id"]: r for r in fitted.rows.collect()}
    assert set(rows) == {r[0] for r in planted} - {9999}
    assert [len(m[0].weights) for m in fitted.mixtures] == [3] * 3 and [c.k for c, _ in fitted.k_means] == [3] * 3
    subjects = {}
    for r in rows.values():
        subjects.setdefault(r["subject"], set()).add(r["fold"])
        assert len(r["probability"]) == 3 and sum(r["probability"]) == pytest.approx(1)
        assert r["label"] == r["reference"][r["fold"]] and r["kmeans"] == r["reference"][3 + r["fold"]]
    assert all(len(f) == 1 for f in subjects.values())
    assert all(len(fitted.artifacts(f)) == 1 and np.argmax(fitted.profiles[f][:, 2]) == fitted.artifacts(f)[0] for f in range(3))


def test_held_out_rows_take_the_statistics_of_the_training_rows(fitted, planted):
    plain = {r[0]: np.array([r[4], r[3]]) for r in planted if r[0] != 9999}
    rows = fitted.rows.select("id", "fold", "y").collect()
    for fold in range(3):
        train = np.array([plain[r["id"]] for r in rows if r["fold"] != fold])
        assert fitted.train_rows[fold] == len(train)
        for r in rows:
            if r["fold"] == fold:
                assert np.allclose(r["y"], (plain[r["id"]] - train.mean(axis=0)) / (train.std(axis=0) + 1e-8), atol=1e-6)


def test_tables_of_the_study(spark, fitted):
    tests = held_out.statistics(fitted).cache()
    got = {(r["kind"], r["fold"], r["band"]): r for r in tests.collect()}
    assert len(got) == 2 * (3 + 3 + 2)
    labels = fitted.rows.select("id", "fold", "label", "blink_free", F.col("y")[0].alias("theta"), F.col("y")[1].alias("alpha")).withColumn("far", F.col("label") + 16 * (F.col("fold") + 1))
    for kind, fold, rows, label in [("fold", 1, labels.where("fold = 1"), "label"), ("pooled", -1, labels, "far"), ("kept", 2, labels.where((F.col("fold") == 2) & ~F.col("label").isin(fitted.artifacts(2))), "label")]:
        for band in ("theta", "alpha"):
            want = hypothesis.kruskal_wallis(rows, label, band).first()
            r = got[kind, fold, band]
            assert (r["n"], r["groups"]) == (want["n"], want["groups"])
            assert (r["h"], r["p"], r["epsilon2"]) == pytest.approx((want["h"], want["p"], want["epsilon2"]))
    assert all(got["fold", f, "alpha"]["survives"] and not got["kept", f, "alpha"]["survives"] for f in range(3))
    agreed = held_out.agreement(fitted).cache()
    ari = {(r["kind"], r["a"], r["b"]): r["ari"] for r in agreed.collect()}
    assert len(ari) == 3 + 2 * 3 * 2 + 2 * 3
    assert min(v for (k, _, _), v in ari.items() if k in ("mixture_boot", "k_means_boot")) > 0.8
    folds = {r["fold"]: r for r in held_out.records(fitted, agreed, tests, "alpha").collect()}
    assert set(folds) == {0, 1, 2} and not folds[0]["survives"] and folds[0]["h"] == pytest.approx(got["fold", 0, "alpha"]["h"])
    pooled = {r["measure"]: r["value"] for r in held_out.pooled(fitted, agreed, tests, "alpha", 50).collect()}
    assert pooled["permutation_p"] == pytest.approx(1 / 51) and pooled["motion_subjects"] == 12 and pooled["motion_low"] > 0.5
    assert pooled["motion_p"] == pytest.approx(2 / 2**12) and pooled["pooled_survives"] == 1


def test_cluster_probabilities_help_where_targets_follow_states(fitted):
    results = held_out.regression(fitted).collect()
    assert len(results) == 12 * 2 * 2
    rows = fitted.rows.where("subject = 's03'").collect()
    y, p = np.array([r["y"][1] for r in rows]), np.array([r["augmented"][1] for r in rows])
    own = next(r for r in results if (r["subject"], r["features"], r["target"]) == ("s03", "augmented", "alpha"))
    assert own["mae"] == pytest.approx(np.abs(y - p).mean()) and own["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_grouped_tests_equal_single_ones_over_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), int(a), float(np.round(v, 1))) for g, a, v in zip(rng.integers(0, 3, 600), rng.integers(0, 4, 600), rng.normal(0, 1, 600), strict=True)]
    rows += [(7, 1, 2.0), (8, 1, 1.0), (8, 2, 1.0), (0, None, 1.0), (0, 1, None)]
    df = spark.createDataFrame(rows, "g int, a int, v double")
    got = {r["g"]: r for r in hypothesis.kruskal_wallis_by(df, ["g"], "a", "v", 5).collect()}
    assert set(got) == {0, 1, 2, 7, 8}
    for g, r in got.items():
        want = hypothesis.kruskal_wallis(df.where(F.col("g") == g), "a", "v").first()
        assert tuple(r)[1:] == pytest.approx(tuple(want))


def test_boosting_by_each_fold_s_own_probabilities(fitted):
    out = held_out.boosted(fitted, 30, 2).toPandas()
    assert len(out) == 12 * 2 * 2
    alpha = out[out.target == "alpha"].groupby("features").r2.mean()
    assert alpha["compact"] > 0.7 and alpha["augmented"] > 0.7  # alpha follows the state
    assert out[out.target == "theta"].r2.mean() < 0.1
    first = fitted.rows.first()
    k = fitted.most
    assert first["probabilities"][first["fold"] * k : (first["fold"] + 1) * k] == pytest.approx(first["probability"])
    assert len(first["z"]) == len(first["own"]) == D
