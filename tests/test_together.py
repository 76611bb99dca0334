"""Many weighted fits at once against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from facewave.operators import models, splits, together


def frame(spark, x, w):
    return spark.createDataFrame([(i, r.tolist(), np.atleast_1d(v).astype(float).tolist()) for i, (r, v) in enumerate(zip(x, w, strict=True))], "id long, x array<double>, w array<double>")


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(3)
    centres = np.array([(-6, 0, 0, 0), (0, 6, 0, 0), (6, 0, 0, 0), (0, 0, 0, 7)], float)
    x = np.concatenate([c + rng.normal(0, 0.5, (60, 4)) for c in centres])
    return x, np.repeat(np.arange(4), 60), rng


def same_parts(a, b):
    return len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(set(a.tolist())) == len(set(b.tolist()))


def test_axes_of_each_sample(spark, planted):
    x, _, rng = planted
    w = rng.integers(0, 3, (len(x), 2))
    fits = together.prepare(frame(spark, x + 1e7, w), "x", "w", "id", [0, 1, 1], [None, None, [0, 2, 3]], 0.9, 50)
    fits.close()
    for f, (s, used) in enumerate([(0, [0, 1, 2, 3]), (1, [0, 1, 2, 3]), (1, [0, 2, 3])]):
        again = np.repeat(x, w[:, s], axis=0)
        values, vectors = np.linalg.eigh(np.cov(again[:, used].T))
        want = vectors[:, ::-1].T[: len(fits.axes[f].axes)]
        want = want * np.sign(want[np.arange(len(want)), np.abs(want).argmax(axis=1)])[:, None]
        assert np.allclose(fits.axes[f].axes[:, used], want, atol=1e-5)
        assert np.allclose(fits.axes[f].mean - 1e7, again.mean(axis=0), atol=1e-5)
        assert np.allclose(fits.axes[f].ratio, values[::-1] / values.sum(), atol=1e-6)
        assert fits.axes[f].ratio[: len(want)].sum() > 0.9 >= fits.axes[f].ratio[: len(want) - 1].sum()


def test_a_weight_is_as_many_rows(spark, planted):
    x, _, rng = planted
    w = rng.integers(0, 4, len(x))
    many = np.repeat(x, w, axis=0)
    got = []
    for df in (frame(spark, x, w), frame(spark, many, np.ones(len(many)))):
        fits = together.prepare(df, "x", "w", "id", [0], None, 0.999)
        found = together.k_means(fits, [[4]], 8)
        mix = together.mixtures(fits, [[(4, True), (4, False)]], found, rounds=200, tol=1e-12)[0]
        got.append((found[0, 4][0].cost, together.silhouettes(fits, [(0, found[0, 4][0].label, 4)])[0], {m.diagonal: (m.loglik, m.bic, m.n) for m in mix}))
        fits.close()
    assert got[0][0] == pytest.approx(got[1][0]) and got[0][1] == pytest.approx(got[1][1])
    for kind in (True, False):
        assert got[0][2][kind] == pytest.approx(got[1][2][kind], rel=1e-6)


@pytest.mark.parametrize("seed", range(4))
def test_planted_clusters_among_outliers(spark, planted, seed):
    x, truth, _ = planted
    far = np.random.default_rng(seed).normal(0, 1, (4, 4))
    far = 14 * far / np.linalg.norm(far, axis=1)[:, None]
    fits = together.prepare(frame(spark, np.vstack([x, far]), np.ones(len(x) + 4)), "x", "w", "id", [0], None, 0.9999)
    try:
        found = together.k_means(fits, [[4]], 20, seed=seed)
        best = together.mixtures(fits, [[(4, True)]], found)[0][0]
        at = (x - fits.axes[0].mean) @ fits.axes[0].axes.T
        assert same_parts(together.predict(best, at).argmax(axis=1), truth)
    finally:
        fits.close()


@pytest.mark.parametrize("part_rows", [10_000, 37])
def test_selection_of_folds_in_one_go(spark, planted, part_rows):
    x, truth, _ = planted
    fold = np.arange(len(x)) % 3
    fits = together.prepare(frame(spark, x, fold[:, None] != np.arange(3)), "x", "w", "id", [0, 1, 2], None, 0.9999, part_rows)
    try:
        ks = range(2, 7)
        found = together.k_means(fits, [ks] * 3, 8)
        picked = together.chosen_k_means(fits, found)
        mixed = together.mixtures(fits, [[(k, d) for k in ks for d in (True, False)]] * 3, found)
        for f in range(3):
            at = (x - fits.axes[f].mean) @ fits.axes[f].axes.T
            best, curve = picked[f]
            assert best.k == 4 and set(curve) == set(ks) and same_parts(best.label(at), truth)
            assert len(mixed[f][0].weights) == 4 and same_parts(together.predict(mixed[f][0], at).argmax(axis=1), truth)
            assert mixed[f][0].n == (fold != f).sum()
            own = best.label(at[fold != f])
            square = ((at[fold != f][:, None] - at[fold != f][None]) ** 2).sum(axis=2)
            inside = np.array([square[i, own == own[i]].sum() / max((own == own[i]).sum() - 1, 1) for i in range(len(own))])
            other = np.array([min(square[i, own == c].mean() for c in range(4) if c != own[i]) for i in range(len(own))])
            assert curve[4] == pytest.approx(((other - inside) / np.maximum(other, inside)).mean())
            cost = ((at[fold != f][:, None] - best.at[None]) ** 2).sum(axis=2).min(axis=1).sum()
            assert best.cost == pytest.approx(cost, rel=1e-5)
    finally:
        fits.close()


def test_mixture_steps_equal_a_plain_version(spark, planted):
    x = planted[0][:, :3] / 4
    fits = together.prepare(frame(spark, x, np.ones(len(x))), "x", "w", "id", [0], None, 0.99999, 50)
    try:
        at = (x - fits.axes[0].mean) @ fits.axes[0].axes.T
        c = together.k_means(fits, [[3]], 1)[0, 3]
        for diagonal in (True, False):
            got = together.mixtures(fits, [[(3, diagonal)]], {(0, 3): c}, 1, 6, 0.0)[0][0]
            r = np.eye(3)[((at[:, None] - c[0].at) ** 2).sum(axis=2).argmin(axis=1)]
            for _ in range(7):
                size = r.sum(axis=0)
                means = r.T @ at / size[:, None]
                cov = [np.cov(at.T, aweights=r[:, j], ddof=0) for j in range(3)]
                cov = [(np.diag(np.diag(v)) if diagonal else v) + 1e-6 * np.eye(at.shape[1]) for v in cov]
                plain = models.Mixture(size / size.sum(), means, np.array(cov), diagonal)
                log = plain.log_densities(at)
                total = np.log(np.exp(log).sum(axis=1))
                r = np.exp(log - total[:, None])
            assert np.allclose(got.means, plain.means, atol=1e-6) and np.allclose(got.covariances, plain.covariances, atol=1e-6)
            assert np.allclose(together.predict(got, at), r, atol=1e-6)
    finally:
        fits.close()


def test_odd_rows_take_no_part(spark):
    x = [[0.0, 1.0], [1.0, 0.0], [float("nan"), 1.0], [1.0, None], None, [2.0, 2.0]]
    df = spark.createDataFrame([(i, r, [1.0, 0.0]) for i, r in enumerate(x)] + [(9, [5.0, 5.0], None)], "id long, x array<double>, w array<double>")
    fits = together.prepare(df, "x", "w", "id", [0], None, 0.5)
    assert fits.rows.count() == 3 and np.allclose(fits.axes[0].mean, [1, 1])
    found = together.k_means(fits, [[2, 3, 5]], 3)  # more clusters than rows: as many as there are different rows
    assert found[0, 5][0].cost == pytest.approx(0, abs=1e-9)
    fits.close()
    with pytest.raises(ValueError, match="no rows"):
        together.prepare(df, "x", "w", "id", [1])


def test_a_small_table_is_worked_on_by_all_cores(spark):
    x = np.random.default_rng(3).normal(size=(300, 3))
    got = []
    for part_rows in (1000, 20):
        fits = together.prepare(frame(spark, x, np.ones((300, 2))), "x", "w", "id", [0, 1], None, 0.9999, part_rows)
        try:
            copy = "g" if fits.copies > 1 else "0"
            tasks = fits.kept.selectExpr(copy, "h").rdd.mapPartitions(lambda rows: [[tuple(r) for r in rows]]).collect()
            assert len(tasks) >= spark.sparkContext.defaultParallelism and all(len({g for g, _ in t}) <= 1 for t in tasks)
            assert len({r for t in tasks for r in t}) == 300 * fits.copies and fits.rows.count() == 300
            assert [x for part in fits.dealt(range(10)) for x in part] == list(range(10))
            found = together.k_means(fits, [[2, 3]] * 2, 4)
            got.append(([c.cost for v in found.values() for c in v], [m.loglik for f in together.mixtures(fits, [[(3, True), (2, False)]] * 2, found) for m in f]))
        finally:
            fits.close()
    assert got[0][0] == pytest.approx(got[1][0]) and got[0][1] == pytest.approx(got[1][1])


def test_bootstraps_of_all_folds_are_those_of_each(spark):
    table = spark.createDataFrame([(f"s{i:02d}", i % 3) for i in range(20)], "subject string, fold int")
    each = table.select("subject", F.explode(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda f: f != F.col("fold"))).alias("of"))
    got = {tuple(r) for r in splits.subject_bootstraps(each, "of", 4, 7).select("of", "subject", "boot", "weight").collect()}
    want = {(f, *r) for f in range(3) for r in splits.subject_bootstrap(table.where(F.col("fold") != f), 4, 7 + f).select("subject", "boot", "weight").collect()}
    assert got == want
