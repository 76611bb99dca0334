"""Boosting of all folds against a plain version, and sums of features that are far from zero."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from facewave.operators import boosting, models


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 1, (400, 5)), 1)
    y = np.column_stack([np.sin(2 * x[:, 0]) + (x[:, 1] > 0.4) + rng.normal(0, 0.1, 400), x[:, 2] * x[:, 3] + rng.normal(0, 0.1, 400)])
    return x, y, np.arange(400) % 3


def plain_tree(b, r, depth, bins):
    """Greedy least-squares splits of binned features, all nodes of a level at a time."""
    node, out = np.zeros(len(b), int), np.zeros(len(b))
    rules = []
    for level in range(depth):
        for k in range(1 << level):
            on = node == k
            best, rule = r[on].sum() ** 2 / max(on.sum(), 1) * (1 + 1e-12), None
            for j in range(b.shape[1]):
                for cut in range(bins):
                    left, right = on & (b[:, j] <= cut), on & (b[:, j] > cut)
                    if left.any() and right.any():
                        gain = r[left].sum() ** 2 / left.sum() + r[right].sum() ** 2 / right.sum()
                        if gain > best + 1e-9:
                            best, rule = gain, (j, cut)
            rules.append((level, k, rule))
        for at, k, rule in rules:
            if at == level:
                on = node == k
                right = on & (b[:, rule[0]] > rule[1]) if rule else np.zeros(len(b), bool)
                node[on] = k + (1 << 20)
                node[right] += 1 << 21
        node = np.where(node >= 1 << 20, 2 * (node & ((1 << 20) - 1)) + (node >> 21), node)
    for k in np.unique(node):
        out[node == k] = r[node == k].mean()
    return out


@pytest.mark.parametrize("part_rows", [10_000, 15])
def test_boosting_equals_a_plain_version(spark, data, part_rows):
    x, y, fold = data
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i, 0]), float(y[i, 1]), int(fold[i])) for i in range(len(x))], "id long, x array<double>, p double, q double, fold int")
    forest = boosting.fit_boosted(df, "x", ["p", "q"], "fold", trees=12, depth=2, bins=8, part_rows=part_rows)
    b = forest.bins(x)
    for f, k in enumerate(forest.folds):
        on = fold != k
        for j in range(2):
            m = np.full(on.sum(), y[on, j].mean())
            for _ in range(12):
                m = m + 0.1 * plain_tree(b[on], y[on, j] - m, 2, 8)
            got = forest.base[f, j] + forest.gains(b[on], f, j, 0, 12)
            assert np.allclose(got, m, atol=1e-8)
    out = boosting.predict_boosted(df, forest, "x", "fold", ["a", "b"]).toPandas().sort_values("id")
    assert 1 - ((out.a - y[:, 0]) ** 2).sum() / ((y[:, 0] - y[:, 0].mean()) ** 2).sum() > 0.5


def test_folds_see_their_own_columns(spark, data):
    """Three shared columns and one for each fold: as three fits of their own."""
    rng = np.random.default_rng(9)
    n, fold = 240, np.arange(240) % 3
    shared, own = rng.normal(size=(n, 3)), rng.normal(size=(n, 3))
    y = shared[:, 0] + own[:, 1] * (shared[:, 2] > 0) + own[:, 0]
    df = spark.createDataFrame([(i, [*shared[i].tolist(), *own[i].tolist()], float(y[i]), int(fold[i])) for i in range(n)], "id long, x array<double>, y double, fold int")
    forest = boosting.fit_boosted(df, "x", ["y"], "fold", 12, 2, columns=[[0, 1, 2, 3 + f] for f in range(3)])
    got = {r.id: r.p for r in boosting.predict_boosted(df, forest, "x", "fold", ["p"]).collect()}
    for f in range(3):
        one = df.select("id", F.array(*[F.get("x", F.lit(i)) for i in (0, 1, 2, 3 + f)]).alias("x"), "y", (F.col("fold") == f).cast("int").alias("fold"))
        for r in models.boosted_by_fold(one, "x", "y", "fold", "p", 12, 2).where("fold = 1").collect():
            assert got[r.id] == pytest.approx(r.p)
    with pytest.raises(ValueError):
        boosting.fit_boosted(df, "x", ["y"], "fold", 1, 1, columns=[[0], [0, 1], [0]])


def test_boosting_of_odd_tables(spark):
    schema = "id long, x array<double>, y double, fold int"
    one = spark.createDataFrame([(i, [1.0, float("nan")], 2.0, i % 2) for i in range(6)], schema)
    assert {r.p for r in models.boosted_by_fold(one, "x", "y", "fold", "p", 3, 2).collect()} == {2.0}
    assert models.boosted_by_fold(one.limit(0), "x", "y", "fold", "p", 3, 2).count() == 0
    lone = models.boosted_by_fold(one.where("fold = 0"), "x", "y", "fold", "p", 3, 2)  # nothing to learn from
    assert lone.count() == 3


def test_moments_far_from_zero(spark, data):
    x, y, fold = data
    rows = lambda shift: spark.createDataFrame([(i, (x[i] + shift).tolist(), float(y[i, 0] + shift), int(fold[i]), float(1 + i % 3)) for i in range(len(x))], "id long, x array<double>, y double, fold int, w double")
    near, far = rows(0.0), rows(1e8)
    a, b = (models.principal_components(df, "x", 0.99) for df in (near, far))
    assert np.allclose(a.axes, b.axes, atol=1e-5) and np.allclose(a.ratio, b.ratio, atol=1e-6) and np.allclose(a.mean + 1e8, b.mean)
    r = [models.pooled_r2(models.gram(df, "x", ["y"], "fold"), 5, 1.0)[0] for df in (near, far)]
    assert abs(r[0] - r[1]) < 1e-6
    p = [models.predict_by_fold(df, "x", "fold", models.ridge_by_fold(df, "x", ["y"], "fold", 1.0), ["p"]).orderBy("id").select("p").toPandas().p.to_numpy() for df in (near, far)]
    assert np.allclose(p[0] + 1e8, p[1], atol=1e-4, rtol=0)
    # a row's weight is as many rows
    again = near.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    assert np.allclose(models.principal_components(near, "x", 0.99, "w").axes, models.principal_components(again, "x", 0.99).axes, atol=1e-2)
    m, n = models.gram(near, "x", ["y"], "fold", "w"), models.gram(again, "x", ["y"], "fold")
    full = lambda g, k: g[k][0, 1:] / g[k][0, 0] + g.shift
    assert all(np.allclose(full(m, k), full(n, k)) and m[k][0, 0] == n[k][0, 0] for k in m)


def test_a_small_table_is_worked_on_by_all_cores(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(4100, 2))
    df = spark.createDataFrame([(i % 3, r.tolist(), float(r[0] > 0.3)) for i, r in enumerate(x)], "fold int, x array<double>, y double")
    parts, plain = [], boosting.added
    monkeypatch.setattr(boosting, "added", lambda table, work, n: parts.append((n, table.rdd.getNumPartitions())) or plain(table, work, n))
    many = boosting.fit_boosted(df, "x", ["y"], "fold", 2, 2)
    assert set(parts) == {(3, 3)}
    monkeypatch.setattr(boosting, "LEAST", 1 << 30)
    one = boosting.fit_boosted(df, "x", ["y"], "fold", 2, 2)
    assert set(parts[4:]) == {(1, 1)}
    assert (many.feature == one.feature).all() and (many.cut == one.cut).all() and np.allclose(many.value, one.value)
