"""A session that is larger than a task gives the rows that it gives as a whole; whole permutations and bootstraps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facewave.operators import alignment, hypothesis, models, segments, shuffles

SMALL = 37


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(2)
    n = 900
    ear = rng.choice([0.1, 0.15, 0.3, 0.4], n).astype(object)
    ear[rng.random(n) < 0.05] = float("nan")
    ear[rng.random(n) < 0.05] = None
    ear[100:330] = None  # several segments without a known state
    ear[99] = 0.1
    t = np.round(np.cumsum(rng.choice([0, 0.05, 0.1, 0.2, 3.0], n, p=[0.1, 0.3, 0.3, 0.28, 0.02])), 3)
    rows = [("long", i, float(a), None if e is None else float(e), bool(f), str(g)) for i, (a, e, f, g) in enumerate(zip(t, ear, rng.random(n) > 0.1, np.repeat(rng.choice(list("ab"), 60), 15), strict=True))]
    rows += [(f"s{k}", i, i * 0.1, 0.1 if i % 3 else 0.4, i % 4 > 0, "b") for k in range(3) for i in range(20)] + [("one", 0, 1.0, 0.1, False, "a")]
    df = spark.createDataFrame(rows, "session string, frame_idx long, ts double, ear double, face boolean, label string").withColumn("us", F.round(F.col("ts") * 1e6).cast("long"))
    return df.repartition(5).cache(), sorted(rows, key=lambda r: (r[0], r[2], r[1]))


def by_session(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def events(rows):
    below, out = False, []
    for r in rows:
        e = r[3]
        event = 0
        if e is not None and e == e:
            event, below = int(e < 0.2 and not below), e < 0.2
        out.append(event)
    return out


def got(df, *columns):
    return sorted(tuple(r) for r in df.select("session", "frame_idx", *columns).collect())


def test_sessions_are_cut(frames):
    df, _ = frames
    c = segments.cut(df, rows=SMALL)
    sizes = c.df.groupBy("session", segments.SEGMENT).count().toPandas()
    assert (sizes[sizes.session == "long"]["count"] <= 2 * SMALL).all() and len(sizes[sizes.session == "long"]) > 15
    assert sizes[sizes.session != "long"][segments.SEGMENT].isna().all() and len(sizes[sizes.session != "long"]) == 4
    assert not segments.cut(df).carries


@pytest.mark.parametrize("rows", [SMALL, segments.ROWS])
def test_blinks(frames, rows):
    df, plain = frames
    want, rates, since = [], [], []
    for s, part in by_session(plain).items():
        e = events(part)
        times = [round(r[2] * 1e6) for r in part]
        for i, r in enumerate(part):
            want.append((s, r[1], e[i]))
            rates.append((s, r[1], min(sum(e[j] for j in range(i + 1) if times[j] >= times[i] - 2_000_000), 5)))
            hit = [j for j in range(i + 1) if e[j]]
            since.append((s, r[1], sum(e[: i + 1]), round(r[2] - part[hit[-1]][2], 6) if hit else None))
    assert got(segments.blink_events(df, "ear", 0.2, rows=rows), "event") == sorted(want)
    assert got(segments.blink_rates(df, "ear", 0.2, "us", 2, 5, rows=rows), "rate") == sorted(rates)
    assert got(segments.since_blink(df, "ear", 0.2, rows=rows), "blinks", F.round("since", 6)) == sorted(since, key=lambda r: r[:2])


@pytest.mark.parametrize("rows", [SMALL, segments.ROWS])
def test_differences_and_runs(frames, rows):
    df, plain = frames
    moved, runs = [], []
    for s, part in by_session(plain).items():
        run = 0
        for i, r in enumerate(part):
            last = part[i - 1][3] if i else None
            moved.append((s, r[1], "nan" if None not in (last, r[3]) and last != last or r[3] is not None and last is not None and r[3] != r[3] else 0.0 if last is None or r[3] is None else round(r[3] - last, 9)))
            run += not r[4]
            runs.append((s, r[1], run))
    found = got(segments.differences(df, {"d": "ear"}, rows=rows), F.round("d", 9))
    assert [(a, b, "nan" if d != d else d) for a, b, d in found] == sorted(moved, key=lambda r: r[:2])
    assert got(segments.face_runs(df, ~F.col("face"), rows=rows), "run") == sorted(runs)


@pytest.mark.parametrize("rows", [SMALL, segments.ROWS])
def test_label_runs(frames, rows):
    df, plain = frames
    want = []
    for s, part in by_session(plain).items():
        part = sorted(part, key=lambda r: r[1])
        run = []
        for r in part:
            if run and run[-1][1] == r[5]:
                run[-1][3:] = [r[1], run[-1][4] + 1]
            else:
                run.append([s, r[5], r[1], r[1], 1])
        want += [(s, k + 1, *x[1:]) for k, x in enumerate(run)]
    assert sorted(tuple(r) for r in segments.label_runs(df, "label", rows=rows).collect()) == sorted(want)


@pytest.mark.parametrize("rows", [SMALL, 5, segments.ROWS])
@pytest.mark.parametrize("least", [0.5, 0.3, 40.0])
def test_rate_limit(frames, rows, least):
    df, plain = frames
    want = []
    for s, part in by_session(plain).items():
        last = None
        for r in part:
            emit = last is None or r[2] - last >= least
            last = r[2] if emit else last
            want.append((s, r[1], emit))
    out = segments.rate_limited(df, least=least, rows=rows)
    assert out.columns == [*df.columns, "emitted"]
    assert got(out, "emitted") == sorted(want)


def test_exits_follow_each_row():
    t = np.array([0.0, 0.1, 0.3, 0.5, 0.6, 0.7, 1.2])
    def walk(i):
        for j in range(i + 1, len(t)):
            if t[j] - t[i] >= 0.5:
                return walk(j)
        return t[i]
    assert segments._exits(t, 0.5).tolist() == [walk(i) for i in range(len(t))]


@pytest.mark.parametrize("rows", [SMALL, segments.ROWS])
def test_alignment(frames, rows):
    df, plain = frames
    samples = df.where("face").select("session", "ts", F.col("frame_idx").alias("sample_idx"), F.coalesce("ear", F.lit(0.0)).alias("value"))
    windows = segments.frame_windows(df, 4, 2, rows=rows)
    found = sorted((r.session, r.start, r.idx) for r in segments.centre_index(windows, samples, rows=rows).collect())
    want = []
    for s, part in by_session(plain).items():
        held = [r[2] for r in part if r[4]]
        for i in range(0, len(part) - 3, 2):
            want.append((s, i, sum(t < (part[i][2] + part[i + 3][2]) / 2 for t in held)))
    assert found == sorted(want)
    cut, whole = (sorted(map(str, alignment.align(windows, samples, 6, rows=n).select("session", "start", "idx", "segment").collect())) for n in (rows, segments.ROWS))
    assert cut == whole and cut


@pytest.mark.parametrize("n", [1, 2, 7, 255, 256, 257, 5000])
def test_every_row_has_a_place(n):
    p = shuffles.places(np.arange(n), n, shuffles.round_keys(5, list(range(30))))
    assert (np.sort(p, axis=0) == np.arange(n)[:, None]).all()
    part = shuffles.places(np.arange(n)[n // 2 :], n, shuffles.round_keys(5, [3, 9]))
    assert (part == p[n // 2 :, [3, 9]]).all()


def test_places_are_even():
    counts = pd.Series(map(tuple, shuffles.places(np.arange(4), 4, shuffles.round_keys(1, list(range(12_000)))).T)).value_counts()
    assert len(counts) == 24 and ((counts - 500) ** 2 / 500).sum() < 60


def test_permutation_test_equals_numpy(spark):
    rng = np.random.default_rng(4)
    n = 400
    label, stratum = rng.integers(0, 3, n), rng.integers(0, 4, n)
    value = rng.normal(0, 1, n) + 0.12 * label + 0.5 * stratum
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), "label": label, "stratum": stratum, "value": value}))
    p = hypothesis.permutation_test(df, "label", "value", ["stratum"], "id", 2000).first()
    ranks = pd.Series(value).rank().to_numpy()
    stat = lambda lab: sum(ranks[lab == k].sum() ** 2 / (lab == k).sum() for k in range(3))
    reached = 0
    for _ in range(2000):
        shuffled = label.copy()
        for s in range(4):
            shuffled[stratum == s] = rng.permutation(label[stratum == s])
        reached += stat(shuffled) >= stat(label) * (1 - 1e-12)
    want = (1 + reached) / 2001
    assert abs(p["p"] - want) < 4 * math.sqrt(2 * want * (1 - want) / 2000) + 1e-3
    assert hypothesis.permutation_test(df.repartition(9), "label", "value", ["stratum"], "id", 2000).first()["p"] == p["p"]


def test_rows_of_one_rank_cost_permutations_no_more(spark):
    """120,000 rows of 5 ranks beside 900 of their own, in blocks: 20,000 permutations, with the mean and spread of shuffled labels."""
    import time

    rows = spark.range(120_900).selectExpr("id", "cast(id % 3 as int) label", "cast(id % 2 as string) stratum", "cast(if(id < 120000, id div 24000, id) as double) rank")
    began = time.time()
    got = hypothesis.permutation_ranks(rows, "label", "rank", ["stratum"], "id", 20_000).toPandas()
    assert time.time() - began < 25  # where each row finds its place in each permutation, these are 2.4 thousand million places
    assert len(got) == 60_000 and set(got["m"]) == {40_300}
    i = np.arange(120_900)
    rank, label, stratum = np.where(i < 120_000, i // 24_000, i).astype(float), i % 3, i % 2
    mean, variance = 0.0, 0.0
    for s in range(2):
        x, k, m = rank[stratum == s], (label[stratum == s] == 1).sum(), (stratum == s).sum()
        mean += k * x.mean()
        variance += k * (m - k) / (m - 1) * x.var()
    r = got[got["label"] == 1]["r"]
    assert abs(r.mean() - mean) < 4 * math.sqrt(variance / 20_000) and abs(r.var() / variance - 1) < 0.05
    assert np.allclose(got.groupby("perm")["r"].sum(), rank.sum())
    small = rows.where("id % 40 = 7")
    again = [x.sort_values(["perm", "label"])["r"].to_numpy() for x in (hypothesis.permutation_ranks(d, "label", "rank", ["stratum"], "id", 20, block_rows=200).toPandas() for d in (small, small.repartition(7)))]
    assert (again[0] == again[1]).all()


def test_draws_from_a_thousand_million_and_more():
    rng = np.random.default_rng(5)
    for good, bad, taken in ((900_000_000, 600_000_000, 500_000_000), (200, 2_000_000_000, 1_500_000_000), (3_000_000_000, 40, 7)):
        x = hypothesis.drawn(rng, *(np.full(4000, v) for v in (good, bad, taken)))
        every = good + bad
        mean, variance = taken * good / every, taken * (good / every) * (bad / every) * (every - taken) / (every - 1)
        assert abs(x.mean() - mean) < 4 * math.sqrt(variance / 4000) + 1e-9
        assert variance < 1e-3 or abs(x.var() / variance - 1) < 0.1


def test_permutation_control_equals_numpy(spark):
    rng = np.random.default_rng(6)
    n, d = 600, 3
    x, fold = rng.normal(0, 1, (n, d)), np.arange(n) % 4
    y = 0.12 * x[:, 0] + rng.normal(0, 1, n)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), int(fold[i])) for i in range(n)], "id long, x array<double>, y double, fold int")
    true, p = models.permutation_control(df, "x", "y", "fold", "id", 1.0, 300, cells=300 * 256)

    def r2(y):
        out = np.empty(n)
        for k in range(4):
            a, b = fold != k, fold == k
            m, s = x[a].mean(axis=0), x[a].std(axis=0)
            z = (x[a] - m) / s
            w = np.linalg.solve(z.T @ z + np.eye(d), z.T @ (y[a] - y[a].mean()))
            out[b] = (x[b] - m) / s @ w + y[a].mean()
        return 1 - ((y - out) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    assert abs(true - r2(y)) < 1e-9
    want = (1 + sum(r2(rng.permutation(y)) >= true for _ in range(1000))) / 1001
    assert abs(p - want) < 0.05


def test_bootstrap_of_blocks_equals_resampling(spark):
    rng = np.random.default_rng(8)
    x = rng.exponential(1, 1000)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", 1, 2.0), ("c", 1, float("nan")), ("c", 2, None), (None, 1, 1.0), (None, 2, 3.0)], "g string, id long, v double")
    means = np.sort([rng.choice(x, 1000).mean() for _ in range(4000)])
    for rows in (64, 10_000):
        out = {r.g: r for r in hypothesis.bootstrap_ci(df, "g", "v", 1500, key="id", block_rows=rows).collect()}
        assert set(out) == {"a", "b", "c", None}
        assert abs(out["a"].low - np.quantile(means, 0.025)) < 0.012 and abs(out["a"].high - np.quantile(means, 0.975)) < 0.012
        assert (out["b"].low, out["b"].high, out["b"].std, out["c"].low, out["c"].n) == (2.0, 2.0, 0.0, None, 0)
        assert 1.0 <= out[None].low <= out[None].high <= 3.0


def test_paired_summary(spark):
    from facewave.plans import study

    rng = np.random.default_rng(9)
    d = {"a": rng.normal(0.4, 1, 30), "b": rng.normal(0, 1, 25)}
    gains = spark.createDataFrame([(m, f"s{i}", float(v)) for m, x in d.items() for i, v in enumerate(x)], "model string, subject string, gain double")
    out = {r.model: r for r in study.paired_summary(gains).collect()}
    for m, x in d.items():
        assert (out[m].n, round(out[m].mean, 9)) == (len(x), round(x.mean(), 9))
        assert abs(out[m].p - hypothesis.signed_rank(x)) < 1e-9
        half = 1.96 * x.std() / math.sqrt(len(x))
        assert abs(out[m].low - (x.mean() - half)) < 0.12 and abs(out[m].high - (x.mean() + half)) < 0.12
    assert study.paired_summary(gains.limit(0)).count() == 0
