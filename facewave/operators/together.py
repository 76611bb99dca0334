"""Many weighted fits at once: components, K-Means and mixtures of all folds, bootstraps, numbers of clusters and starts.

A row has a weight for each sample that is drawn of the table: 0 or 1 for folds, how often its subject was drawn for bootstraps. No row is repeated or sent anywhere: a pass over the rows adds up
what every fit that has not settled needs of them, and only these sums, whose size follows the models, reach the driver. Results do not depend on partitions: draws are hashes of a row's key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facewave.operators.models import Components, Mixture, centre
from facewave.operators.shuffles import round_keys
from facewave.operators.sums import added

#: Rows that a task looks at together, and those whose products of features it holds.
STEP, HELD = 4096, 1024
#: Tasks that a pass is to have for each core, of a table with several partitions.
WAVES = 2


@dataclass
class Fits:
    """Rows (h long, z array, w array) that are kept in memory until ``close``, and the fits on them: fit f weighs a row by w[sample[f]] and sees it along axes[f].

    The rows lie in ``parts`` partitions. Where these are fewer than the cores can take, ``kept`` holds the rows in ``copies`` (column g, one of them in a partition) and a pass deals its fits to them, so that work that follows the fits is spread too."""

    kept: DataFrame
    parts: int
    sample: list[int]
    axes: list[Components] = field(default_factory=list)
    copies: int = 1

    @property
    def rows(self) -> DataFrame:
        """Every row once."""
        return (self.kept.where("g = 0") if self.copies > 1 else self.kept).select("h", "z", "w")

    def close(self) -> None:
        self.kept.unpersist()

    def dealt(self, items: Sequence, cost: Callable = lambda x: 1.0) -> list[list]:
        """The items in their order, a run of about the same cost for each copy."""
        costs = np.array([cost(x) for x in items], float)
        own = ((np.cumsum(costs) - costs / 2) / max(costs.sum(), 1e-300) * self.copies).astype(int)
        return [[items[i] for i in np.flatnonzero(own == g)] for g in range(self.copies)]

    def sums(self, work: Callable[[int, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
        """What ``work`` gives for the blocks (copy, h, z, w), added up by key; a key belongs to one copy."""
        return _block_sums(self.kept, self.parts * self.copies, work)

    def seen(self, f: int, z: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows that count in fit f: which they are, where they lie, their weights."""
        w = w[:, self.sample[f]]
        on = np.flatnonzero(w > 0)
        return on, (z[on] - self.axes[f].mean) @ self.axes[f].axes.T, w[on]

    def models(self) -> Fits:
        """Itself without the table, for tasks."""
        return Fits(None, self.parts, self.sample, self.axes, self.copies)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for a in range(0, len(batch), STEP):
            part = batch.slice(a, STEP)
            n = len(part)
            copy = part.column(3)[0].as_py() if part.num_columns > 3 else 0
            yield copy, part.column(0).to_numpy(zero_copy_only=False), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1), part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _block_sums(table: DataFrame, parts: int, work: Callable[[int, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    def task(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total: dict[int, np.ndarray] = {}
        for g, h, z, w in _blocks(batches):
            for k, s in work(g, h, z, w):
                total[k] = total[k] + s if k in total else s
        return total

    return added(table, task, parts)


def block_sums(table: DataFrame, parts: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """What ``work`` gives for every block of rows (h, z, w), added up by key."""
    return _block_sums(table, parts, lambda g, h, z, w: work(h, z, w))


def prepare(df: DataFrame, features: str, weights: str, key: str, samples: Sequence[int], columns: Sequence[Sequence[int] | None] | None = None, keep: float | None = 0.95, part_rows: int = 50_000) -> Fits:
    """Fits with their axes: fit f is of sample ``samples[f]`` (a place in ``weights``) and of the features ``columns[f]`` (None: all). Axes are the fewest whose share of variance exceeds ``keep``, the
    largest loading of each positive; without ``keep`` they are the features themselves. Rows with a null or non-finite feature, or without weights, take no part; a sample without rows is refused."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = df.select(F.xxhash64(key).alias("h"), F.transform(features, lambda x: x.cast("double")).alias("z"), F.transform(weights, lambda x: x.cast("double")).alias("w"))
    rows = rows.where(F.col("w").isNotNull() & F.col("z").isNotNull() & F.forall("z", real) & F.exists("w", lambda x: x > 0))
    parts = max(int(rows.count() // part_rows + 1), 1)
    copies = max(1, -(-df.sparkSession.sparkContext.defaultParallelism * (WAVES if parts > 1 else 1) // parts))
    at = F.pmod("h", F.lit(parts)).cast("int")
    if copies > 1:  # as many as make up for few partitions, so what is kept is bounded by them, not by the rows
        rows = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        at = at + F.col("g") * parts
    table = rows.repartitionById(parts * copies, at).persist()
    shift = centre(table.select("z"))
    fits = Fits(table, parts, list(samples), copies=copies)
    dealt = fits.dealt(sorted(set(samples)))

    def work(g, h, z, w):
        z = np.column_stack([np.ones(len(z)), z - shift])
        for s in dealt[g]:
            yield s, ((z * w[:, [s]]).T @ z).ravel()

    found = fits.sums(work)
    for f, s in enumerate(samples):
        if s not in found or not found[s][0] > 0:
            fits.close()
            raise ValueError(f"sample {s} has no rows")
        m = found[s].reshape(len(shift) + 1, -1)
        used = np.arange(len(shift)) if columns is None or columns[f] is None else np.array(columns[f], int)
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        spread = ((m[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1))[np.ix_(used, used)]
        values, vectors = np.linalg.eigh(spread)
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
        ratio = values / max(values.sum(), 1e-300)
        if keep is None:
            fits.axes.append(Components(mean + shift, np.eye(len(shift))[used], np.diag(spread) / max(np.trace(spread), 1e-300)))
            continue
        k = min(int(np.searchsorted(np.cumsum(ratio), keep, "right")) + 1, len(ratio))
        axes = np.zeros((k, len(shift)))
        axes[:, used] = vectors[:k] * np.where(vectors[np.arange(k), np.abs(vectors[:k]).argmax(axis=1)] < 0, -1, 1)[:, None]
        fits.axes.append(Components(mean + shift, axes, ratio))
    return fits


def _uniform(h: np.ndarray, seed: int, name: int) -> np.ndarray:
    """A number in (0, 1) for each row, the same wherever the row lies."""
    key = round_keys(seed, [name], 1)[0, 0]
    x = h.astype(np.int64).view(np.uint64) ^ key
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, not below zero."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)


def _by_fit(items: Sequence[tuple]) -> dict[int, list[tuple]]:
    """Items, whose first parts are fits, by these."""
    out: dict[int, list[tuple]] = {}
    for x in items:
        out.setdefault(x[0], []).append(x)
    return out


def seeds(fits: Fits, drawn: int, starts: int, rounds: int = 4, seed: int = 42) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By (fit, start) candidate centres and the weight of the rows nearest to each, as in k-means||: from the mean on, each round draws ``drawn`` rows in proportion to weight times squared
    distance from the candidates so far. A round is one pass: the rows with the least exponential of that rate are such a draw, and tasks keep only so many."""
    at = {(f, s): np.zeros((1, len(a.axes))) for f, a in enumerate(fits.axes) for s in range(starts)}
    light, dealt = fits.models(), [_by_fit(x) for x in fits.dealt(list(at))]
    for turn in range(rounds):

        def draw(batches: Iterator[pa.RecordBatch], at: dict = at, turn: int = turn) -> Iterator[pd.DataFrame]:
            held: dict = {}
            for g, h, z, w in _blocks(batches):
                for f, of in dealt[g].items():
                    on, x, weight = light.seen(f, z, w)
                    for _, s in of:
                        rate = weight * _near(x, at[f, s]).min(axis=1)
                        ok = np.flatnonzero(rate > 1e-12 * max(rate.max(initial=0), 1e-300))
                        e = -np.log(_uniform(h[on[ok]], seed, (s * rounds + turn) * 4096 + f)) / rate[ok]
                        e, ok = np.append(held[f, s][0], e) if (f, s) in held else e, np.vstack([held[f, s][1], x[ok]]) if (f, s) in held else x[ok]
                        first = np.argsort(e, kind="stable")[:drawn]
                        held[f, s] = e[first], ok[first]
            for (f, s), (e, x) in held.items():
                yield pd.DataFrame({"f": f, "s": s, "e": e, "x": list(x)})

        def batches_of(batches, draw=draw):
            for pdf in draw(batches):
                if len(pdf):
                    yield pa.RecordBatch.from_arrays([pa.array(pdf["f"], pa.int32()), pa.array(pdf["s"], pa.int32()), pa.array(pdf["e"], pa.float64()), pa.array([r.tolist() for r in pdf["x"]], pa.list_(pa.float64()))], ["f", "s", "e", "x"])

        best = fits.kept.mapInArrow(batches_of, "f int, s int, e double, x array<double>").withColumn("r", F.row_number().over(Window.partitionBy("f", "s").orderBy("e", "x"))).where(F.col("r") <= drawn)
        drawn_now: dict = {}
        for r in best.orderBy("f", "s", "r").collect():  # fits by starts by draws
            drawn_now.setdefault((r["f"], r["s"]), []).append(r["x"])
        # the mean is no row and goes when there are rows: near all others in many dimensions, it would keep them
        at = {k: np.vstack([*([c] if turn else []), *drawn_now[k]]) if k in drawn_now else c for k, c in at.items()}

    def count(g, h, z, w):
        for f, of in dealt[g].items():
            _, x, weight = light.seen(f, z, w)
            for _, s in of:
                c = at[f, s]
                yield f * starts + s, np.bincount(_near(x, c).argmin(axis=1), weight, len(c)) if len(x) else np.zeros(len(c))

    many = fits.sums(count)
    return {(f, s): (c, many[f * starts + s]) for (f, s), c in at.items()}


def _reclustered(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """k centres of some weighted points, by k-means++ and Lloyd steps."""
    on = weights > 0
    points, weights = points[on], weights[on]
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    while len(chosen) < k:
        far = weights * _near(points, np.array(chosen)).min(axis=1)
        if far.sum() <= 0:
            break
        chosen.append(points[rng.choice(len(points), p=far / far.sum())])
    c = np.array(chosen)
    for _ in range(rounds):
        own = _near(points, c).argmin(axis=1)
        size = np.bincount(own, weights, len(c))
        moved = np.stack([np.bincount(own, weights * points[:, j], len(c)) for j in range(points.shape[1])], axis=1)
        c = np.where(size[:, None] > 0, moved / np.maximum(size, 1e-300)[:, None], c)
    return c


@dataclass
class Centres:
    """K-Means of one fit with a number of clusters."""

    fit: int
    k: int
    at: np.ndarray
    cost: float = math.inf

    def label(self, x: np.ndarray) -> np.ndarray:
        return _near(x, self.at).argmin(axis=1)


def k_means(fits: Fits, ks: Sequence[Sequence[int]], restarts: int = 20, rounds: int = 50, tol: float = 1e-6, seed: int = 42, drawn: Sequence[int] | None = None) -> dict[tuple[int, int], list[Centres]]:
    """By (fit, k) all restarts, cheapest first, for the numbers of clusters ``ks[f]`` of each fit. Candidates of one k-means|| draw serve several restarts; a cluster that loses its rows keeps its centre."""
    starts = min(4, restarts)
    found = seeds(fits, 2 * max(max(k) for k in ks), starts, seed=seed)
    rng = np.random.default_rng(seed)
    tries = [Centres(f, k, _reclustered(*found[f, i % starts], k, rng)) for f, wanted in enumerate(ks) for k in wanted for i in range(restarts)]
    live, light = list(range(len(tries))), fits.models()
    for _ in range(rounds):
        now = [_by_fit([(tries[i].fit, i, tries[i].at) for i in of]) for of in fits.dealt(live, lambda i: len(tries[i].at))]

        def work(g, h, z, w, now=now):
            for f, held in now[g].items():
                _, x, weight = light.seen(f, z, w)
                if not len(x):
                    continue
                ends = np.cumsum([0, *[len(c) for _, _, c in held]])
                c = np.vstack([c for _, _, c in held])
                far = -2 * (c @ x.T)
                far += (c * c).sum(axis=1)[:, None]  # with the square of the row a squared distance
                hit, near = np.zeros_like(far), np.empty((len(held), len(x)))
                for j in range(len(held)):
                    part = far[ends[j] : ends[j + 1]]
                    near[j] = part.min(axis=0)
                    own = part == near[j]
                    if np.count_nonzero(own) > len(x):  # equally near centres: the first
                        own &= own.cumsum(axis=0) == 1
                    hit[ends[j] : ends[j + 1]] = own * weight
                moments = hit @ np.column_stack([np.ones(len(x)), x])
                near += (x * x).sum(axis=1)
                cost = np.maximum(near, 0) @ weight
                for j, (_, i, _) in enumerate(held):
                    yield i, np.append(moments[ends[j] : ends[j + 1]].ravel(), cost[j])

        sums, left = fits.sums(work), []
        for i in live:
            s, c = sums[i], tries[i].at
            m, cost = s[:-1].reshape(len(c), -1), float(s[-1])
            settled = tries[i].cost - cost <= tol * max(cost, 1e-300)
            tries[i].cost = cost
            if not settled:
                tries[i].at = np.where(m[:, :1] > 0, m[:, 1:] / np.maximum(m[:, :1], 1e-300), c)
                left.append(i)
        live = left
        if not live:
            break
    out: dict[tuple[int, int], list[Centres]] = {}
    for t in tries:
        out.setdefault((t.fit, t.k), []).append(t)
    return {k: sorted(v, key=lambda t: t.cost) for k, v in out.items()}


def silhouettes(fits: Fits, models: Sequence[tuple[int, Callable[[np.ndarray], np.ndarray], int]]) -> list[float]:
    """Mean silhouette (squared distance) of each (fit, labels of points, number of clusters), over rows by weight: two passes for all. The only row of a cluster has 0; one cluster used gives -1."""
    light, dealt = fits.models(), fits.dealt([(i, *m) for i, m in enumerate(models)])

    def about(g, h, z, w):
        for i, f, label, k in dealt[g]:
            _, x, weight = light.seen(f, z, w)
            hit = np.zeros((len(x), k))
            hit[np.arange(len(x)), label(x)] = weight
            yield i, (hit.T @ np.column_stack([np.ones(len(x)), (x * x).sum(axis=1), x])).ravel()

    sums = {i: s.reshape(models[i][2], -1) for i, s in fits.sums(about).items()}

    def score(g, h, z, w):
        for i, f, label, _ in dealt[g]:
            _, x, weight = light.seen(f, z, w)
            n, square, y = sums[i][:, 0], sums[i][:, 1], sums[i][:, 2:]
            total = np.maximum((x * x).sum(axis=1)[:, None] * n + square - 2 * x @ y.T, 0)
            rows, own = np.arange(len(x)), label(x)
            a = total[rows, own] / np.maximum(n[own] - 1, 1)
            b = np.where(n > 0, total / np.maximum(n, 1e-300), np.inf)
            b[rows, own] = np.inf
            b = b.min(axis=1, initial=np.inf)
            with np.errstate(invalid="ignore"):
                s = np.where((n[own] > 1) & np.isfinite(b), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
            yield i, np.array([weight @ s, weight.sum()])

    return [float(s[0] / s[1]) if (sums[i][:, 0] > 0).sum() > 1 else -1.0 for i, s in sorted(fits.sums(score).items())]


def chosen_k_means(fits: Fits, found: dict[tuple[int, int], list[Centres]]) -> list[tuple[Centres, dict[int, float]]]:
    """For each fit in ``found``, in order, the cheapest restart of the number of clusters with the largest silhouette (ties: the smaller number), and the silhouette of every number."""
    best = [v[0] for _, v in sorted(found.items(), key=lambda x: x[0])]
    curve: dict[int, dict[int, float]] = {f: {} for f, _ in sorted(found)}
    for c, s in zip(best, silhouettes(fits, [(c.fit, c.label, len(c.at)) for c in best]), strict=True):
        curve[c.fit][c.k] = s
    return [(found[f, max(sorted(c), key=c.get)][0], c) for f, c in curve.items()]


def _shape(m: Mixture) -> tuple[np.ndarray, ...]:
    """What the log densities of a mixture take of it."""
    d = m.means.shape[1]
    top = np.log(np.maximum(m.weights, 1e-300)) - 0.5 * d * math.log(2 * math.pi)
    if m.diagonal:
        v = np.diagonal(m.covariances, axis1=1, axis2=2)
        a = m.means / v
        return np.vstack([(m.means * a).sum(axis=1), -2 * a.T, (1 / v).T]), top - 0.5 * np.log(v).sum(axis=1)
    low = np.linalg.cholesky(m.covariances)
    back = np.linalg.inv(low)
    return back.reshape(-1, d), np.einsum("kij,kj->ki", back, m.means).ravel(), top - np.log(np.diagonal(low, axis1=1, axis2=2)).sum(axis=1)


def _log_densities(m: Mixture, x: np.ndarray, shape: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    shape = shape or _shape(m)
    if m.diagonal:
        return shape[1] - 0.5 * np.maximum(np.column_stack([np.ones(len(x)), x, x * x]) @ shape[0], 0)
    back, centre_, top = shape
    y = x @ back.T
    y -= centre_
    y = y.reshape(len(x), len(top), x.shape[1])
    return top - 0.5 * np.einsum("nkd,nkd->nk", y, y)


def _products(x: np.ndarray) -> np.ndarray:
    """1, the features, and the products of every two of them (a <= b, by a)."""
    n, d = x.shape
    out = np.empty((n, 1 + d + d * (d + 1) // 2))
    out[:, 0], out[:, 1 : d + 1], at = 1, x, d + 1
    for a in range(d):
        np.multiply(x[:, a : a + 1], x[:, a:], out=out[:, at : at + d - a])
        at += d - a
    return out


def mixtures(fits: Fits, kinds: Sequence[Sequence[tuple[int, bool]]], found: dict[tuple[int, int], list[Centres]], starts: int = 2, rounds: int = 50, tol: float = 1e-5, floor: float = 1e-6) -> list[list[Mixture]]:
    """For each fit the mixtures of its ``kinds`` (number of components, diagonal), lowest BIC first: expectation-maximisation from the ``starts`` cheapest different K-Means of that number, of which the
    likeliest stays. One pass serves every mixture that has not settled; diagonal ones bring back no products."""
    tries: list[tuple[int, Mixture, np.ndarray | None]] = []
    for f, wanted in enumerate(kinds):
        for k, diagonal in wanted:
            costs: list[float] = []
            for c in found[f, k]:
                if len(costs) < starts and all(abs(c.cost - o) > 1e-6 * max(o, 1e-300) for o in costs):
                    costs.append(c.cost)
                    d = c.at.shape[1]
                    tries.append((f, Mixture(np.full(len(c.at), 1 / len(c.at)), c.at, np.array([np.eye(d)] * len(c.at)), diagonal), c.at))
    live, hard, light = list(range(len(tries))), True, fits.models()
    def cost(i: int) -> float:
        k, d = tries[i][1].means.shape
        return k * (d + (0 if tries[i][1].diagonal else d * d))

    for _ in range(rounds + 1):
        now = [_by_fit([(tries[i][0], i, tries[i][1]) for i in of]) for of in fits.dealt(live, cost)]

        def work(g, h, z, w, now=now, hard=hard, shapes={}):  # noqa: B006 (what a task works out once)
            for f, held in now[g].items():
                _, every, weights = light.seen(f, z, w)
                for a in range(0, len(every), HELD):
                    x, weight = every[a : a + HELD], weights[a : a + HELD]
                    for diagonal in (True, False):
                        of = [(i, m) for _, i, m in held if m.diagonal == diagonal]
                        if not of:
                            continue
                        r, whole = [], []
                        for i, m in of:
                            if hard:
                                p, most = np.zeros((len(x), len(m.means))), np.zeros(len(x))
                                p[np.arange(len(x)), _near(x, m.means).argmin(axis=1)] = 1
                            else:
                                if i not in shapes:
                                    shapes[i] = _shape(m)
                                p = _log_densities(m, x, shapes[i])
                                top = p.max(axis=1, keepdims=True)
                                p = np.exp(p - top)
                                total = p.sum(axis=1, keepdims=True)
                                p /= total
                                most = (top + np.log(total))[:, 0]
                            r.append(p * weight[:, None])
                            whole.append(weight @ most)
                        s = np.hstack(r).T @ (np.column_stack([np.ones(len(x)), x, x * x]) if diagonal else _products(x))
                        ends = np.cumsum([0, *[p.shape[1] for p in r]])
                        for j, (i, _) in enumerate(of):
                            yield i, np.concatenate([[whole[j], weight.sum()], s[ends[j] : ends[j + 1]].ravel()])

        sums, left = fits.sums(work), []
        for i in live:
            _, m, _ = tries[i]
            s, d = sums[i], m.means.shape[1]
            m.n = float(s[1])
            if not hard:
                done = s[0] - m.loglik < tol * abs(s[0])
                m.loglik = float(s[0])
                if done:
                    continue
            if m.diagonal:
                b = s[2:].reshape(-1, 2 * d + 1)
                size = np.maximum(b[:, 0], 1e-9)
                means = b[:, 1 : d + 1] / size[:, None]
                m.covariances = np.array([np.diag(v) for v in np.maximum(b[:, d + 1 :] / size[:, None] - means**2, 0) + floor])
            else:
                b = s[2:].reshape(-1, 1 + d + d * (d + 1) // 2)
                size = np.maximum(b[:, 0], 1e-9)
                means = b[:, 1 : d + 1] / size[:, None]
                upper = np.triu_indices(d)
                both = np.zeros((len(b), d, d))
                both[:, upper[0], upper[1]] = both[:, upper[1], upper[0]] = b[:, d + 1 :]
                m.covariances = both / size[:, None, None] - means[:, :, None] * means[:, None, :]
                m.covariances = np.array([_positive(c, floor) for c in m.covariances])
            m.weights, m.means = size / size.sum(), means
            left.append(i)
        live, hard = left, False
        if not live:
            break
    best: list[dict[tuple[int, bool], Mixture]] = [{} for _ in fits.axes]
    for f, m, _ in tries:
        kind = len(m.weights), m.diagonal
        if kind not in best[f] or m.loglik > best[f][kind].loglik:
            best[f][kind] = m
    return [sorted(b.values(), key=lambda m: m.bic) for b in best]


def fit_mixtures(df: DataFrame, features: str, key: str, ks: Sequence[int] = range(2, 9), diagonal: Sequence[bool] = (True, False), keep: float | None = None, restarts: int = 20, starts: int = 2, rounds: int = 50, seed: int = 42) -> tuple[Components, list[Mixture]]:
    """The axes of one sample, all rows, and every candidate on them, lowest BIC first. Without ``keep`` the mixtures are of the features as they are."""
    fits = prepare(df.withColumn("__w", F.array(F.lit(1.0))), features, "__w", key, [0], None, keep)
    try:
        found = mixtures(fits, [[(k, d) for k in ks for d in diagonal]], k_means(fits, [ks], restarts, rounds, seed=seed), starts, rounds)[0]
    finally:
        fits.close()
    if keep is None:
        for m in found:
            m.means = m.means + fits.axes[0].mean
    return fits.axes[0], found


def _positive(c: np.ndarray, floor: float) -> np.ndarray:
    """A covariance without negative directions (rounding), plus the floor."""
    c = (c + c.T) / 2
    try:  # none is negative: the floor is all that changes
        np.linalg.cholesky(c + 1e-6 * floor * np.eye(len(c)))
        return c + floor * np.eye(len(c))
    except np.linalg.LinAlgError:
        pass
    values, vectors = np.linalg.eigh(c)
    return (vectors * (np.maximum(values, 0) + floor)) @ vectors.T


def predict(m: Mixture, x: np.ndarray) -> np.ndarray:
    """Probabilities of the components."""
    log = _log_densities(m, x)
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)
