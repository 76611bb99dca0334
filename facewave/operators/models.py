"""Models from sums: principal components, ridge by folds, permutation controls, mixtures and k-means.

What reaches the driver are sums whose size follows the number of features, folds, components or permutations, never the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facewave.operators.boosting import fit_boosted, predict_boosted
from facewave.operators.sequence import numbered
from facewave.operators.shuffles import places, round_keys


class Moments(dict):
    """Sums of w z z' by key, with z = (1, features, targets) less ``shift`` (which has no part for the 1)."""

    shift: np.ndarray


def centre(df: DataFrame, rows: int = 1000) -> np.ndarray:
    """The medians of some rows (array<double> z): numbers near all values, so that sums of squares about them lose no digits."""
    some = [r[0] for r in df.limit(rows).collect()]
    return np.nan_to_num(np.median(np.array(some, float), axis=0)) if some else np.zeros(0)


def gram(df: DataFrame, features: str, targets: Sequence[str] = (), by: str | None = None, weight: str | None = None) -> Moments:
    """Moments for each value of ``by`` (None: one entry), rows counting by ``weight``."""
    z = F.concat(F.transform(features, lambda x: x.cast("double")), F.array(*[F.col(t).cast("double") for t in targets]).cast("array<double>"))
    rows = df.select(z.alias("z"), (F.col(by) if by else F.lit(0)).cast("long").alias("k"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("w"))
    shift = centre(rows.select("z"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for k, part in pdf.groupby("k"):
                z = np.column_stack([np.ones(len(part)), np.array(part["z"].tolist(), float) - shift])
                total[k] = total.get(k, 0) + (z.T * part["w"].to_numpy(float)) @ z
        for k, m in total.items():
            yield pd.DataFrame({"k": [int(k)], "m": [m.ravel().tolist()]})

    parts = rows.mapInPandas(work, "k long, m array<double>").select("k", F.posexplode("m").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    held: dict = {}
    for r in parts.orderBy("k", "i").collect():
        held.setdefault(r["k"], []).append(r["v"])
    out = Moments({k: np.array(v).reshape(math.isqrt(len(v)), -1) for k, v in held.items()})
    out.shift = shift
    return out


@dataclass
class Components:
    mean: np.ndarray
    axes: np.ndarray  # [kept, features]
    ratio: np.ndarray  # share of variance of every axis

    def transform(self, df: DataFrame, features: str, out: str = "components") -> DataFrame:
        mean, axes = self.mean, self.axes

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            return pd.Series(list((np.array(x.tolist(), float).reshape(len(x), -1) - mean) @ axes.T)) if len(x) else pd.Series([], dtype=object)

        return df.withColumn(out, project(features))

    def inverse(self, points: np.ndarray) -> np.ndarray:
        return points @ self.axes + self.mean


def principal_components(df: DataFrame, features: str, keep: float = 0.95, weight: str | None = None) -> Components:
    """The fewest axes whose share of variance exceeds ``keep``; the largest loading of each axis is positive."""
    sums = gram(df, features, weight=weight)
    m = sums[0]
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    values, vectors = np.linalg.eigh((m[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    ratio = values / max(values.sum(), 1e-300)
    k = min(int(np.searchsorted(np.cumsum(ratio), keep, "right")) + 1, len(ratio))
    axes = vectors[:k] * np.sign(vectors[np.arange(k), np.abs(vectors[:k]).argmax(axis=1)])[:, None]
    return Components(mean + sums.shift, axes, ratio)


def _ridge(m: np.ndarray, d: int, alpha: float) -> np.ndarray:
    """Weights [1 + d, targets] from a moment matrix; features are scaled to deviation one and the constant is free."""
    n, mean = m[0, 0], m[0, 1 : d + 1] / m[0, 0]
    centred = m[1 : d + 1, 1 : d + 1] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(centred) / n, 0))
    scale[scale < 1e-12] = 1
    y = m[0, d + 1 :] / n
    cross = (m[1 : d + 1, d + 1 :] - n * np.outer(mean, y)) / scale[:, None]
    w = np.linalg.solve(centred / np.outer(scale, scale) + alpha * np.eye(d), cross) / scale[:, None]
    return np.vstack([y - mean @ w, w])


def ridge_by_fold(df: DataFrame, features: str, targets: Sequence[str], fold: str, alpha: float) -> dict[int, np.ndarray]:
    """Weights of each fold, fitted on all the others: the sums of a fold are taken from the sums of all."""
    sums = gram(df, features, targets, fold)
    total = sum(sums.values())
    d = len(total) - 1 - len(targets)
    out = {k: _ridge(total - m, d, alpha) for k, m in sums.items()}
    for w in out.values():  # the constant for features as they are
        w[0] += sums.shift[d:] - sums.shift[:d] @ w[1:]
    return out


def predict_by_fold(df: DataFrame, features: str, fold: str, weights: dict[int, np.ndarray], names: Sequence[str]) -> DataFrame:
    """Adds the held-out predictions as columns ``names``. The weights go to every task as a table with a row for each fold."""
    table = df.sparkSession.createDataFrame([(int(k), w.T.tolist()) for k, w in weights.items()], "__k int, __w array<array<double>>")
    at = lambda j: F.get("__w", F.lit(j))
    sums = {name: F.get(at(j), F.lit(0)) + F.aggregate(F.zip_with(F.slice(at(j), F.lit(2), F.size(features)), features, lambda a, x: a * x), F.lit(0.0), lambda t, v: t + v) for j, name in enumerate(names)}
    return df.join(F.broadcast(table), F.col(fold) == F.col("__k"), "left").withColumns(sums).drop("__k", "__w")


def pooled_r2(sums: dict[int, np.ndarray], d: int, alpha: float) -> np.ndarray:
    """R2 of each target over all rows, every row predicted by the fold that did not see it; from moment matrices alone."""
    total = sum(sums.values())
    residual = 0
    for m in sums.values():
        w = _ridge(total - m, d, alpha)
        x, xy, y = m[: d + 1, : d + 1], m[: d + 1, d + 1 :], np.diag(m[d + 1 :, d + 1 :])
        residual = residual + y - 2 * (w * xy).sum(axis=0) + (w * (x @ w)).sum(axis=0)
    n = total[0, 0]
    spread = np.diag(total[d + 1 :, d + 1 :]) - total[0, d + 1 :] ** 2 / n
    return np.where(spread > 1e-12, 1 - residual / np.where(spread > 1e-12, spread, 1), (residual < 1e-12).astype(float))


def permutation_control(df: DataFrame, features: str, target: str, fold: str, key: str, alpha: float, n: int = 200, seed: int = 42, cells: int = 1 << 22) -> tuple[float, float]:
    """(true R2, p) when targets are permuted over all rows. A permutation leaves the features' moments alone, so those of the true targets serve for all; only sums of features
    by permuted target are made anew.

    Rows are numbered; in each permutation a row's target goes to the row that ``shuffles.places`` names. Targets are sent to blocks of rows, where they meet the features of that block, and a block
    gives one vector for each permutation and fold. No task holds more than a block (``cells`` targets), and no row is bound to a group, whatever the table."""
    base = gram(df, features, [target], fold)
    d, count, shift = len(next(iter(base.values()))) - 2, int(sum(m[0, 0] for m in base.values())), base.shift
    true, width = float(pooled_r2(base, d, alpha)[0]), max(256, cells // n)
    rows = df.select(F.col(key).alias("key"), F.col(target).cast("double").alias("y"), F.col(features).alias("x"), F.col(fold).cast("int").alias("fold"), F.xxhash64(F.lit(seed), key).cast("double").alias("h"))
    rows = numbered(rows, [], "h", "i", tie="key")
    kind = np.dtype([("perm", "<i4"), ("at", "<i4"), ("y", "<f8")])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = round_keys(seed, list(range(n)))
        for pdf in batches:
            for a in range(0, len(pdf), 4096):
                i, y = pdf["i"].to_numpy(np.int64)[a : a + 4096], pdf["y"].to_numpy(float)[a : a + 4096] - shift[d]
                to = places(i, count, keys).ravel()
                packed = np.empty(len(to), kind)
                packed["perm"], packed["at"], packed["y"] = np.tile(np.arange(n), len(i)), to % width, np.repeat(y, n)
                block = to // width
                order = np.argsort(block, kind="stable")
                names, first = np.unique(block[order], return_index=True)
                yield pd.DataFrame({"block": names, "sent": [p.tobytes() for p in np.split(packed[order], first[1:])]})

    def meet(rows: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"perm": [], "fold": [], "s": []})
        rows = rows.sort_values("i")
        x, z = np.column_stack([np.ones(len(rows)), np.array(rows["x"].tolist(), float) - shift[:d]]), np.zeros((n, len(rows)))
        for got in sent["sent"]:
            got = np.frombuffer(got, kind)
            z[got["perm"], got["at"]] = got["y"]
        out = []
        for k in np.unique(rows["fold"]):
            on = (rows["fold"] == k).to_numpy()
            sums = np.column_stack([z[:, on] @ x[on], (z[:, on] ** 2).sum(axis=1)])
            out += [(perm, k, s.tolist()) for perm, s in enumerate(sums)]
        return pd.DataFrame(out, columns=["perm", "fold", "s"])

    blocks = rows.select(F.floor(F.col("i") / width).alias("block"), "i", "x", "fold").groupBy("block")
    sent = rows.select("i", "y").mapInPandas(send, "block long, sent binary").groupBy("block")
    sums = blocks.cogroup(sent).applyInPandas(meet, "perm int, fold int, s array<double>").select("perm", "fold", F.posexplode("s").alias("i", "v")).groupBy("perm", "fold", "i").agg(F.sum("v").alias("v"))
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in sums.collect():  # permutations by folds by features
        found.setdefault(r["perm"], {}).setdefault(r["fold"], np.zeros(d + 2))[r["i"]] = r["v"]

    def moments(m: np.ndarray, s: np.ndarray) -> np.ndarray:
        m = m.copy()
        m[: d + 1, d + 1] = m[d + 1, : d + 1] = s[:-1]
        m[d + 1, d + 1] = s[-1]
        return m

    reached = sum(float(pooled_r2({k: moments(base[k], s) for k, s in block_.items()}, d, alpha)[0]) >= true for block_ in found.values())
    return true, (reached + 1) / (n + 1)


def boosted_by_fold(df: DataFrame, features: str, target: str, fold: str, name: str, trees: int = 50, depth: int = 3) -> DataFrame:
    """Adds ``name``: each row's prediction by gradient boosting fitted on the other folds."""
    return predict_boosted(df, fit_boosted(df, features, [target], fold, trees, depth), features, fold, [name])


def baselines(df: DataFrame, features: str, target: str, fold: str, column: int, trees: int = 50, depth: int = 3) -> DataFrame:
    """(fold, model, mae, rmse, r2) of the training mean, a ridge on one column, a ridge on all and gradient boosting, each fold predicted by the others."""
    sums = df.groupBy(fold).agg(F.sum(target).alias("__s"), F.count(target).alias("__n"))
    total = sums.agg(F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn"))
    means = sums.crossJoin(F.broadcast(total)).select(fold, ((F.col("__ts") - F.col("__s")) / (F.col("__tn") - F.col("__n"))).alias("mean"), (F.col("__s") / F.col("__n")).alias("__own"))
    rows = df.join(F.broadcast(means), fold).withColumn("__one", F.array(F.get(features, F.lit(column))))  # a row for each fold
    for name, x, alpha in (("ridge_column", "__one", 10.0), ("ridge", features, 100.0)):
        rows = predict_by_fold(rows, x, fold, ridge_by_fold(rows, x, [target], fold, alpha), [name])
    rows = boosted_by_fold(rows, features, target, fold, "boosted", trees, depth)
    names = ["mean", "ridge_column", "ridge", "boosted"]
    gap = lambda c: F.pow(F.col(target) - F.col(c), 2)
    long = rows.select(fold, target, "__own", F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))])).alias("model", "p"))
    return long.groupBy(fold, "model").agg(F.avg(F.abs(F.col(target) - F.col("p"))).alias("mae"), F.sqrt(F.avg(gap("p"))).alias("rmse"), (1 - F.sum(gap("p")) / F.sum(gap("__own"))).alias("r2"))


def zeroed(df: DataFrame, features: str, positions: Sequence[int]) -> DataFrame:
    """Features with some positions set to 0 (an ablation)."""
    return df.withColumn(features, F.transform(features, lambda x, i: F.when(i.isin(*positions), 0.0).otherwise(x)))


def k_means(df: DataFrame, features: str, ks: Sequence[int] = range(2, 9), seeds: Sequence[int] = (1, 2, 3)) -> tuple[int, dict[int, float], object]:
    """The number of clusters with the largest silhouette (squared distance), the curve, and the model."""
    rows = df.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("features")).cache()
    curve, models = {}, {}
    try:
        for k in ks:
            fits = [KMeans(k=k, seed=s, featuresCol="features").fit(rows) for s in seeds]
            best = min(fits, key=lambda m: m.summary.trainingCost)
            used = best.summary.cluster.select("prediction").distinct().count()
            curve[k] = ClusteringEvaluator(featuresCol="features").evaluate(best.transform(rows)) if used > 1 else -1.0
            models[k] = best
    finally:
        rows.unpersist()
    k = max(curve, key=lambda x: (curve[x], -x))
    return k, curve, models[k]


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray  # [k, d, d]
    diagonal: bool
    loglik: float = -math.inf
    n: float = 0

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.weights)))
        for j, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances, strict=True)):
            low = np.linalg.cholesky(c)
            z = np.linalg.solve(low, (x - m).T)
            out[:, j] = math.log(max(w, 1e-300)) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
        return out

    @property
    def bic(self) -> float:
        k, d = self.means.shape
        free = 2 * k * d + k - 1 if self.diagonal else k * d * (d + 1) // 2 + k * d + k - 1
        return -2 * self.loglik + free * math.log(max(self.n, 1))


def assign(df: DataFrame, features: str, model: Mixture) -> DataFrame:
    """Adds ``probability`` (array) and ``label``, the most probable component."""

    @F.pandas_udf("array<double>")
    def probability(x: pd.Series) -> pd.Series:
        log = model.log_densities(np.array(x.tolist(), float))
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return pd.Series(list(p / p.sum(axis=1, keepdims=True)))

    out = df.withColumn("probability", probability(features))
    return out.withColumn("label", (F.array_position("probability", F.array_max("probability")) - 1).cast("int"))
