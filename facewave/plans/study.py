"""Parts of studies made of the operators: normalising, scoring, paired regressions, artifact checks, the cluster table, silhouettes.

A study takes a table (id, subject, features array<double>, alpha double). Only tables of subjects, folds, components and
metrics reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facewave.operators import hypothesis, models, together


def normaliser(train: DataFrame, features: str = "features", subject: str = "subject") -> DataFrame:
    """(subject, mean, std) of the features as arrays, by subject and (null) over all rows."""
    long = train.select(subject, F.posexplode(features).alias("i", "v"))
    one = lambda by: long.groupBy(*by, "i").agg(F.avg("v").alias("m"), (F.stddev_pop("v") + 1e-8).alias("s"))
    pack = lambda df, by: df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "m", "s"))).alias("z"))
    every = pack(one([]), []).withColumn(subject, F.lit(None).cast(train.schema[subject].dataType))
    both = pack(one([subject]), [subject]).unionByName(every)
    return both.select(subject, F.transform("z", lambda x: x["m"]).alias("mean"), F.transform("z", lambda x: x["s"]).alias("std"))


def normalised(df: DataFrame, stats: DataFrame, features: str = "features", subject: str = "subject") -> DataFrame:
    """Features less the subject's mean over its deviation; subjects without statistics use those of all rows."""
    overall = stats.where(F.col(subject).isNull()).select(F.col("mean").alias("__m"), F.col("std").alias("__s"))
    out = df.join(stats.where(F.col(subject).isNotNull()), subject, "left").crossJoin(F.broadcast(overall))  # one row
    z = F.zip_with(F.zip_with(features, F.coalesce("mean", "__m"), lambda x, m: x - m), F.coalesce("std", "__s"), lambda d, s: d / s)
    return out.withColumn(features, z).select(df.columns)


@dataclass
class Scorer:
    """A fitted pipeline whose parameters are a small table: statistics, axes, mixture."""

    stats: DataFrame
    axes: models.Components
    mixture: models.Mixture

    def score(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``probability``, ``label`` and ``share``, the probability of the best component."""
        x = self.axes.transform(normalised(df, self.stats, features), features, "components")
        out = models.assign(x, "components", self.mixture)
        return out.withColumn("share", F.array_max("probability")).drop("components")

    def profiles(self) -> np.ndarray:
        """Component means in the normalised features."""
        return self.axes.inverse(self.mixture.means)

    def save(self, path: str) -> None:
        m = self.mixture
        body = {"mean": self.axes.mean.tolist(), "axes": self.axes.axes.tolist(), "ratio": self.axes.ratio.tolist(), "weights": m.weights.tolist(), "means": m.means.tolist(), "covariances": m.covariances.tolist(), "diagonal": m.diagonal}
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        self.stats.sparkSession.createDataFrame([(json.dumps(body),)], "body string").write.mode("overwrite").text(f"{path}/model")


def load_scorer(spark, path: str) -> Scorer:
    b = json.loads(spark.read.text(f"{path}/model").first()[0])
    a = {k: np.array(v) for k, v in b.items() if k != "diagonal"}
    return Scorer(spark.read.parquet(f"{path}/stats"), models.Components(a["mean"], a["axes"], a["ratio"]), models.Mixture(a["weights"], a["means"], a["covariances"], b["diagonal"]))


def fit_scorer(train: DataFrame, ks: Sequence[int] = range(2, 9), keep: float = 0.95, rounds: int = 50) -> Scorer:
    """Statistics, axes and the mixture of lowest BIC over ``ks``, each from the two cheapest different K-Means of its number."""
    stats = normaliser(train)
    axes, found = together.fit_mixtures(normalised(train, stats), "features", "id", ks, keep=keep, rounds=rounds)
    return Scorer(stats, axes, found[0])


def paired_summary(gains: DataFrame, by: str = "model", subject: str = "subject", gain: str = "gain", n: int = 2000) -> DataFrame:
    """(by, n, mean, std, low, high, p) of the subjects' gains: their mean with its bootstrap interval, and the signed-rank test of no gain."""
    tests = [hypothesis.signed_rank_table(gains.where(F.col(by) == m), gain).select(F.lit(m).alias(by), "p") for m in sorted(r[0] for r in gains.select(by).distinct().collect())]  # a few models
    out = hypothesis.bootstrap_ci(gains, by, gain, n, key=subject)
    return out.join(F.broadcast(reduce(DataFrame.unionByName, tests)), by) if tests else out.withColumn("p", F.lit(None).cast("double"))


def artifact_check(labels: DataFrame, excluded: dict[int, Sequence[int]], bands: Sequence[str]) -> DataFrame:
    """(fold, variable, n, groups, h, p, adjusted, survives): the tests of each fold after the rows of its excluded clusters are left out; a variable survives where its p, adjusted over the
    variables, is below 0.05."""
    out = []
    for fold, gone in excluded.items():
        kept = labels.where(F.col("fold") == fold)
        kept = kept.where(~F.col("label").isin(*gone)) if gone else kept
        rows = hypothesis.band_statistics(kept, "label", bands)
        out.append(rows.select(F.lit(fold).alias("fold"), F.col("band").alias("variable"), "n", "groups", "h", "p", "adjusted", (F.col("adjusted") < 0.05).alias("survives")))
    return reduce(DataFrame.unionByName, out)


def cluster_table(stats: DataFrame, fits: DataFrame, bands: Sequence[str], models_: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row for each fold: its statistics (fold, band, h, adjusted, epsilon2) with a column for each band, and beside every fold the measures of the fits
    (model, features compact or augmented, measures) with their differences."""
    at = lambda c, b: F.max(F.when(F.col("band") == b, F.col(c)))
    folds = stats.groupBy("fold").agg(*[at(c, b).alias(f"{n}_{b}") for b in bands for c, n in (("h", "kw"), ("adjusted", "p_holm"), ("epsilon2", "epsilon_squared"))])
    of = lambda k, f, m: F.max(F.when((F.col("model") == k) & (F.col("features") == f), F.col(m)))
    cells = [of(k, f, m).alias(f"{k}_{f}_{m}") for k in models_ for f in ("compact", "augmented") for m in measures]
    gains = [(of(k, "augmented", m) - of(k, "compact", m)).alias(f"{k}_paired_{m}_delta") for k in models_ for m in measures]
    return folds.crossJoin(F.broadcast(fits.agg(*cells, *gains)))  # one row


def exact_silhouette(df: DataFrame, features: str, label: str, key: str, block: int = 4096) -> DataFrame:
    """(key, silhouette) by Euclidean distance of every row with features and a label, against all such rows; keys are unique. Rows are dealt to
    shards by a hash of the key, and every two shards (and each with itself) are compared once, in a task of their own. What goes on from there are
    sums of distances by row and label. 0 for the only row of a label or where there is one label."""
    import pyarrow as pa

    rows = df.where(F.col(key).isNotNull() & F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).alias("own"), F.col(features).alias("x"))
    sizes = rows.groupBy(F.col("own").alias("other")).agg(F.count("*").alias("size"))
    shards = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = dealt.select("id", "own", "x", "shard", F.least("shard", "with").alias("i"), F.greatest("shard", "with").alias("j"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        shard = group["shard"].to_numpy()
        sides = []
        for part in (group.filter(pa.array(shard == group["i"][0].as_py())), group.filter(pa.array(shard == group["j"][0].as_py()))):
            names, code = np.unique(part["own"].to_numpy(zero_copy_only=False), return_inverse=True)
            order = np.argsort(code, kind="stable")
            part = part.take(pa.array(order))
            x = np.array(part["x"].to_pylist(), float).reshape(len(part), -1)
            sides.append((part, x, (x * x).sum(axis=1), names, np.searchsorted(code[order], np.arange(len(names)))))
        out = []
        for a, b in ((0, 1),) if group["i"][0] == group["j"][0] else ((0, 1), (1, 0)):
            (part, y, yy, _, _), (_, x, xx, names, starts) = sides[a], sides[b]
            if not len(y) or not len(x):
                continue
            sums = np.empty((len(y), len(names)))
            for k in range(0, len(y), 256):
                both = yy[k : k + 256, None] + xx[None]
                square = both - 2 * y[k : k + 256] @ x.T
                square[square <= 1e-13 * both] = 0.0  # no more than rounding: equal rows
                sums[k : k + 256] = np.add.reduceat(np.sqrt(square), starts, axis=1)
            at = np.repeat(np.arange(len(y)), len(names))
            out.append(pa.table({"id": part["id"].take(pa.array(at)), "own": part["own"].take(pa.array(at)), "other": pa.array(np.tile(names, len(y)), part["own"].type), "total": sums.ravel()}))
        return pa.concat_tables(out)

    kind = df.schema[label].dataType.simpleString()
    sums = dealt.groupBy("i", "j").applyInArrow(compare, f"id {df.schema[key].dataType.simpleString()}, own {kind}, other {kind}, total double")
    sums = sums.groupBy("id", "own", "other").agg(F.sum("total").alias("total")).join(sizes, "other")
    inside = F.col("own") == F.col("other")
    found = sums.groupBy("id").agg(F.max(F.when(inside, F.col("size"))).alias("n"), F.max(F.when(inside, F.col("total") / F.greatest(F.col("size") - 1, F.lit(1)))).alias("a"), F.min(F.when(~inside, F.col("total") / F.col("size"))).alias("b"))
    score = (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300))
    return found.select(F.col("id").alias(key), F.when((F.col("n") > 1) & F.col("b").isNotNull(), score).otherwise(0.0).alias("silhouette"))
