"""Gradient boosting of all folds and targets at once, from histograms of binned features.

Features are cut at quantiles into a few bins. A level of the trees of every fold and target is one pass over the rows: a task adds up counts and residuals by fold, target, node,
feature and bin, and these sums, whose size follows the models and not the rows, choose the splits. Rows keep what the trees so far give them, so that a pass goes through the last few trees only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from facewave.operators.sums import added

#: Trees after which rows take in what the trees give them, and rows from which on a small table is worth another core.
EVERY, LEAST = 10, 2000


@dataclass
class Forest:
    """Trees [fold, target, tree, node] over binned features; a row goes right where its bin lies above ``cut``."""

    folds: list[int]
    edges: list[np.ndarray]
    base: np.ndarray  # [fold, target]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray  # [fold, target, tree, leaf]
    columns: list[np.ndarray] = field(default_factory=list)  # the places in the vector that each fold sees, all if empty

    def seen(self, bins: np.ndarray, f: int) -> np.ndarray:
        return bins[:, self.columns[f]] if self.columns else bins

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)]).astype(np.uint8)

    def nodes(self, bins: np.ndarray, f: int, j: int, t: int, depth: int) -> np.ndarray:
        """The node of each row at a depth, from 0."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for level in range(depth):
            node = at + (1 << level) - 1
            at = 2 * at + (bins[rows, self.feature[f, j, t][node]] > self.cut[f, j, t][node])
        return at

    def gains(self, bins: np.ndarray, f: int, j: int, first: int, last: int) -> np.ndarray:
        """What trees from ``first`` to before ``last`` add."""
        depth = self.value.shape[3].bit_length() - 1
        return sum((self.value[f, j, t][self.nodes(bins, f, j, t, depth)] for t in range(first, last)), np.zeros(len(bins)))


def _splits(counts: np.ndarray, sums: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Of the counts and residuals of a node [feature, bin] the split that lowers the squares most, and counts and sums of its sides. Nothing to gain: all go left."""
    left, right = np.cumsum(counts, axis=1), 0
    low = np.cumsum(sums, axis=1)
    all_n, all_s = left[0, -1], low[0, -1]
    right, high = all_n - left, all_s - low
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((left > 0) & (right > 0), low * low / left + high * high / right, -np.inf)
    d, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if not all_n or gain[d, b] <= all_s * all_s / all_n * (1 + 1e-12) + 1e-300:
        d, b = 0, counts.shape[1] - 1
    return int(d), int(b), np.array([left[d, b], right[d, b]]), np.array([low[d, b], high[d, b]])


def fit_boosted(df: DataFrame, features: str, targets: Sequence[str], fold: str, trees: int = 50, depth: int = 3, rate: float = 0.1, bins: int = 32, part_rows: int = 50_000, columns: Sequence[Sequence[int]] = ()) -> Forest:
    """Each fold's trees, fitted on the rows of all other folds, in order of the folds. ``columns`` are the places in the vector that each fold's trees see, as many for each; none given: all of it."""
    if len({len(c) for c in columns}) > 1:
        raise ValueError("folds must see equally many features")
    rows = df.select(F.col(fold).cast("int").alias("fold"), F.transform(features, lambda x: x.cast("double")).alias("x"), F.array(*[F.col(t).cast("double") for t in targets]).alias("y"))
    about = rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(F.get("y", F.lit(j))).alias(f"s{j}") for j in range(len(targets))]).orderBy("fold").collect()
    if not about:
        return Forest([], [], np.zeros((0, len(targets))), *[np.zeros((0, len(targets), trees, n)) for n in (2**depth - 1, 2**depth - 1, 2**depth)])
    folds, many = [r["fold"] for r in about], np.array([r["n"] for r in about], float)
    sums = np.array([[r[f"s{j}"] for j in range(len(targets))] for r in about])
    d = rows.select(F.max(F.size("x"))).first()[0]
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(i)), at, 1000).alias(f"q{i}") for i in range(d)]).first()
    others = np.maximum(many.sum() - many, 1)[:, None]
    shape = (len(folds), len(targets), trees)
    forest = Forest(folds, [np.unique(q) for q in found], (sums.sum(axis=0) - sums) / others, np.zeros((*shape, 2**depth - 1), np.int64), np.full((*shape, 2**depth - 1), bins, np.int64), np.zeros((*shape, 2**depth)), [np.array(c, int) for c in columns])
    d = len(columns[0]) if columns else d

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                b = forest.bins(np.array(pdf["x"].tolist(), float).reshape(len(pdf), -1))
                yield pd.DataFrame({"fold": pdf["fold"], "bins": [r.tobytes() for r in b], "y": pdf["y"], "m": [forest.base.ravel().tolist()] * len(pdf)})

    kept = "fold int, bins binary, y array<double>, m array<double>"
    parts = max(int(many.sum() // part_rows) + 1, min(df.sparkSession.sparkContext.defaultParallelism, int(many.sum() // LEAST) + 1))
    table = rows.repartition(parts).mapInPandas(binned, kept).persist()

    def read(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        b = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), -1)
        return pdf["fold"].to_numpy(), b, np.array(pdf["y"].tolist(), float), np.array(pdf["m"].tolist(), float).reshape(len(pdf), *forest.base.shape)

    def histogram(tree: int, level: int, since: int) -> np.ndarray:
        """Counts and residuals [fold, target, node, feature, bin, 2] of a level."""
        size = (*forest.base.shape, 1 << level, d, bins)

        def work(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            total = np.zeros((2, *size))
            for batch in batches:
                of, b, y, m = read(batch.to_pandas())
                for f, k in enumerate(forest.folds):
                    on = of != k
                    own = forest.seen(b, f)[on]
                    cell = np.arange(d) * bins + own
                    for j in range(y.shape[1]):
                        residual = y[on, j] - m[on, f, j] - forest.gains(own, f, j, since, tree)
                        place = (forest.nodes(own, f, j, tree, level)[:, None] * (d * bins) + cell).ravel()
                        total[0, f, j] += np.bincount(place, minlength=total[0, f, j].size).reshape(size[2:])
                        total[1, f, j] += np.bincount(place, np.repeat(residual, d), total[0, f, j].size).reshape(size[2:])
            return {0: total.ravel()}

        return added(table, work, parts)[0].reshape(2, *size)

    since = 0
    try:
        for tree in range(trees):
            for level in range(depth):
                counts, residuals = histogram(tree, level, since)
                for f in range(len(folds)):
                    for j in range(len(targets)):
                        for node in range(1 << level):
                            at, cut, n, s = _splits(counts[f, j, node], residuals[f, j, node])
                            forest.feature[f, j, tree, node + (1 << level) - 1], forest.cut[f, j, tree, node + (1 << level) - 1] = at, cut
                            if level == depth - 1:
                                forest.value[f, j, tree, 2 * node : 2 * node + 2] = rate * s / np.maximum(n, 1)
            if (tree + 1) % EVERY == 0 and tree + 1 < trees:
                def taken_in(batches: Iterator[pd.DataFrame], since: int = since, to: int = tree + 1) -> Iterator[pd.DataFrame]:
                    for pdf in batches:
                        if len(pdf):
                            _, b, _, m = read(pdf)
                            for f in range(m.shape[1]):
                                for j in range(m.shape[2]):
                                    m[:, f, j] += forest.gains(forest.seen(b, f), f, j, since, to)
                            yield pdf.assign(m=list(m.reshape(len(pdf), -1)))

                old, table, since = table, table.mapInPandas(taken_in, kept).persist(), tree + 1
                table.count()
                old.unpersist()
    finally:
        table.unpersist()
    return forest


def predict_boosted(df: DataFrame, forest: Forest, features: str, fold: str, names: Sequence[str]) -> DataFrame:
    """Adds the predictions of each row by its own fold's trees, which have not seen it, as columns ``names``; null for a fold without trees."""
    schema = StructType([*df.schema, *[StructField(n, DoubleType()) for n in names]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array(batch.column(batch.schema.get_field_index(fold)).to_pylist(), float)
            out = np.full((len(names), len(batch)), np.nan)
            if len(batch) and forest.edges:
                b = forest.bins(np.array(batch.column(batch.schema.get_field_index(features)).to_pylist(), float).reshape(len(batch), -1))
                for f, k in enumerate(forest.folds):
                    on = of == k
                    for j in range(len(names)):
                        out[j, on] = forest.base[f, j] + forest.gains(forest.seen(b, f)[on], f, j, 0, forest.value.shape[2])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(o, pa.float64(), from_pandas=True) for o in out]], names=schema.names)

    return df.mapInArrow(work, schema)
