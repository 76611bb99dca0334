"""Nearest neighbours by inner product in vantage-point trees (operator 2).

The vectors are dealt to shards by a hash of their id. Each shard turns inner product into a distance - one more coordinate gives all
its vectors the same length, so that the nearest by Euclid is the largest by inner product - and builds a vantage-point tree: a
vector, the median distance of the others from it, those within and those beyond, and for both the least and largest distance. A block of queries walks down the tree
together. A side of a node is searched where the triangle inequality allows a nearer vector there: the gap between the query's distance and those of the side is
multiplied by ``factor``, so with factor one the search is exact and with a larger one it prunes more.

Every row is indexed and every query meets every shard; a query brings back the ``k`` nearest of the shards of a task, and the
best ``k`` of these are its result.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a null id; of several
dimensions the most frequent takes part; copies of a vector are neighbours of each other, ties go to the smaller id; rows of a query's own id never are its neighbours, rows of another id with several
vectors are each a candidate; extra columns are not read; a repeated query id asks once (with the
smallest of its vectors), rows that repeat an id and a vector are one candidate; fewer
candidates than ``k`` give fewer rows; empty tables give an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facewave.llm._shared import stored
from facewave.llm._text import tidy

LEAF = 128
#: Queries that walk down a tree together.
STEP = 4096


@dataclass
class Node:
    rows: np.ndarray | None = None  # of a leaf
    point: int = 0
    radius: float = 0.0
    inside: Node | None = None
    beyond: Node | None = None
    # least and largest distance from the point to the rows inside and to those beyond
    reach: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))


class VpTree:
    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        square = (x * x).sum(axis=1)
        self.top = float(square.max())
        self.x = np.column_stack([x, np.sqrt(np.maximum(self.top - square, 0))])
        self.square = (self.x * self.x).sum(axis=1)
        self.leaf = leaf
        self.root = self._build(np.arange(len(x)), 0)

    def _distance(self, a: np.ndarray, square: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(square[:, None] + self.square[rows][None, :] - 2 * (a @ self.x[rows].T), 0))

    def _build(self, rows: np.ndarray, depth: int) -> Node:
        if len(rows) <= self.leaf:
            return Node(rows)
        # of a few rows the one that is farthest from the first: it parts the others best
        some = rows[:: max(1, len(rows) // 64)]
        point = int(some[self._distance(self.x[rows[:1]], self.square[rows[:1]], some)[0].argmax()])
        d = self._distance(self.x[[point]], self.square[[point]], rows)[0]
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        parts = order[:half], order[half:]
        reach = tuple((float(d[p[0]]), float(d[p[-1]])) for p in parts)
        return Node(None, point, float(d[order[half]]), *(self._build(rows[p], depth + 1) for p in parts), reach)

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, int]:
        """Places (in ``queries``, in the tree's rows) of all rows found that are as near as a query's ``k``-th, ties at that place included; and the
        distances worked out in all."""
        q = np.column_stack([queries, np.zeros(len(queries))])
        square = (q * q).sum(axis=1)
        # distances come from sums with rounding: what lies within it of a bound is kept
        slack = 1e-7 * np.sqrt(self.top + square)
        best = np.full((len(q), k), np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen = 0

        def walk(node: Node, on: np.ndarray) -> None:
            nonlocal seen
            if not len(on):
                return
            if node.rows is not None:
                seen += len(on) * len(node.rows)
                d = self._distance(q[on], square[on], node.rows)
                best[on] = np.partition(np.concatenate([best[on], d], axis=1), k - 1, axis=1)[:, :k]
                i, j = np.nonzero(d <= (best[on].max(axis=1) + slack[on])[:, None])
                found.append((on[i], node.rows[j], d[i, j]))
                return
            seen += len(on)
            d = self._distance(q[on], square[on], np.array([node.point]))[:, 0]
            # no row of a side is nearer than the gap between d and that side's distances
            gaps = [np.maximum(np.maximum(low - d, d - high), 0) for low, high in node.reach]
            near = d < node.radius
            for first in (True, False):  # the near side of each query, then the other
                for part, gap, own in ((node.inside, gaps[0], near), (node.beyond, gaps[1], ~near)):
                    walk(part, on[(own == first) & (gap * factor <= best[on].max(axis=1) + slack[on])])

        walk(self.root, np.arange(len(q)))
        i, j, d = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        kept = d <= best.max(axis=1)[i] + slack[i]
        return i[kept], j[kept], seen


def usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & ok & F.exists(vector, lambda v: v != 0)


class Shard:
    """The tree over the distinct vectors of a shard, and the ids of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.lexsort((*x.T, ids))
        ids, x = ids[order], x[order]
        once = np.concatenate(([True], (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)))
        ids, x = ids[once], x[once]
        _, first, copy_of = np.unique(x.view([("", x.dtype)] * x.shape[1]), return_index=True, return_inverse=True)
        copy_of = copy_of.ravel()
        self.ids, self.begins = ids[np.argsort(copy_of, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(copy_of))])
        self.x, self.sorted_ids = x[first], ids  # ids are in order
        self.tree = VpTree(self.x.astype(np.float64))

    def nearest(self, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vector id, score) of the vectors found, a query's own id left out."""
        # more than wanted by the vectors that stand here under a query's own id
        own = np.searchsorted(self.sorted_ids, query_ids, "right") - np.searchsorted(self.sorted_ids, query_ids, "left")
        i, r, _ = self.tree.search(q, k + int(own.max(initial=0)), factor)
        score = np.concatenate([(self.x[r[a : a + 65536]].astype(np.float64) * q[i[a : a + 65536]]).sum(axis=1) for a in range(0, len(r), 65536)] or [np.empty(0)])
        # of copies the smallest ids; an id has a vector once, so one of them may be the query's own
        n = np.minimum(self.begins[r + 1] - self.begins[r], k + 1)
        at = np.repeat(self.begins[r] - np.cumsum(n) + n, n) + np.arange(n.sum())
        found = np.repeat(query_ids[i], n), self.ids[at], np.repeat(score, n)
        other = found[0] != found[1]
        return best_of(*(c[other] for c in found), k)


def best_of(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``k`` rows with the largest scores, ties by id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))[: len(query)]
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[rank < k], vec[rank < k], score[rank < k]


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 4.0, key: str = "vec_id", vector: str = "embedding", shard_rows: int = 8192, block: int = 65536) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of ``queries`` the ``k`` rows of ``vectors`` with the largest inner product
    that were found, its own id left out.

    Trees are built once for each shard. Queries go to all tasks in blocks of at most ``block`` (a broadcast of that bound); a task searches its
    shards one after the other and returns its best ``k`` of each query. With several blocks the trees are stored and read again for each."""
    spark = vectors.sparkSession
    take = lambda df: df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    base, asked = take(vectors), take(queries)
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d, n = sizes[0]["d"], sizes[0]["count"]
    base = base.where(F.size("v") == d)
    asked = asked.where(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v"))  # a repeated id asks once
    shards, blocks = math.ceil(n / shard_rows), math.ceil(max(asked.count(), 1) / block)

    def build(table: pa.Table) -> pa.Table:
        shard = Shard(table["id"].to_numpy(), _matrix(table["v"], d))
        return pa.table([pa.array([pickle.dumps(shard)], pa.binary())], ["tree"])

    trees = base.groupBy(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")).applyInArrow(build, "tree binary")
    trees = stored(trees, "trees") if blocks > 1 else trees
    asked = stored(asked, "asked") if blocks > 1 else asked

    def found(b: int) -> DataFrame:
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast((got["id"].to_numpy(), _matrix(got["v"], d).astype(np.float64)))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))] * (len(ids) // STEP + 1)
            for batch in batches:
                for tree in batch.column(0):
                    shard = pickle.loads(tree.as_py())
                    for j in range(len(best)):
                        part = slice(j * STEP, (j + 1) * STEP)
                        both = zip(best[j], shard.nearest(ids[part], q[part], k, factor), strict=True)
                        best[j] = best_of(*map(np.concatenate, both), k)
            for row in best:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["query_id", "vec_id", "score"])

        return trees.mapInArrow(tidy(work), "query_id long, vec_id long, score double")

    got = found(0) if blocks == 1 else reduce(DataFrame.union, [stored(found(b), "found") for b in range(blocks)])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
