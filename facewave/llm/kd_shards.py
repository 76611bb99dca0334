"""Sharding by k-d tree (operator 8).

The rows are points with a weight in bytes; the dimensions are their metadata, each on the same scale (the query takes language, source
and number of characters). A node that stands for several shards is split along its widest dimension at the weighted median - the place that gives each half its share of the shards in bytes - and so on until every leaf is one shard of the
target size. Medians are found for all nodes of a level together: counts of bytes by a few bits of the coordinate at a time (a
grouped sum in Spark, some thousands of rows to the driver whatever the input) narrow each down to one coordinate, then rows with that very
coordinate are split by the text's CRC and at last by a hash, so that sizes come out near equal even where many rows share a coordinate.

Rows with equal texts stay in one shard: they take the metadata and the hash of their group, so no cut can part them. Only a group that holds more than ``WHOLE`` of a shard's bytes is split, by
a hash of its keys, as no shards near equal in size could hold it.

Defined results: null text has no bytes (the fixed part of the size remains) and CRC 0, and counts as the empty text in groups; null metadata counts as 0; rows that are equal in all
get shards by their hash; an empty table gives an empty result; extra columns are dropped by the query and kept by ``shards`` whatever they are called, but that it
replaces columns named shard and slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from facewave.llm._shared import as_they_are, named, small, stored
from facewave.llm._text import tidy

#: Bits of a coordinate, and bits that one pass settles.
BITS, STEP = 24, 12
#: A split may miss its share by so much of a shard.
MISS = 0.0005
#: Share of a shard's bytes up to which rows with equal texts stay together.
WHOLE = 0.25


@dataclass
class Node:
    first: int  # shards first to first + n - 1
    n: int
    dim: int = 0
    # a row goes left if (coordinate, crc, hash) is below the cut
    cut: tuple[int, int, int] = (0, 0, 0)
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if not self.left else self.left.leaves() + self.right.leaves()


def leaf_of(root: Node, dims: np.ndarray, crc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The first shard of the leaf of every row; ``dims`` is [dimensions, rows]."""
    out = np.zeros(len(crc), np.int32)
    stack = [(root, np.arange(len(crc)))]
    while stack:
        node, rows = stack.pop()
        if not node.left:
            out[rows] = node.first
            continue
        a, b, c = dims[node.dim][rows], crc[rows], key[rows]
        x, y, z = node.cut
        below = (a < x) | ((a == x) & ((b < y) | ((b == y) & (c < z))))
        stack += [(node.left, rows[below]), (node.right, rows[~below])]
    return out


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (size, crc, hash, dimensions ...): dimensions, crc, hash and size."""
    size, crc, key, *dims = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
    return np.array(dims), crc, key, size


def _sums(points: DataFrame, root: Node, cells: dict[int, tuple[int, tuple[int, ...], int]]) -> dict[int, list[tuple[int, int]]]:
    """Bytes by the next ``STEP`` bits. ``cells`` has for each open leaf its dimension, the settled coordinates
    (the last of them in part) and the bits that are still open there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {k: np.zeros(1 << STEP, np.int64) for k in cells}
        for batch in batches:
            dims, crc, key, size = _columns(batch)
            leaf = leaf_of(root, dims, crc, key)
            for k, (dim, settled, shift) in cells.items():
                at = np.flatnonzero(leaf == k)
                for column, value in zip((dims[dim], crc, key), settled[:-1], strict=False):
                    at = at[column[at] == value]
                column = (dims[dim], crc, key)[len(settled) - 1]
                at = at[column[at] >> (shift + STEP) == settled[-1] >> (shift + STEP)]
                np.add.at(total[k], (column[at] >> shift) & ((1 << STEP) - 1), size[at])
        for k, t in total.items():
            b = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), k, np.int32)), pa.array(b.astype(np.int32)), pa.array(t[b])], ["k", "b", "s"])

    got: dict[int, list[tuple[int, int]]] = {k: [] for k in cells}
    for r in points.mapInArrow(tidy(work), "k int, b int, s long").groupBy("k", "b").agg(F.sum("s").alias("s")).collect():
        got[r["k"]].append((r["b"], r["s"]))
    return got


def tree(points: DataFrame, n: int) -> Node:
    """The k-d tree of ``n`` leaves over points (size, crc, hash, dimensions ...), all but the size in [0, 2^BITS)."""
    root, many = Node(0, n), len(points.columns) - 3

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, crc, key, size = _columns(batch)
            leaf = leaf_of(root, dims, crc, key)
            for k in np.unique(leaf):
                at = leaf == k
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([size[at].sum()], pa.int64()), pa.array([dims[:, at].min(axis=1).tolist()], pa.list_(pa.int64())), pa.array([dims[:, at].max(axis=1).tolist()], pa.list_(pa.int64()))], ["k", "s", "low", "high"])

    while open_ := {x.first: x for x in root.leaves() if x.n > 1}:
        bounds = [f(F.get(c, i)).alias(f"{c}{i}") for i in range(many) for f, c in ((F.min, "low"), (F.max, "high"))]
        found = {r["k"]: r for r in points.mapInArrow(tidy(spans), "k int, s long, low array<long>, high array<long>").groupBy("k").agg(F.sum("s").alias("s"), *bounds).collect()}
        settled: dict[int, list[int]] = {}
        want: dict[int, float] = {}
        for k, node in open_.items():
            r = found.get(k)
            node.dim = max(range(many), key=lambda i: r[f"high{i}"] - r[f"low{i}"]) if r else 0
            settled[k], want[k] = [], (r["s"] if r else 0) * (node.n // 2) / node.n
        least = MISS * min((r["s"] / open_[k].n for k, r in found.items() if k in open_), default=0)
        live = dict.fromkeys(open_)
        for shift in [*range(BITS - STEP, -1, -STEP)] * 3:
            for k in live:
                if shift == BITS - STEP:
                    settled[k].append(0)
            got = _sums(points, root, {k: (open_[k].dim, tuple(settled[k]), shift) for k in live}) if live else {}
            for k in [*live]:
                at, weight = 0, 0
                for at, weight in sorted(got[k]):
                    if weight > want[k]:
                        break
                    want[k] -= weight
                settled[k][-1] |= at << shift
                if (weight <= least or len(settled[k]) == 3 and not shift) and want[k] >= weight / 2:
                    settled[k][-1] += 1 << shift  # the cell goes left, where that is nearer to the share
                if weight <= least:  # what is left in this cell is too little to part
                    live.pop(k)
        for k, node in open_.items():
            node.cut = (*settled[k], 0, 0)[:3]
            m = node.n // 2
            node.left, node.right = Node(node.first, m), Node(node.first + m, node.n - m)
    return root


def scaled(df: DataFrame, column: str) -> Column:
    """A numeric column stretched over [0, 2^BITS); null counts as 0. The bounds are one aggregate over the table."""
    low, high = df.agg(F.min(F.coalesce(named(column), F.lit(0))), F.max(F.coalesce(named(column), F.lit(0)))).first()
    if low is None or high == low:
        return F.lit(0)
    return ((F.coalesce(named(column), F.lit(0)) - F.lit(low)) / F.lit(float(high - low)) * F.lit(float((1 << BITS) - 1))).cast("int")


def placed_by(df: DataFrame, column: str) -> Column:
    """A column of names or marks as a coordinate: a hash, so that equal values have one place; null counts as 0."""
    code = F.shiftrightunsigned(F.xxhash64(named(column).cast("string")), 64 - BITS).cast("int")
    return F.when(named(column).isNull(), 0).otherwise(code)


def in_groups(points: DataFrame, group: list[str], about: list[str], key: str, n: int) -> DataFrame:
    """Rows with equal ``group`` (not null) take the least ``about`` among them, and ``tie``, which is theirs in common where they hold at most ``WHOLE`` of the bytes of one of ``n`` shards and their
    key's elsewhere. Only groups of several rows are joined."""
    total = points.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    several = points.groupBy(*group).agg(F.count("*").alias("__rows"), F.sum("size").alias("__bytes"), F.min(F.struct(*map(named, about))).alias("__about")).where("__rows > 1")
    rows = points.join(small(stored(several, "groups")), group, "left")
    own = F.xxhash64(named(key).cast("string"))
    tie = F.when(F.col("__bytes") <= WHOLE * total / n, F.xxhash64(*map(named, group))).otherwise(own)
    shared = {c: F.coalesce(F.col(f"__about.{c}"), named(c)) for c in about}
    return rows.withColumns({**shared, "tie": tie}).drop("__rows", "__bytes", "__about")


def shards(df: DataFrame, n: int, size: Column, dims: dict[str, Column], crc: Column, key: str, tie: Column | None = None, part_rows: int = 250_000) -> DataFrame:
    """Adds shard (0 to n - 1) and slot (gapless from 0 within the shard). ``dims`` are the dimensions as integers in [0, 2^BITS); rows that are equal in one and in ``crc`` go by ``tie``
    (by default a hash of the key).

    Slots are numbered within parts of about ``part_rows`` of every shard, by the hash of the key, and the parts' counts are added up
    before, so no task sorts a whole shard."""
    df = df.drop("shard", "slot")
    names = [f"__d{i}" for i in range(len(dims))]
    fields = [c.cast("int").alias(a) for c, a in zip(dims.values(), names, strict=True)]
    top = lambda c: F.shiftrightunsigned(c, 64 - BITS).cast("int")
    own = F.xxhash64(named(key).cast("string"))
    every = df.select(size.cast("long").alias("__size"), F.shiftright(crc, 32 - BITS).cast("int").alias("__crc"), top(own if tie is None else tie).alias("__hash"), *fields, F.struct(*as_they_are(df)).alias("__row"))
    root = tree(every.drop("__row"), n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, crc, key, _ = _columns(batch.select([*range(batch.num_columns - 1)]))
            yield pa.RecordBatch.from_arrays([batch.column(batch.num_columns - 1), pa.array(leaf_of(root, dims, crc, key))], ["row", "shard"])

    placed = stored(every.mapInArrow(tidy(place), StructType([StructField("row", df.schema), StructField("shard", IntegerType())])), "placed")
    spread = placed.groupBy("shard").count().agg(F.ceil(F.coalesce(F.max("count"), F.lit(0)) / part_rows)).first()[0]
    key_of = F.col("row").getField(key)
    placed = placed.withColumn("__part", F.pmod(F.xxhash64(key_of.cast("string")), F.lit(max(1, int(spread)))))
    before = placed.groupBy("shard", "__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slot = F.row_number().over(Window.partitionBy("shard", "__part").orderBy(key_of)) - 1
    placed = placed.withColumn("__slot", slot).join(F.broadcast(before), ["shard", "__part"])  # n times the parts of the largest shard
    return placed.select("row.*", "shard", (F.col("__slot") + F.col("__before")).cast("long").alias("slot"))


def op8_kd_shards(spark: SparkSession, sf_dir: str, n: int = 40) -> DataFrame:
    """Dimensions: language, source, and the number of characters (by its logarithm)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    about = [placed_by(docs, "lang").alias("at_lang"), placed_by(docs, "source").alias("at_source"), F.log1p(F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0))).alias("log_chars")]
    equal = [F.octet_length(text).alias("bytes"), F.xxhash64(F.lit(1), text).alias("text_a"), F.xxhash64(F.lit(2), text).alias("text_b")]
    points = stored(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *equal, *about), "points")
    points = stored(in_groups(points, ["bytes", "text_a", "text_b"], ["at_lang", "at_source", "log_chars"], "doc_id", n).drop("bytes", "text_a", "text_b"), "points")
    dims = {"lang": F.col("at_lang"), "source": F.col("at_source"), "chars": scaled(points, "log_chars")}
    out = shards(points, n, F.col("size"), dims, F.col("text_crc32"), "doc_id", F.col("tie"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
