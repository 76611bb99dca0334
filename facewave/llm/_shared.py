"""Tables in the shared folder, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facewave.llm._text import tidy
from facewave.sources.shared import discard, shared_folder, stored  # noqa: F401 (for the operators)


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_they_are(df: DataFrame) -> list[Column]:
    """All columns of ``df`` in their order, whatever their names hold."""
    return [named(c) for c in df.columns]


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by their places, for Arrow functions, which do not read names with dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def rows_where(df: DataFrame, column: str, good: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows for whose value in ``column`` a function of an Arrow array holds, in their own columns, whatever these are called."""
    place, names = df.columns.index(column), df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(good(batch.column(place)), pa.bool_())).columns, names)

    return by_place(df).mapInArrow(tidy(work), df.schema)


def parts_by_bytes(df: DataFrame, column: str, part_bytes: int) -> int:
    """How many parts of about ``part_bytes`` the texts of a column make."""
    total = df.agg(F.coalesce(F.sum(F.octet_length(named(column))), F.lit(0))).first()[0]
    return int(total // part_bytes) + 1


def small(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """``df``, marked to go to every task if it has at most ``rows`` rows. It is counted, so give a stored one."""
    return F.broadcast(df) if df.count() <= rows else df


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges (longs), as rows (node, root): root is the smallest node of the component.

    Alternates two steps that hang neighbours below smaller neighbours until nothing changes; every step is a grouped
    minimum and an equi-join, so no component is gathered in one task. Nodes without edges do not appear. Null ends and
    loops are left out."""
    e = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(),
        "edges",
    )
    before, start = None, e
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v")
        old, e = start, stored(e.distinct(), "edges")
        start = e
        discard(old)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
