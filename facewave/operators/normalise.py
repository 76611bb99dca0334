"""Statistics by subject and their use on other rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(rows: DataFrame, values: Sequence[str], subject: str = "subject", eps: float = 1e-8) -> DataFrame:
    """(subject, m_<v>, s_<v>): means and population deviations plus ``eps`` of each subject and, with subject null, of all rows."""
    aggregates = [x for v in values for x in (F.avg(v).alias(f"m_{v}"), (F.stddev_pop(v) + eps).alias(f"s_{v}"))]
    known = rows.where(F.col(subject).isNotNull())
    return known.groupBy(subject).agg(*aggregates).unionByName(known.agg(*aggregates).withColumn(subject, F.lit(None).cast(known.schema[subject].dataType)))


def _with_stats(rows: DataFrame, stats: DataFrame, values: Sequence[str], subject: str) -> DataFrame:
    """Each row's own statistics, or those of all rows for a subject that has none."""
    names = [f"{k}_{v}" for v in values for k in "ms"]
    overall = stats.where(F.col(subject).isNull()).select(*[F.col(n).alias(f"__{n}") for n in names])
    out = rows.join(stats.where(F.col(subject).isNotNull()), subject, "left").crossJoin(F.broadcast(overall))  # one row
    return out.withColumns({n: F.coalesce(n, f"__{n}") for n in names}).drop(*[f"__{n}" for n in names])


def transform(rows: DataFrame, stats: DataFrame, values: Sequence[str], subject: str = "subject") -> DataFrame:
    out = _with_stats(rows, stats, values, subject)
    return out.withColumns({v: (F.col(v) - F.col(f"m_{v}")) / F.col(f"s_{v}") for v in values}).drop(*[f"{k}_{v}" for v in values for k in "ms"])


def inverse(rows: DataFrame, stats: DataFrame, values: Sequence[str], subject: str = "subject") -> DataFrame:
    out = _with_stats(rows, stats, values, subject)
    return out.withColumns({v: F.col(v) * F.col(f"s_{v}") + F.col(f"m_{v}") for v in values}).drop(*[f"{k}_{v}" for v in values for k in "ms"])
