"""The driver tables in the roles that the operators expect.

``events`` are frames (a user is a session, value the eye ratio, an error a lost face) and samples of a second clock; ``embeddings`` are
windows of 64 samples or 32 landmarks, their label a cluster; ``lineitem`` is the large table of windows with targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("frame_idx"), micros.alias("us"), (micros / 1e6).alias("ts"), F.col("value").alias("ear"),
        "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("event_type") != "error").alias("face"),
    )


#: The same for DuckDB, as the start of a query.
FRAMES = """WITH fr AS (SELECT user_id AS session, event_id AS frame_idx, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS ts, value AS ear, event_type,
CAST(props ->> '$.k' AS BIGINT) AS k, event_type <> 'error' AS face FROM events)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x) with x an array<double> of 64."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def points(x: Column | str = "x") -> Column:
    """32 landmarks from an array of 64 coordinates."""
    x = F.col(x) if isinstance(x, str) else x
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get(x, 2 * i).alias("x"), F.get(x, 2 * i + 1).alias("y"), F.lit(0.0).alias("z")))


def at(i: int, axis: str = "") -> str:
    """DuckDB: a coordinate of landmark i, or the i-th value."""
    return f"CAST(embedding[{2 * i + 1 + (axis == 'y') if axis else i + 1}] AS DOUBLE)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("row", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
