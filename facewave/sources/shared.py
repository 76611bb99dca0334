"""The folder that the driver and all executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_top(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is not set, one machine (a local master) uses its own temporary folder, and a cluster is refused: its executors would
    each write to a disk of their own."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if top:
        return top.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set: name a folder there that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/spark-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that all machines share. It goes when the application ends."""
    path = f"{shared_top(spark)}/llm-{uuid.uuid4().hex}"
    _files(spark, path, lambda system, place: system.deleteOnExit(place))
    return path


def _files(spark: SparkSession, path: str, do: Callable) -> None:
    """``do`` with the file system of ``path`` and the path, by Spark's own Hadoop client."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    do(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again: its lineage ends there, and lost executors do
    not repeat the work before it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table that ``stored`` wrote, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _files(df.sparkSession, folder, lambda system, place: system.delete(place, True))
