"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}  # application -> folder, where one process is the whole cluster


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session (tests) gets a temporary folder; a cluster must name one."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df there and reads it back: lineage ends, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffles: compressed files of repeating rows look small to the planner, which would send millions of rows through the driver as a broadcast."""
    return df.hint("merge")


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes one file of bounded size there; its path."""
    path = f"{shared_dir(spark)}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders in whatever store they lie; what isn't there is left out."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
