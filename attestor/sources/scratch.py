"""Intermediate tables in the folder that the cluster shares, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; it is deleted when the application ends.

    Where that is unset, a temporary folder in local mode and an error on a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    own = f"{root.rstrip('/')}/attestor-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to a new scratch folder and read again."""
    at = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def released(df: DataFrame, name: str) -> DataFrame:
    """stored(), and the shuffles that made the table are given back before the next ones are written: Spark deletes those that no plan refers to when the driver collects garbage."""
    out = stored(df, name)
    df.sparkSession._jvm.System.gc()
    return out
