"""Session helpers: reading tables and cutting lineage in a folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``; only where that is unset (tests, local runs) one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "genlex-shared")
    return f"{base.rstrip('/')}/genlex-{uuid.uuid4().hex}"


_made: list[str] = []


def shared_path(spark: SparkSession) -> str:
    """As ``shared_dir``, and the folder is among those that ``release`` deletes."""
    _made.append(path := shared_dir(spark))
    return path


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back: lineage ends there and survives lost executors.

    Column types and names are kept; row order is not. Needs unique column names.
    """
    path = shared_path(df.sparkSession)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of ours through the Hadoop file system it lives on."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the Hadoop file system it names."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file through the Hadoop file system it lies on."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(jpath, True)
    out.write(data)
    out.close()


def release(spark: SparkSession) -> int:
    """Delete the folders that ``materialize`` made in this process; call it when the results that read them are written. Returns their number."""
    count = len(_made)
    while _made:
        delete_path(spark, _made.pop())
    return count
