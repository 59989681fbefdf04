"""Intermediate results written to a folder that all executors reach.

A written table cuts the lineage and survives the loss of any executor. The folder is the one
named by ``spark.checkpoint.dir``, else the warehouse; what a session wrote there goes when the
session ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; an error if the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return root.rstrip("/")


def _session_folder(spark: SparkSession) -> str:
    """A folder of this session's own, removed by the file system when the session's JVM ends."""
    key = f"{scratch_root(spark)}/tallybook/{spark.sparkContext.applicationId}"
    if key not in _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(key)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[key] = key
    return key


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    return f"{_session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and go on from the written copy."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deal(df: DataFrame, key: str) -> DataFrame:
    """Rows of a key side by side, in as many partitions as a shuffle makes."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), key)


def materialize_by(df: DataFrame, key: str, label: str = "table") -> DataFrame:
    """As ``materialize``, bucketed by ``key``: joins and groups by it do not shuffle the copy again.

    ``df`` should be dealt by ``key`` already, else every task writes a file for every bucket.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    df.write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    return spark.read.table(name)
