"""Folders that all executors share, for checkpoints, stream state and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_handed_out: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors must share.

    Only a session on one machine (a local master) may leave the setting out; a temporary folder takes its
    place there.  On a cluster that would be a folder of each machine's own, so the setting is demanded.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _handed_out.append(path)
    return path


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the folders that this process was given, and tells how many there were.

    To be called once the results that read them are written: DataFrames are lazy, so only the caller knows.
    """
    gone = 0
    while _handed_out:
        path = spark._jvm.org.apache.hadoop.fs.Path(_handed_out.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
