"""Tables in shared storage: durable intermediates, and padded results with or without encryption."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext._conf.get("spark.veilspark.scratch")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="veilspark-")
        spark.sparkContext._conf.set("spark.veilspark.scratch", root)
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(os.path.join(root, "checkpoints"))
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A path of this application in the shared folder; all of them go when its driver ends."""
    folder = f"{shared_root(spark).rstrip('/')}/veilspark/{spark.sparkContext.applicationId}"
    where, fs = _file_system(spark, folder)
    fs.deleteOnExit(where)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, lost executors cost nothing.

    ``discard`` removes a table that is no longer read before the driver ends.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._frozen_at = path
    return out


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``freeze`` gave, once everything made of them is itself written."""
    for table in tables:
        where, fs = _file_system(table.sparkSession, table._frozen_at)
        fs.delete(where, True)
