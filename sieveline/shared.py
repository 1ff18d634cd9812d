"""Lineage cut on shared storage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); where none is set, a local one for a local master, as in tests, and an error else."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster, intermediates need a folder that all executors share")
    path = tempfile.mkdtemp(prefix="sieveline-shared-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder, eagerly."""
    at = shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(at)
    return df.checkpoint()
