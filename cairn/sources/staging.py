"""Cuts a plan where its parts are used many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without that setting a local session gets a temporary one, and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-cairn-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder; later steps start from there."""
    _shared(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables, beside what ``staged`` writes."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
