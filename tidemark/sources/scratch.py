"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The context's checkpoint folder, else ``spark.checkpoint.dir``; a temporary folder only where neither is set and the session runs on one machine."""
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = there.get() if there.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="spark-")


def fresh(spark: SparkSession, label: str) -> str:
    """A new folder of its own below the shared one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: no lineage behind it, nothing computed twice, lost executors cost nothing."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
