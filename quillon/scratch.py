"""Intermediate tables: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session in one process (tests) gets a folder; any other raises."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own: its lineage is cut, it survives lost executors, and its rows do not change any more."""
    at = f"{shared_dir(df.sparkSession)}/quillon-table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
