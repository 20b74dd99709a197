"""Cutting a plan's lineage between rounds, and folders that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, on one machine, a temporary one."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='lattica-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a Parquet table in the shared folder (a checkpoint would compute its last stage twice)."""
    path = new_path(df.sparkSession, "held")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
