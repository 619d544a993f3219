"""Cutting the lineage between rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where a local master lacks it, a temporary folder. A cluster without the setting is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found is None:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/tessera/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows behind a checkpoint, which outlives lost executors and keeps plans of later rounds short."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
