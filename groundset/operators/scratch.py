"""Intermediate tables in the run's shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the folder that spark.checkpoint.dir names that nothing has used yet. Where the setting is absent (tests), a temporary folder is set."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="groundset-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` written once to a new folder and read back: lineage ends there, and Spark knows its size."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
