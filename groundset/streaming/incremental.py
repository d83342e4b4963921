"""The latest row of each key over a stream of batch files.

The only incremental work in scope is resuming and upserting; both are a stateful version of `latest_wins`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def batch_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet batch files below `path` as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def latest_stream(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A running upsert: the last row of each key so far, kept in the aggregation's state store (output mode `update` or `complete`)."""
    rest = [c for c in stream.columns if c not in keys]
    best = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
