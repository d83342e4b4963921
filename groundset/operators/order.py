"""Numbering of rows in a total order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written


def indexed(df: DataFrame, *keys: str) -> DataFrame:
    """`df` with 0-based `idx` in the order of `keys`, which are unique: range partitions are numbered inside, and their sizes added up.

    The partitions are written to the scratch folder, since two passes must see the same ones.
    """
    parts = written(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = parts.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(*keys)))
    return inner.join(F.broadcast(starts), "_part").withColumn("idx", F.col("_start") + F.col("_at") - 1).drop("_part", "_at", "_start")


def ranked_within(df: DataFrame, group: str, *keys: str) -> DataFrame:
    """`df` with `rank`, from 1, in each group by `keys`, which are unique in it: rows are range-partitioned by group and keys, so a large group is split."""
    rows = indexed(df, group, *keys)
    first = rows.groupBy(F.col(group).alias("_group")).agg(F.min("idx").alias("_first"))
    met = rows.join(first.hint("merge"), F.col(group).eqNullSafe(F.col("_group")))
    return met.withColumn("rank", F.col("idx") - F.col("_first") + 1).drop("idx", "_group", "_first")
