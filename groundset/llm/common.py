"""Helpers shared by the training-data operators: reliable checkpoints, graph components, distributed ranks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class for Java, RE2 and Python patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; only where it names none (tests), a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="groundset-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once into the reliable checkpoint folder and continue from there.

    Used where a result feeds several branches, or where a loop would grow the lineage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet below the shared checkpoint folder and read back: as `cut`, for wide or many rows.

    The folder is the run's scratch space, as with checkpoints, and may be cleared when the application has ended.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with lean(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def configured(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Within it, the session has the given settings (`__` for a dot); those of before come back."""
    names = {name.replace("__", "."): value for name, value in conf.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def lean(spark: SparkSession):
    """Settings of eager steps: shuffle files go when the query ends, not when the driver next collects its garbage, and a batch for Python has
    8 MB at most, as batches of 64 MB of long texts are held several times over by the task and its worker."""
    return configured(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__execution__arrow__maxBytesPerBatch="8m")


def merge_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join whatever the size estimates say; AQE splits its skewed partitions."""
    return left.join(right.hint("merge"), on, how)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph by alternating star contraction.

    `edges` has two columns of one orderable type, `a` and `b`; self-loops, repeats and direction do
    not matter. Returns (node, root) with root the smallest node of the component, for every node that
    is not itself a root. Each round is two grouped minima and two joins on distinct edges; no node's
    neighbours are gathered in one place, and rounds grow with the logarithm of the longest path.
    """
    cur = cut(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct())
    state = None
    while True:
        found = tuple(cur.agg(F.count("*"), F.sum(F.hash("lo", "hi").cast("long")), F.bit_xor(F.xxhash64("lo", "hi"))).first())
        if found == state or not found[0]:
            return cur.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        state = found
        both = cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = merge_join(cur.withColumnRenamed("lo", "u"), least, "u").select(F.col("m").alias("lo"), "hi").distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = merge_join(large, small, "hi").where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        cur = cut(moved.union(small.select(F.col("m").alias("lo"), "hi")).distinct())


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    return name if name not in df.columns else f"{name}_{uuid.uuid4().hex}"


def with_row_key(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """`docs` and a column that tells its rows apart: `id_col` if no id is null or repeated, else a number in a written copy of `docs`."""
    ids = docs.select(F.col(id_col).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    if ids.where("id IS NULL OR n > 1").isEmpty():
        return docs, id_col
    key = fresh(docs, "row_key")
    return stored(docs.withColumn(key, F.monotonically_increasing_id())), key


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """`df` with a 0-based rank in a total `order`, without moving all rows to one task.

    Rows are range-partitioned and ranked inside their partition; only the row count of each partition is added up.
    """
    from pyspark.sql import Window as W

    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inner = parts.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    sizes = sorted(tuple(r) for r in parts.groupBy("_part").count().collect())  # one row for each partition
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    starts = F.create_map(*[F.lit(x) for pair in before for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    return inner.withColumn(name, (F.col("_at") - 1 + F.element_at(starts, F.col("_part"))).cast("long")).drop("_part", "_at")
