"""From raw documents to token digests in five stages, each written as Parquet and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from groundset.llm import exact_dedup, langid, mixing, queries, simhash
from groundset.llm.common import ensure_checkpoint_dir


def small_batches(spark: SparkSession) -> None:
    """Batches of 8 MB for Python in the pipeline's session: of 64 MB, the default, a task and its worker hold several at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, null languages filled in; texts that are null, empty or without a letter go. Repeated rows stay.

    Any column may be null, any table empty; extra columns pass through whatever their names.
    """
    small_batches(spark)
    return langid.drop_unidentified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for ASCII white space: the longest, then the smallest id. Null ids come last.

    Any column may be null, any table empty; extra columns pass through whatever their names.
    """
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the smallest id. Null ids come last.

    Any column may be null, any table empty; extra columns pass through whatever their names.
    """
    return simhash.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document in the mix, range-sorted by training position. A null source is a source; empty texts are kept once.

    Any column may be null, any table empty; extra columns pass through whatever their names.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: number of token ids, digest of the ids, digest of the decoded text. Null text counts as empty; repeated rows each get a row."""
    small_batches(spark)
    return queries._bpe_digests(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("simhash_dedup", near_copies), ("mixing", mixture), ("bpe", tokens)]

#: SimHash and BPE have no SQL twin; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`. Results between stages go to the run's shared scratch folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
