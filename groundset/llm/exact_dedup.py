"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, merge_join, stored, with_row_key

#: Counters of a Misra-Gries summary. At most COUNTERS + 1 digests are broadcast.
COUNTERS = 256


def _summary(counters: int):
    """Misra-Gries over the batches of one partition; an estimate falls short by at most rows / (counters + 1)."""

    def run(batches):
        kept: dict[bytes, int] = {}
        for batch in batches:
            for digest, n in batch["digest"].value_counts().items():
                kept[digest] = kept.get(digest, 0) + int(n)
            if len(kept) > counters:
                cut_off = sorted(kept.values(), reverse=True)[counters]
                kept = {k: v - cut_off for k, v in kept.items() if v > cut_off}
        yield pd.DataFrame({"digest": pd.Series(list(kept), dtype=object), "est": pd.Series(list(kept.values()), dtype="int64")})

    return run


def heavy_hitters(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that may hold over 2 / (counters + 1) of all rows; holds each that does, and at most counters + 1.

    Each partition's summary underestimates by its rows / (counters + 1), so the summed estimate of such a
    digest stays at or above rows / (counters + 1), a level that at most counters + 1 digests can reach.
    """
    rows = digests.count()
    found = digests.select("digest").mapInPandas(_summary(counters), "digest binary, est long")
    return found.groupBy("digest").agg(F.sum("est").alias("est")).where(F.col("est") * (counters + 1) >= rows).where(F.col("est") > 1).select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, key_col: str | None = None) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, digest (SHA-256 of the text without ASCII white space), n_chars, and `key_col`, if given, as key.

    Of equal texts the row with most code points stays, then the smallest id (null ids last), then one of the
    repeated rows. Null text counts as empty; empty texts are one group. An empty table gives an empty result; other
    columns, whatever their names, are neither read nor returned.

    Rows are reduced to digests once. Frequent digests are found by Misra-Gries, their winners verified by an exact
    count and broadcast (at most counters + 1 rows); all other digests are grouped by an ordinary shuffle, in which no
    group can hold more than 2 / (counters + 1) of the rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = cut(
        docs.select(
            F.col(id_col).alias("id"),
            F.length(text).cast("long").alias("n_chars"),
            F.unhex(F.sha2(F.regexp_replace(text, SPACE + "+", ""), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
            F.col(key_col or id_col).alias("key"),
        )
    )
    place = F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    best = [F.min(place).alias("best"), F.count("*").alias("group_size")]
    hot = F.broadcast(cut(heavy_hitters(keyed, counters)))
    hot_best = F.broadcast(cut(keyed.join(hot, "digest", "left_semi").groupBy("digest").agg(*best)))
    hot_rows = keyed.join(hot_best, "digest")
    rest = keyed.join(hot, "digest", "left_anti")
    rest_rows = merge_join(rest, rest.groupBy("digest").agg(*best), "digest")
    return hot_rows.union(rest_rows.select(*hot_rows.columns)).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "digest",
        "n_chars",
        *(["key"] if key_col else []),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `exact_dedup` keeps, with all their columns, whatever their names; one row of each group of equal texts.

    Nulls, ties and repeated rows as in `exact_dedup`. An empty table stays empty. Where ids repeat or are null, rows are told apart by a
    number in a written copy of `docs`.
    """
    keyed, key = with_row_key(docs, id_col)
    gone = stored(exact_dedup(keyed, id_col, text_col, key_col=key).where("NOT kept").select(F.col("key").alias(key)))
    return keyed.join(gone, key, "left_anti").select(*docs.columns)
