"""Stupid-backoff language-model scores: count tables partitioned by hash, joined to the documents' n-grams."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import n_words

#: Characters of text in a block of documents, and blocks for each hash partition of the count tables.
BLOCK_CHARS, SPREAD = 8_000_000, 4
#: Weight of the backoff; count of a word that no other document has.
ALPHA, UNKNOWN = 0.4, 0.5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _grams(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, unigram, bigram) for every word of a block: the text it is in, the hash of the word, and that of the word
    with the one before it; 0 for the first word of a text. Words are lower-cased runs without ASCII white space (bytes split so)."""
    import xxhash

    code: dict[bytes, int] = {}
    each, sizes = [], []
    for t in texts:
        words = t.lower().encode().split() if t else []
        sizes.append(len(words))
        each.append(np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) | 1 for w in code), np.uint64, len(code))
    ids = np.concatenate(each) if each else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    uni = hashes[ids] if len(ids) else np.zeros(0, np.uint64)
    bi = np.zeros(len(uni), np.uint64)
    if len(uni):
        bi[1:] = _mix(uni[:-1] * _MIX + uni[1:]) & ~np.uint64(1)  # even; unigrams are odd
        bi[np.r_[True, owner[1:] != owner[:-1]]] = 0
    return owner, uni, bi


def _sent(uni: np.ndarray, bi: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, counts, hash partitions): a block's distinct n-grams by hash partition, then by key, whatever the order of its rows."""
    grams, n = np.unique(np.concatenate([uni, bi[bi != 0]]), return_counts=True)
    to = (_mix(grams) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return grams[order], n[order], to[order]


def _count_block(buckets: int):
    """A block's distinct n-grams with their counts, in one row for each hash partition."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, uni, bi = _grams(pdf["text"])
        grams, n, to = _sent(uni, bi, buckets)
        grams, n = grams.view(np.int64), n.astype(np.int32)
        at = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
        return pd.DataFrame({"block": int(pdf["block"].iloc[0]) if len(pdf) else 0, "bucket": to[at], "grams": np.split(grams, at[1:]) if len(at) else [], "n": np.split(n, at[1:]) if len(at) else []})

    return run


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    """One hash partition of the count tables: adds up the blocks' counts and gives each block the totals of its n-grams, in the order it sent them."""
    sizes = [len(g) for g in pdf["grams"]]
    grams = np.concatenate(list(pdf["grams"]))
    _, at = np.unique(grams, return_inverse=True)
    total = np.bincount(at, np.concatenate(list(pdf["n"]))).astype(np.int64)[at]
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "total": np.split(total, np.cumsum(sizes)[:-1])})


def _own(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each key occurs in its own text."""
    _, at, n = np.unique(_mix(keys * _MIX + (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)), return_inverse=True, return_counts=True)
    return n[at]


def _score_block(words: int, alpha: float, buckets: int):
    def run(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        owner, uni, bi = _grams(docs["text"])
        grams, _, _ = _sent(uni, bi, buckets)
        total = np.concatenate(list(told.sort_values("bucket")["total"])).astype(np.float64) if len(told) else np.zeros(0)
        order = np.argsort(grams)
        grams, total = grams[order], total[order]

        def elsewhere(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
            return total[np.searchsorted(grams, keys)] - _own(owner, keys) if len(keys) else np.zeros(0)

        n = np.bincount(owner, minlength=len(docs))
        one, first = elsewhere(uni, owner), bi == 0
        log = np.log(np.maximum(one, UNKNOWN) / np.maximum(1, words - n)[owner])
        two = np.zeros(len(bi))
        two[~first] = elsewhere(bi[~first], owner[~first])
        seen = two > 0
        before = np.r_[1.0, one[:-1]] if len(one) else one
        log = np.where(seen, np.log(np.where(seen, two, 1) / np.where(seen, before, 1)), log + np.where(first, 0.0, math.log(alpha)))
        return pd.DataFrame({"id": docs["id"], "n_words": n, "n_backoff": np.bincount(owner, ~seen & ~first, len(docs)).astype(np.int64), "log_score": np.bincount(owner, log, len(docs))})

    return run


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, n_words, n_backoff, log_score, mean_log_score) for every row, under the bigram model of all other rows.

    Counts are those of the whole corpus less the text's own, so every bigram of the corpus counts and none vouches for itself. A word
    scores c(previous, word) / c(previous) if another text has the pair, else `alpha` times its share of all words (of a word that
    no other text has, UNKNOWN occurrences); a text's first word scores its share. log_score is the sum of natural logarithms, from whole
    texts; n_backoff counts the backed-off words. Null and empty texts have no words, score 0 and a null mean.
    Repeated rows count each, null ids are kept, an empty table gives an empty result, other columns are not read.

    Documents are dealt by hash into blocks of about `block_chars`, as many as the corpus needs. A block sends each of its
    distinct n-grams, with a count, to the hash partition of the count table that owns it; the partition adds up
    and sends the totals back, in the order received, to the block, which joins them to its n-grams and sums per document.
    An n-gram is sent once for a block, so no frequent word makes a partition large. Bigrams are keyed by 64-bit hashes.
    """
    size = docs.agg(F.sum(F.length(text_col)), F.sum(n_words(F.col(text_col)))).first()
    blocks, words = max(1, math.ceil((size[0] or 0) / block_chars)), size[1] or 0
    buckets = math.ceil(blocks / SPREAD)
    dealt = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).withColumn("block", F.pmod(F.xxhash64("id", F.length("text")), F.lit(blocks)))
    dealt = dealt.repartition(blocks, "block")
    counted = dealt.groupBy("block").applyInPandas(_count_block(buckets), "block long, bucket long, grams array<long>, n array<int>")
    told = counted.groupBy("bucket").applyInPandas(_total, "block long, bucket long, total array<long>")
    kind = dict(docs.dtypes)[id_col]
    scored = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_score_block(words, alpha, buckets), "id string, n_words long, n_backoff long, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_backoff", "log_score", mean.alias("mean_log_score"))
