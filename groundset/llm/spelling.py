"""Spelling variants: words one edit apart, found by PartEnum signatures of their letter multisets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, merge_join, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Partitions of the letter vector by the greatest Hamming distance of the vectors that must share a signature.
PARTS = {1: 3, 2: 5}


def lower_ascii(word: Column) -> Column:
    """A-Z lowered and nothing else."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, _UPPER, _LOWER))


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6) -> DataFrame:
    """(id, run): every maximal run of letters of at least `min_chars` code points in all texts, A-Z lowered. Null texts have none."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    return runs.where(F.length("run") >= min_chars).select("id", lower_ascii(F.col("run")).alias("run"))


def word_counts(words: DataFrame, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of the words of column `word` that are long and frequent enough, counted over all rows."""
    counted = words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _projections(dims: Column, parts: int) -> list[Column]:
    """The vector's set bits in each of `parts` partitions of its dimensions."""
    one = lambda i: F.array_join(F.filter(dims, lambda d: F.pmod(F.xxhash64(d), F.lit(parts)) == i), "")
    return [one(i) for i in range(parts)]


def signatures(words: DataFrame) -> DataFrame:
    """(word, signature): a word and any word one edit apart share at least one signature.

    A word's multiset of letters is a binary vector with a dimension for each letter and count: its k-th `e` sets (e, k). A replaced letter moves
    two bits, an inserted or deleted one moves one. The dimensions are dealt to PARTS[k] partitions by hash; vectors at distance k at most
    agree on all but k partitions, so each choice of the others is a signature: ten for words of one length (k = 2), three for
    lengths that differ by one (k = 1). One edit leaves at least half of what is left of a word as it was, at its beginning or at its end, so a
    signature is emitted once with the word's first half and once with its last, which keeps buckets small and loses no pair.
    """
    letters = F.array_sort(F.filter(F.split("word", ""), lambda c: c != ""))
    dims = words.select("word", F.length("word").alias("size"), letters.alias("letters")).withColumn("dims", F.transform("letters", lambda c, i: F.concat(c, (i - F.array_position("letters", c)).cast("string"))))
    projected = dims.select("word", "size", *[F.array(*_projections(F.col("dims"), parts)).alias(f"p{k}") for k, parts in PARTS.items()])
    found = []
    # the pair's lengths: both `size`, or the word is the shorter or the longer one of `size` and `size + 1`
    for k, low in ((2, F.col("size")), (1, F.col("size")), (1, F.col("size") - 1)):
        half = F.ceil((low - (1 if k == 2 else 0)) / 2).cast("int")
        for kept in combinations(range(PARTS[k]), PARTS[k] - k):
            parts = [F.col(f"p{k}")[i] for i in kept]
            for side, affix in (("first", F.substring(F.col("word"), F.lit(1), half)), ("last", F.right(F.col("word"), half))):
                found.append(F.xxhash64(F.lit(side), F.lit(str((k, kept))), low, affix, *parts))
    return projected.select("word", F.explode(F.array_distinct(F.array(*found))).alias("signature"))


def near_words(words: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of words exactly one inserted, deleted or replaced code point apart, each once.

    Words that share a signature are verified inside the join, so unlike words of a bucket are never written or shuffled; a signature of one
    word only is dropped before.
    """
    signed = stored(signatures(words))
    shared = stored(signed.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1").select("signature"))
    left = stored(merge_join(signed, shared, "signature"))
    a, b = left.select("signature", F.col("word").alias("a")), left.select(F.col("signature").alias("other"), F.col("word").alias("b"))
    near = (F.col("signature") == F.col("other")) & (F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    return merge_join(a, b, near).select("a", "b").distinct()


def variant_forms(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `words` (word, n; words are distinct).

    A word's form is its near word of largest n, the smallest in code-point order of several, if that n is at least `ratio` times its own; its root is the
    last form that forms lead to, itself if it has none. Forms grow by `ratio` at each step, so chains are short and have no
    circle; they are followed by doubling. An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("a form is at least twice as frequent as its variant")
    words = stored(words.select("word", "n"))
    pairs = stored(near_words(words.select("word")))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    best = merge_join(both, words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = stored(merge_join(words, best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")).withColumn("has", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))))
    steps = cut(told.where("has").select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(merge_join(steps, onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    form = lambda c: F.when(F.col("has"), F.col(c)).alias(c)
    return merge_join(told, steps, "word", "left").select("word", form("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", form("form_n"))
