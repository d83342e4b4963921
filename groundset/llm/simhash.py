"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import components, cut, merge_join, stored, with_row_key

SEED = 42
BLOCK = 1 << 16
#: A fingerprint's own value and its one-bit neighbours.
_MASKS = [0] + [1 << i if i < 63 else -(1 << 63) for i in range(64)]
#: A MinHash signature has BANDS * DEPTH values; DEPTH of them in a row are a band.
BANDS, DEPTH = 24, 5
#: Standard deviations of a signature's estimate below the threshold down to which pairs are verified; members of a block of a crowded bucket.
SLACK, BLOCK_ROWS = 5, 512
_MULTIPLIERS = np.random.default_rng(24).integers(0, 1 << 63, BANDS * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
#: One-bit signature values of a long sketch, and products of shingles and multipliers that are held at once.
LONG, SIGNED = 2048, 1 << 18


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash, as a signed long, of the text's word shingles, repeats included.

    A-Z are lowered; words are runs without ASCII white space. Fewer words than a shingle needs: the whole
    sequence is one shingle. No word, or null: 0.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    k = min(words, len(parts))
    ends = list(accumulate(len(w) + 1 for w in parts))
    starts = [0, *ends[:-1]]
    spans = zip(starts, ends[k - 1 :])
    total, n, hashed = np.zeros(64, np.int64), len(parts) - k + 1, xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        h = np.fromiter((hashed(joined[a : b - 1], SEED) for a, b in (next(spans) for _ in range(min(BLOCK, n - at)))), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.int64)[0])


def _fingerprints(words: int):
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return run


def ball_edges(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Edges (a, b) that join distinct fingerprints `fp` at up to two differing bits.

    Each fingerprint emits itself and its 64 one-bit neighbours; two fingerprints within two bits share such a
    variant. A variant's bucket holds at most 65 fingerprints, all within two bits of one another, so it
    is enough to tie each to the bucket's smallest: classes come out whole without a bucket's pairs.
    """
    if bits not in (1, 2):
        raise ValueError("half the radius is one bit")
    variants = prints.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in _MASKS])).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.withColumn("other", F.min("fp").over(W.partitionBy("variant")))
    if bits == 1:
        met = met.withColumn("other", F.col("variant")).join(prints.select(F.col("fp").alias("variant")).hint("merge"), "variant", "left_semi")
    return met.where(F.col("fp") != F.col("other")).select(F.col("other").alias("a"), F.col("fp").alias("b")).distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """(id, fp, component_id) for every row: component_id is the smallest id that links at `bits` or fewer differing bits reach.

    Copies share a fingerprint and are one node of the graph, so a group of copies costs one node. Rows without words
    have fingerprint 0 and link like any other. Null ids never become a component_id unless all ids of the
    class are null. Repeated rows each get their row; an empty table gives an empty result; other columns are not read.
    """
    prints = cut(docs.select(F.col(id_col).alias("id"), _fingerprints(words)(F.col(text_col)).alias("fp")))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(ball_edges(nodes.select("fp"), bits))
    placed = merge_join(nodes, roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = merge_join(placed, firsts, "root").select("fp", "component_id")
    return merge_join(prints, classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted XXH64 of the text's distinct word shingles; empty without words. Words and short texts as in `fingerprint`."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, k, hashed = b" ".join(parts), min(words, len(parts)), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in parts))
    return np.unique(np.fromiter((hashed(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[k - 1 :])), np.uint64))


def signature(shingles: np.ndarray, multipliers: np.ndarray = _MULTIPLIERS) -> np.ndarray:
    """MinHash values of a set: the share of equal values estimates the Jaccard similarity of two sets."""
    least, step = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64), max(1, SIGNED // len(multipliers))
    for at in range(0, len(shingles), step):
        least = np.minimum(least, (shingles[at : at + step, None] * multipliers).min(0))
    return least


def _profiles(words: int):
    """Two hashes of the set of shingles, its SimHash, its size, the last byte of each signature value, and a hash of each band."""

    @F.pandas_udf("h1 long, h2 long, fp long, n int, sketch binary, bands array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            x = shingle_set(t, words)
            raw, signed = x.tobytes(), signature(x)
            bits = np.zeros(64, np.int64)
            for at in range(0, len(x), BLOCK):
                bits += np.unpackbits(x[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            fp = int(np.packbits(bits * 2 > len(x), bitorder="little").view(np.int64)[0])
            bands = np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(signed.reshape(BANDS, DEPTH))], np.uint64).view(np.int64)
            h1, h2 = (np.array([xxhash.xxh64_intdigest(raw, s)], np.uint64).view(np.int64)[0] for s in (1, 2))
            out.append((h1, h2, fp, len(x), (signed >> np.uint64(56)).astype(np.uint8).tobytes(), bands))
        return pd.DataFrame(out, columns=["h1", "h2", "fp", "n", "sketch", "bands"])

    return run


def _sets(words: int):
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words).view(np.int64) for t in texts])

    return run


def _least_equal(similarity: float) -> float:
    """Equal signature values that a pair at the threshold has, less SLACK standard deviations."""
    n = BANDS * DEPTH
    return similarity * n - SLACK * math.sqrt(n * similarity * (1 - similarity))


def _promising(similarity: float):
    """Whether sketches have so many equal values that the pair must be verified."""
    least = _least_equal(similarity)

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
        return pd.Series((x == y).sum(1) >= least)

    return run


@F.pandas_udf(BinaryType())
def _long_sketches(sets: pd.Series) -> pd.Series:
    """One bit of each of LONG signature values."""
    multipliers = np.random.default_rng(48).integers(0, 1 << 63, LONG, np.uint64) * np.uint64(2) + np.uint64(1)
    return pd.Series([np.packbits(signature(np.asarray(s, np.int64).view(np.uint64), multipliers) >> np.uint64(40) & np.uint64(1) > 0).tobytes() for s in sets])


def _across(similarity: float):
    """Pairs of a bucket's strays and its members that lie in different groups and must be verified. Rows come sorted by pair of blocks: those
    that ask (strays) and those that answer (all members); of two strays the smaller asks.

    A pair counts in the first band it shares only; if that bucket holds no third member, its tie has settled the pair.
    Of one-bit values of sets with Jaccard similarity J, those that agree exceed those that differ by a share of J.
    """
    least = similarity - SLACK * math.sqrt((1 - similarity**2) / LONG)

    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        asks = g["asks"].to_numpy(bool)
        if asks.all() or not asks.any():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        bits = np.unpackbits(np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(g), -1), axis=1).astype(np.float32) * 2 - 1
        (names, other), (roots, root), (sizes, size), (_, stray) = (((x := g[c].to_numpy())[asks], x[~asks]) for c in ("class", "root", "n", "stray"))
        fit = np.minimum(sizes[:, None], size[None, :]) >= (similarity - 1e-9) * np.maximum(sizes[:, None], size[None, :])
        i, j = np.nonzero((bits[asks] @ bits[~asks].T >= least * LONG) & fit & (roots[:, None] != root[None, :]) & (~stray[None, :].astype(bool) | (names[:, None] < other[None, :])))
        bands, met = np.stack(g["bands"]), np.zeros(len(i), bool)
        left, right = bands[asks], bands[~asks]
        for band in range(int(g["kind"].iloc[0]) - len(_MASKS)):
            met |= left[i, band] == right[j, band]
        return pd.DataFrame({"a": names[i[~met]], "b": other[j[~met]]}, dtype="int64")

    def run(batches):
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            groups = [g for _, g in batch.groupby(["bucket", "i", "j"], sort=False)]
            for g in groups[:-1]:
                yield pairs(g)
            held = groups[-1] if groups else None
        if held is not None:
            yield pairs(held)

    return run


def dealt_strays(placed: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(bucket, i, j, asks, kind, class, root, stray): who is compared with whom in buckets of `placed` (bucket, kind, class, root) that hold several groups.

    A bucket's members outside its largest group, its strays, are compared with all its members; those of the largest group are not compared with one
    another, so a stray costs a crowd one pass. Both are dealt by hash to blocks of about BLOCK_ROWS, so no task reads
    a whole bucket: a stray goes to each block of members, to ask, and every member to each block of strays, to answer.
    """
    size = F.lit(block_rows or BLOCK_ROWS)
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("rows"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("rows", "root")).alias("main"), F.sum("rows").alias("rows")).where("rows > main.rows")
    mixed = stored(mixed.select("bucket", F.col("main.root").alias("main"), F.ceil((F.col("rows") - F.col("main.rows")) / size).alias("asking"), F.ceil(F.col("rows") / size).alias("answering")))
    numbered = merge_join(placed, mixed, "bucket").withColumn("stray", F.col("root") != F.col("main"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("class"), F.col(n))
    asked = F.transform(upto("answering"), lambda j: F.struct(own("asking").alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    answered = F.transform(upto("asking"), lambda i: F.struct(i.alias("i"), own("answering").alias("j"), F.lit(False).alias("asks")))
    cells = F.explode(F.when(F.col("stray"), F.concat(asked, answered)).otherwise(answered))
    return numbered.withColumn("at", cells).select("bucket", "at.*", "kind", "class", "root", "stray")


def _left_apart(met: DataFrame, links: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of a band's members that `links` leave in different groups and whose long sketches don't rule them out. A bucket of two has been
    settled by its tie."""
    groups = components(links)
    placed = merge_join(met.where(f"members > 2 AND kind >= {len(_MASKS)}"), groups.select(F.col("node").alias("class"), "root"), "class", "left").select("bucket", "kind", "class", F.coalesce("root", "class").alias("root"))
    dealt = stored(dealt_strays(placed))
    marks = merge_join(sets, dealt.select("class").distinct(), "class", "left_semi").select("class", F.size("s").alias("n"), _long_sketches("s").alias("sketch"))
    marks = stored(merge_join(classes.select("class", "bands"), marks, "class"))
    cells = merge_join(dealt, marks, "class").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "class")
    return cells.mapInPandas(_across(similarity), "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of `similarity` or more.

    The set of `b` is joined first, so that the set of an `a` with many partners is not copied in a shuffle.
    """
    both = merge_join(merge_join(pairs, sets.select(F.col("class").alias("b"), F.col("s").alias("sb")), "b"), sets.select(F.col("class").alias("a"), F.col("s").alias("sa")), "a")
    counted = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("n"), (F.size("sa") + F.size("sb")).alias("m"))
    return stored(counted.where(F.col("n") >= similarity * (F.col("m") - F.col("n")) - 1e-9).select("a", "b"))


def _near_rows(docs: DataFrame, key: str, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """(key, id, best) for every row of `docs`, whose rows `key` tells apart: `best` names the row of the group that stays."""
    best = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "key").alias("best")
    rows = docs.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), _profiles(words)(F.col(text_col)).alias("p"))
    rows = stored(rows.select("key", "id", best, "p.*"))
    same = [F.first(c).alias(c) for c in ("fp", "n", "sketch", "bands")]  # equal sets have them in common
    classes = stored(rows.groupBy("h1", "h2").agg(F.min("best").alias("best"), *same).withColumn("class", F.monotonically_increasing_id()))
    # buckets: variants of the fingerprint within half the radius, and bands of the signature
    masks = F.array(*[F.lit(m).cast("long") for m in _MASKS])
    keys = F.concat(F.transform(masks, lambda m: F.xxhash64(F.lit("ball"), F.col("fp").bitwiseXOR(m))), "bands")
    each = classes.select("class", F.posexplode(keys).alias("kind", "bucket"))
    # counts and hubs are small and written first, so that AQE can split a hot bucket in the joins with them
    crowded = stored(each.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"))
    met = stored(merge_join(each, crowded, "bucket").select("class", "kind", "bucket", "members"))
    # every member is tied to the one that meets most others: of edits of one text, to that text
    degree = met.groupBy("class").agg(F.sum("members").alias("degree"))
    placed = merge_join(met, degree, "class")
    hubs = placed.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("class")).alias("less"))).alias("hub")).select("bucket", (-F.col("hub.less")).alias("a"))
    pairs = merge_join(met.select("bucket", F.col("class").alias("b")), stored(hubs), "bucket").where("a != b").select("a", "b").distinct()
    marks = classes.select("class", "sketch")
    pairs = merge_join(merge_join(pairs, marks.select(F.col("class").alias("b"), F.col("sketch").alias("mb")), "b"), marks.select(F.col("class").alias("a"), F.col("sketch").alias("ma")), "a")
    pairs = stored(pairs.where(_promising(similarity)("ma", "mb")).select("a", "b"))
    wanted = stored(merge_join(classes, met.select("class").distinct(), "class", "left_semi").select("class", F.col("best.key").alias("wanted")))
    # `wanted` has been written, so Spark knows its size and chooses the join by it
    sets = stored(docs.select(F.col(key).alias("wanted"), F.col(text_col).alias("text")).join(wanted, "wanted").select("class", _sets(words)("text").alias("s")))
    links = _verified(pairs, sets, similarity)
    links = links.union(_verified(_left_apart(met, links, classes, sets, similarity), sets, similarity))
    placed = merge_join(classes.select("class", "h1", "h2", "best"), components(links).select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    told = merge_join(placed.select("h1", "h2", "root"), placed.groupBy("root").agg(F.min("best").alias("best")), "root").select("h1", "h2", "best")
    return merge_join(rows.select("key", "id", "h1", "h2"), told, ["h1", "h2"]).select("key", "id", "best")


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id) for every row: the smallest id reached by links between texts whose sets of word shingles have a Jaccard
    similarity of `similarity` or more.

    Candidates share a variant of the SimHash of the set (one bit at most, as in `ball_edges`) or a band of its MinHash
    signature: the ball alone would find few pairs near 0.8, where about 10 of 64 bits differ; of these, BANDS bands miss
    7 in 100 000. In each bucket all members are tied to the one with most bucket mates. Ties are verified on the whole sets.
    Members that verified links leave in different groups are compared with one another in blocks by longer sketches, and
    promising pairs verified too, so no member is left out of a large bucket. Links are exact up to equal 64-bit hashes.

    Texts without words (null, empty) have equal sets. Null ids never become a component_id unless all ids of the group
    are null. Repeated rows each get their row; an empty table gives an empty result; other columns are not read. Very long
    texts are worked on whole.
    """
    keyed, key = with_row_key(docs.select(F.col(id_col), F.col(text_col)), id_col)
    return _near_rows(keyed, key, id_col, text_col, words, similarity).select(F.col("id").alias(id_col), F.col("best.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of `docs` of each group of `near_copy_groups`, with its columns: the smallest id (null ids last), then, where ids repeat, one of
    these rows by a hash of the text. All columns of `docs` are kept whatever their names; an empty table stays empty."""
    keyed, key = with_row_key(docs, id_col)
    gone = stored(_near_rows(keyed, key, id_col, text_col, words, similarity).where(F.col("key") != F.col("best.key")).select(F.col("key").alias(key)))
    return keyed.join(gone, key, "left_anti").select(*docs.columns)
