"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, merge_join

#: Rows that the rotation is learned from, its rounds, and the wanted chance to miss a pair just at the threshold.
FIT_ROWS, ROUNDS, MISS = 20_000, 30, 0.01


def learn_rotation(x: np.ndarray, bits: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Iterative quantisation: a (dim, bits) projection whose signs lose least of the principal components of `x`."""
    _, _, v = np.linalg.svd(x, full_matrices=False)
    basis = np.zeros((x.shape[1], bits))
    basis[:, : min(bits, len(v))] = v[:bits].T
    projected = x @ basis
    rotation = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(codes.T @ projected)
        rotation = (u @ w).T
    return basis @ rotation


def plan_tables(rows: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): keys of log2(rows) + 2 bits, so that a bucket of unlike vectors stays small at any size, and as many
    tables as make the chance to miss a pair at the threshold, probing keys within one bit, at most `miss`."""
    bits = min(48, max(10, math.ceil(math.log2(max(2, rows))) + 2))
    flip = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    hit = (1 - flip) ** bits + bits * flip * (1 - flip) ** (bits - 1)
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - hit)))


def _keys(planes: np.ndarray, bits: int, tables: int):
    """Array of the tables' keys, then a 64-bit code of the first bits for a cheap check."""

    @F.pandas_udf("array<long>")
    def run(vectors: pd.Series) -> pd.Series:
        signs = (np.stack(vectors.to_numpy()).astype(np.float64) @ planes) >= 0
        keys = signs[:, : bits * tables].reshape(len(signs), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
        check = np.packbits(signs[:, -64:], axis=1, bitorder="little").view(np.int64)
        return pd.Series(list(np.hstack([keys, check])))

    return run


def usable(vec: Column) -> Column:
    """True for vectors without null or non-finite components and with a length above zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _tame(vec: Column) -> Column:
    """A vector whose squares would leave the range of doubles, divided by its largest component, which changes no angle; others as they are."""
    most = F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))
    wide = F.transform(vec, lambda x: x.cast("double"))
    return F.when(most.between(1e-100, 1e100), wide).otherwise(F.transform(wide, lambda x: x / most))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _class_links(classes: DataFrame, dim: int, rows: int, cosine: float) -> DataFrame:
    """(a, b): classes of one dimension, a < b, whose vectors have a cosine of at least `cosine`."""
    sample = classes.orderBy(F.xxhash64("class"), "class").limit(FIT_ROWS).select("vec").collect()  # bounded by FIT_ROWS
    x = np.array([r["vec"] for r in sample], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bits, tables = plan_tables(rows, cosine)
    rng, wide = np.random.default_rng(7), min(dim, 64)
    planes = np.hstack([learn_rotation(x, wide, rng) for _ in range(math.ceil((bits * tables + 64) / wide))])
    keyed = cut(classes.select("class", _keys(planes[:, -(bits * tables + 64) :], bits, tables)("vec").alias("keys")))
    near = math.acos(cosine) / math.pi * 64
    most = math.ceil(near + 5 * math.sqrt(near)) + 2  # bits in which codes of a pair at the threshold differ, and 5 standard deviations
    each = keyed.select("class", F.element_at("keys", -1).alias("code"), F.posexplode(F.slice("keys", 1, tables)).alias("table", "key"))
    masks = F.array(*[F.lit(m).cast("long") for m in [0] + [1 << i for i in range(bits)]])
    probes = each.select(F.col("class").alias("b"), F.col("code").alias("other"), "table", "key", F.explode(masks).alias("mask")).select("b", "other", "table", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    met = merge_join(probes, each.withColumnRenamed("class", "a"), ["table", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("code").bitwiseXOR(F.col("other"))) <= most)).select("a", "b").distinct()
    va, vb = classes.select(F.col("class").alias("a"), F.col("vec").alias("va")), classes.select(F.col("class").alias("b"), F.col("vec").alias("vb"))
    pairs = merge_join(merge_join(met, va, "a"), vb, "b")
    return pairs.where(_dot("va", "vb") / (F.sqrt(_dot("va", "va")) * F.sqrt(_dot("vb", "vb"))) >= cosine).select("a", "b")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: how many other rows it links with, the smallest id it reaches.

    Rows link at a cosine, in double precision, of `cosine` or more; candidates come from Hamming tables and are all
    checked against the original vectors. Equal vectors are one class, so a group of copies is compared once and
    counted with its size. Unusable vectors (null, empty, zero, with null or non-finite components) link with nothing;
    vectors of different lengths never link, very small and very large ones link like any other. Repeated rows count each; null ids are never a component_id unless no
    row of the component has an id. An empty table gives an empty result; other columns are not read.

    The rotation is learned from at most FIT_ROWS vectors; every vector is indexed and every one is a query.
    """
    vec = F.col(vec_col)
    rows = cut(vectors.select(F.col(id_col).alias("id"), F.when(usable(vec), vec).alias("vec")).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit("other"), "vec")}))
    grouped = rows.where("vec IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = cut(grouped.withColumn("class", F.struct("h1", "h2")).withColumn("dim", F.size("vec")).withColumn("vec", _tame(F.col("vec"))))
    links = None
    for dim, n in sorted((r["dim"], r["count"]) for r in classes.groupBy("dim").count().collect()):  # one row for each length of vector
        found = _class_links(classes.where(F.col("dim") == dim), dim, n, cosine)
        links = found if links is None else links.union(found)
    plain = classes.select("class", "first", "copies")
    if links is None:
        counts, roots = plain.select("class", F.lit(0).alias("others")), plain.select(F.col("class").alias("node"), F.col("class").alias("root"))
    else:
        links = cut(links)
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        size = plain.select(F.col("class").alias("b"), "copies")
        counts = merge_join(both, size, "b").groupBy(F.col("a").alias("class")).agg(F.sum("copies").alias("others"))
        roots = components(links)
    placed = merge_join(merge_join(plain, counts, "class", "left"), roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    told = merge_join(placed, firsts, "root").select("class.h1", "class.h2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), "component_id")
    linked = merge_join(rows.where("vec IS NOT NULL").select("id", "h1", "h2"), told, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("vec IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
