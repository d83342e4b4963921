"""Vector retrieval and passage selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors of a block of queries and of a block of the corpus that one task multiplies.
QUERY_BLOCK, CORPUS_BLOCK = 1024, 16_384
#: Products that a task holds at once, and rows that it passes on at once, at most.
PRODUCTS, ROWS = 1 << 21, 8192
#: Centres of a corpus at most, and rows of the sample for each that they are fitted on.
CENTRES, SAMPLE = 1024, 32


def normalize(vec: Column) -> Column:
    """The vector at length 1, in double precision; a zero vector stays."""
    wide = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _slices(n: int, width: int):
    """Ranges of `n` rows whose products with `width` vectors fit in PRODUCTS."""
    step = max(1, PRODUCTS // max(1, width))
    return [slice(i, min(n, i + step)) for i in range(0, n, step)]


def _cell(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[s] @ centres.T - half, 1) for s in _slices(len(x), len(centres))])


def _centres(corpus: DataFrame, rows: int) -> np.ndarray:
    """A centre for each CORPUS_BLOCK rows, CENTRES at most, by k-means on a sample of at most SAMPLE rows for each. Any centres give exact results."""
    n = min(CENTRES, -(-rows // CORPUS_BLOCK))
    sample = corpus.where(F.pmod(F.xxhash64("key"), F.lit(max(1, rows // (n * SAMPLE)))) == 0).select("vec").limit(2 * n * SAMPLE).toPandas()["vec"]
    x = np.stack(sample.to_numpy()).astype(np.float64) if len(sample) else np.zeros((1, 1))
    centres = x[np.random.default_rng(7).permutation(len(x))[:n]]
    for _ in range(8):
        near = _cell(x, centres)
        centres = np.stack([x[near == i].mean(0) if (near == i).any() else centres[i] for i in range(len(centres))])
    return centres


def _nearest(centres: np.ndarray):
    """Rows with the cell of the nearest centre and the distance to it."""

    def run(batches):
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vec"].to_numpy()).astype(np.float64)
                cell = _cell(x, centres)
                yield batch.assign(cell=cell.astype(np.int32), far=np.sqrt(((x - centres[cell]) ** 2).sum(1)))

    return run


def _wanted_cells(centres: np.ndarray, radius: np.ndarray, rows: np.ndarray, k: int, second: bool):
    """Rows of queries with a cell to search. First those of the best centres until they hold k rows; then, of the others, those in which by
    Cauchy and Schwarz a product may reach the k-th score found, q c + |q| r. Few queries are taken at a time, and ROWS rows passed on."""

    def found(x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mid, size = x @ centres.T, np.sqrt((x**2).sum(1))
        order = np.argsort(-mid, 1)
        before = np.cumsum(rows[order], 1) - rows[order]
        first = np.zeros(mid.shape, bool)
        np.put_along_axis(first, order, before < k, 1)
        wanted = first & (rows > 0)
        if second:
            slack = 1e-9 * size[:, None] * (np.sqrt((centres**2).sum(1)) + radius)
            wanted = ~first & (rows > 0) & (mid + size[:, None] * radius + slack >= least[:, None])
        return np.nonzero(wanted)

    def run(batches):
        for batch in batches:
            for s in _slices(len(batch), 8 * len(centres)):
                part = batch.iloc[s]
                at, cell = found(np.stack(part["vec"].to_numpy()).astype(np.float64), part["least"].to_numpy(np.float64))
                for i in range(0, len(at), ROWS):
                    yield part.drop(columns="least").iloc[at[i : i + ROWS]].assign(cell=cell[i : i + ROWS].astype(np.int32))

    return run


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Which are the k best of each row, and of those that tie with the last the first."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    least = np.partition(scores, -k, 1)[:, -k][:, None]
    room = k - (scores > least).sum(1)
    return (scores > least) | ((scores == least) & (np.cumsum(scores == least, 1, dtype=np.int32) <= room[:, None]))


def _leading(scores: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The scores of each row's best column of each value, the first of equals; -inf elsewhere."""
    codes = pd.factorize(values, use_na_sentinel=False)[0]
    order = np.argsort(codes, kind="stable")
    n = np.bincount(codes)
    dealt = scores[:, order]
    top = dealt == np.repeat(np.fmax.reduceat(dealt, np.cumsum(n) - n, 1), n, 1)
    so_far = np.cumsum(top, 1, dtype=np.int32)
    before = np.repeat((so_far - top)[:, np.cumsum(n) - n], n, 1)
    out = np.empty_like(scores)
    out[:, order] = np.where(top & (so_far - before == 1), dealt, -np.inf)
    return out


def _scored(queries: DataFrame, corpus: DataFrame, banned: DataFrame | None, kinds: tuple, k: int, differ: bool, n_q: int, one: bool, leaders: int = 0) -> DataFrame:
    """(query, doc, score): the k best of each query in each cell. `queries` (key, vec, value, cell) meet `corpus` (key, vec, value, cell, sub, subs).
    With `leaders` also the best of each value, of the so many values whose best are best, and the value as a column.

    A task holds a block of each, and the bans (who, key) that concern both. Blocks of the corpus are sent only to blocks of queries that want them;
    `one`: the corpus is one block.
    """

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        bans, c = c[c["who"].notna()], c[c["who"].isna()].sort_values("key")
        if not len(q) or not len(c):
            return pd.DataFrame({"query": [], "doc": [], "score": []} | ({"value": []} if leaders else {}))
        key, value = c["key"].to_numpy(), c["value"].to_numpy()
        vectors = np.stack(c["vec"].to_numpy()).astype(np.float64).T
        row, column = pd.Index(q["key"]).get_indexer_for(bans["who"].astype(q["key"].dtype)), pd.Index(c["key"]).get_indexer_for(bans["key"])
        both = (row >= 0) & (column >= 0)
        row, column = row[both], column[both]
        out = []
        for s in _slices(len(q), len(c)):
            part = q.iloc[s]
            scores = np.stack(part["vec"].to_numpy()).astype(np.float64) @ vectors
            if differ:
                scores[part["value"].to_numpy()[:, None] == value[None, :]] = -np.inf
            mine = (row >= s.start) & (row < s.stop)
            scores[row[mine] - s.start, column[mine]] = -np.inf
            take = _best(scores, k)
            if leaders:
                first = _leading(scores, value)
                take |= _best(first, leaders) & (first > -np.inf)
            at, of = np.nonzero(take & (scores > -np.inf))
            out.append(pd.DataFrame({"query": part["key"].to_numpy()[at], "doc": key[of], "score": scores[at, of]} | ({"value": c["value"].iloc[of].array} if leaders else {})))
        return pd.concat(out)

    block = lambda key: F.pmod(F.xxhash64(key), F.lit(n_q)).cast("int")
    asked = queries.withColumn("block", block("key"))
    own = corpus.select("key", "vec", "value", "cell", "sub", F.lit(None).cast(kinds[0]).alias("who"))
    if one:
        left, right = asked.withColumn("sub", F.lit(0)), own.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    else:
        left = asked.join(corpus.select("cell", "sub").distinct().hint("merge"), "cell")
        right = own.join(asked.select("cell", "block").distinct().hint("merge"), "cell")
    if banned is not None:
        placed = corpus.select("key", "cell", "sub").join(banned.hint("merge"), "key")
        right = right.unionByName(placed.select("key", F.lit(None).cast(corpus.schema["vec"].dataType).alias("vec"), F.lit(None).cast(corpus.schema["value"].dataType).alias("value"), "cell", "sub", "who", block("who").alias("block")))
    keys = ["cell", "sub", "block"]
    # new names for the columns of each side, which come from the same tables
    return left.toDF(*left.columns).groupBy(*keys).cogroup(right.toDF(*right.columns).groupBy(*keys)).applyInPandas(best, f"query {kinds[0]}, doc {kinds[1]}, score double" + (f", value {dict(corpus.dtypes)['value']}" if leaders else ""))


def _top(found: DataFrame, k: int, leaders: int = 0) -> DataFrame:
    by = lambda *keys: F.row_number().over(W.partitionBy("query", *keys).orderBy(F.desc("score"), "doc"))
    ranked = found.withColumn("rank", by())
    if not leaders:
        return ranked.where(F.col("rank") <= k)
    # `lead`: the place of a value's best among those of all values
    led = ranked.withColumn("_first", by("value") == 1).withColumn("lead", F.when(F.col("_first"), by("_first"))).drop("_first")
    return led.where((F.col("rank") <= k) | (F.col("lead") <= leaders))


def knn(queries: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str, vec: str, k: int, differ: str | None = None, banned: DataFrame | None = None, leaders: tuple[str, int] | None = None) -> DataFrame:
    """(query_id, corpus_id, score, rank): the k best inner products of each query, exact; ties by id. Null vectors are left out; ids are unique.

    With `differ`, only passages whose value in that column is another than the query's count; `banned` (query_id, corpus_id) are passages that a query
    must not get. Both hold before the k best. With `leaders` (column, n), the best passage of each value of that column is given too, for the n values whose
    best are best, however many passages of others stand before it; the column is returned, and the ranks of hits beyond the k best only order them.

    A corpus of over CORPUS_BLOCK rows is dealt to cells by the nearest of some centres, and a cell to blocks by hash. Each query is first compared with
    its best cells, then only with those that may hold a better product than its k-th so far. A task multiplies a block of queries and a block
    of the corpus, PRODUCTS at a time, and passes on the k best of each query. Only the centres, a bounded sample and a row for each cell pass through the driver.
    """
    kinds = dict(queries.dtypes)[query_id], dict(corpus.dtypes)[corpus_id]
    if differ and leaders:
        raise ValueError("one column of values")
    of, most = leaders or (None, 0)
    side = lambda df, key, value: df.select(F.col(key).alias("key"), F.col(vec).alias("vec"), (F.col(value) if value else F.lit(0)).alias("value")).where("vec IS NOT NULL")
    q, c = side(queries, query_id, differ), side(corpus, corpus_id, differ or of)
    forbidden = None if banned is None else banned.select(F.col(query_id).alias("who"), F.col(corpus_id).alias("key")).where("who IS NOT NULL")
    n_q, rows = -(-q.count() // QUERY_BLOCK) or 1, c.count()
    scored = lambda q, c: _scored(q, c, forbidden, kinds, k, bool(differ), n_q, rows <= CORPUS_BLOCK, most)
    if rows <= CORPUS_BLOCK:
        found = scored(q.withColumn("cell", F.lit(0)), c.withColumns({"cell": F.lit(0), "sub": F.lit(0)}))
    else:
        centres = _centres(c, rows)
        cells = c.mapInPandas(_nearest(centres), _fields(c, "cell int, far double"))
        held, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for cell, n, far in cells.groupBy("cell").agg(F.count("*"), F.max("far")).collect():  # a row for each centre
            held[cell], radius[cell] = n, far
        subs = F.element_at(F.array(*[F.lit(int(-(-n // CORPUS_BLOCK) or 1)) for n in held]), F.col("cell") + 1)
        placed = cells.withColumn("sub", F.pmod(F.xxhash64("key"), subs).cast("int")).drop("far")
        searched = lambda q, second: q.mapInPandas(_wanted_cells(centres, radius, held, k, second), _fields(q.drop("least"), "cell int"))
        near = _top(scored(searched(q.withColumn("least", F.lit(0.0)), False), placed), k, most)
        reached = near.where(F.col("rank") == k).select(F.col("query").alias("key"), F.col("score").alias("least"))
        if most:
            values = c.select("value").distinct().limit(most).count()  # `most` of them or all there are
            led = near.where(F.col("lead") == values).select(F.col("query").alias("key"), F.col("score").alias("led"))
            reached = reached.join(led.hint("merge"), "key").select("key", F.least("least", "led").alias("least"))
            near = near.drop("lead")
        rest = q.join(reached.hint("merge"), "key", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        found = near.drop("rank").union(scored(searched(rest, True), placed))
    return _top(found, k, most).select(F.col("query").alias(query_id), F.col("doc").alias(corpus_id), "score", "rank", *([F.col("value").alias(of)] if of else []))


def _fields(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"{name} {kind}" for name, kind in df.dtypes), more])


def packet(queries: DataFrame, corpus: DataFrame, banned: DataFrame, query_id: str, corpus_id: str, vec: str, k: int, allowed: Column | None = None) -> DataFrame:
    """The k best passages of each query among the `allowed` ones, without those that `banned` (query, passage) forbids it: its own answers, leaks.

    Both filters come before the k best, however many passages a query is forbidden: a ban goes to the one task that compares the two.
    """
    forbidden = banned.select(query_id, corpus_id).distinct()
    return knn(queries, corpus if allowed is None else corpus.where(allowed), query_id, corpus_id, vec, k, banned=forbidden)


def rerank(hits: DataFrame, query_id: str, doc_id: str, boost: Column, weight: float = 0.04, most: int = 3) -> DataFrame:
    """Scores raised by `weight` for each of up to `most` keywords that a passage contains, and ranked anew."""
    scored = hits.withColumn("score", F.col("score") + weight * F.least(F.lit(most), boost))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("score"), doc_id)))


def with_fallback(hits: DataFrame, query_id: str, ok: Column) -> DataFrame:
    """Rows that satisfy `ok`, or all rows of a query if none does."""
    any_ok = F.max(ok.cast("int")).over(W.partitionBy(query_id)) == 1
    return hits.withColumn("_any", any_ok).where(ok | ~F.col("_any")).drop("_any")


def diverse(hits: DataFrame, query_id: str, doc_id: str, source: str, k: int, anchor: Column | None = None) -> DataFrame:
    """k passages of each query: the hit that `anchor` pins, if there is one, the best of each other source by score, then the rest by score."""
    pinned = hits.withColumn("_pin", F.coalesce(anchor, F.lit(False)) if anchor is not None else F.lit(False))
    taken = F.max(F.when(F.col("_pin"), F.col(source))).over(W.partitionBy(query_id))
    best = F.row_number().over(W.partitionBy(query_id, source).orderBy(F.desc("score"), doc_id)) == 1
    tiered = pinned.withColumn("_first", best & ~F.coalesce(F.col(source) == taken, F.lit(False)))
    order = W.partitionBy(query_id).orderBy(F.desc("_pin"), F.desc("_first"), F.desc("score"), doc_id)
    return tiered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_pin", "_first")


def retrieval_report(hits: DataFrame, query_id: str, source: str, on_topic: Column, least: tuple[int, int] = (4, 3)) -> DataFrame:
    """Per query: passages on topic, sources, and whether both reach `least`."""
    r = hits.groupBy(query_id).agg(F.sum(on_topic.cast("int")).cast("long").alias("on_topic"), F.countDistinct(source).alias("sources"))
    return r.withColumn("ok", (F.col("on_topic") >= least[0]) & (F.col("sources") >= least[1]))


def group_overlap(df: DataFrame, group: str, member: str, element: str) -> DataFrame:
    """Per group: members and the mean number of elements that two of its members share."""
    rows = df.select(group, member, element).distinct()
    n = rows.groupBy(group).agg(F.countDistinct(member).alias("n"))
    # of c members that hold an element, c (c - 1) / 2 pairs share it: pairs are counted, not made
    per = rows.groupBy(group, element).agg(F.count("*").alias("c")).groupBy(group).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("shared"))
    return n.join(per.hint("shuffle_hash"), group).select(group, "n", F.round(F.when(F.col("n") > 1, F.col("shared") / (F.col("n") * (F.col("n") - 1) / 2)), 6).alias("mean_overlap"))


def retrieval_summary(report: DataFrame, least: tuple[int, int] = (4, 3), share: float = 0.9) -> DataFrame:
    """One row over `retrieval_report`: queries, means, shares of queries with enough passages on topic and enough sources, and whether each share passes."""
    rate = lambda c, n: F.avg((F.col(c) >= n).cast("int"))
    topic, sources = rate("on_topic", least[0]), rate("sources", least[1])
    return report.agg(F.count("*").alias("n"), F.round(F.avg("on_topic"), 6).alias("mean_on_topic"), F.round(F.avg("sources"), 6).alias("mean_sources"), F.round(topic, 6).alias("enough_on_topic"), F.round(sources, 6).alias("enough_sources"), (topic >= share).alias("topic_ok"), (sources >= share).alias("sources_ok"))
