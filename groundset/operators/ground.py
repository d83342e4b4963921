"""Grounding: quoted spans in their sources, provenance, claims."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_span(text: Column, quote: Column) -> tuple[Column, Column]:
    """0-based start and end of the first exact occurrence; null if there is none or the quote is empty. Code points."""
    at = F.instr(text, quote)
    start = F.when((at > 0) & (quote != ""), at - 1)
    return start, start + F.length(quote)


def tolerant_pattern(quote: Column) -> Column:
    r"""A pattern of the quote's words, each taken literally, with any white space between them."""
    words = F.filter(F.split(quote, r"\s+"), lambda w: w != "")
    literal = F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.array_join(literal, r"\s+")


def snap(df: DataFrame, text: str, quote: str) -> DataFrame:
    """`df` with `found` (the exact text), char_start and char_end: an exact hit first, else one that differs in white space."""
    start, _ = find_span(F.col(text), F.col(quote))
    loose = F.when(start.isNull() & (F.trim(quote) != ""), F.nullif(F.regexp_substr(F.col(text), tolerant_pattern(F.col(quote))), F.lit("")))
    found = F.when(start.isNotNull(), F.col(quote)).otherwise(loose)
    placed = df.withColumn("found", found)
    at = (F.instr(F.col(text), F.col("found")) - 1).cast("long")
    return placed.withColumns({"char_start": F.when(F.col("found").isNotNull(), at), "char_end": F.when(F.col("found").isNotNull(), at + F.length("found"))})


#: (code points of a gram, grams of a window) by the least length of a quote without its white space: long quotes meet their documents on the least
#: gram of a window, shorter ones on a gram of as many code points as they surely have.
GRAMS = {32: (16, 17), 6: (6, 1), 3: (3, 1), 2: (2, 1), 1: (1, 1)}
#: Quotes, and code points of all of them, that are broadcast to the documents, at most.
BROADCAST_QUOTES, BROADCAST_POINTS = 1 << 15, 1 << 23
#: Distinct quote grams that are broadcast to the documents if the quotes are not, at most: 8 bytes each.
BROADCAST_ANCHORS = 1 << 20
#: Code points that are hashed at once while quotes are looked for, so that the hashes stay in the processor's cache.
SLICE = 1 << 15
_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), 0x9E3779B97F4A7C15
_FOUND = ["quote", "_doc", "found", "char_start", "char_end"]
_SPACES = " \t\n\x0b\x0c\r"


def _points(text: str) -> np.ndarray:
    """Code points of a text without its ASCII white space."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points[(points != 32) & ((points < 9) | (points > 13))]


def _gram_hashes(points: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """64-bit hashes of all grams of each of `sizes` code points, by doubling."""
    h = (points.astype(np.uint64) + np.uint64(1)) * _MIX
    have, out, at = 1, {}, dict.fromkeys(sizes, 0)
    while True:
        for size in sizes:
            if size & have:  # the grams so far, followed by one of `have` code points
                if at[size]:
                    power = np.uint64(pow(_STEP, have, 1 << 64))
                    out[size] = out[size][: max(0, len(h) - at[size])] * power + h[at[size] : at[size] + len(out[size])]
                else:
                    out[size] = h
                at[size] += have
        if have * 2 > max(sizes):
            return out
        h, have = h[: max(0, len(h) - have)] * np.uint64(pow(_STEP, have, 1 << 64)) + h[have:], have * 2


def _window_least(h: np.ndarray, window: int) -> np.ndarray:
    """The least of each `window` hashes in a row."""
    have = 1
    while have < window and len(h):
        step = min(have, window - have)
        h, have = np.minimum(h[: max(0, len(h) - step)], h[step:]), have + step
    return h


def _quote_gram(quotes: pd.Series) -> pd.DataFrame:
    """The class and the gram of a quote: the least hash of its first window, or of all its grams."""
    out = []
    for quote in quotes:
        kind, gram = None, None
        points = _points(quote or "")
        if len(points):
            kind = next(k for k in GRAMS if len(points) >= k)
            h = _gram_hashes(points, [GRAMS[kind][0]])[GRAMS[kind][0]]
            gram = int((h[: GRAMS[kind][1]] if GRAMS[kind][1] > 1 else h).min().view(np.int64))
        out.append((kind, gram))
    return pd.DataFrame(out, columns=["kind", "gram"]).astype({"kind": "Int32", "gram": "Int64"})


def _document_grams(kinds: list[int], wanted):
    """(doc, gram) of the distinct grams of each text that quotes of these classes may have; only wanted ones, if they were broadcast."""

    def run(batches):
        own = wanted.value if wanted is not None else None
        for batch in batches:
            docs, grams = [], []
            for doc, text in zip(batch["_doc"], batch["body"]):
                h = _gram_hashes(_points(text or ""), [GRAMS[k][0] for k in kinds])
                held = np.unique(np.concatenate([_window_least(h[GRAMS[k][0]], GRAMS[k][1]) for k in kinds])).view(np.int64)
                if own is not None:
                    held = held[np.isin(held, own)] if len(own) < len(held) else held[own[np.minimum(np.searchsorted(own, held), len(own) - 1)] == held]
                if len(held):
                    docs.append(np.full(len(held), doc, dtype=object))
                    grams.append(held)
            if docs:
                yield pd.DataFrame({"_doc": np.concatenate(docs), "gram": np.concatenate(grams)})

    return run


def _span(body: str, bare: str, quote: str) -> tuple[str, int, int] | None:
    """What `snap` finds: the quote's first exact occurrence in a body, else the first that differs in white space. `bare` is the body without white space."""
    at = body.find(quote)
    if at >= 0:
        return quote, at, at + len(quote)
    words = [w for w in re.split(f"[{_SPACES}]+", quote) if w]
    if words == [quote] or "".join(words) not in bare:
        return None
    m = re.search(f"[{_SPACES}]+".join(map(re.escape, words)), body)
    return m and (m[0], *m.span())


def _quotes_held(quotes):
    """(quote, doc, found, char_start, char_end) of the broadcast quotes (quote, text, kind, gram) that each text holds."""

    def run(batches):
        own, by_gram = quotes.value, {}
        if not own:
            return
        for i, (*_, gram) in enumerate(own):
            by_gram.setdefault(gram, []).append(i)
        sizes = sorted({GRAMS[kind][0] for _, _, kind, _ in own})
        shift = np.uint64(56 - len(by_gram).bit_length())
        marked = np.zeros(1 << 64 - int(shift), dtype=bool)  # by a hash's first bits, 128 to 256 for each gram
        marked[np.array(list(by_gram), dtype=np.int64).view(np.uint64) >> shift] = True
        for batch in batches:
            out = []
            for doc, text in zip(batch["_doc"], batch["body"]):
                points = _points(text or "")
                met = []
                for at in range(0, len(points), SLICE):
                    for h in _gram_hashes(points[at : at + SLICE + max(sizes) - 1], sizes).values():
                        met.append(h[marked[(h >> shift).view(np.int64)]])
                held = [i for gram in np.unique(np.concatenate(met)).view(np.int64).tolist() for i in by_gram.get(gram, ())] if met else []
                bare = points.tobytes().decode("utf-32-le", "surrogatepass") if held else ""
                out += [(own[i][0], doc, *span) for i in held if (span := _span(text, bare, own[i][1]))]
                if len(out) >= 1 << 13:
                    yield pd.DataFrame(out, columns=_FOUND)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=_FOUND)

    return run


def candidates(keyed: DataFrame, docs: DataFrame, kinds: list[int]) -> DataFrame:
    """(quote, doc): pairs of quotes (quote, kind, gram) and documents (_doc, body) among which are all that hold a quote, also with other white space.

    Grams that no quote has go where they arise, if the quotes' ones are few enough to be broadcast, which is counted first; else both sides
    are shuffled by gram.
    """
    some = keyed.select("gram").distinct()
    few = some.limit(BROADCAST_ANCHORS + 1).toPandas()["gram"].to_numpy(np.int64)  # at most so many longs
    wanted = keyed.sparkSession.sparkContext.broadcast(np.sort(few)) if len(few) <= BROADCAST_ANCHORS else None
    found = docs.select("_doc", "body").mapInPandas(_document_grams(sorted(kinds), wanted), f"_doc {docs.schema['_doc'].dataType.simpleString()}, gram long")
    return found.join(keyed.select("quote", "gram").hint("merge"), "gram").select("quote", "_doc")


def locate(quotes: DataFrame, docs: DataFrame, quote_id: str, doc_id: str, text: str = "text") -> DataFrame:
    """(quote, doc, found, char_start, char_end) for every document that holds a quote, also with other white space.

    Quotes may be in any script and begin or end inside a word. Only documents with a gram of a quote are searched for it, so every pair
    is exact. Null, empty and blank quotes are not found; a repeated quote id is a quote of its own.

    A document that holds a quote holds it without white space too. Then a quote of 32 code points or more has a window of 17 grams of 16 whose
    least hash is the least of some window of the document; a shorter quote has a gram that is one of the document's. Quotes and documents meet on
    these hashes, whatever the script and wherever in a word a quote begins. Quotes that are few enough are broadcast, which is counted first, and
    looked for where each document is read; else quotes and documents meet by a join on gram, and the texts of the pairs by another.
    """
    q = quotes.select(F.col(quote_id).alias("quote"), F.col(text).alias("text")).where(F.col("quote").isNotNull() & F.col("text").rlike(f"[^{_SPACES}]"))
    d = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("body")).where("_doc IS NOT NULL")
    keyed = q.select("quote", "text", F.pandas_udf(_quote_gram, "kind int, gram long")("text").alias("g")).select("quote", "text", "g.*")
    n = keyed.agg(F.count("*").alias("quotes"), F.sum(F.length("text")).alias("points"), F.collect_set("kind").alias("kinds")).first()  # five kinds at most
    if n["quotes"] <= min(BROADCAST_QUOTES, BROADCAST_ANCHORS) and (n["points"] or 0) <= BROADCAST_POINTS:
        few = q.sparkSession.sparkContext.broadcast([tuple(r) for r in keyed.collect()])
        kind = {c: t.schema[c].dataType.simpleString() for t, c in ((q, "quote"), (d, "_doc"))}
        met = d.mapInPandas(_quotes_held(few), f"quote {kind['quote']}, _doc {kind['_doc']}, found string, char_start long, char_end long")
    else:
        held = candidates(keyed, d, n["kinds"]).distinct().join(q.withColumnRenamed("text", "said").hint("shuffle_hash"), "quote")
        met = snap(held.join(d.hint("merge"), "_doc"), "body", "said").where("found IS NOT NULL")
    return met.select(F.col("quote").alias(quote_id), F.col("_doc").alias(doc_id), "found", "char_start", "char_end")


def assemble(parts: DataFrame, sources: DataFrame, item: str, number: str, kind: str, question: str, quote: str, cited: str, source_id: str, text: str = "text") -> DataFrame:
    """Questions of items from generated parts: each part's quoted answer is snapped to the source it cites.

    Returns every part with qid (`item#number`), answer (the exact text of the source), char_start, char_end, and `kept`: false where the quote
    is not in the cited source or the source is unknown; then the answer and offsets are null. A part that cites nothing keeps the answer given
    as its quote, and is dropped if that is null or empty.
    """
    given = parts.select(*parts.columns, F.col(cited).alias("_doc"))
    body = sources.select(F.col(source_id).alias("_doc"), F.col(text).alias("_body"))
    met = snap(given.join(body.hint("merge"), "_doc", "left"), "_body", quote)
    free = F.col(cited).isNull()
    kept = F.when(free, F.coalesce(F.col(quote), F.lit("")) != "").otherwise(F.col("found").isNotNull())
    qid = F.concat_ws("#", F.col(item).cast("string"), F.col(number).cast("string"))
    return met.select(item, qid.alias("qid"), kind, question, F.when(free, F.col(quote)).otherwise(F.col("found")).alias("answer"), F.col(cited), "char_start", "char_end", kept.alias("kept"))


def assembly_report(assembled: DataFrame, sources: DataFrame, item: str, kind: str, cited: str, source_id: str, text: str = "text") -> DataFrame:
    """Per kind: items, parts, parts kept and dropped, and kept ones whose offsets don't give their answer, which must be none."""
    body = sources.select(F.col(source_id).alias(cited), F.col(text).alias("_body"))
    told = F.expr("substring(_body, cast(char_start + 1 AS int), cast(char_end - char_start AS int))")
    joined = assembled.join(body.hint("merge"), cited, "left")
    bad = F.col("kept") & F.col(cited).isNotNull() & ~F.coalesce(told == F.col("answer"), F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    return joined.groupBy(kind).agg(F.countDistinct(item).alias("n_items"), F.count("*").alias("n_parts"), n(F.col("kept")).alias("n_kept"), n(~F.col("kept")).alias("n_dropped"), n(bad).alias("n_bad"))


def mismatches(cited: DataFrame, chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Cited answers that are not what their offsets say: unknown chunk, null or wrong offsets."""
    joined = cited.join(chunks.select(key, F.col(text).alias("_body")).hint("merge"), key, "left")
    told = F.expr("substring(_body, cast(char_start + 1 AS int), cast(char_end - char_start AS int))")
    return joined.where(~F.coalesce(told == F.col("answer"), F.lit(False))).drop("_body")


def claim_gate(scores: DataFrame, item: str, sentence: str, least: float = 0.5) -> DataFrame:
    """Per item: the best premise of each sentence, the weakest sentence of those, and whether it reaches `least`."""
    best = scores.groupBy(item, sentence).agg(F.max("score").alias("best"))
    return best.groupBy(item).agg(F.count("*").alias("n_sentences"), F.round(F.min("best"), 6).alias("score")).withColumn("grounded", F.col("score") >= least)


def support(scores: DataFrame, item: str, sentence: str, entail: str = "p_entail", contra: str = "p_contra") -> DataFrame:
    """Per item: share of sentences that some premise entails, whether all are, and the share that none does."""
    ok = (F.col(entail) > 0.5) & (F.col(entail) > F.col(contra))
    each = scores.groupBy(item, sentence).agg(F.max(ok.cast("int")).alias("ok"))
    return each.groupBy(item).agg(F.round(F.avg("ok"), 6).alias("partial"), (F.min("ok") == 1).alias("strict"), F.round(1 - F.avg("ok"), 6).alias("unsupported"))


def replace_elements(items: DataFrame, patches: DataFrame, key: str, kind: str, value: str) -> DataFrame:
    """Long-form array elements with those of a patched (key, kind) replaced; others stay."""
    p = patches.select(key, kind, F.col(value).alias("_new"))
    return items.join(p.hint("merge"), [key, kind], "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def capped(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group in order."""
    from pyspark.sql import Window as W

    return df.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= most).drop("_rn")


def repaired_span(span: Column, tail: Column, stop: list[str]) -> Column:
    """A span whose last word is in `stop`, extended by `tail`, the source behind it, up to the next end of a sentence, if it has one."""
    last = F.lower(F.regexp_extract(span, r"([A-Za-z]+)\W*$", 1))
    more = F.regexp_extract(tail, r"^[^.!?)\]]*[.!?)\]]", 0)
    return F.when(last.isin(*stop) & (more != ""), F.concat(span, more)).otherwise(span)


def inventory(rows: DataFrame, concept: str, question: str, base: str, key: str, most: int) -> DataFrame:
    """At most `most` rows of each concept, those of the base facet first, then by key; a question of a concept once."""
    first = rows.groupBy(concept, question).agg(F.min(F.struct((~F.col(base)).alias("_later"), F.col(key).alias("_key"))).alias("_b"))
    once = first.select(concept, F.col("_b._key").alias(key), (~F.col("_b._later")).alias(base)).withColumn("_rank", (~F.col(base)).cast("int"))
    return capped(once, concept, ["_rank", key], most).drop("_rank")
