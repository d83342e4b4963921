"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, ranked, with_row_key

#: Weights of the sources in order, repeating, and how often a source may be gone through.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Slope of each source's weight over the training time, repeating: early, flat and late sources.
SLOPES = (-0.5, 0.0, 0.5)
#: A source's documents are summed in so many ranges of their hash.
RANGE_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, at, target): each source's share of all words by weight, none above `repeats` times its size.

    `sizes` has one row per source. What a capped source can't take is shared by weight among the others until none
    is above its cap; each pass is one aggregate, and passes end when no further source reaches its cap.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    placed = cut(ranked(sizes, F.col("source").asc_nulls_last(), name="at").withColumn("weight", weight))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    capped, rate = -1, 0.0
    while True:
        full = F.col("source_size") * repeats < F.col("weight") * F.lit(rate)
        n, taken, open_weight = placed.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("source_size") * repeats)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        if n == capped:
            break
        capped, rate = n, (total - taken) / open_weight if open_weight else 0.0
        if not open_weight:
            break
    return placed.withColumn("target", F.least(F.col("source_size") * F.lit(float(repeats)), F.col("weight") * F.lit(float(rate))))


def position(words_before: Column) -> Column:
    """The training time (0 to 1) at which so many of a source's words are due: the integral (1 - slope) t + slope t^2 of its weight, inverted.

    What lies beyond the source's target is never due before the end, time 1.
    """
    slope = F.col("slope")
    done = F.when(F.col("target") > 0, F.least(words_before / F.col("target"), F.lit(1.0))).otherwise(F.lit(1.0))
    return F.when(slope == 0, done).otherwise((F.sqrt((1 - slope) * (1 - slope) + 4 * slope * done) - (1 - slope)) / (2 * slope))


def due_by(time: Column) -> Column:
    """The words of a source that its schedule asks for up to a training time, in whole words."""
    slope = F.col("slope")
    return F.floor(F.col("target") * ((1 - slope) * time + slope * time * time) + 0.5)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS, whole: bool = False, key_col: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, taken, position, positions) for every row of `docs`.

    A source's documents stand in the order of md5(id) and are gone through up to `repeats` times. A use of a document lasts from the
    training time at which the words before it are due to the time at which its own last word is: the inverse of the
    source's cumulative demand, whose weight runs linearly from 1 - slope to 1 + slope. `taken` sums the words that the schedule asks
    for in these times, so the source's words sum to its rounded target; a use that starts at the end of training has none. `positions`
    are the times of the uses that take words, `position` the first of them (1 without a use). With `whole`, a use counts in full if at
    least half of its words are due, else not at all; a document without words then has one use.

    Null text has size 0; a null source is a source, the last; repeated rows count each; ties of md5 go by id, then
    size, then a hash of the text. `key_col`, if given, is returned too. Sources are not gathered in a task: their words are summed in 4096 ranges of the hash, then within ranges.
    An empty table gives an empty result; other columns are not read.
    """
    rows = cut(docs.select(F.col(key_col or id_col).alias("key"), F.xxhash64(text_col).alias("text_hash"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")).withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))))
    rows = rows.withColumn("range", F.substring("h", 1, RANGE_DIGITS))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    before = F.coalesce(F.sum("in_range").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = cut(ranges.withColumn("range_start", before))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("in_range").alias("source_size")), weights, repeats)
    r, t = ranges.alias("r"), targets.alias("t")
    starts = r.join(t.hint("merge"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(F.col("r.source").alias("_source"), F.col("range").alias("_range"), "range_start", "source_size", "target", "at")
    placed = rows.join(starts.hint("merge"), rows["source"].eqNullSafe(starts["_source"]) & (rows["range"] == starts["_range"]))
    inner = W.partitionBy("source", "range").orderBy("h", F.col("id").asc_nulls_last(), "size", "text_hash", "key").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("range_start") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    slope = F.element_at(F.array(*[F.lit(x) for x in SLOPES]), (F.col("at") % len(SLOPES) + 1).cast("int"))
    placed = placed.withColumn("slope", slope)

    def use(i: int) -> Column:
        first = F.col("start") + i * F.col("source_size")
        begins, ends = position(first), position(first + F.col("size"))
        words = due_by(ends) - due_by(begins)
        if whole:
            words = F.when(F.col("size") == 0, 0).when(2 * words >= F.col("size"), F.col("size")).otherwise(0)
        counts = (words > 0) | (F.lit(whole and i == 0) & (F.col("size") == 0))
        return F.struct(begins.alias("at"), words.cast("long").alias("words"), counts.alias("counts"))

    placed = placed.withColumn("uses", F.array(*[use(i) for i in range(repeats)]))
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda n, u: n + u["words"])
    positions = F.transform(F.filter("uses", lambda u: u["counts"]), lambda u: u["at"])
    names = [F.col("id").alias(id_col)] + ([F.col("key").alias(key_col)] if key_col not in (None, id_col) else [])
    return placed.select(*names, "source", "size", "source_size", "target", taken.alias("taken"), F.coalesce(F.try_element_at(positions, F.lit(1)), F.lit(1.0)).alias("position"), positions.alias("positions"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus with the columns of `docs`: a row for each use of a document, range-sorted by training position.

    Whole documents only; a document without words takes no room in the mix and is kept once. Each row of a repeated document is
    used as often as its own place in the mix says. Null sources are a source; extra columns are kept whatever their names; an
    empty table stays empty. Very long texts are only counted and carried.
    """
    keyed, key = with_row_key(docs, id_col)
    plan = mix(keyed, id_col, text_col, source_col, whole=True, key_col=key)
    at = fresh(keyed, "at")
    uses = plan.select(key, F.explode("positions").alias(at))
    found = keyed.join(uses.hint("merge"), key)
    return found.repartitionByRange(F.col(at), F.col(key)).sortWithinPartitions(at, key).select(*docs.columns)
