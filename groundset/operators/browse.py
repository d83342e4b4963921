"""Browsing a released set: rows with their boxes and options, facet counts, and a substring filter by trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def blob(*texts: Column) -> Column:
    """The searchable text of a row: its texts in a row, A-Z lowered; null ones are left out."""
    return F.translate(F.concat_ws(" ", *texts), _UPPER, _LOWER)


def browse_rows(items: DataFrame, boxes: DataFrame, options: DataFrame, item: str) -> DataFrame:
    """`items` with `boxes`, an array of (idx, label, corners) in order, and `easy` and `hard`, the options of both multiple-choice variants (item, variant,
    options); empty or null where an item has none. An item's boxes are a value of its row."""
    drawn = boxes.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("idx", "label", "x0", "y0", "x1", "y1"))).alias("boxes"))
    sets = options.groupBy(item).pivot("variant", ["easy", "hard"]).agg(F.first("options"))
    return items.join(drawn.hint("merge"), item, "left").join(sets.hint("merge"), item, "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(drawn.schema["boxes"].dataType)))


def facet_counts(items: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, n): how many items have each value of each facet, in one pass over the grouping sets of single facets; null is a value."""
    named = items.select(*[F.col(f).cast("string").alias(f) for f in facets])
    counted = named.groupingSets([[F.col(f)] for f in facets], *[F.col(f) for f in facets]).agg(F.count("*").alias("n"), *[F.grouping(f).alias(f"_g{i}") for i, f in enumerate(facets)])
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, f in enumerate(facets):
        facet, value = F.when(F.col(f"_g{i}") == 0, F.lit(f)).otherwise(facet), F.when(F.col(f"_g{i}") == 0, F.col(f)).otherwise(value)
    return counted.select(facet.alias("facet"), value.alias("value"), "n")


def _trigrams(text: Column) -> Column:
    points = F.filter(F.split(text, ""), lambda c: c != "")
    pair = lambda a, b: F.concat(a, b)  # noqa: E731  null past the end
    return F.when(F.size(points) >= 3, F.array_distinct(F.zip_with(F.zip_with(points, F.slice(points, 2, F.size(points)), pair), F.slice(points, 3, F.size(points)), pair)))


def search(items: DataFrame, needles: DataFrame, item: str, needle: str, text: str = "blob", most: int = 300) -> DataFrame:
    """(needle, item, rank): for each text of `needles` (needle, text) the first `most` items, by item, whose `text` contains it.

    Items are indexed by the trigrams of their text; a needle meets only the items that hold its rarest one, and these are searched. A
    needle of one or two code points has no trigram and searches every item; an empty or null one finds none.
    """
    index = items.select(item, F.explode(_trigrams(F.col(text))).alias("gram")).where("gram IS NOT NULL AND char_length(gram) = 3")
    sought = needles.select(F.col(needle), F.col(text).alias("_said")).where("_said != ''")
    own = sought.where(F.length("_said") >= 3).select(needle, "_said", F.explode(_trigrams(F.col("_said"))).alias("gram")).where("char_length(gram) = 3")
    held = index.join(own.select("gram").distinct().hint("merge"), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no item holds finds nothing, so it is the rarest
    rarest = own.join(held.hint("merge"), "gram", "left").groupBy(needle, "_said").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select(needle, "_said", F.col("r.gram").alias("gram"))
    met = index.join(rarest.hint("merge"), "gram").select(needle, "_said", item).join(items.select(item, F.col(text).alias("_body")).hint("merge"), item)
    brief = sought.where(F.length("_said") < 3)
    if not brief.isEmpty():
        met = met.unionByName(items.select(item, F.col(text).alias("_body")).crossJoin(brief))  # a stated set of short queries against all items
    found = met.where(F.contains("_body", "_said")).select(needle, item)
    return found.withColumn("rank", F.row_number().over(W.partitionBy(needle).orderBy(item))).where(F.col("rank") <= most)
