"""Time windows, candidate selection and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import md5_int
from .order import indexed
from .scratch import written


def force_windows(df: DataFrame, start: str, end: str, most: float = 60.0, step: float = 30.0, least: float = 1.0) -> DataFrame:
    """Intervals of at least `least` seconds; those above `most` are cut every `step`, a tail below `least` is dropped."""
    d = F.col(end) - F.col(start)
    long = d > most
    n = F.when(long, F.ceil(d / step)).otherwise(1)
    each = df.where(d >= least).withColumn("_long", long).withColumn("window", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    lo = F.when(F.col("_long"), F.col(start) + F.col("window") * step).otherwise(F.col(start))
    hi = F.when(F.col("_long"), F.least(F.col(end), F.col(start) + (F.col("window") + 1) * step)).otherwise(F.col(end))
    return each.withColumns({"w_start": lo, "w_end": hi, "was_long": F.col("_long")}).where(F.col("w_end") - F.col("w_start") >= least).drop("_long")


def sample_times(df: DataFrame, start: str, end: str, most: int = 12, every: float = 4.0) -> DataFrame:
    """Evenly spaced inner points of each interval: one for each `every` seconds, 1 to `most`."""
    d = F.col(end) - F.col(start)
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(d / every).cast("int")))
    return df.withColumn("n_samples", n).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n_samples")))).withColumn("at", F.col(start) + F.col("i") * d / (F.col("n_samples") + 1))


def first_reason(tests: list[tuple[str, Column]]) -> Column:
    """Name of the first test that holds, null if none does."""
    out = F.when(tests[0][1], tests[0][0])
    for name, hit in tests[1:]:
        out = out.when(hit, name)
    return out


def sign_code(vec: Column) -> Column:
    """The signs of the first 64 components as one long."""
    bits = F.transform(F.slice(vec, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def greedy_hamming(df: DataFrame, group: str, code: str, order: list[str], radius: int = 6, most: int = 6) -> DataFrame:
    """In each group, rows in order that differ by over `radius` bits from every kept row, until `most` are kept.

    No group is gathered: each of `most` rounds is a grouped minimum over the rows that are far from all kept ones, and only
    kept rows, `most` for a group, are carried along.
    """
    item = F.struct(*order, F.col(code).alias("_code"))
    empty = F.array().cast(f"array<struct<{', '.join(f'{c}:{dict(df.dtypes)[c]}' for c in order)}, _code:bigint>>")
    rows = df.select(F.col(group).alias("_group"), item.alias("_item"))
    kept = rows.groupBy("_group").agg(F.array(F.min("_item")).cast(df.select(empty.alias("x")).schema["x"].dataType).alias("_kept"))
    for _ in range(most - 1):
        far = F.forall("_kept", lambda k: F.bit_count(k["_code"].bitwiseXOR(F.col("_item._code"))) > radius)
        j = rows.join(kept.hint("merge"), "_group").groupBy("_group").agg(F.first("_kept").alias("_kept"), F.min(F.when(far, F.col("_item"))).alias("_next"))
        kept = j.select("_group", F.when(F.col("_next").isNull(), F.col("_kept")).otherwise(F.concat("_kept", F.array("_next"))).alias("_kept"))
    return kept.select(F.col("_group").alias(group), F.explode("_kept").alias("r")).select(group, *[F.col(f"r.{c}") for c in order])


def runs(df: DataFrame, group: str, at: str) -> DataFrame:
    """(group, first, last, n) of each run of consecutive numbers."""
    rows = df.select(group, at).distinct()
    island = F.col(at) - F.row_number().over(W.partitionBy(group).orderBy(at))
    return rows.withColumn("_island", island).groupBy(group, "_island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_island")


def normalized_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, least: float = 2.0) -> Column:
    """Corners clamped, ordered, scaled to 0..1 and rounded to 4 digits; null if a side is under `least` pixels."""
    clamp = lambda v, m: F.least(F.greatest(v, F.lit(0.0)), m)
    a, b, c, d = clamp(x0, width), clamp(y0, height), clamp(x1, width), clamp(y1, height)
    lo_x, hi_x, lo_y, hi_y = F.least(a, c), F.greatest(a, c), F.least(b, d), F.greatest(b, d)
    box = F.struct(*[F.round(v / m, 4).alias(k) for k, v, m in (("x0", lo_x, width), ("y0", lo_y, height), ("x1", hi_x, width), ("y1", hi_y, height))])
    return F.when((hi_x - lo_x >= least) & (hi_y - lo_y >= least), box)


def box_pairs(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """All pairs of boxes of one frame and label, with iou and containment; columns idx, x0, y0, x1, y1 on both sides."""
    side = lambda df, s: df.select(*on, *[F.col(c).alias(f"{s}_{c}") for c in ("idx", "x0", "y0", "x1", "y1")])
    met = side(a, "a").join(side(b, "b").hint("merge"), on)
    return met.withColumns({"iou": C.iou("a", "b"), "inside": C.containment("a", "b")})


#: Pairs of a group that are matched in one row; larger groups are matched in rounds.
ROW_PAIRS = 1 << 12


def one_to_one(pairs: DataFrame, group: list[str], choice: Column) -> DataFrame:
    """`pairs` (group, a_idx, b_idx) that match if each a in the order of a_idx takes, of its b that are free, the least by `choice`. With `choice` as a column.

    A group of at most ROW_PAIRS pairs is matched in one row. A larger one is never gathered: in rounds every a offers to its best b, each b holds the
    earliest a that has offered, and its pairs with later ones go; when all offers are held they are the matches. All b
    rank the a alike, so this stable matching is the one that the serial order gives.
    """
    rows = pairs.select(*group, "a_idx", "b_idx", choice.alias("choice"))
    pair = F.struct("a_idx", "choice", "b_idx")
    none = F.array().cast(rows.select(F.array(pair).alias("x")).schema["x"].dataType)

    def step(kept, p):
        clash = F.exists(kept, lambda k: (k["a_idx"] == p["a_idx"]) | (k["b_idx"] == p["b_idx"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(p)))

    # pairs are counted, gathered and matched where their join leaves them, sorted by group; a large group leaves its number alone
    counted = rows.withColumn("_n", F.count("*").over(W.partitionBy(*group)))
    gathered = counted.groupBy(*group).agg(F.max("_n").alias("_n"), F.array_sort(F.collect_list(F.when(F.col("_n") <= ROW_PAIRS, pair))).alias("_pairs"))
    found = written(gathered.select(*group, "_n", F.explode_outer(F.aggregate("_pairs", none, step)).alias("m")))
    matched = found.where("m IS NOT NULL").select(*group, "m.a_idx", "m.b_idx", "m.choice")
    large = found.where(F.col("_n") > ROW_PAIRS).select(*group)
    if large.isEmpty():
        return matched
    alive = written(rows.join(large.hint("merge"), group, "left_semi"))
    while True:
        offers = alive.groupBy(*group, "a_idx").agg(F.min(F.struct("choice", "b_idx")).alias("_best")).select(*group, "a_idx", "_best.b_idx", "_best.choice")
        held = written(offers.groupBy(*group, "b_idx").agg(F.min("a_idx").alias("_held"), F.count("*").alias("_offers")))
        if held.where("_offers > 1").isEmpty():
            return matched.unionByName(offers)
        alive = written(alive.join(held.hint("merge"), [*group, "b_idx"], "left").where("_held IS NULL OR a_idx <= _held").select(*alive.columns))


def greedy_matches(a: DataFrame, b: DataFrame, frame: str, label: str, least: float = 0.5) -> DataFrame:
    """One-to-one: each box of `a` in order takes the best free box of `b` in its frame and label with iou of `least` or more; of equals the last."""
    pairs = box_pairs(a, b, [frame, label]).where(F.col("iou") >= least)
    found = one_to_one(pairs, [frame, label], F.struct((-F.col("iou")).alias("less"), (-F.col("b_idx")).alias("back")))
    return found.select(frame, label, "a_idx", "b_idx", (-F.col("choice.less")).alias("iou"))


def agreement(a: DataFrame, b: DataFrame, frame: str, label: str, least: float = 0.5) -> DataFrame:
    """(frame, label, a_idx, b_idx, iou, found_by): the matched boxes of two sources, then those that only `a` or only `b` has.

    The matches are used three times and matched once.
    """
    met = written(greedy_matches(a, b, frame, label, least))
    one = lambda df, s: df.select(frame, label, F.col("idx").alias(f"{s}_idx")).join(met.select(frame, label, f"{s}_idx").hint("merge"), [frame, label, f"{s}_idx"], "left_anti")
    both = met.withColumn("found_by", F.lit("both"))
    return both.unionByName(one(a, "a").withColumn("found_by", F.lit("a")), allowMissingColumns=True).unionByName(one(b, "b").withColumn("found_by", F.lit("b")), allowMissingColumns=True)


def agreement_rates(found: DataFrame, by: list[str]) -> DataFrame:
    """Per group of `agreement`: boxes of both sources, of one only, and the shares of each source's boxes that the other has."""
    n = lambda s: F.count(F.when(F.col("found_by") == s, 1))
    return _with_rates(found.groupBy(*by).agg(n("both").alias("n_matched"), n("a").alias("a_only"), n("b").alias("b_only")))


def _with_rates(r: DataFrame) -> DataFrame:
    share = lambda only: F.round(F.try_divide(F.col("n_matched"), F.col("n_matched") + F.col(only)), 6)
    return r.withColumns({"rate_a": share("a_only"), "rate_b": share("b_only")})


def match_rates(a: DataFrame, b: DataFrame, frame: str, label: str, least: float = 0.5) -> DataFrame:
    """`agreement_rates` per label. Boxes are only counted: those of one source alone are its boxes less the matched ones, so no box meets its match again."""
    met = greedy_matches(a, b, frame, label, least)
    one = lambda df, s: df.select(label, F.lit(s).alias("_of")).groupBy(label, "_of").agg(F.count("*").alias("_n"))
    n = lambda s: F.coalesce(F.sum(F.when(F.col("_of") == s, F.col("_n"))), F.lit(0))
    every = one(a, "a").unionByName(one(b, "b")).unionByName(one(met, "both"))
    r = every.groupBy(label).agg(n("both").alias("n_matched"), (n("a") - n("both")).alias("a_only"), (n("b") - n("both")).alias("b_only"))
    return _with_rates(r)


#: Boxes of both sources that one task compares, about.
TASK_BOXES = 1 << 18


def best_inside(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """(on, idx, best): for every box of `a`, the largest share of it that lies inside a box of `b` of the same `on`; null if there is none.

    Tasks grow in number with the boxes, not in size, and the maximum is taken where the join leaves its rows.
    """
    tasks = -(-(a.count() + b.count()) // TASK_BOXES) or 1
    side = lambda df, s: df.select(*on, *[F.col(c).alias(f"{s}_{c}") for c in ("idx", "x0", "y0", "x1", "y1")]).repartition(tasks, *on)
    met = side(a, "a").join(side(b, "b").hint("merge"), on, "left")
    inside = F.when(F.col("b_idx").isNotNull(), C.containment("a", "b"))
    return met.groupBy(*on, F.col("a_idx").alias("idx")).agg(F.max(inside).alias("best"))


def reviewed(boxes: DataFrame, verdicts: DataFrame, on: list[str], label: str, valid: Column) -> DataFrame:
    """Boxes after review: deleted ones gone, relabelled ones with a valid new label, others kept."""
    j = boxes.join(verdicts.hint("merge"), on, "left").withColumn("verdict", F.coalesce("verdict", F.lit("keep")))
    new = F.when((F.col("verdict") == "relabel") & valid, F.col("new_label")).otherwise(F.col(label))
    return j.where("verdict != 'delete'").withColumn(label, new)


def expand_mask(y0: Column, y1: Column, x0: Column, x1: Column, edge: float = 0.15, pad: float = 0.03) -> Column:
    """A caption's mask: full width if it lies at the top or bottom, else padded and clamped."""
    band = (y1 < edge) | (y0 > 1 - edge)
    box = [(F.when(band, 0.0).otherwise(F.greatest(x0 - pad, F.lit(0.0))), "x0"), (F.greatest(y0 - pad, F.lit(0.0)), "y0"), (F.when(band, 1.0).otherwise(F.least(x1 + pad, F.lit(1.0))), "x1"), (F.least(y1 + pad, F.lit(1.0)), "y1")]
    return F.struct(*[F.round(v, 4).alias(k) for v, k in box])


def survival(proposals: DataFrame, reviewed: DataFrame, frame: str, label: str, least: float = 0.5) -> DataFrame:
    """`proposals` (frame, label, idx, corners, other columns) with `fate` (kept, relabelled, deleted) and `iou`.

    In the order of idx, each proposal takes the best free reviewed box of its own label with iou of `least` or more, else the best
    of another label, else it counts as deleted; of equal boxes the one with the larger idx.
    """
    side = lambda df, s: df.select(frame, F.col(label).alias(f"{s}_{label}"), *[F.col(c).alias(f"{s}_{c}") for c in ("idx", "x0", "y0", "x1", "y1")])
    met = side(proposals, "a").join(side(reviewed, "b").hint("merge"), frame).withColumn("iou", C.iou("a", "b")).where(F.col("iou") >= least)
    choice = F.struct((F.col(f"a_{label}") != F.col(f"b_{label}")).alias("other"), (-F.col("iou")).alias("less"), (-F.col("b_idx")).alias("back"))
    matched = one_to_one(met, [frame], choice)
    found = matched.select(frame, F.col("a_idx").alias("idx"), F.when(F.col("choice.other"), "relabelled").otherwise("kept").alias("_fate"), (-F.col("choice.less")).alias("iou"))
    return proposals.join(found.hint("merge"), [frame, "idx"], "left").withColumn("fate", F.coalesce("_fate", F.lit("deleted"))).drop("_fate")


def survival_report(fates: DataFrame, by: str) -> DataFrame:
    """Per group and over all (null): proposals, survivors, relabelled ones, deletion rate, and the share of survivors at iou 0.99 or more."""
    n = lambda c: F.count(F.when(c, 1))
    gone, moved = F.col("fate") == "deleted", F.col("fate") == "relabelled"
    r = fates.rollup(by).agg(F.count("*").alias("n"), n(~gone).alias("n_kept"), n(moved).alias("n_relabelled"), F.round(F.avg(gone.cast("int")), 6).alias("deletion_rate"), n(F.col("iou") >= 0.99).alias("_same"))
    return r.withColumn("unmoved", F.round(F.try_divide("_same", "n_kept"), 6)).drop("_same")


def coco_import(annotations: DataFrame, categories: DataFrame, shipped: DataFrame, width: float, height: float) -> DataFrame:
    """Annotations (image_id, idx, category_id, x, y, w, h in pixels) of shipped images as labels and corners in 0..1, rounded to 4 digits."""
    own = annotations.join(shipped.select("image_id").hint("merge"), "image_id", "left_semi").join(categories.hint("shuffle_hash"), "category_id")
    at = lambda v, m: F.round(v / m, 4)
    corners = [at(F.col("x"), width).alias("x0"), at(F.col("y"), height).alias("y0"), at(F.col("x") + F.col("w"), width).alias("x1"), at(F.col("y") + F.col("h"), height).alias("y1")]
    return own.select("image_id", "idx", "label", *corners)


def split_with_repair(boxes: DataFrame, frame: str, label: str, share: float = 0.2, salt: str = "split") -> DataFrame:
    """(frame, split): `share` of the frames, drawn by md5, go to validation; a class without a training frame then moves its first validation frame back.

    Classes are looked at in order, and one that an earlier move has served moves nothing. Frames are numbered by range partitions; what is
    folded in one row is a frame and its classes for each class without a training frame.
    """
    labels = boxes.select(frame, label).distinct()
    h = md5_int(F.concat(F.lit(salt), F.col(frame).cast("string")))
    frames = indexed(labels.select(frame).distinct().withColumn("_h", h), "_h", frame)
    n = F.floor(F.lit(share) * F.lit(frames.count()))
    drawn = frames.withColumn("_val", F.col("idx") < n)
    held = labels.join(drawn.hint("merge"), frame)
    lacking = held.groupBy(label).agg(F.bool_and("_val").alias("_none"), F.min(F.struct("idx", frame)).alias("_first")).where("_none").select(F.col(label).alias("_class"), F.col(f"_first.{frame}").alias(frame))
    classes = labels.join(lacking.select(frame).distinct().hint("merge"), frame, "left_semi").groupBy(frame).agg(F.collect_set(label).alias("_has"))
    rows = F.array_sort(F.collect_list(F.struct("_class", F.col(frame).alias("f"), "_has")))

    def step(moved, c):
        served = F.exists(moved, lambda m: F.array_contains(m["_has"], c["_class"]))
        return F.when(served, moved).otherwise(F.concat(moved, F.array(c)))

    listed = lacking.join(classes.hint("merge"), frame).agg(rows.alias("_rows"))
    none = F.filter("_rows", lambda r: F.lit(False))
    back = listed.select(F.explode(F.aggregate("_rows", none, step)).alias("m")).select(F.col("m.f").alias(frame), F.lit(True).alias("_back"))
    told = drawn.join(back.hint("merge"), frame, "left")
    return told.select(frame, F.when(F.col("_val") & F.col("_back").isNull(), "val").otherwise("train").alias("split"))


def centre_labels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A pixel box as `cx cy w h` in shares of the image, six digits each."""
    return F.concat_ws(" ", *[F.format_string("%.6f", v) for v in ((x + w / 2) / width, (y + h / 2) / height, w / width, h / height)])


def review_rates(boxes: DataFrame, verdicts: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Per group of boxes: how many were kept, relabelled and deleted (no verdict: kept), and the shares of the last two."""
    j = boxes.join(verdicts.select(*on, "verdict").hint("merge"), on, "left").withColumn("_v", F.coalesce("verdict", F.lit("keep")))
    n = lambda v: F.count(F.when(F.col("_v") == v, 1))
    r = j.groupBy(*by).agg(F.count("*").alias("n"), n("keep").alias("n_kept"), n("relabel").alias("n_relabelled"), n("delete").alias("n_deleted"))
    return r.withColumns({"relabel_rate": F.round(F.col("n_relabelled") / F.col("n"), 6), "deletion_rate": F.round(F.col("n_deleted") / F.col("n"), 6)})


def missed_labels(wanted: DataFrame, boxes: DataFrame, frame: str, label: str) -> DataFrame:
    """(frame, labels): the sorted labels that each frame should have and no box of it has; the next request list. Frames that lack none have no row."""
    lacking = wanted.select(frame, label).distinct().join(boxes.select(frame, label).distinct().hint("merge"), [frame, label], "left_anti")
    return lacking.groupBy(frame).agg(F.array_sort(F.collect_set(label)).alias("labels"))  # a frame has as many labels as there are classes at most
