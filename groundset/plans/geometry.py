"""Windows over `events` (a user is a video, a value is a sharpness) and boxes made from `lineitem` numbers."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import geometry as G
from ..operators.order import ranked_within
from ..operators.scratch import written
from .registry import query

_GAPS = """g AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS t0, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))::DOUBLE AS t1 FROM events),
i AS (SELECT user_id, event_id, 0.0::DOUBLE AS w0, (t1 - t0) / 3600.0::DOUBLE AS w1 FROM g WHERE t1 IS NOT NULL)"""


def _intervals(t):
    seconds = F.col("ts").cast("timestamp").cast("double")
    g = t.events.withColumn("t0", seconds).withColumn("t1", F.lead("t0").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return g.where("t1 IS NOT NULL").select("user_id", "event_id", F.lit(0.0).alias("w0"), ((F.col("t1") - F.col("t0")) / 3600.0).alias("w1"))


@query(f"""WITH {_GAPS}, e AS (SELECT *, w1 - w0 > 60 AS long, unnest(range(0, CASE WHEN w1 - w0 > 60 THEN ceil((w1 - w0) / 30.0::DOUBLE)::INT ELSE 1 END)) AS "window" FROM i WHERE w1 - w0 >= 1),
p AS (SELECT event_id, "window"::INT AS "window", CASE WHEN long THEN w0 + "window" * 30.0::DOUBLE ELSE w0 END AS a, CASE WHEN long THEN least(w1, w0 + ("window" + 1) * 30.0::DOUBLE) ELSE w1 END AS b, long AS was_long FROM e)
SELECT event_id, "window", round(a, 4) AS w_start, round(b, 4) AS w_end, was_long FROM p WHERE b - a >= 1""")
def force_window(t):
    return G.force_windows(_intervals(t), "w0", "w1").select("event_id", "window", F.round("w_start", 4).alias("w_start"), F.round("w_end", 4).alias("w_end"), "was_long")


@query(f"""WITH {_GAPS}, n AS (SELECT *, least(12, greatest(1, floor((w1 - w0) / 4.0::DOUBLE)::INT)) AS n FROM i), e AS (SELECT *, unnest(range(1, n + 1))::INT AS i FROM n)
SELECT event_id, i, round(w0 + i * (w1 - w0) / (n + 1), 4) AS at FROM e""")
def sample_times(t):
    return G.sample_times(_intervals(t), "w0", "w1").select("event_id", "i", F.round("at", 4).alias("at"))


@query("""SELECT coalesce(CASE WHEN value < 5 THEN 'near_black' WHEN value > 200 THEN 'blown_out' WHEN event_type = 'view' AND value < 20 THEN 'blank_uniform' WHEN value < 30 THEN 'blurry' END, 'kept') AS reason, count(*) AS n FROM events GROUP BY 1""")
def prefilter_reason(t):
    v = F.col("value")
    reason = G.first_reason([("near_black", v < 5), ("blown_out", v > 200), ("blank_uniform", (F.col("event_type") == "view") & (v < 20)), ("blurry", v < 30)])
    return t.events.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT vec_id, label, list_reduce(list_prepend(0::HUGEINT, list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::HUGEINT << i::INT) ELSE 0 END)), lambda s, b: s + b)::UBIGINT AS code FROM embeddings),
g AS (SELECT label, list(vec_id ORDER BY vec_id) AS ids, list(code ORDER BY vec_id) AS codes FROM c GROUP BY 1),
k AS (SELECT label, ids, list_reduce(list_transform(range(1, len(ids) + 1), lambda i: [i]), lambda kept, i: CASE WHEN len(kept) < 6 AND len(list_filter(kept, lambda k: bit_count(xor(codes[k], codes[i[1]])) <= 6)) = 0 THEN list_append(kept, i[1]) ELSE kept END) AS kept FROM g)
SELECT label, ids[unnest(kept)] AS vec_id FROM k""")
def greedy_hamming_dedup(t):
    coded = t.embeddings.select("label", "vec_id", G.sign_code(F.col("embedding")).alias("code"))
    return G.greedy_hamming(coded, "label", "code", ["vec_id"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS rn FROM events),
k AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n_candidates, count(*) FILTER (event_type IN ('view', 'click') AND value >= 30) AS n_ok, coalesce(max(value) FILTER (event_type IN ('view', 'click') AND value >= 30), 0) AS max_score FROM r WHERE rn <= 6 GROUP BY 1, 2)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n_candidates, least(4, n_ok) AS n_kept, max_score, CASE WHEN n_ok > 0 THEN 'keep' ELSE 'drop' END AS verdict FROM k""")
def window_verdict(t):
    e = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    first = e.withColumn("rn", F.row_number().over(W.partitionBy("user_id", "day").orderBy("ts", "event_id"))).where("rn <= 6")
    ok = F.col("event_type").isin("view", "click") & (F.col("value") >= 30)
    r = first.groupBy("user_id", "day").agg(F.count("*").alias("n_candidates"), F.count(F.when(ok, 1)).alias("n_ok"), F.coalesce(F.max(F.when(ok, F.col("value"))), F.lit(0.0)).alias("max_score"))
    return r.select("user_id", "day", "n_candidates", F.least(F.lit(4), "n_ok").alias("n_kept"), "max_score", F.when(F.col("n_ok") > 0, "keep").otherwise("drop").alias("verdict"))


@query("""SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS t_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS t_end, string_agg(DISTINCT event_id::VARCHAR, ',' ORDER BY event_id::VARCHAR) AS items FROM events GROUP BY 1, 2""")
def segments_table(t):
    items = F.array_join(F.array_sort(F.collect_set(F.col("event_id").cast("string"))), ",")
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return t.events.groupBy("user_id", "event_type").agg(fmt(F.min("ts")).alias("t_start"), fmt(F.max("ts")).alias("t_end"), items.alias("items"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS video, regexp_extract(url, '/([a-z]{2})/', 1) AS shot, regexp_extract(url, '/([0-9]+)', 1) AS cand FROM pages""")
def parse_frame_key(t):
    one = lambda p: F.regexp_extract("url", p, 1)
    return t.pages.select("page_id", one("^https?://([^/]+)/").alias("video"), one("/([a-z]{2})/").alias("shot"), one("/([0-9]+)").alias("cand"))


@query("""WITH d AS (SELECT DISTINCT user_id, datediff('day', DATE '1970-01-01', ts::DATE) AS day FROM events), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM d)
SELECT user_id, min(day)::INT AS first, max(day)::INT AS last, count(*) AS n FROM i GROUP BY user_id, island""")
def contiguous_runs(t):
    return G.runs(t.events.select("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day")), "user_id", "day")


_BOX = """l AS (SELECT l_orderkey AS frame, l_returnflag AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS idx, l_quantity AS q, l_discount AS d, l_tax AS x FROM lineitem),
a AS (SELECT frame, label, idx, d * 5 AS x0, x * 5 AS y0, d * 5 + 0.1::DOUBLE + q / 200 AS x1, x * 5 + 0.1::DOUBLE + q / 200 AS y1 FROM l),
b AS (SELECT frame, label, idx, x0 + 0.02::DOUBLE * (idx % 3) AS x0, y0, x1 + 0.02::DOUBLE * (idx % 3) AS x1, y1 FROM a WHERE idx % 5 <> 4)"""


def _boxes(t, tasks=None):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    lines = t.lineitem.repartition(tasks, "l_orderkey") if tasks else t.lineitem
    rows = lines.withColumn("idx", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)) - 1)
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    a = rows.select(F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("label"), "idx", (d * 5).alias("x0"), (x * 5).alias("y0"), (d * 5 + 0.1 + q / 200).alias("x1"), (x * 5 + 0.1 + q / 200).alias("y1"))
    return a, _other(a)


def _other(a):
    """The second source: most boxes of the first, moved."""
    shift = 0.02 * (F.col("idx") % 3)
    return a.where("idx % 5 != 4").select("frame", "label", "idx", (F.col("x0") + shift).alias("x0"), "y0", (F.col("x1") + shift).alias("x1"), "y1")


def _written_boxes(t):
    """Both, numbered and written once, for plans that read them several times; in tasks of a bounded size."""
    a = written(_boxes(t, -(-t.lineitem.count() // G.TASK_BOXES) or 1)[0])
    return a, _other(a)


_IOU = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
_PAIRS = f"""{_BOX}, o AS (SELECT a.frame, a.label, a.idx AS a_idx, b.idx AS b_idx, {_IOU} AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab FROM a JOIN b ON a.frame = b.frame AND a.label = b.label),
p AS (SELECT *, i / (aa + ab - i) AS iou, i / aa AS inside FROM o)"""


@query("""SELECT l_orderkey, l_linenumber, round(least(q, e) / 100, 4) AS x0, round(greatest(q, e) / 100, 4) AS x1 FROM (SELECT l_orderkey, l_linenumber, least(l_quantity * 3, 100.0::DOUBLE) AS q, least(floor(l_extendedprice / 500), 100.0::DOUBLE) AS e FROM lineitem) WHERE abs(q - e) >= 2""")
def box_normalize(t):
    hundred = F.lit(100.0)
    box = G.normalized_box(F.col("l_quantity") * 3, F.lit(0.0), F.floor(F.col("l_extendedprice") / 500).cast("double"), F.lit(50.0), hundred, hundred)
    return t.lineitem.select("l_orderkey", "l_linenumber", box.alias("b")).where("b IS NOT NULL").select("l_orderkey", "l_linenumber", "b.x0", "b.x1")


@query(f"WITH {_PAIRS} SELECT frame, label, a_idx, b_idx, round(iou, 6) AS iou, round(inside, 6) AS inside FROM p WHERE iou > 0")
def box_iou_pairs(t):
    a, b = _boxes(t)
    return G.box_pairs(a, b, ["frame", "label"]).where("iou > 0").select("frame", "label", F.col("a_idx").cast("long").alias("a_idx"), F.col("b_idx").cast("long").alias("b_idx"), F.round("iou", 6).alias("iou"), F.round("inside", 6).alias("inside"))


def _greedy(group: str, prefer: str, where: str, boxes: str = "a") -> str:
    """CTEs of the serial matching: box after box of a group takes the first of its ordered candidates that is free."""
    on = " AND ".join(f"{{x}}.{c} = {{y}}.{c}" for c in group.split(", "))
    return f"""turns AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY idx) AS turn FROM {boxes}),
options AS (SELECT {group}, a_idx AS idx, list({{'b': b_idx, 'iou': iou, 'other': other}} ORDER BY {prefer}, iou DESC, b_idx DESC) AS options FROM {where} WHERE iou >= 0.5 GROUP BY ALL),
greedy AS (
  SELECT DISTINCT {group}, 0::BIGINT AS turn, NULL::BIGINT AS idx, []::BIGINT[] AS used, NULL::STRUCT(b BIGINT, iou DOUBLE, other BOOLEAN) AS took FROM turns
  UNION ALL SELECT {", ".join(f"t.{c}" for c in group.split(", "))}, t.turn, t.idx, CASE WHEN took IS NULL THEN used ELSE list_append(used, took.b) END, list_filter(options, lambda o: NOT list_contains(CASE WHEN took IS NULL THEN used ELSE list_append(used, took.b) END, o.b))[1]
  FROM greedy g JOIN turns t ON {on.format(x="g", y="t")} AND t.turn = g.turn + 1 LEFT JOIN options o ON {on.format(x="o", y="t")} AND o.idx = t.idx),
matched AS (SELECT {group}, idx AS a_idx, took.b AS b_idx, took.iou AS iou, took.other AS other FROM greedy WHERE took IS NOT NULL)"""


_AGREED = f"""WITH RECURSIVE {_PAIRS}, same AS (SELECT frame, label, a_idx::BIGINT AS a_idx, b_idx::BIGINT AS b_idx, iou, false AS other FROM p), {_greedy("frame, label", "other", "same")}"""
_LAYERS = f"""{_AGREED}, layers AS (SELECT frame, label, a_idx, b_idx, iou, 'both' AS found_by FROM matched
  UNION ALL SELECT frame, label, idx, NULL, NULL, 'a' FROM a WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.frame = a.frame AND m.label = a.label AND m.a_idx = a.idx)
  UNION ALL SELECT frame, label, NULL, idx, NULL, 'b' FROM b WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.frame = b.frame AND m.label = b.label AND m.b_idx = b.idx))"""


@query(_AGREED + " SELECT frame, label, a_idx, b_idx, round(iou, 6) AS iou FROM matched")
def box_consensus(t):
    a, b = _written_boxes(t)
    return G.greedy_matches(a, b, "frame", "label").select("frame", "label", "a_idx", "b_idx", F.round("iou", 6).alias("iou"))


@query(_LAYERS + " SELECT frame, label, a_idx, b_idx, found_by FROM layers")
def box_agreement(t):
    a, b = _written_boxes(t)
    return G.agreement(a, b, "frame", "label").select("frame", "label", "a_idx", "b_idx", "found_by")


@query(_LAYERS + """ SELECT label, count(*) FILTER (found_by = 'both') AS n_matched, count(*) FILTER (found_by = 'a') AS a_only, count(*) FILTER (found_by = 'b') AS b_only,
  round(count(*) FILTER (found_by = 'both') / count(*) FILTER (found_by <> 'b'), 6) AS rate_a, round(count(*) FILTER (found_by = 'both') / count(*) FILTER (found_by <> 'a'), 6) AS rate_b FROM layers GROUP BY 1""")
def box_match_rates(t):
    """Shares of each source's boxes that the other has, by the one-to-one matching."""
    a, b = _written_boxes(t)
    return G.match_rates(a, b, "frame", "label")


@query(f"""WITH {_BOX}, v AS (SELECT frame, idx, CASE WHEN idx % 4 = 1 THEN 'delete' WHEN idx % 4 = 2 THEN 'relabel' ELSE 'keep' END AS verdict, CASE WHEN frame % 2 = 0 THEN 'Z' ELSE '?' END AS new_label FROM b)
SELECT a.frame, a.idx, CASE WHEN verdict = 'relabel' AND new_label = 'Z' THEN new_label ELSE label END AS label, coalesce(verdict, 'keep') AS verdict FROM a LEFT JOIN v USING (frame, idx) WHERE coalesce(verdict, 'keep') <> 'delete'""")
def apply_box_review(t):
    a, b = _boxes(t)
    verdict = F.when(F.col("idx") % 4 == 1, "delete").when(F.col("idx") % 4 == 2, "relabel").otherwise("keep")
    v = b.select("frame", "idx", verdict.alias("verdict"), F.when(F.col("frame") % 2 == 0, "Z").otherwise("?").alias("new_label"))
    return G.reviewed(a, v, ["frame", "idx"], "label", F.col("new_label") == "Z").select("frame", F.col("idx").cast("long").alias("idx"), "label", "verdict")


@query(f"WITH {_PAIRS} SELECT frame, a_idx AS idx, iou >= 0.1 AND ab <= 1.2::DOUBLE * aa AS refined FROM p WHERE a_idx = b_idx")
def accept_refined_box(t):
    a, b = _boxes(t)
    p = G.box_pairs(a, b, ["frame", "label"]).where("a_idx = b_idx")
    return p.select("frame", F.col("a_idx").cast("long").alias("idx"), ((F.col("iou") >= 0.1) & (C.box_area("b") <= 1.2 * C.box_area("a"))).alias("refined"))


@query(f"WITH {_BOX} SELECT a.frame, a.idx, CASE WHEN a.idx = 0 THEN 'hand' WHEN b.idx IS NULL THEN 'unchecked' WHEN b.idx % 3 = 2 THEN 'disputed' ELSE 'verified' END AS tier FROM a LEFT JOIN b USING (frame, idx)")
def box_tier(t):
    a, b = _boxes(t)
    j = a.join(b.select("frame", "idx", F.lit(True).alias("seen")).hint("merge"), ["frame", "idx"], "left")
    return j.select("frame", F.col("idx").cast("long").alias("idx"), F.when(F.col("idx") == 0, "hand").when(F.col("seen").isNull(), "unchecked").when(F.col("idx") % 3 == 2, "disputed").otherwise("verified").alias("tier"))


@query(f"""WITH RECURSIVE {_BOX}, r AS (SELECT * REPLACE (CASE WHEN idx % 4 = 1 THEN 'Z' ELSE label END AS label) FROM b),
o AS (SELECT a.frame, a.idx::BIGINT AS a_idx, b.idx::BIGINT AS b_idx, a.label <> b.label AS other, {_IOU} AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab FROM a JOIN r b ON a.frame = b.frame),
near AS (SELECT *, i / (aa + ab - i) AS iou FROM o), {_greedy("frame", "other", "near")},
fates AS (SELECT (a.idx % 3)::VARCHAR AS tier, m.iou, CASE WHEN m.other IS NULL THEN 'deleted' WHEN m.other THEN 'relabelled' ELSE 'kept' END AS fate FROM a LEFT JOIN matched m ON m.frame = a.frame AND m.a_idx = a.idx)
SELECT tier, count(*) AS n, count(*) FILTER (fate <> 'deleted') AS n_kept, count(*) FILTER (fate = 'relabelled') AS n_relabelled, round(avg((fate = 'deleted')::INT), 6) AS deletion_rate, round(count(*) FILTER (iou >= 0.99) / nullif(count(*) FILTER (fate <> 'deleted'), 0), 6) AS unmoved FROM fates GROUP BY ROLLUP (tier)""")
def proposal_survival(t):
    a, b = _written_boxes(t)
    reviewed = b.withColumn("label", F.when(F.col("idx") % 4 == 1, "Z").otherwise(F.col("label")))
    fates = G.survival(a.withColumn("tier", (F.col("idx") % 3).cast("string")), reviewed, "frame", "label")
    return G.survival_report(fates, "tier")


@query("""SELECT frame, idx, label, round(x0, 4) AS x0, round(x1, 4) AS x1 FROM (SELECT l_orderkey AS frame, l_linenumber AS idx, l_returnflag AS label, l_quantity * 4 AS x, l_discount * 1000 AS w, x / 640 AS x0, (x + w) / 640 AS x1 FROM lineitem) WHERE frame IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def coco_import(t):
    """Pixel boxes with category ids back to labels and unit corners, for the frames that are shipped."""
    pixels = t.lineitem.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("idx"), F.ascii("l_returnflag").alias("category_id"), (F.col("l_quantity") * 4).alias("x"), F.lit(0.0).alias("y"), (F.col("l_discount") * 1000).alias("w"), F.lit(48.0).alias("h"))
    categories = t.lineitem.select(F.ascii("l_returnflag").alias("category_id"), F.col("l_returnflag").alias("label")).distinct()
    shipped = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("image_id"))
    boxes = G.coco_import(pixels, categories, shipped, 640, 480)
    return boxes.select(F.col("image_id").alias("frame"), "idx", "label", "x0", "x1")


@query(f"WITH {_BOX} SELECT frame AS image_id, dense_rank() OVER (ORDER BY label) AS category_id, idx, round(x0 * 640, 2) AS x, round(y0 * 480, 2) AS y, round((x1 - x0) * 640, 2) AS w, round((y1 - y0) * 480, 2) AS h FROM a")
def coco_tables(t):
    a, _ = _boxes(t)
    labels = a.select("label").distinct()
    ids = labels.withColumn("category_id", F.row_number().over(W.orderBy("label")))  # a row for each label
    px = [F.round(v, 2).alias(k) for k, v in (("x", F.col("x0") * 640), ("y", F.col("y0") * 480), ("w", (F.col("x1") - F.col("x0")) * 640), ("h", (F.col("y1") - F.col("y0")) * 480))]
    return a.join(ids, "label").select(F.col("frame").alias("image_id"), F.col("category_id").cast("long").alias("category_id"), F.col("idx").cast("long").alias("idx"), *px)


@query(f"WITH {_PAIRS} SELECT a.frame, a.idx, round(max(p.inside), 6) AS best, max(p.inside) >= 0.5 AS ok FROM a LEFT JOIN p ON p.frame = a.frame AND p.label = a.label AND p.a_idx = a.idx GROUP BY 1, 2")
def region_check(t):
    a, b = _written_boxes(t)
    j = G.best_inside(a, b, ["frame", "label"])
    return j.select("frame", F.col("idx").cast("long").alias("idx"), F.round("best", 6).alias("best"), (F.col("best") >= 0.5).alias("ok"))


@query(f"""WITH {_BOX} SELECT frame, idx, round(CASE WHEN y1 < 0.15 OR y0 > 0.85 THEN 0.0 ELSE greatest(x0 - 0.03::DOUBLE, 0.0) END, 4) AS x0, round(greatest(y0 - 0.03::DOUBLE, 0.0), 4) AS y0, round(CASE WHEN y1 < 0.15 OR y0 > 0.85 THEN 1.0 ELSE least(x1 + 0.03::DOUBLE, 1.0) END, 4) AS x1, round(least(y1 + 0.03::DOUBLE, 1.0), 4) AS y1 FROM a""")
def expand_mask_box(t):
    a, _ = _boxes(t)
    return a.select("frame", F.col("idx").cast("long").alias("idx"), G.expand_mask(F.col("y0"), F.col("y1"), F.col("x0"), F.col("x1")).alias("m")).select("frame", "idx", "m.*")


@query(f"""WITH {_BOX}, u AS (SELECT *, 'reviewed' AS source, 0 AS o FROM b UNION ALL SELECT *, 'recovered', 1 FROM a WHERE idx % 5 = 4) SELECT frame, label, source, row_number() OVER (PARTITION BY frame ORDER BY o, idx) - 1 AS position FROM u""")
def merge_box_layers(t):
    a, b = _boxes(t)
    u = b.withColumns({"source": F.lit("reviewed"), "o": F.lit(0)}).unionByName(a.where("idx % 5 = 4").withColumns({"source": F.lit("recovered"), "o": F.lit(1)}))
    return u.select("frame", "label", "source", (F.row_number().over(W.partitionBy("frame").orderBy("o", "idx")) - 1).cast("long").alias("position"))


@query("""WITH s AS (SELECT c_custkey, c_mktsegment, ('0x' || substr(md5('split' || c_custkey), 1, 8))::BIGINT AS h FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY h, c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM s)
SELECT c_custkey, CASE WHEN rn <= floor(n * 0.2) AND n > 1 THEN 'val' ELSE 'train' END AS split FROM r""")
def grouped_split(t):
    h = C.md5_int(F.concat(F.lit("split"), F.col("c_custkey").cast("string")))
    n = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    r = ranked_within(t.customer.select("c_custkey", "c_mktsegment", h.alias("h")), "c_mktsegment", "h", "c_custkey").join(n.hint("merge"), "c_mktsegment")
    return r.select("c_custkey", F.when((F.col("rank") <= F.floor(F.col("n") * 0.2)) & (F.col("n") > 1), "val").otherwise("train").alias("split"))


#: Orders as frames, their parts' priorities and rare customers as classes: a class of one frame falls into validation now and then.
_CLASSED = "c AS (SELECT o_orderkey AS frame, o_orderpriority AS label FROM orders UNION SELECT o_orderkey, 'rare ' || o_custkey FROM orders WHERE o_custkey % 40 = 1)"


@query(f"""WITH RECURSIVE {_CLASSED}, f AS (SELECT frame, row_number() OVER (ORDER BY ('0x' || substr(md5('split' || frame), 1, 8))::BIGINT, frame) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT frame FROM c)),
d AS (SELECT frame, idx, idx < floor(0.2::DOUBLE * n) AS val FROM f), l AS (SELECT label, arg_min(frame, idx) AS frame, row_number() OVER (ORDER BY label) AS nr FROM c JOIN d USING (frame) GROUP BY 1 HAVING bool_and(val)),
m AS (SELECT 0::BIGINT AS nr, []::BIGINT[] AS moved, []::VARCHAR[] AS served UNION ALL
  SELECT l.nr, CASE WHEN list_contains(served, l.label) THEN moved ELSE list_append(moved, l.frame) END, CASE WHEN list_contains(served, l.label) THEN served ELSE list_concat(served, has) END FROM m JOIN l ON l.nr = m.nr + 1 JOIN (SELECT frame, list(label) AS has FROM c GROUP BY 1) h ON h.frame = l.frame)
SELECT frame, CASE WHEN val AND NOT list_contains((SELECT arg_max(moved, nr) FROM m), frame) THEN 'val' ELSE 'train' END AS split FROM d""")
def split_with_repair(t):
    own = t.orders.select(F.col("o_orderkey").alias("frame"), F.col("o_orderpriority").alias("label"))
    rare = t.orders.where("o_custkey % 40 = 1").select(F.col("o_orderkey").alias("frame"), F.concat(F.lit("rare "), F.col("o_custkey").cast("string")).alias("label"))
    return G.split_with_repair(own.union(rare), "frame", "label")


@query(f"""WITH {_BOX} SELECT frame, idx, printf('%.6f %.6f %.6f %.6f', (x0 + x1) / 2 * 640 / 640, (y0 + y1) / 2 * 480 / 480, (x1 - x0) * 640 / 640, (y1 - y0) * 480 / 480) AS line FROM a""")
def centre_labels(t):
    """Lines of a detector's training labels."""
    a, _ = _boxes(t)
    w, h = F.lit(640.0), F.lit(480.0)
    return a.select("frame", F.col("idx").cast("long").alias("idx"), G.centre_labels(F.col("x0") * w, F.col("y0") * h, (F.col("x1") - F.col("x0")) * w, (F.col("y1") - F.col("y0")) * h, w, h).alias("line"))


@query(f"""WITH {_BOX}, v AS (SELECT frame, idx, CASE WHEN idx % 4 = 1 THEN 'delete' WHEN idx % 4 = 2 THEN 'relabel' ELSE 'keep' END AS verdict FROM b), j AS (SELECT a.label, CASE WHEN a.idx = 0 THEN 'hand' ELSE 'drawn' END AS tier, coalesce(verdict, 'keep') AS verdict FROM a LEFT JOIN v USING (frame, idx))
SELECT label, tier, count(*) AS n, count(*) FILTER (verdict = 'keep') AS n_kept, count(*) FILTER (verdict = 'relabel') AS n_relabelled, count(*) FILTER (verdict = 'delete') AS n_deleted, round(count(*) FILTER (verdict = 'relabel') / count(*), 6) AS relabel_rate, round(count(*) FILTER (verdict = 'delete') / count(*), 6) AS deletion_rate FROM j GROUP BY 1, 2""")
def box_review_rates(t):
    a, b = _boxes(t)
    v = b.select("frame", "idx", F.when(F.col("idx") % 4 == 1, "delete").when(F.col("idx") % 4 == 2, "relabel").otherwise("keep").alias("verdict"))
    return G.review_rates(a.withColumn("tier", F.when(F.col("idx") == 0, "hand").otherwise("drawn")), v, ["frame", "idx"], ["label", "tier"])


@query(f"WITH {_BOX} SELECT frame, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.frame = a.frame AND b.label = a.label AND b.idx % 2 = 0) GROUP BY 1")
def missed_label_requests(t):
    a, b = _boxes(t)
    return G.missed_labels(a, b.where("idx % 2 = 0"), "frame", "label").withColumn("labels", F.array_join("labels", ","))
