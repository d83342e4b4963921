"""Samples, blinding and control inputs."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import sample as P
from ..operators.order import ranked_within
from .registry import query

_ALLOC = """n AS (SELECT c_mktsegment, count(*) AS n, c_mktsegment = 'MACHINERY' AS whole FROM customer GROUP BY 1), f AS (SELECT coalesce(sum(n) FILTER (whole), 0) AS whole_n, sum(n) FILTER (NOT whole) AS rest FROM n),
b AS (SELECT n.*, 900 - whole_n AS left_n, CASE WHEN whole THEN n ELSE round_even((900 - whole_n) * n / rest::DOUBLE, 0)::BIGINT END AS take FROM n, f),
a AS (SELECT c_mktsegment, n, (take + CASE WHEN NOT whole AND row_number() OVER (PARTITION BY whole ORDER BY n DESC, c_mktsegment) = 1 THEN left_n - sum(take) FILTER (NOT whole) OVER () ELSE 0 END)::BIGINT AS take FROM b)"""


def _takes(t):
    return P.allocate(t.customer, "c_mktsegment", 900, ("MACHINERY",))


@query(f"WITH {_ALLOC} SELECT * FROM a WHERE (SELECT count(*) FROM customer) >= 900")
def stratified_alloc(t):
    return _takes(t)


_WITHIN = f"""WITH RECURSIVE {_ALLOC}, i AS (SELECT c_mktsegment, 'v' || c_nationkey % 4 AS verdict, count(*) AS n FROM customer GROUP BY 1, 2),
g AS (SELECT c_mktsegment, any_value(a.take) AS k, sum(i.n)::BIGINT AS total, list(i.n ORDER BY verdict) AS ns, list(verdict ORDER BY verdict) AS names FROM i JOIN a USING (c_mktsegment) GROUP BY 1),
r AS (SELECT c_mktsegment, k, ns, names, CASE WHEN k >= total THEN ns ELSE list_transform(ns, lambda n: least(n, greatest(1, round_even(k * n / total::DOUBLE, 0)::BIGINT))) END AS alloc FROM g
UNION ALL SELECT c_mktsegment, k, ns, names, CASE WHEN list_sum(alloc) > k THEN list_transform(alloc, lambda x, i: x - CASE WHEN i = list_position(alloc, list_max(alloc)) THEN 1 ELSE 0 END) ELSE list_transform(alloc, lambda x, i: x + CASE WHEN i = list_position(room, list_max(room)) THEN 1 ELSE 0 END) END
FROM (SELECT *, list_transform(ns, lambda n, i: n - alloc[i]) AS room FROM r WHERE list_sum(alloc) <> least(k, list_sum(ns)))),
w AS (SELECT c_mktsegment, unnest(names) AS verdict, unnest(ns) AS n, unnest(alloc)::BIGINT AS take FROM r WHERE list_sum(alloc) = least(k, list_sum(ns)))"""


def _verdicts(t):
    return t.customer.select("c_custkey", "c_mktsegment", F.concat(F.lit("v"), (F.col("c_nationkey") % 4).cast("string")).alias("verdict"))


@query(_WITHIN + " SELECT * FROM w")
def allocation_within(t):
    return P.allocate_within(_verdicts(t), "c_mktsegment", "verdict", _takes(t))


@query(_WITHIN + """, p AS (SELECT c_custkey, c_mktsegment, 'v' || c_nationkey % 4 AS verdict, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey % 4 ORDER BY ('0x' || substr(md5('pick' || c_custkey), 1, 8))::BIGINT, c_custkey) AS rn FROM customer)
SELECT c_custkey, c_mktsegment, verdict FROM p JOIN w USING (c_mktsegment, verdict) WHERE rn <= take""")
def stratified_pick(t):
    both = F.concat_ws("/", "c_mktsegment", "verdict")
    takes = P.allocate_within(_verdicts(t), "c_mktsegment", "verdict", _takes(t)).select(both.alias("stratum"), "take")
    return P.pick(_verdicts(t).withColumn("stratum", both), "stratum", takes, "c_custkey", "pick").select("c_custkey", "c_mktsegment", "verdict")


@query("""WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS round, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_orderkey, round FROM r ORDER BY round, n DESC, o_custkey LIMIT 500""")
def round_robin_sample(t):
    return P.round_robin(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 500).select("o_orderkey", F.col("round").cast("long").alias("round"))


@query("""SELECT conv_id, CASE WHEN ('0x' || substr(md5('blind' || conv_id), 1, 8))::BIGINT % 2 = 0 THEN 'A' ELSE 'B' END AS slot FROM (SELECT DISTINCT conv_id FROM conversations)""")
def blind_pairs(t):
    return t.conversations.select("conv_id").distinct().select("conv_id", F.when(P.draw("blind", "conv_id") % 2 == 0, "A").otherwise("B").alias("slot"))


@query("""SELECT sha256('salt' || role || conv_id || '#' || turn) AS rec_id, length(text) AS n_chars FROM conversations""")
def blind_pool(t):
    key = F.concat(F.lit("salt"), "role", F.col("conv_id").cast("string"), F.lit("#"), F.col("turn").cast("string"))
    return t.conversations.select(F.sha2(key, 256).alias("rec_id"), F.length("text").cast("long").alias("n_chars"))


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, ('0x' || substr(md5('swap' || conv_id || '#' || turn), 1, 8))::BIGINT, conv_id || '#' || turn) - 1 AS rank, count(*) OVER () AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations),
m AS (SELECT *, max(c) OVER () AS most FROM r) SELECT conv_id, turn, rank, (rank + most) % n AS donor_rank FROM m""")
def frameswap_control(t):
    c = t.conversations.select("conv_id", "turn", F.concat(F.col("conv_id").cast("string"), F.lit("#"), F.col("turn").cast("string")).alias("key"))
    return P.rotated(c, "conv_id", "key", "swap").select("conv_id", "turn", F.col("rank").cast("long").alias("rank"), F.col("donor_rank").cast("long").alias("donor_rank"))


@query("""SELECT conv_id, min(turn) AS first_turn, count(*) > 1 AS multi FROM conversations GROUP BY 1""")
def first_only_control(t):
    return t.conversations.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), (F.count("*") > 1).alias("multi"))


@query("""SELECT conv_id, turn, CASE role WHEN 'user' THEN 'open' WHEN 'assistant' THEN 'refusal' ELSE 'other' END AS task, coalesce(l.toxic + 1, 2) AS severity FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id""")
def eval_inputs(t):
    side = t.labels.select(F.col("doc_id").alias("conv_id"), "toxic")
    task = F.when(F.col("role") == "user", "open").when(F.col("role") == "assistant", "refusal").otherwise("other")
    return t.conversations.join(side.hint("merge"), "conv_id", "left").select("conv_id", "turn", task.alias("task"), F.coalesce(F.col("toxic") + 1, F.lit(2)).alias("severity"))


@query(r"""SELECT conv_id, turn, role AS "type", len(regexp_extract_all(text, '\S+')) AS target, greatest(1, round_even(least(len(regexp_extract_all(text, '\S+')) * 0.8::DOUBLE, len(regexp_extract_all(text, '\S+')) - 5.0::DOUBLE), 0)::INT) AS low FROM conversations WHERE role <> 'system'""")
def generation_jobs(t):
    n = F.regexp_count("text", F.lit(r"\S+"))
    return t.conversations.where("role != 'system'").select("conv_id", "turn", F.col("role").alias("type"), n.cast("long").alias("target"), C.length_band(n)[0].alias("low"))


@query("""WITH j AS (SELECT o_orderkey, o_orderpriority FROM orders), a AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT o_orderpriority, count(*) AS n_jobs, count(n) AS n_answered, count(*) FILTER (n BETWEEN 2 AND 4) AS n_in_band FROM j LEFT JOIN a ON l_orderkey = o_orderkey GROUP BY 1""")
def collect_arm(t):
    a = t.lineitem.where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t.orders.select("o_orderkey", "o_orderpriority").join(a.hint("merge"), "o_orderkey", "left").groupBy("o_orderpriority").agg(F.count("*").alias("n_jobs"), F.count("n").alias("n_answered"), F.count(F.when(F.col("n").between(2, 4), 1)).alias("n_in_band"))


@query("""SELECT p_brand, n, round(avg_rank, 4) AS avg_rank FROM (SELECT p_brand, count(*) AS n, avg(pos) AS avg_rank FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY ('0x' || substr(md5('gold' || p_partkey), 1, 8))::BIGINT, p_partkey) % 4 AS pos FROM part) GROUP BY 1)""")
def gold_position_balance(t):
    r = ranked_within(t.part.select("p_brand", "p_partkey", P.draw("gold", "p_partkey").alias("h")), "p_brand", "h", "p_partkey").withColumn("pos", F.col("rank") % 4)
    return r.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("pos"), 4).alias("avg_rank"))


def _answers(t):
    """Documents as items: the source is the concept, the length the facet, the first eight words the answer."""
    answer = F.array_join(F.slice(F.split("text", " "), 1, 8), " ")
    d = t.documents.select("doc_id", F.col("source").alias("concept"), F.concat(F.lit("f"), (F.col("n_chars") % 5).cast("string")).alias("facet"), answer.alias("answer"))
    return d.where(F.length("answer") >= 15)


_ANSWERS = """rec AS (SELECT * FROM (SELECT doc_id, source AS concept, 'f' || n_chars % 5 AS facet, array_to_string(string_split(text, ' ')[1:8], ' ') AS answer FROM documents) WHERE length(answer) >= 15)"""


@query(f"""WITH {_ANSWERS}, pool AS (SELECT DISTINCT facet, concept, answer FROM rec), ring AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY ('0x' || substr(md5('mcq' || answer), 1, 8))::BIGINT, answer, concept) - 1 AS at, count(*) OVER (PARTITION BY facet) AS n FROM pool),
p AS (SELECT doc_id, facet, unnest(range(0, 8)) AS place FROM rec)
SELECT doc_id, place::INT AS place, ring.answer, ring.concept FROM p JOIN ring ON ring.facet = p.facet AND ring.at = (('0x' || substr(md5('mcq' || doc_id), 1, 8))::BIGINT + place) % ring.n WHERE place < n""")
def mcq_candidates(t):
    return P.distractor_candidates(_answers(t), "doc_id", ["facet"], 8, "mcq").select("doc_id", "place", "answer", "concept")


def _mcq(hard: bool) -> str:
    """The greedy choice over each item's whole pools, stage after stage in md5 order from its own place."""
    stages = [(1, "concept", "concept = own AND facet <> face AND answer <> gold", "'f:' || facet"), (2, "concept", "concept = own AND facet <> face AND answer <> gold", "NULL")] if hard else []
    stages += [(3, "facet", "concept <> own", "'c:' || concept"), (4, "''", "concept <> own", "'c:' || concept")]
    md5 = lambda x: f"('0x' || substr(md5({x}), 1, 8))::BIGINT"
    near = lambda a, b: f"len(list_intersect({a}, {b})) > 0.6::DOUBLE * (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
    rings = ", ".join(f"""p{n} AS (SELECT DISTINCT {key} AS pool, facet, concept, answer FROM rec),
r{n} AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY {md5(f"'mcq{n if n > 2 else 1}' || answer")}, answer, concept, facet) - 1 AS spot, count(*) OVER (PARTITION BY pool) AS n FROM p{n}),
s{n} AS (SELECT i.doc_id, {n} AS stage, (spot - {md5(f"'mcq{n if n > 2 else 1}' || i.doc_id")} % n + n) % n AS place, r.answer, {tag} AS tag FROM (SELECT doc_id, concept AS own, facet AS face, answer AS gold, {key} AS pool FROM rec) i JOIN r{n} r USING (pool) WHERE {ok})""" for n, key, ok, tag in stages)
    every = " UNION ALL ".join(f"SELECT * FROM s{n}" for n, *_ in stages)
    return f"""WITH {_ANSWERS}, words AS (SELECT DISTINCT answer, list_distinct(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS w FROM rec), {rings}, e AS ({every}),
l AS (SELECT e.doc_id, rec.answer AS gold, list({{'s': e.stage, 'a': e.answer, 't': e.tag, 'w': x.w}} ORDER BY e.stage, e.place) AS c FROM e JOIN rec USING (doc_id) JOIN words x ON x.answer = e.answer JOIN words g ON g.answer = rec.answer WHERE NOT {near("x.w", "g.w")} GROUP BY ALL),
k AS (SELECT doc_id, gold, list_reduce(list_prepend(c[1:0], list_transform(c, lambda x: [x])), lambda kept, x: CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda j: coalesce(j.t = x[1].t, false) OR {near("j.w", "x[1].w")})) = 0 THEN list_append(kept, x[1]) ELSE kept END) AS kept FROM l),
o AS (SELECT doc_id, gold, list_prepend(gold, list_transform(kept, lambda j: j.a)) AS options, len(list_filter(kept, lambda j: j.s > 2)) > 0 AS fell_back FROM k WHERE len(kept) = 3),
u AS (SELECT doc_id, gold, fell_back, unnest(options) AS o FROM o), m AS (SELECT doc_id, gold, fell_back, list(o ORDER BY {md5("doc_id || 'opt' || o")}, o) AS options FROM u GROUP BY ALL)
SELECT doc_id, array_to_string(options, '|') AS options, list_position(options, gold) - 1 AS gold_position, fell_back FROM m"""


@query(_mcq(False))
def mcq_distractors_easy(t):
    return P.distractors(_answers(t), "doc_id", hard=False).withColumn("options", F.array_join("options", "|"))


@query(_mcq(True))
def mcq_distractors_hard(t):
    return P.distractors(_answers(t), "doc_id", hard=True).withColumn("options", F.array_join("options", "|"))


@query("""WITH j AS (SELECT l_orderkey, l_linestatus AS kind, l_quantity::INT AS target, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS place FROM lineitem),
r AS (SELECT l_orderkey, l_linestatus AS kind, (l_partkey % 50 + 1)::INT AS words, l_suppkey % 6 AS choice, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS place FROM lineitem WHERE l_tax >= 0.03)
SELECT kind, count(*) AS n_jobs, count(words) AS n_answered, count(*) FILTER (choice < 5) AS n_valid, count(*) FILTER (words BETWEEN greatest(1, round_even(least(target * 0.8::DOUBLE, target - 5.0::DOUBLE), 0)::INT) AND round_even(greatest(target * 1.25::DOUBLE, target + 5.0::DOUBLE), 0)::INT) AS n_in_band
FROM j LEFT JOIN r USING (l_orderkey, kind, place) GROUP BY 1""")
def arm_by_type(t):
    """Jobs are lines of an order by type, the arm's replies those of them that it answered, in order."""
    rows = t.lineitem.withColumns({"kind": F.col("l_linestatus"), "target": F.col("l_quantity").cast("int"), "words": (F.col("l_partkey") % 50 + 1).cast("int"), "choice": F.col("l_suppkey") % 6})
    return P.arm_report(P.collect_arm(rows, rows.where("l_tax >= 0.03"), "l_orderkey", "kind", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]), "kind", 5)


@query("""SELECT sha256(concat_ws(chr(31), 'salt', role, conv_id::VARCHAR, turn::VARCHAR)) AS rec_id, role, conv_id, turn, md5(text) AS shown FROM conversations""")
def blind_pool_keys(t):
    """The key table of the pooled records, met with what is shown of them."""
    shown, keys = P.blinded(t.conversations.select("role", "conv_id", "turn", "text"), ["role", "conv_id", "turn"], "salt")
    return keys.join(shown.hint("merge"), "rec_id").select("rec_id", "role", "conv_id", "turn", F.md5("text").alias("shown"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, string_split(text, ' ')[1:4] AS words, l.toxic FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id)
SELECT conv_id || '#' || turn AS id, CASE role WHEN 'user' THEN 'recognition' WHEN 'assistant' THEN 'doctrine' ELSE 'refusal' END AS kind, CASE WHEN role = 'user' THEN array_to_string(CASE WHEN list_contains(words, 'the') THEN words ELSE list_append(words, 'the') END, '|') END AS options,
  CASE role WHEN 'user' THEN words[1] WHEN 'assistant' THEN substr(text, 1, 60) ELSE 'REFUSE' END AS gold, CASE WHEN role = 'assistant' THEN NULL ELSE coalesce(toxic + 1, 2) END AS severity FROM c""")
def eval_projection(t):
    """Each type's own fields: options with the abstain option once, gold answers, severity where the type has it."""
    c = t.conversations.join(t.labels.select(F.col("doc_id").alias("conv_id"), "toxic").hint("merge"), "conv_id", "left").withColumn("words", F.slice(F.split("text", " "), 1, 4))
    r = F.col("role")
    gold = F.when(r == "user", F.get("words", F.lit(0))).when(r == "assistant", F.substring("text", 1, 60)).otherwise("REFUSE")
    kind = F.when(r == "user", "recognition").when(r == "assistant", "doctrine").otherwise("refusal")
    options = F.when(r == "user", F.array_join(P.with_abstain(F.col("words"), "the"), "|"))
    return c.select(F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), kind.alias("kind"), options.alias("options"), gold.alias("gold"), F.when(r != "assistant", F.coalesce(F.col("toxic") + 1, F.lit(2))).alias("severity"))


@query("""WITH v AS (SELECT l_orderkey AS item, l_suppkey AS voter, min(CASE WHEN l_tax > 0.06 THEN 'none' ELSE l_returnflag END) AS vote FROM lineitem GROUP BY 1, 2), j AS (SELECT o_orderkey AS item, o_custkey % 50 AS target FROM orders)
SELECT 'reference' AS source, item, target, o_orderstatus AS given FROM j JOIN orders ON o_orderkey = item UNION ALL SELECT 'voter', item, target, vote FROM j JOIN v USING (item) WHERE voter = 3 AND vote <> 'none'""")
def jobs_with_label(t):
    """Jobs with the reference's label, and jobs with the label that one voter named; where that one abstained there is no job."""
    jobs = t.orders.select(F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 50).alias("target"))
    reference = t.orders.select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("label"))
    votes = t.lineitem.groupBy(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("voter")).agg(F.min(F.when(F.col("l_tax") > 0.06, "none").otherwise(F.col("l_returnflag"))).alias("vote"))
    told = lambda source, named: P.job_labels(jobs, reference, votes, "item", "label", "voter", "vote", named).select(F.lit(source).alias("source"), "item", "target", "given")
    return told("reference", None).union(told("voter", 3))
