"""Votes from `lineitem` (order = item, supplier = voter, return flag = vote), audits from `labels` over `documents`."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import md5_int
from ..operators import audit as A
from ..operators import browse as B
from ..operators import stats as S
from .registry import query


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND value >= 20 THEN event_type ELSE 'none' END AS vote FROM events""")
def vote_from_reply(t):
    confidence = F.when(F.col("value") >= 50, "high").when(F.col("value") >= 20, "medium").otherwise("low")
    return t.events.select("event_id", A.vote(F.col("event_type"), confidence, ["click", "view"]).alias("vote"))


@query("""SELECT d.doc_id, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'answerable' ELSE 'refusal' END AS task_type, CASE WHEN l.quality IS NULL THEN 'no_clear' WHEN l.quality = 0 OR l.toxic = 1 THEN 'low_confidence' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)""")
def route_answerable(t):
    d = t.documents.select("doc_id").join(t.labels.hint("merge"), "doc_id", "left")
    ok = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return d.select("doc_id", F.when(ok, "answerable").otherwise("refusal").alias("task_type"), F.when(F.col("quality").isNull(), "no_clear").when(~ok, "low_confidence").alias("reason"))


_VOTES = """v AS (SELECT l_orderkey AS item, l_suppkey AS voter, min(CASE WHEN l_tax > 0.06 THEN 'none' ELSE l_returnflag END) AS vote FROM lineitem GROUP BY 1, 2)"""
_CONSENSUS = _VOTES + """, n AS (SELECT item, vote, count(*) AS n FROM v GROUP BY 1, 2), s AS (SELECT item, sum(n)::BIGINT AS n_votes FROM n GROUP BY 1), b AS (SELECT item, vote, n FROM n WHERE vote <> 'none' QUALIFY row_number() OVER (PARTITION BY item ORDER BY n DESC, vote) = 1),
c AS (SELECT s.item, n_votes, CASE WHEN b.n >= 3 THEN b.vote ELSE 'none' END AS winner FROM s LEFT JOIN b USING (item))"""


def _votes(t):
    given = F.when(F.col("l_tax") > 0.06, "none").otherwise(F.col("l_returnflag"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("voter")).agg(F.min(given).alias("vote"))


@query(f"WITH {_CONSENSUS} SELECT * FROM c")
def consensus_vote(t):
    return A.consensus(_votes(t), "item", "vote", 5)


@query(f"WITH {_CONSENSUS} SELECT CASE WHEN winner = 'none' THEN 'none' WHEN winner = 'N' THEN 'agree' ELSE 'other' END AS outcome, count(*) AS n FROM c GROUP BY 1")
def consensus_outcome(t):
    w = F.col("winner")
    return A.consensus(_votes(t), "item", "vote", 5).groupBy(F.when(w == "none", "none").when(w == "N", "agree").otherwise("other").alias("outcome")).agg(F.count("*").alias("n"))


#: Orders as items: those with a finished or open status have a label, others are refusals; of seven in a row, each derives from the one before.
_ITEMS = "i AS (SELECT o_orderkey AS item, CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' END AS released, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey - 1 END AS derived_from FROM orders)"


def _items(t):
    status = F.col("o_orderstatus")
    return t.orders.select(F.col("o_orderkey").alias("item"), F.when(status == "F", "R").when(status == "O", "N").alias("released"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") - 1).alias("derived_from"))


@query(f"""WITH RECURSIVE {_VOTES}, {_ITEMS}, g AS (SELECT i.item, released, derived_from, count(*) FILTER (vote = released) AS n_agree FROM i LEFT JOIN v USING (item) GROUP BY ALL),
k AS (SELECT *, released IS NULL OR n_agree >= 1 AS own FROM g), gone AS (SELECT item FROM k WHERE NOT own UNION SELECT k.item FROM k JOIN gone ON k.derived_from = gone.item)
SELECT item, n_agree, CASE WHEN NOT own THEN 'not_agreed' WHEN item IN (SELECT item FROM gone) THEN 'derived' ELSE 'kept' END AS status FROM k""")
def release_gate(t):
    """Items whose label a voter names, without those that derive, over up to six steps, from one that goes."""
    return A.released(_items(t), _votes(t), "item", "released", "vote", 1, "derived_from").select("item", "n_agree", "status")


@query(f"WITH {_VOTES} SELECT item, " + ", ".join(f"min(CASE WHEN voter % 6 = {i} THEN vote END) AS voter_{i}" for i in range(6)) + " FROM v GROUP BY 1")
def vote_matrix(t):
    votes = _votes(t).select("item", F.concat(F.lit("voter_"), (F.col("voter") % 6).cast("string")).alias("voter"), "vote")
    return A.vote_matrix(votes, "item", "voter", "vote", [f"voter_{i}" for i in range(6)])


@query(f"WITH {_CONSENSUS}, {_ITEMS} SELECT coalesce(released, 'refusal') AS released, winner, count(*) AS n FROM i JOIN c USING (item) WHERE coalesce(released, 'refusal') <> winner GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10")
def consensus_transitions(t):
    """The ten most frequent changes from the released label to the consensus."""
    met = _items(t).withColumn("released", F.coalesce("released", F.lit("refusal"))).join(A.consensus(_votes(t), "item", "vote", 5).hint("merge"), "item")
    return A.transitions(met, "released", "winner")


@query(f"WITH {_VOTES}, i AS (SELECT o_orderkey AS item, CASE WHEN o_orderstatus = 'F' THEN 'R' ELSE 'N' END AS released FROM orders), g AS (SELECT item, released, count(*) FILTER (vote = released) AS n_agree FROM v JOIN i USING (item) GROUP BY 1, 2) SELECT item, released, n_agree FROM g WHERE n_agree >= 2")
def consensus_gate(t):
    items = t.orders.select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("N").alias("released"))
    return A.gate(items, _votes(t), "item", "released", "vote", 2)


@query(f"""WITH {_VOTES}, c AS (SELECT l_orderkey AS item, bool_and(l_linestatus = 'O') AS confirmed FROM lineitem GROUP BY 1), j AS (SELECT voter, CASE WHEN voter % 7 <> item % 7 THEN vote END AS vote, confirmed FROM v JOIN c USING (item)),
x AS (SELECT *, coalesce(vote = 'N', false)::INT AS agree FROM j)
SELECT voter, count(*) AS n, round(avg(agree), 6) AS agreement, count(*) FILTER (vote = 'none') AS n_none, count(*) FILTER (vote IS NULL) AS n_unparsed, round(avg(agree) FILTER (confirmed), 6) AS on_confirmed, round(avg(agree) FILTER (NOT confirmed), 6) AS on_rejected FROM x GROUP BY 1""")
def voter_report(t):
    confirmed = t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg(F.bool_and(F.col("l_linestatus") == "O").alias("confirmed"))
    votes = _votes(t).withColumn("vote", F.when(F.col("voter") % 7 != F.col("item") % 7, F.col("vote")))
    return A.voters(votes.join(confirmed.hint("merge"), "item").withColumn("gold", F.lit("N")), "voter", "vote", "gold", "confirmed")


@query("""SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS n_primary, count(*) FILTER (quality = 0) AS n_salvage, count(*) FILTER (quality IS NULL) AS n_review, round(count(quality) / count(*), 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def audit_tiers(t):
    d = t.documents.select("doc_id", "source").join(t.labels.hint("merge"), "doc_id", "left")
    tier = A.audit_tier(F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no"))
    n = lambda x: F.count(F.when(tier == x, 1)).alias(f"n_{x}")
    return d.groupBy("source").agg(F.count("*").alias("n"), n("primary"), n("salvage"), n("review"), F.round(F.count("quality") / F.count("*"), 6).alias("coverage"))


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'unaudited' WHEN quality = 1 THEN 'kept' ELSE 'reservoir' END AS pool FROM documents LEFT JOIN labels USING (doc_id)""")
def audit_split(t):
    q = F.col("quality")
    return t.documents.select("doc_id").join(t.labels.hint("merge"), "doc_id", "left").select("doc_id", F.when(q.isNull(), "unaudited").when(q == 1, "kept").otherwise("reservoir").alias("pool"))


_CLEAN = """s AS (SELECT event_type, user_id, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT *, CASE WHEN m < 20 THEN 'dark' WHEN s < 10 THEN 'flat' END AS why FROM s)"""


@query(f"WITH {_CLEAN} SELECT event_type, user_id, why, n FROM c")
def clean_refusals(t):
    return _with_why(t)


def _with_why(t):
    s = t.events.groupBy("event_type", "user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").alias("n"))
    return s.select("event_type", "user_id", F.when(F.col("m") < 20, "dark").when(F.col("s") < 10, "flat").alias("why"), "n")


@query(f"WITH {_CLEAN} SELECT event_type, why, count(*) AS n_groups, sum(n)::BIGINT AS n_rows FROM c WHERE why IS NOT NULL GROUP BY 1, 2")
def refusal_drop_log(t):
    return _with_why(t).where("why IS NOT NULL").groupBy("event_type", "why").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))


@query(f"WITH {_CLEAN} SELECT event_id, event_type, user_id FROM events JOIN c USING (event_type, user_id) WHERE why IS NULL")
def refusal_input_kept(t):
    kept = _with_why(t).where("why IS NULL").select("event_type", "user_id")
    return t.events.join(kept.hint("merge"), ["event_type", "user_id"], "left_semi").select("event_id", "event_type", "user_id")


@query("""WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS before FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, event_id) AS after, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_type <> 'view') AS evidence FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT user_id, before, after, coalesce(evidence, '') AS evidence FROM a JOIN b USING (user_id) WHERE before <> after""")
def label_changes(t):
    last = F.max_by("event_type", "event_id")
    a = t.events.where("event_id % 2 = 0").groupBy("user_id").agg(last.alias("before"))
    b = t.events.where("event_id % 2 = 1").groupBy("user_id").agg(last.alias("after"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("event_type") != "view", F.col("event_type")))), ",").alias("evidence"))
    return a.join(b.hint("merge"), "user_id").where("before != after")


_RANKED = """r AS (SELECT conv_id // 20 AS block, conv_id, turn, role, row_number() OVER (PARTITION BY conv_id // 20 ORDER BY conv_id, turn) - 1 AS rank, count(*) OVER (PARTITION BY conv_id // 20) AS n FROM conversations)"""


@query(f"""WITH {_RANKED}, s AS (SELECT *, CASE WHEN rank + n // 2 < n THEN rank + n // 2 ELSE 0 END AS start FROM r)
SELECT s.conv_id, s.turn, s.rank, coalesce((SELECT min(x.rank) FROM r x WHERE x.block = s.block AND x.rank >= s.start AND x.conv_id <> s.conv_id), (SELECT min(x.rank) FROM r x WHERE x.block = s.block AND x.conv_id <> s.conv_id)) AS partner_rank FROM s""")
def swap_partner(t):
    c = t.conversations.select("conv_id", "turn", F.floor(F.col("conv_id") / 20).alias("block"))
    return A.next_different(c, ["conv_id", "turn"], "conv_id", "block").select("conv_id", "turn", "rank", "partner_rank")


@query("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS rank FROM conversations)
SELECT s.conv_id, s.turn, s.rank, coalesce((SELECT min(x.rank) FROM r x WHERE x.conv_id = s.conv_id AND x.rank > s.rank AND x.role <> s.role), (SELECT min(x.rank) FROM r x WHERE x.conv_id = s.conv_id AND x.role <> s.role)) AS partner_rank FROM r s""")
def next_different_answer(t):
    c = t.conversations.select("conv_id", "turn", "role", "text")
    return A.next_different(c, ["turn", "text"], "role", "conv_id", half=False).select("conv_id", "turn", "rank", "partner_rank")


@query("""WITH u AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1), q AS (SELECT c.conv_id, min(c.text) AS question FROM conversations c JOIN u USING (conv_id, turn) WHERE c.role = 'user' GROUP BY 1)
SELECT c.conv_id, c.turn, 'answerability' AS task, 'other_question' AS condition, length(question) AS n_chars FROM conversations c JOIN q USING (conv_id) WHERE c.role = 'assistant'""")
def same_context_question(t):
    """The third control: each refusal with another question of the item whose context it reuses."""
    first = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("q"))
    refused = t.conversations.where("role = 'assistant'").select("conv_id", "turn")
    return refused.join(first.hint("merge"), "conv_id").select("conv_id", "turn", F.lit("answerability").alias("task"), F.lit("other_question").alias("condition"), F.length("q.text").alias("n_chars"))


_MD5 = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query(f"""WITH v AS (SELECT p_partkey, p_brand, p_type, {_MD5.format("'audit' || p_partkey")} % 5 AS h, 'Brand#' || (p_partkey % 31 + 1) AS correct FROM part),
m AS (SELECT p_brand, p_type AS display FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1),
l AS (SELECT display, row_number() OVER (ORDER BY display) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT display FROM m)),
j AS (SELECT v.*, m.display, CASE WHEN h = 0 THEN 'agreed' WHEN h = 1 THEN 'confirmed' WHEN h IN (2, 3) AND m.display IS NOT NULL THEN 'corrected' ELSE 'refused' END AS action FROM v LEFT JOIN m ON m.p_brand = v.correct),
a AS (SELECT p_partkey, display AS shown, unnest(range(0, least(4, (SELECT max(n) FROM l)))) AS place FROM j WHERE action = 'corrected'),
d AS (SELECT p_partkey, shown, place, l.display FROM a JOIN l ON l.idx = ({_MD5.format("'fix' || p_partkey")} + place) % l.n WHERE l.display <> shown QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY place) <= 3),
o AS (SELECT p_partkey, string_agg(display, ',' ORDER BY {_MD5.format("'fix' || p_partkey || display")}, display) AS options FROM (SELECT p_partkey, display FROM d UNION ALL SELECT DISTINCT p_partkey, shown FROM a) GROUP BY 1)
SELECT p_partkey, action, CASE action WHEN 'corrected' THEN correct WHEN 'refused' THEN NULL ELSE p_brand END AS p_brand, CASE WHEN action = 'corrected' THEN p_brand END AS corrected_from,
CASE action WHEN 'refused' THEN 'no answer' WHEN 'corrected' THEN display ELSE p_type END AS p_type, options FROM j LEFT JOIN o USING (p_partkey)""")
def apply_concept_verdict(t):
    h = md5_int(F.concat(F.lit("audit"), F.col("p_partkey").cast("string"))) % 5
    verdict = F.when(h == 1, "original").when(h == 2, "reperceived").when(h == 3, "other").otherwise("none")
    verdicts = t.part.where(h > 0).select("p_partkey", verdict.alias("verdict"), F.concat(F.lit("Brand#"), (F.col("p_partkey") % 31 + 1).cast("string")).alias("correct"))
    found = A.correct_concepts(t.part, verdicts, t.part.select("p_brand"), "p_partkey", "p_brand", "p_type", "no answer")
    return found.withColumn("options", F.array_join("options", ","))


@query("""WITH n AS (SELECT conv_id AS doc_id, trim(substr(text, 1, 12), ' ') AS rec FROM conversations WHERE turn = 0), c AS (SELECT conv_id AS doc_id, CASE WHEN conv_id % 3 = 0 THEN '' ELSE trim(substr(text, 1, 9), ' ') END AS com FROM conversations WHERE turn = 1)
SELECT doc_id, concat_ws(';', CASE WHEN com <> '' THEN 'comment=' || com END, 'quality=' || quality, CASE WHEN rec <> '' THEN 'recognition_note=' || rec END) AS labels FROM labels LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""")
def merge_notes(t):
    old = F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("comment"), F.lit("old"), F.lit("recognition_note"), F.lit("old"))
    note = t.conversations.where("turn < 2").select(
        F.col("conv_id").alias("doc_id"), F.when(F.col("turn") == 0, "recognition_note").otherwise("comment").alias("name"),
        F.when(F.col("turn") == 0, F.substring("text", 1, 12)).when(F.col("conv_id") % 3 == 0, "  ").otherwise(F.substring("text", 1, 9)).alias("text"),
    )
    merged = A.merge_notes(t.labels.select("doc_id", old.alias("labels")), note, "doc_id", "labels", ["recognition_note", "comment"])
    return merged.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("labels"))


@query("""SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 20""")
def head_per_group(t):
    from ..operators.ground import capped

    return capped(t.orders.select("o_orderpriority", "o_orderkey"), "o_orderpriority", ["o_orderkey"], 20)


@query("""WITH n AS (SELECT event_type, CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'null' END AS verdict, count(*) AS n FROM events GROUP BY 1, 2) SELECT *, round(100 * n / sum(n) OVER (PARTITION BY event_type), 4) AS percent FROM n""")
def verdict_distribution(t):
    v = F.when(F.col("value") < 20, "low").when(F.col("value") < 60, "mid")
    return A.distribution(t.events.select("event_type", v.alias("v")), ["event_type"], "v")


@query("""SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_models, count(*) FILTER (l_tax <= 0.04) AS n_pass, count(*) FILTER (l_tax <= 0.04) >= 3 AS majority FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 4""")
def majority_pass(t):
    return A.majority(t.lineitem, "l_orderkey", "l_suppkey", F.col("l_tax") <= 0.04, 4)


@query("""SELECT l.quality, l.toxic, count(*) AS n, count(*) FILTER ((n_chars > 200) = (quality = 1 AND toxic = 0)) AS n_correct FROM labels l JOIN documents USING (doc_id) GROUP BY 1, 2""")
def model_vs_raters(t):
    j = t.labels.join(t.documents.select("doc_id", "n_chars").hint("merge"), "doc_id")
    right = (F.col("n_chars") > 200) == ((F.col("quality") == 1) & (F.col("toxic") == 0))
    return j.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count(F.when(right, 1)).alias("n_correct"))


@query("""WITH k AS (SELECT doc_id, 'q' AS known, quality AS a FROM labels UNION ALL SELECT doc_id, 't', toxic FROM labels), g AS (SELECT doc_id, 'x' AS given, CASE WHEN doc_id % 10 = 0 THEN 1 - quality ELSE quality END AS b FROM labels UNION ALL SELECT doc_id, 'y', toxic FROM labels),
r AS (SELECT given, known, avg((a = b)::INT) AS rate FROM k JOIN g USING (doc_id) GROUP BY 1, 2) SELECT given, known, round(rate, 6) AS rate FROM r QUALIFY row_number() OVER (PARTITION BY given ORDER BY rate DESC, known) = 1""")
def match_rater_role(t):
    one = lambda role, v: t.labels.select("doc_id", F.lit(role).alias("role"), v.alias("label"))
    known = one("q", F.col("quality")).union(one("t", F.col("toxic")))
    given = one("x", F.when(F.col("doc_id") % 10 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).union(one("y", F.col("toxic")))
    return A.match_roles(known, given, "doc_id", "role", "label")


@query("""SELECT s_suppkey, n_name, CASE WHEN regexp_matches(n_name, '^(UNITED|CHINA|JAPAN)') THEN 'official' WHEN regexp_matches(n_name, '(?i)a$') THEN 'partner' ELSE 'public' END AS channel, s_acctbal < 0 AS requires_login FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE NOT regexp_matches(n_name, 'RUSSIA|IRAN')""")
def rights_filter(t):
    j = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).where(~F.col("n_name").rlike("RUSSIA|IRAN"))
    channel = F.when(F.col("n_name").rlike("^(UNITED|CHINA|JAPAN)"), "official").when(F.col("n_name").rlike("(?i)a$"), "partner").otherwise("public")
    return j.select("s_suppkey", "n_name", channel.alias("channel"), (F.col("s_acctbal") < 0).alias("requires_login"))


@query("""SELECT doc_id, source, CASE WHEN quality = 0 THEN 'quality' ELSE 'toxic' END AS reason FROM documents JOIN labels USING (doc_id) WHERE quality = 0 OR toxic = 1""")
def dropped_ledger(t):
    j = t.documents.select("doc_id", "source").join(t.labels.hint("merge"), "doc_id").where("quality = 0 OR toxic = 1")
    return j.select("doc_id", "source", F.when(F.col("quality") == 0, "quality").otherwise("toxic").alias("reason"))


@query("""SELECT CASE WHEN event_type = 'view' THEN 'available' WHEN value < 20 THEN 'removed' WHEN value < 60 THEN 'private' ELSE 'unknown' END AS status, count(DISTINCT user_id) AS n_sources, count(*) AS n_items FROM events GROUP BY 1""")
def availability_rollup(t):
    v = F.col("value")
    status = F.when(F.col("event_type") == "view", "available").when(v < 20, "removed").when(v < 60, "private").otherwise("unknown")
    return t.events.groupBy(status.alias("status")).agg(F.countDistinct("user_id").alias("n_sources"), F.count("*").alias("n_items"))


@query("""SELECT o_orderkey AS item_id, o_orderstatus AS status, concat_ws('|', o_custkey::VARCHAR, o_orderpriority) AS leftovers FROM orders""")
def public_projection(t):
    return t.orders.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("status"), F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("leftovers"))


@query("""SELECT 'lines_without_order' AS name, count(*) AS n, count(*) = 0 AS ok FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'labels_without_document', count(*), count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'orders_without_line', count(*), count(*) = 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def package_checks(t):
    keys = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", (F.col("n") == 0).alias("ok"))
    parts = [one("lines_without_order", keys.join(t.orders.select("o_orderkey").hint("merge"), "o_orderkey", "left_anti")), one("labels_without_document", t.labels.join(t.documents.select("doc_id").hint("merge"), "doc_id", "left_anti")), one("orders_without_line", t.orders.join(keys.hint("merge"), "o_orderkey", "left_anti"))]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH f AS (SELECT 'orders' AS label, count(*)::DOUBLE AS got FROM orders UNION ALL SELECT 'mean_quantity', avg(l_quantity) FROM lineitem) SELECT label, round(got, 6) AS got, want, abs(got - want) <= tol AS ok FROM f JOIN (VALUES ('orders', 15000.0::DOUBLE, 0.0::DOUBLE), ('mean_quantity', 25.0::DOUBLE, 1.0::DOUBLE)) e(label, want, tol) USING (label)""")
def verify_expected(t):
    found = t.orders.agg(F.count("*").cast("double").alias("got")).select(F.lit("orders").alias("label"), "got").union(t.lineitem.agg(F.avg("l_quantity").alias("got")).select(F.lit("mean_quantity").alias("label"), "got"))
    expected = t.spark.createDataFrame([("orders", 15000.0, 0.0), ("mean_quantity", 25.0, 1.0)], "label string, want double, tol double")
    return A.verify(found, expected).withColumn("got", F.round("got", 6))


@query("""SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources, median(n_chars) AS median_chars, max(n_chars) AS max_chars, round(quantile_cont(n_chars, 0.25), 4) AS q1, round(quantile_cont(n_chars, 0.75), 4) AS q3 FROM documents GROUP BY 1""")
def composition_counts(t):
    counts = t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.max("n_chars").alias("max_chars"))
    cuts = S.quantiles(t.documents, ["lang"], "n_chars", {"median_chars": 0.5, "q1": 0.25, "q3": 0.75}).drop("n")
    met = counts.join(cuts.withColumnRenamed("lang", "_lang").hint("merge"), F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    return met.withColumns({c: F.round(c, 4) for c in ("q1", "q3")})


@query("""SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'drop' WHEN quality = 0 OR toxic = 1 THEN 'fix' ELSE 'keep' END AS verdict FROM labels""")
def derive_verdict(t):
    bad = F.col("quality") == 0, F.col("toxic") == 1
    return t.labels.select("doc_id", F.when(bad[0] & bad[1], "drop").when(bad[0] | bad[1], "fix").otherwise("keep").alias("verdict"))


@query("""SELECT c.conv_id, string_agg(DISTINCT c.role, ',' ORDER BY c.role) AS regen_types, count(*) AS n FROM conversations c JOIN labels l ON l.doc_id = c.conv_id WHERE l.quality = 0 OR l.toxic = 1 GROUP BY 1""")
def regeneration_list(t):
    flagged = t.labels.where("quality = 0 OR toxic = 1").select(F.col("doc_id").alias("conv_id"))
    return t.conversations.join(flagged.hint("merge"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("regen_types"), F.count("*").alias("n"))


@query("""SELECT conv_id, count(*) AS n_turns, max(l.quality IS NOT NULL) AS has_human, translate(string_agg(c.text, ' ' ORDER BY turn), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS blob FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id GROUP BY 1""")
def browse_items(t):
    c = t.conversations.join(t.labels.select(F.col("doc_id").alias("conv_id"), F.lit(True).alias("seen")).hint("merge"), "conv_id", "left")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max(F.coalesce("seen", F.lit(False))).alias("has_human"), F.translate(F.array_join(turns, " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("blob"))


@query("""WITH q AS (SELECT DISTINCT l_orderkey, l_returnflag AS kind FROM lineitem), i AS (SELECT l_orderkey, l_returnflag AS kind, count(DISTINCT l_suppkey % 2) AS n FROM lineitem WHERE l_tax > 0.05 GROUP BY 1, 2), b AS (SELECT DISTINCT l_orderkey, l_returnflag AS kind, true AS bad FROM lineitem WHERE l_linenumber % 4 < 2)
SELECT l_orderkey, string_agg(kind, ',' ORDER BY kind) FILTER (n IS NOT NULL) AS regen_types, coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (n IS NULL), '') AS kept, max(n) >= 2 AS second_pass, count(*) FILTER (n IS NOT NULL AND bad) AS n_discarded
FROM q LEFT JOIN i USING (l_orderkey, kind) LEFT JOIN b USING (l_orderkey, kind) GROUP BY 1 HAVING count(n) > 0""")
def regeneration_plan(t):
    rows = t.lineitem.withColumn("kind", F.col("l_returnflag"))
    issues = rows.where("l_tax > 0.05").withColumn("pass", F.col("l_suppkey") % 2)
    verdict = F.when(F.col("l_linenumber") % 4 == 0, "answerable").when(F.col("l_linenumber") % 4 == 1, "off_topic").otherwise("fine")
    return A.regeneration(rows, issues, rows.withColumn("verdict", verdict), "l_orderkey", "kind")


_AUDITED = """a AS (SELECT doc_id, source, CASE WHEN quality = 1 THEN 'yes' WHEN toxic = 0 THEN 'partial' WHEN toxic = 1 THEN 'no' END AS verdict, ['yes', 'partial', 'no'][(n_chars % 3 + 1)::INT] AS cross_check FROM documents LEFT JOIN labels USING (doc_id))"""


def _audited(t):
    d = t.documents.select("doc_id", "source", "n_chars").join(t.labels.hint("merge"), "doc_id", "left")
    verdict = F.when(F.col("quality") == 1, "yes").when(F.col("toxic") == 0, "partial").when(F.col("toxic") == 1, "no")
    return d.select("doc_id", "source", verdict.alias("verdict"), F.element_at(F.array(*map(F.lit, ("yes", "partial", "no"))), (F.col("n_chars") % 3 + 1).cast("int")).alias("cross_check"))


@query(f"""WITH {_AUDITED} SELECT source, count(*) AS n, count(verdict) AS n_audited, round(count(*) FILTER (verdict IN ('yes', 'partial')) / nullif(count(verdict), 0), 6) AS "precision", round(count(*) FILTER (verdict = 'yes') / nullif(count(verdict), 0), 6) AS clear,
  round(count(*) FILTER (cross_check = 'no' AND coalesce(verdict <> 'yes', true)) / nullif(count(*) FILTER (cross_check = 'no'), 0), 6) AS rejected_rightly, round(count(*) FILTER (cross_check <> 'no' AND verdict = 'yes') / nullif(count(*) FILTER (cross_check <> 'no'), 0), 6) AS accepted_rightly FROM a GROUP BY 1""")
def audit_precision(t):
    return A.audit_precision(_audited(t), ["source"], "verdict", "cross_check")


@query(f"WITH {_AUDITED} SELECT cross_check, verdict, count(*) AS n FROM a GROUP BY 1, 2")
def audit_confusion(t):
    return A.confusion(_audited(t), "cross_check", "verdict")


@query("""WITH k AS (SELECT doc_id, 'q' AS known, quality AS a FROM labels UNION ALL SELECT doc_id, 't', toxic FROM labels), g AS (
  SELECT doc_id, 'x' AS given, CASE WHEN doc_id % 30 = 0 THEN 1 - quality ELSE quality END AS b FROM labels UNION ALL SELECT doc_id, 'y', toxic FROM labels UNION ALL SELECT doc_id, 'z', toxic FROM labels UNION ALL SELECT doc_id, 'w', CASE WHEN doc_id % 2 = 0 THEN 1 - quality ELSE quality END FROM labels),
r AS (SELECT given, known, round(avg((a = b)::INT), 6) AS rate FROM k JOIN g USING (doc_id) GROUP BY 1, 2), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY given ORDER BY rate DESC, known) = 1)
SELECT given, known, rate, CASE WHEN rate < 0.9 THEN 'agreement' WHEN count(*) FILTER (rate >= 0.9) OVER (PARTITION BY known) > 1 THEN 'claimed' END AS problem FROM b""")
def rater_identity(t):
    """Four raters' files against two known roles: one is identified, two claim the same role, one agrees with none."""
    one = lambda role, v: t.labels.select("doc_id", F.lit(role).alias("role"), v.alias("label"))
    off = lambda n: F.when(F.col("doc_id") % n == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    known = one("q", F.col("quality")).union(one("t", F.col("toxic")))
    given = one("x", off(30)).union(one("y", F.col("toxic"))).union(one("z", F.col("toxic"))).union(one("w", off(2)))
    return A.assign_roles(known, given, "doc_id", "role", "label")


_DROPPED = "dropped AS (SELECT doc_id, source, CASE WHEN quality = 0 THEN 'quality' ELSE 'toxic' END AS reason FROM documents JOIN labels USING (doc_id) WHERE quality = 0 OR toxic = 1)"


@query(f"""WITH {_DROPPED} SELECT 'conversations' AS name, (SELECT count(*) FROM conversations) AS n_before, (SELECT count(*) FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM dropped)) AS n_kept
UNION ALL SELECT 'labels', (SELECT count(*) FROM labels), (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM dropped)) UNION ALL SELECT 'embeddings', (SELECT count(*) FROM embeddings), (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM dropped))""")
def dropped_dependents(t):
    """Rows of the tables that hang on items, before and after those of dropped items went."""
    tables = {"conversations": (t.conversations, "conv_id"), "labels": (t.labels, "doc_id"), "embeddings": (t.embeddings, "vec_id")}
    kept = A.kept_dependents(tables, dropped_ledger(t), "doc_id")
    count = lambda df, name, c: df.agg(F.count("*").alias(c)).withColumn("name", F.lit(name))
    parts = [count(tables[name][0], name, "n_before").join(count(kept[name], name, "n_kept").hint("merge"), "name") for name in tables]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH {_DROPPED}, c AS (SELECT doc_id, source FROM documents) SELECT c.source, count(*) AS n, count(*) FILTER (reason = 'quality') AS n_quality, count(*) FILTER (reason = 'toxic') AS n_toxic, count(*) FILTER (reason IS NULL) AS n_kept FROM c LEFT JOIN dropped d USING (doc_id) GROUP BY 1")
def dropped_by_source(t):
    d = t.documents.select("doc_id", "source").join(dropped_ledger(t).select("doc_id", "reason").hint("merge"), "doc_id", "left")
    n = lambda c: F.count(F.when(c, 1))
    return d.groupBy("source").agg(F.count("*").alias("n"), n(F.col("reason") == "quality").alias("n_quality"), n(F.col("reason") == "toxic").alias("n_toxic"), n(F.col("reason").isNull()).alias("n_kept"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'original' WHEN o_custkey % 3 = 0 THEN 'reperceived' WHEN o_custkey % 3 = 1 THEN 'other' ELSE 'none' END AS audit,
  CASE WHEN o_custkey % 11 = 0 THEN 'refuse' WHEN o_custkey % 2 = 0 AND o_orderstatus <> 'P' THEN 'ok' WHEN o_custkey % 2 = 1 AND o_orderstatus = 'P' THEN 'fix_both' WHEN o_custkey % 2 = 1 THEN 'fix_a' ELSE 'fix_b' END AS disagreement FROM orders""")
def verdict_rollups(t):
    c = F.col("o_custkey")
    audit = A.audit_verdict(F.col("o_orderstatus") == "F", c % 3 == 0, c % 3 == 1)
    return t.orders.select("o_orderkey", audit.alias("audit"), A.disagreement_verdict(c % 2 == 0, F.col("o_orderstatus") != "P", c % 11 != 0).alias("disagreement"))


@query("""WITH l AS (SELECT l_orderkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx, l_returnflag AS label FROM lineitem),
b AS (SELECT item, count(*) AS n_boxes, string_agg(label, '' ORDER BY idx) AS labels FROM l GROUP BY 1)
SELECT o_orderkey AS item, coalesce(n_boxes, 0) AS n_boxes, coalesce(labels, '') AS labels, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || '|' || o_orderstatus END AS easy, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || '|' || o_custkey END AS hard FROM orders LEFT JOIN b ON item = o_orderkey""")
def browse_rows(t):
    """Orders as items with their lines as boxes and the options of both variants."""
    idx = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    boxes = t.lineitem.select(F.col("l_orderkey").alias("item"), idx.alias("idx"), F.col("l_returnflag").alias("label"), *[F.col(c).alias(k) for c, k in (("l_discount", "x0"), ("l_tax", "y0"), ("l_quantity", "x1"), ("l_extendedprice", "y1"))])
    o = t.orders.withColumn("item", F.col("o_orderkey"))
    easy = o.where("item % 2 = 0").select("item", F.lit("easy").alias("variant"), F.array("o_orderpriority", "o_orderstatus").alias("options"))
    hard = o.where("item % 3 = 0").select("item", F.lit("hard").alias("variant"), F.array("o_orderstatus", F.col("o_custkey").cast("string")).alias("options"))
    rows = B.browse_rows(o.select("item"), boxes, easy.union(hard), "item")
    return rows.select("item", F.size("boxes").cast("long").alias("n_boxes"), F.array_join(F.transform("boxes", lambda x: x["label"]), "").alias("labels"), F.array_join("easy", "|").alias("easy"), F.array_join("hard", "|").alias("hard"))


@query("""WITH i AS (SELECT doc_id, lang, source, (quality IS NOT NULL)::VARCHAR AS human FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM i GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM i GROUP BY 2 UNION ALL SELECT 'human', human, count(*) FROM i GROUP BY 2""")
def browse_facets(t):
    d = t.documents.select("doc_id", "lang", "source").join(t.labels.hint("merge"), "doc_id", "left").withColumn("human", F.col("quality").isNotNull())
    return B.facet_counts(d, ["lang", "source", "human"])


_BLOB = "translate(string_agg(text, ' ' ORDER BY turn), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""WITH i AS (SELECT conv_id, {_BLOB} AS blob FROM conversations GROUP BY 1), q AS (SELECT item_id, translate(substr(text, 5, 1 + item_id % 6), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS said FROM benchmark)
SELECT item_id AS needle, conv_id, row_number() OVER (PARTITION BY item_id ORDER BY conv_id) AS rank FROM i JOIN q ON said <> '' AND contains(blob, said) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY conv_id) <= 300""")
def browse_search(t):
    """Substrings of the benchmark, of one to six characters, in the turns of whole conversations: the first 300 hits of each."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    items = t.conversations.groupBy("conv_id").agg(B.blob(F.array_join(turns, " ")).alias("blob"))
    needles = t.benchmark.select(F.col("item_id").alias("needle"), B.blob(F.expr("substring(text, 5, cast(1 + item_id % 6 AS int))")).alias("blob"))
    return B.search(items, needles, "conv_id", "needle")
