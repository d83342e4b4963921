"""Scores and statistics: predictions from `orders`, ratings from `labels` and `lineitem`, clusters from `events`."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import stats as S
from ..operators import text as T
from .registry import query
from .texts import RULES

_PRED = """p AS (SELECT o_orderkey, o_orderpriority, o_orderstatus AS gold, CASE ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 4 WHEN 0 THEN NULL WHEN 1 THEN 'F' WHEN 2 THEN o_orderstatus ELSE 'O' END AS pred, o_custkey % 3 + 1 AS severity FROM orders)"""
_Z = "1.96::DOUBLE"


def _predictions(t):
    h = C.md5_int(F.col("o_orderkey").cast("string")) % 4
    pred = F.when(h == 0, None).when(h == 1, "F").when(h == 2, F.col("o_orderstatus")).otherwise("O")
    return t.orders.select("o_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("gold"), pred.alias("pred"), (F.col("o_custkey") % 3 + 1).alias("severity"))


@query(f"WITH {_PRED} SELECT o_orderpriority, count(*) AS n, sum((coalesce(pred = gold, false))::INT)::BIGINT AS n_right, round(avg((coalesce(pred = gold, false))::INT), 6) AS accuracy FROM p GROUP BY 1")
def accuracy(t):
    return S.accuracy(_predictions(t), ["o_orderpriority"], "pred", "gold").select("o_orderpriority", "n", "n_right", "accuracy")


@query(f"""WITH {_PRED}, g AS (SELECT o_orderpriority, count(*)::DOUBLE AS n, sum((coalesce(pred = gold, false))::INT)::DOUBLE AS k FROM p GROUP BY 1), q AS (SELECT *, (k / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) AS mid, {_Z} * sqrt((k / n) * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n) AS half FROM g)
SELECT o_orderpriority, round(mid - half, 6) AS low, round(mid + half, 6) AS high FROM q""")
def wilson_ci(t):
    return S.accuracy(_predictions(t), ["o_orderpriority"], "pred", "gold").select("o_orderpriority", "low", "high")


@query(f"WITH {_PRED} SELECT count(*) AS n_groups, round(avg(m), 6) AS macro FROM (SELECT o_orderpriority, avg((coalesce(pred = gold, false))::INT) AS m FROM p GROUP BY 1)")
def macro_accuracy(t):
    return S.macro(_predictions(t), "o_orderpriority", F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)).cast("int"))


_RISK = f"""WITH {_PRED}, g AS (SELECT o_orderpriority, count(*) AS n, count(pred) AS a, count(*) FILTER (pred <> gold) AS w, coalesce(sum(severity) FILTER (pred <> gold), 0) AS s FROM p GROUP BY 1)"""


@query(_RISK + " SELECT o_orderpriority, round(s / a, 6) AS risk FROM g")
def risk_weighted_error(t):
    return S.risk(_predictions(t), ["o_orderpriority"], F.col("pred") != F.col("gold"), F.col("pred").isNotNull(), F.col("severity")).select("o_orderpriority", "risk")


@query(_RISK + " SELECT o_orderpriority, n, round(a / n, 6) AS coverage, round(w / a, 6) AS error FROM g")
def coverage_risk(t):
    return S.risk(_predictions(t), ["o_orderpriority"], F.col("pred") != F.col("gold"), F.col("pred").isNotNull(), F.col("severity")).select("o_orderpriority", "n", "coverage", "error")



@query("""WITH d AS (SELECT l_suppkey, count(*) FILTER (l_quantity > 45) AS b, count(*) FILTER (l_quantity < 5) AS c FROM lineitem GROUP BY 1), t AS (SELECT *, (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::DOUBLE))) FROM range(0, least(b, c) + 1) r(i)) AS tail FROM d)
SELECT l_suppkey, b, c, round(least(1.0, 2 * tail), 6) AS p FROM t""")
def mcnemar_exact(t):
    n = lambda c: F.count(F.when(c, 1))
    d = t.lineitem.groupBy("l_suppkey").agg(n(F.col("l_quantity") > 45).alias("b"), n(F.col("l_quantity") < 5).alias("c"))
    return d.withColumn("p", S.mcnemar(F.col("b"), F.col("c")))


_AC1 = """c AS (SELECT item, label, count(*) AS n FROM r WHERE label IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY item) AS r FROM c QUALIFY r > 1), a AS (SELECT item, sum(n * (n - 1) / (r * (r - 1))) AS agree FROM s GROUP BY 1),
pa AS (SELECT avg(agree) AS pa, count(*) AS n_items FROM a), pi AS (SELECT label, sum(n / r) / any_value(n_items) AS pi FROM s, pa GROUP BY 1), e AS (SELECT sum(pi * (1 - pi)) / (count(*) - 1) AS pe FROM pi)
SELECT n_items, round(pa, 6) AS observed, round((pa - pe) / (1 - pe), 6) AS ac1 FROM pa, e"""


@query("WITH r AS (SELECT doc_id AS item, quality AS label FROM labels UNION ALL SELECT doc_id, 1 - toxic FROM labels), " + _AC1)
def gwet_ac1_binary(t):
    r = t.labels.select(F.col("doc_id").alias("item"), F.col("quality").alias("label")).union(t.labels.select("doc_id", 1 - F.col("toxic")))
    return S.ac1(r, "item", "label")


@query("WITH r AS (SELECT l_orderkey AS item, l_returnflag AS label FROM lineitem), " + _AC1)
def gwet_ac1_multi(t):
    return S.ac1(t.lineitem, "l_orderkey", "l_returnflag")


@query("""WITH c AS (SELECT user_id, sum(value) AS s, count(value) AS n, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM events GROUP BY 1), k AS (SELECT count(*) AS k FROM c),
d AS (SELECT rep, ('0x' || substr(md5('boot' || rep || '-' || idx), 1, 8))::BIGINT % k AS idx FROM c, k, range(1, 1001) r(rep)), m AS (SELECT rep, sum(s) / sum(n) AS m FROM d JOIN c USING (idx) GROUP BY 1)
SELECT (SELECT round(sum(s) / sum(n), 6) FROM c) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def cluster_bootstrap_ci(t):
    return S.cluster_bootstrap(t.events, "user_id", "value", reps=1000)


@query("""WITH j AS (SELECT o_orderpriority, o_custkey % 5 AS a, (o_custkey + o_orderkey % 3) % 5 AS b FROM orders), r AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY a) + (count(*) OVER (PARTITION BY o_orderpriority, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY o_orderpriority ORDER BY b) + (count(*) OVER (PARTITION BY o_orderpriority, b) - 1) / 2.0::DOUBLE AS rb FROM j)
SELECT o_orderpriority, count(*) AS n, round(corr(a, b), 4) AS pearson, round(corr(ra, rb), 4) AS spearman, round(avg((abs(a - b) <= 1)::INT), 6) AS within_one, round(avg(abs(a - b)), 6) AS mae FROM r GROUP BY 1""")
def judge_agreement(t):
    j = t.orders.select("o_orderpriority", (F.col("o_custkey") % 5).alias("a"), ((F.col("o_custkey") + F.col("o_orderkey") % 3) % 5).alias("b"))
    return S.judge_agreement(j, ["o_orderpriority"], "a", "b")


@query("""SELECT l_orderkey, count(*) AS n_claims, count(*) FILTER (l_returnflag = 'A') AS n_unsupported, count(*) FILTER (l_returnflag = 'R') AS n_contradicted, bool_or(l_tax > 0.07) AS premise_error FROM lineitem GROUP BY 1""")
def claim_metrics(t):
    claims = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("label"), "l_tax")).alias("claims"))
    n = lambda x: F.size(F.filter("claims", lambda c: c["label"] == x)).cast("long")
    return claims.select("l_orderkey", F.size("claims").cast("long").alias("n_claims"), n("A").alias("n_unsupported"), n("R").alias("n_contradicted"), F.exists("claims", lambda c: c["l_tax"] > 0.07).alias("premise_error"))


@query("""SELECT l_returnflag, round(sum(l_tax) / sum(l_discount), 6) AS micro, round(avg(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END), 6) AS macro FROM lineitem GROUP BY 1""")
def micro_macro_rates(t):
    return S.micro_macro(t.lineitem, ["l_returnflag"], "l_tax", "l_discount")


@query("""WITH i AS (SELECT l_orderkey, l_linestatus AS arm, bool_and(l_returnflag <> 'R' AND l_tax <= 0.07) AS clean FROM lineitem GROUP BY 1, 2) SELECT arm, count(*) AS n, round(avg(clean::INT), 6) AS rate FROM i GROUP BY 1""")
def clean_rate(t):
    i = t.lineitem.groupBy("l_orderkey", F.col("l_linestatus").alias("arm")).agg(F.bool_and((F.col("l_returnflag") != "R") & (F.col("l_tax") <= 0.07)).alias("clean"))
    return i.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg(F.col("clean").cast("int")), 6).alias("rate"))


@query("""WITH q AS (SELECT quantile_cont(n_chars, 1 / 3.0::DOUBLE) AS a, quantile_cont(n_chars, 2 / 3.0::DOUBLE) AS b FROM documents) SELECT lang, CASE WHEN n_chars <= a THEN 1 WHEN n_chars <= b THEN 2 ELSE 3 END AS tertile, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents, q GROUP BY 1, 2""")
def tertile_rates(t):
    q = S.quantiles(t.documents, [], "n_chars", {"a": 1 / 3, "b": 2 / 3}).drop("n")
    tertile = F.when(F.col("n_chars") <= F.col("a"), 1).when(F.col("n_chars") <= F.col("b"), 2).otherwise(3)
    return t.documents.crossJoin(F.broadcast(q)).groupBy("lang", tertile.alias("tertile")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"))  # q is one row


@query("""WITH w AS (SELECT conv_id, avg(length(text)) FILTER (role = 'user') AS a, avg(length(text)) FILTER (role = 'assistant') AS b FROM conversations GROUP BY 1) SELECT count(*) AS n, round(avg(b - a), 6) AS mean_difference, round(avg((a <> b)::INT), 6) AS share_changed FROM w WHERE a IS NOT NULL AND b IS NOT NULL""")
def probe_pairs(t):
    one = lambda r: F.avg(F.when(F.col("role") == r, F.length("text")))
    w = t.conversations.groupBy("conv_id").agg(one("user").alias("a"), one("assistant").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return w.agg(F.count("*").alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean_difference"), F.round(F.avg((F.col("a") != F.col("b")).cast("int")), 6).alias("share_changed"))


@query("""WITH w AS (SELECT l_suppkey % 3 AS judge, l_orderkey, avg(l_quantity) FILTER (l_linestatus = 'O') AS a, avg(l_quantity) FILTER (l_linestatus = 'F') AS b FROM lineitem GROUP BY 1, 2), n AS (SELECT judge, count(*) AS n_items FROM w GROUP BY 1),
p AS (SELECT judge, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a - b), 6) AS difference, count(*) FILTER (a > b) AS wins, count(*) FILTER (a = b) AS ties, count(*) FILTER (a < b) AS losses FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1) SELECT * FROM n JOIN p USING (judge)""")
def paired_comparison(t):
    rows = t.lineitem.withColumn("judge", F.col("l_suppkey") % 3)
    return S.paired(rows, "l_orderkey", "l_linestatus", "l_quantity", ("O", "F"), "judge")


@query("""WITH w AS (SELECT l_orderkey % 97 AS cluster, l_orderkey, avg(l_quantity) FILTER (l_linestatus = 'O') - avg(l_quantity) FILTER (l_linestatus = 'F') AS d FROM lineitem GROUP BY 1, 2), c AS (SELECT cluster, sum(d) AS s, count(d) AS n, row_number() OVER (ORDER BY cluster) - 1 AS idx FROM w WHERE d IS NOT NULL GROUP BY 1), k AS (SELECT count(*) AS k FROM c),
d AS (SELECT rep, ('0x' || substr(md5('boot' || rep || '-' || idx), 1, 8))::BIGINT % k AS idx FROM c, k, range(1, 1001) r(rep)), m AS (SELECT rep, sum(s) / sum(n) AS m FROM d JOIN c USING (idx) GROUP BY 1)
SELECT (SELECT round(sum(s) / sum(n), 6) FROM c) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def paired_difference_ci(t):
    rows = t.lineitem.withColumn("cluster", F.col("l_orderkey") % 97)
    return S.paired_interval(rows, "l_orderkey", "cluster", "l_linestatus", "l_quantity", ("O", "F"))


@query(rf"""WITH x AS (SELECT role, CASE turn % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'mcq' WHEN 2 THEN 'closed_set' ELSE 'self_pick' END AS mode, regexp_matches(text, '\bthe\b') AS ok FROM conversations),
g AS (SELECT role AS generator, mode, count(*)::DOUBLE AS n, count(*) FILTER (NOT ok)::DOUBLE AS k FROM x GROUP BY 1, 2), q AS (SELECT *, (k / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) AS mid, {_Z} * sqrt((k / n) * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n) AS half FROM g)
SELECT generator, mode, n::BIGINT AS n, round(k / n, 6) AS rate, round(mid - half, 6) AS low, round(mid + half, 6) AS high FROM q""")
def generator_error_rates(t):
    mode = F.element_at(F.array(*map(F.lit, ("open", "mcq", "closed_set", "self_pick"))), (F.col("turn") % 4 + 1).cast("int"))
    named = T.taxonomy(t.conversations.select("role", "text", mode.alias("mode")), "text", RULES)
    r = named.groupBy(F.col("role").alias("generator"), "mode").agg(F.count("*").alias("n"), F.count(F.when(~F.array_contains("named", "alpha"), 1)).alias("k"))
    low, high = C.wilson(F.col("k"), F.col("n"))
    return r.select("generator", "mode", "n", F.round(F.col("k") / F.col("n"), 6).alias("rate"), low.alias("low"), high.alias("high"))


@query("""WITH k AS (SELECT count(DISTINCT o_orderpriority) AS k FROM orders) SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS n_runs FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT k FROM k)""")
def complete_judges(t):
    k = t.orders.agg(F.countDistinct("o_orderpriority").alias("k"))
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("n_runs"))
    return per.join(F.broadcast(k), F.col("n_runs") == F.col("k")).drop("k")  # k is one row


@query("""SELECT source, count(*) AS n, round(100 * avg(quality), 4) AS percent_correct, round(avg(toxic), 6) AS severity FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def rater_report(t):
    j = t.labels.join(t.documents.select("doc_id", "source").hint("merge"), "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.round(100 * F.avg("quality"), 4).alias("percent_correct"), F.round(F.avg("toxic"), 6).alias("severity"))


_TAIL = "round(least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::DOUBLE))) FROM range(0, least(b, c) + 1) r(i))), 6)"


@query(f"""WITH {_PRED}, x AS (SELECT o_orderpriority, coalesce(pred = gold, false) AS a, coalesce('O' = gold, false) AS s, coalesce(CASE WHEN o_orderkey % 9 = 0 THEN 'F' ELSE pred END = gold, false) AS f, pred IS NULL AS n FROM p),
g AS (SELECT o_orderpriority, round(avg(a::INT), 6) AS baseline, round(avg(n::INT), 6) AS abstain, round(avg(s::INT), 6) AS swapped, round(avg(s::INT) - avg(a::INT), 6) AS swapped_delta, round(avg(f::INT), 6) AS first_only, round(avg(f::INT) - avg(a::INT), 6) AS first_only_delta,
count(*) FILTER (a AND NOT s) AS sb, count(*) FILTER (s AND NOT a) AS sc, count(*) FILTER (a AND NOT f) AS fb, count(*) FILTER (f AND NOT a) AS fc FROM x GROUP BY 1),
sp AS (SELECT o_orderpriority, {_TAIL} AS swapped_p FROM (SELECT o_orderpriority, sb AS b, sc AS c FROM g)), fp AS (SELECT o_orderpriority, {_TAIL} AS first_only_p FROM (SELECT o_orderpriority, fb AS b, fc AS c FROM g))
SELECT g.* EXCLUDE (sb, sc, fb, fc), swapped_p, first_only_p FROM g JOIN sp USING (o_orderpriority) JOIN fp USING (o_orderpriority)""")
def control_report(t):
    first = F.when(F.col("o_orderkey") % 9 == 0, "F").otherwise(F.col("pred"))
    arms = _predictions(t).withColumns({"swap": F.lit("O"), "first": first})
    return S.control_table(arms, ["o_orderpriority"], "gold", "pred", {"swapped": "swap", "first_only": "first"})


_POOL = f"""WITH {_PRED}, u AS (SELECT o_orderpriority, pred, pred <> gold AS wrong, severity FROM p UNION ALL SELECT o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN 'answered' END, true, severity FROM p WHERE gold = 'P'),
w(scheme, s1, s2, s3) AS (VALUES ('flat', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), ('default', 1, 2, 3), ('convex', 1, 4, 9))"""


@query(_POOL + " SELECT o_orderpriority, scheme, count(pred) AS n_answered, round(coalesce(sum(CASE severity WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END) FILTER (wrong AND pred IS NOT NULL), 0) / count(pred), 6) AS risk FROM u, w GROUP BY 1, 2")
def risk_by_scheme(t):
    """Weighted wrong answers over the answered, of predictions and refusals together; a refusal that was answered is always wrong."""
    p = _predictions(t)
    pool = p.select("o_orderpriority", "pred", (F.col("pred") != F.col("gold")).alias("wrong"), "severity")
    refused = p.where("gold = 'P'").select("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, "answered").alias("pred"), F.lit(True).alias("wrong"), "severity")
    schemes = {"flat": {1: 1, 2: 1, 3: 1}, "default": {1: 1, 2: 2, 3: 3}, "convex": {1: 1, 2: 4, 3: 9}}
    return S.risk_schemes(pool.union(refused), ["o_orderpriority"], F.col("wrong"), F.col("pred").isNotNull(), F.col("severity"), schemes)


@query("""WITH i AS (SELECT l_orderkey, bool_and(l_returnflag <> 'R' AND l_tax <= 0.07) FILTER (l_linestatus = 'F') AS a, bool_and(l_returnflag <> 'R' AND l_tax <= 0.07) FILTER (l_linestatus = 'O') AS c FROM lineitem GROUP BY 1), n AS (SELECT count(*) AS n_items, count(*) FILTER (a AND NOT c) AS only_first, count(*) FILTER (c AND NOT a) AS only_second FROM i WHERE a IS NOT NULL AND c IS NOT NULL)
SELECT *, round(least(1.0, 2 * (SELECT sum(exp(lgamma(only_first + only_second + 1) - lgamma(i + 1) - lgamma(only_first + only_second - i + 1) - (only_first + only_second) * ln(2.0::DOUBLE))) FROM range(0, least(only_first, only_second) + 1) r(i))), 6) AS p FROM n""")
def clean_pairs(t):
    """Items that are clean in one arm as a whole and not in the other."""
    rows = t.lineitem.select("l_orderkey", "l_linestatus", ((F.col("l_returnflag") != "R") & (F.col("l_tax") <= 0.07)).alias("clean"))
    return S.clean_pairs(rows, "l_orderkey", "l_linestatus", "clean", ("F", "O")).withColumn("p", F.round("p", 6))
