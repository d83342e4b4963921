"""Text operators over the given tables."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import stats as S
from ..operators import text as T
from .registry import query

#: One capitalised word on a line is a heading in the given texts, which have no line in capitals.
TITLE = r"^[A-Z][a-z]+\.?$"
RULES = [("alpha", r"\bthe\b"), ("beta", r"tion\b"), ("gamma", r"(?i)\bder\b"), ("delta", r"[0-9]")]
_RULE_SQL = "list_filter([CASE WHEN regexp_matches(text, '\\bthe\\b') THEN 'alpha' END, CASE WHEN regexp_matches(text, 'tion\\b') THEN 'beta' END, CASE WHEN regexp_matches(text, '(?i)\\bder\\b') THEN 'gamma' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'delta' END], lambda x: x IS NOT NULL)"


@query(r"""SELECT doc_id, (i - 1)::INT AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
WHERE regexp_matches(line, '^[A-Z][a-z]+\.?$') AND NOT regexp_matches(line, '^The') AND length(line) BETWEEN 1 AND 120""")
def heading_lines(t):
    return T.lines(t.documents, "doc_id").where(T.heading(F.col("line"), [TITLE], ["^The"]))


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
m AS (SELECT *, regexp_matches(line, '^[A-Z][a-z]+\.?$') AND length(line) BETWEEN 1 AND 120 AS h FROM l),
s AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM m),
n AS (SELECT *, greatest(1, length(line) // 4) AS w, row_number() OVER (PARTITION BY doc_id, sec ORDER BY i) AS rn FROM s WHERE NOT h),
f AS (SELECT doc_id, sec, rn, line, w AS open, 0 AS part FROM n WHERE rn = 1
  UNION ALL SELECT n.doc_id, n.sec, n.rn, n.line, CASE WHEN f.open + n.w > 100 THEN n.w ELSE f.open + n.w END, f.part + (f.open + n.w > 100)::INT FROM f JOIN n ON n.doc_id = f.doc_id AND n.sec = f.sec AND n.rn = f.rn + 1),
c AS (SELECT doc_id, sec, part, regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY rn), '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g') AS text FROM f GROUP BY 1, 2, 3)
SELECT c.doc_id, coalesce(s.line, 'root') AS section, (row_number() OVER (PARTITION BY c.doc_id ORDER BY c.sec, c.part) - 1)::INT AS chunk_idx, c.text
FROM c LEFT JOIN s ON s.doc_id = c.doc_id AND s.sec = c.sec AND s.h WHERE c.text <> ''""")
def chunk_documents(t):
    return T.chunk_documents(t.documents, "doc_id", lambda line: T.heading(line, [TITLE], []), budget=100)


@query(r"""WITH RECURSIVE c AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.;])[ \t\r\f]+', '\1' || chr(10), 'g'), '[•\n]'), lambda p: regexp_replace(p, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')), lambda p: length(p) >= 1) AS c FROM documents),
n AS (SELECT doc_id, list_transform(c, lambda p: len(regexp_extract_all(p, '[^ \t\n\r\f\x0B]+'))) AS n FROM c WHERE len(c) > 0),
f AS (SELECT doc_id, 1 AS i, n[1] AS open, 0 AS "window" FROM n UNION ALL SELECT f.doc_id, i + 1, CASE WHEN open > 0 AND open + n[i + 1] > 100 THEN n[i + 1] ELSE open + n[i + 1] END, "window" + (open > 0 AND open + n[i + 1] > 100)::INT FROM f JOIN n USING (doc_id) WHERE i < len(n))
SELECT doc_id, "window", max(open)::BIGINT AS n_words, count(*) AS n_sentences FROM f GROUP BY 1, 2""")
def sentence_windows(t):
    return T.sentence_windows(t.documents, "doc_id")


@query(r"""SELECT doc_id, len(c) AS n_claims, md5(array_to_string(c, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.;])[ \t\r\f]+', '\1' || chr(10), 'g'), '[•\n]'), lambda p: regexp_replace(p, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')), lambda p: length(p) >= 15) AS c FROM documents)""")
def split_claims(t):
    c = C.split_claims(F.col("text"))
    return t.documents.select("doc_id", F.size(c).cast("long").alias("n_claims"), F.md5(F.array_join(c, "|")).alias("digest"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')) AS cleaned,
 md5(regexp_replace(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g')) AS collapsed FROM documents""")
def clean_whitespace(t):
    return t.documents.select("doc_id", F.md5(C.clean_whitespace(F.col("text"))).alias("cleaned"), F.md5(C.collapse(F.col("text"))).alias("collapsed"))


@query(r"""WITH a AS (SELECT conv_id, turn, regexp_replace(text, '([^.?!:; \t\n\r\f])[ \t\n\r\f]*[•*-][ \t]+', '\1. ', 'g') AS x FROM conversations),
b AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(x, '(^|[ \t\n\r\f])[•*-][ \t]+', '\1', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g') AS y FROM a),
c AS (SELECT conv_id, turn, upper(substr(y, 1, 1)) || substr(y, 2) AS z FROM b)
SELECT conv_id, turn, CASE WHEN z = '' OR regexp_matches(z, '[.?]$') THEN z ELSE regexp_replace(z, '[,;:!]$', '') || '.' END AS text FROM c""")
def normalize_surface(t):
    return t.conversations.select("conv_id", "turn", C.normalize_surface(F.col("text")).alias("text"))


_GATE = r"""SELECT doc_id, CASE WHEN length(text) < 140 THEN 'short' WHEN regexp_matches(substr(text, 1, 170), '(?i)table of contents|figure [0-9]|legend:') THEN 'header'
 WHEN regexp_matches(text, '^[0-9]+[ .][A-Z]') THEN 'running_head' WHEN len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1) > 0.12 THEN 'digits' WHEN regexp_matches(text, '\[[0-9]+\]|et al\.') THEN 'citations'
 WHEN len(regexp_extract_all(substr(text, 1, 120), '\p{Lu}')) / greatest(len(regexp_extract_all(substr(text, 1, 120), '\p{L}')), 1) > 0.5 THEN 'capitals'
 WHEN len(regexp_extract_all(text, '\.')) < 2 THEN 'periods' WHEN len(regexp_extract_all(text, '\p{Ll}')) / greatest(length(text), 1) < 0.66 THEN 'lower' END AS reason FROM documents"""


def _first_failure(text):
    out = None
    for name, ok in C.prose_tests(text):
        out = F.when(~ok, name) if out is None else out.when(~ok, name)
    return out


@query(f"SELECT doc_id FROM ({_GATE}) WHERE reason IS NULL")
def prose_gate(t):
    return t.documents.where(_first_failure(F.col("text")).isNull()).select("doc_id")


@query(f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM ({_GATE}) GROUP BY 1")
def prose_gate_reasons(t):
    return t.documents.groupBy(F.coalesce(_first_failure(F.col("text")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedup_exact(t):
    return T.dedup_first(t.documents.select("doc_id", "text"), "text", ["doc_id"])


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n_words, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS n_long FROM documents""")
def token_stats(t):
    one = lambda p: F.size(F.array_distinct(C.tokens(F.col("text"), p))).cast("long")
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n_words"), one("[a-z0-9]+").alias("n_tokens"), one("[a-z]{3,}").alias("n_long"))


@query(r"""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark),
p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS j FROM w a JOIN w b ON a.item_id < b.item_id)
SELECT a, b, round(j, 6) AS jaccard FROM p WHERE j >= 0.2""")
def jaccard_pairs(t):
    return T.jaccard_pairs(t.benchmark, "item_id", least=0.2)


@query(r"""WITH w AS (SELECT conv_id * 1000 + turn AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS j FROM w a JOIN w b ON a.id < b.id)
SELECT a, b, round(j, 6) AS jaccard FROM p WHERE j >= 0.15""")
def jaccard_turns(t):
    """Turns of all conversations with much the same words, whatever common words all of them share."""
    return T.jaccard_pairs(t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "id", least=0.15)


@query(r"""WITH p AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM part), v AS (SELECT DISTINCT p_type AS label, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS w FROM part),
j AS (SELECT p_partkey, label, len(list_intersect(p.w, v.w)) / (len(p.w) + len(v.w) - len(list_intersect(p.w, v.w))) AS j FROM p, v)
SELECT p_partkey, label, round(j, 6) AS jaccard FROM j WHERE j > 0 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY j DESC, label) = 1""")
def best_label_by_overlap(t):
    p = t.part.select("p_partkey", F.array_distinct(C.tokens(F.col("p_name"))).alias("w")).withColumn("word", F.explode("w"))
    labels = t.part.select(F.col("p_type").alias("label")).distinct().withColumn("lw", F.array_distinct(C.tokens(F.col("label")))).withColumn("word", F.explode("lw"))
    met = p.join(labels.hint("shuffle_hash"), "word").select("p_partkey", "label", C.jaccard(F.col("w"), F.col("lw")).alias("j")).distinct()
    best = met.groupBy("p_partkey").agg(F.min(F.struct((-F.col("j")).alias("j"), "label")).alias("b"))
    return best.select("p_partkey", "b.label", F.round(-F.col("b.j"), 6).alias("jaccard"))


CONTAINMENT_SQL = r"""WITH bw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM bw), dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM dw),
n AS (SELECT item_id, count(*) AS n FROM bg GROUP BY 1), k AS (SELECT item_id, doc_id, count(*) AS shared FROM bg JOIN dg USING (g) GROUP BY 1, 2)
SELECT item_id, doc_id, shared, round(shared / n, 6) AS containment FROM k JOIN n USING (item_id) WHERE shared / n >= 0.5"""


@query(CONTAINMENT_SQL)
def ngram_containment(t):
    return T.containment_pairs(t.benchmark, t.documents, "item_id", "doc_id")


@query(f"SELECT doc_id, array_to_string(n, ',') AS named, n[1] AS \"primary\" FROM (SELECT doc_id, {_RULE_SQL} AS n FROM documents)")
def concepts_named(t):
    return T.taxonomy(t.documents.select("doc_id", "text"), "text", RULES).select("doc_id", F.array_join("named", ",").alias("named"), "primary")


@query(f"SELECT lang, count(*) AS n, round(avg((coalesce(n[1], '') <> 'alpha')::INT), 6) AS strict_rate, round(avg((NOT list_contains(n, 'alpha'))::INT), 6) AS lenient_rate FROM (SELECT lang, {_RULE_SQL} AS n FROM documents) GROUP BY 1")
def concept_mismatch_rate(t):
    named = T.taxonomy(t.documents.select("lang", "text"), "text", RULES)
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return named.groupBy("lang").agg(F.count("*").alias("n"), rate(F.coalesce("primary", F.lit("")) != "alpha").alias("strict_rate"), rate(~F.array_contains("named", "alpha")).alias("lenient_rate"))


@query("SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'cheap' WHEN contains(p_name, 'a') THEN 'has_a' WHEN contains(p_name, 'e') THEN 'has_e' ELSE 'other' END AS facet FROM part")
def facet_bucket(t):
    return t.part.select("p_partkey", T.bucket(F.col("p_name"), {}, [("a", "has_a"), ("e", "has_e")]).alias("by_name"), "p_type").select("p_partkey", F.when(F.col("p_type") == "ECONOMY", "cheap").otherwise(F.col("by_name")).alias("facet"))


@query(r"SELECT conv_id, turn, regexp_matches(text, '(?i)(onnd|nicht|thion the|qui le)') AS abstains FROM conversations WHERE role = 'assistant'")
def abstention_flag(t):
    phrases = "|".join(("onnd", "nicht", "thion the", "qui le"))
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("text").rlike(f"(?i)({phrases})").alias("abstains"))


_TURNS = r"""WITH c AS (SELECT conv_id, turn, role, len(regexp_extract_all(text, '\S+')) AS n, lead(len(regexp_extract_all(text, '\S+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations),
q AS (SELECT conv_id, turn, n, answer FROM c WHERE role = 'user' AND next_role = 'assistant')"""


def _turns(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.select("conv_id", "turn", "role", F.regexp_count("text", F.lit(r"\S+")).alias("n"))
    return c.withColumn("answer", F.lead("n").over(w)).withColumn("next_role", F.lead("role").over(w)).where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", "n", "answer")


@query(_TURNS + """, d AS (SELECT turn % 3 AS kind, answer - n AS d, answer BETWEEN greatest(1, round_even(least(n * 0.8::DOUBLE, n - 5.0::DOUBLE), 0)::INT) AND round_even(greatest(n * 1.25::DOUBLE, n + 5.0::DOUBLE), 0)::INT AS inside FROM q),
s AS (SELECT kind, count(*) AS n, count(*) FILTER (inside) AS n_in_band, list(d ORDER BY d)::DOUBLE[] AS x FROM d GROUP BY 1), p AS (SELECT *, [greatest(1, least(n - 1, floor(p * (n + 1))))::BIGINT FOR p IN [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]] AS j FROM s WHERE n > 1)
SELECT kind, n, n_in_band, round(x[j[1]] + (0.25::DOUBLE * (n + 1) - j[1]) * (x[j[1] + 1] - x[j[1]]), 4) AS q1, round(x[j[2]] + (0.5::DOUBLE * (n + 1) - j[2]) * (x[j[2] + 1] - x[j[2]]), 4) AS median, round(x[j[3]] + (0.75::DOUBLE * (n + 1) - j[3]) * (x[j[3] + 1] - x[j[3]]), 4) AS q3 FROM p""")
def length_deviation(t):
    """Answers' deviation in words from their targets: how many lie in the band, the median and the quartiles of the sample."""
    low, high = C.length_band(F.col("n"))
    d = _turns(t).select((F.col("turn") % 3).alias("kind"), (F.col("answer") - F.col("n")).alias("d"), F.col("answer").between(low, high).alias("inside"))
    counts = d.groupBy("kind").agg(F.count(F.when(F.col("inside"), 1)).alias("n_in_band"))
    cuts = S.quantiles(d, ["kind"], "d", {"q1": 0.25, "median": 0.5, "q3": 0.75}, exclusive=True).where("n > 1")
    return cuts.join(counts.hint("merge"), "kind").select("kind", "n", "n_in_band", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")])


@query(_TURNS + " SELECT conv_id, turn, n, answer, greatest(1, round_even(least(n * 0.8::DOUBLE, n - 5.0::DOUBLE), 0)::INT) AS low, round_even(greatest(n * 1.25::DOUBLE, n + 5.0::DOUBLE), 0)::INT AS high FROM q")
def length_band(t):
    low, high = C.length_band(F.col("n"))
    return _turns(t).select("conv_id", "turn", F.col("n").cast("long").alias("n"), F.col("answer").cast("long").alias("answer"), low.alias("low"), high.alias("high"))


@query(_TURNS + """, b AS (SELECT *, answer BETWEEN greatest(1, round_even(least(n * 0.8::DOUBLE, n - 5.0::DOUBLE), 0)::INT) AND round_even(greatest(n * 1.25::DOUBLE, n + 5.0::DOUBLE), 0)::INT AS band FROM q)
SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n_candidates FROM b QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY band DESC, abs(answer - n), turn) = 1""")
def best_candidate(t):
    return T.best_candidate(_turns(t), "conv_id", F.col("answer"), F.col("n"), ["turn"]).select("conv_id", F.col("best.turn").alias("turn"), "n_candidates")


@query(r"""SELECT conv_id, turn, regexp_matches(text, '^[A-Z ]{4,}') AS header_noise, len(regexp_extract_all(text, '\S+')) < 4 AS too_short, contains(text, '?') AS asks FROM conversations""")
def quality_flags(t):
    x = F.col("text")
    return t.conversations.select("conv_id", "turn", x.rlike("^[A-Z ]{4,}").alias("header_noise"), (F.regexp_count(x, F.lit(r"\S+")) < 4).alias("too_short"), x.contains("?").alias("asks"))


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(rf"""WITH c AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations),
w AS (SELECT conv_id, turn, text, {_WORDS.format("text")} AS qw, {_WORDS.format("answer")} AS aw FROM c WHERE role = 'user' AND next_role = 'assistant')
SELECT conv_id, turn, coalesce(len(aw) > 0 AND len(list_intersect(aw, qw)) >= 0.3::DOUBLE * len(aw), false) AS telegraphs, turn > min(turn) OVER (PARTITION BY conv_id, list_sort(qw)) AS repeats,
 md5(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '\bthe\b', 'a', 'g')) AS general FROM w""")
def question_policies(t):
    """Questions that tell their answer, that repeat an earlier one of the item, and their text with general terms."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("answer"), F.lead("role").over(w).alias("next_role")).where("role = 'user' AND next_role = 'assistant'")
    told = T.telegraphed(F.col("text"), F.col("answer"), 0.3).alias("telegraphs")
    general = F.md5(T.generalized(F.col("text"), [("[0-9]+", "#"), (r"\bthe\b", "a")])).alias("general")
    return T.mark_repeats(c, "conv_id", "turn", "text").select("conv_id", "turn", told, "repeats", general)


@query(r"""WITH bw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM bw), dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM dw),
n AS (SELECT item_id, count(*) AS n_grams FROM bg GROUP BY 1), k AS (SELECT item_id, count(DISTINCT g) AS shared FROM bg JOIN dg USING (g) WHERE doc_id % 8 = item_id % 8 GROUP BY 1)
SELECT item_id, n_grams, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / n_grams, 6) AS containment FROM n LEFT JOIN k USING (item_id)""")
def packet_containment(t):
    """Each benchmark text against the union of the documents of its packet, an eighth of all."""
    b = t.benchmark.select("item_id", (F.col("item_id") % 8).alias("packet"))
    packets = b.join(t.documents.select("doc_id", (F.col("doc_id") % 8).alias("packet")).hint("merge"), "packet")
    return T.packet_containment(t.benchmark, packets, t.documents, "item_id", "doc_id")


@query("""WITH p AS (SELECT DISTINCT translate(substr(text, 1, 9), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS phrase FROM benchmark)
SELECT doc_id, EXISTS (SELECT 1 FROM p WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), phrase)) AS abstains FROM documents""")
def phrase_table_flag(t):
    """Documents that hold any phrase of a parameter table, here the beginnings of the benchmark's texts."""
    phrases = t.benchmark.select(F.substring("text", 1, 9).alias("phrase"))
    return T.holds_phrase(t.documents, phrases, "text", "phrase", "abstains").select("doc_id", "abstains")
