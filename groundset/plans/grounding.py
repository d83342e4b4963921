"""Grounding over `benchmark` (quotes and claims), `documents` (sources) and `conversations` (items)."""

from pyspark.sql import functions as F

from ..operators import ground as G
from ..operators import text as T
from .registry import query

_SPANS = """s AS (SELECT b.item_id, d.doc_id, strpos(d.text, b.text) - 1 AS char_start, strpos(d.text, b.text) - 1 + length(b.text) AS char_end, b.text AS answer, d.text AS body, d.source FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def _spans(t):
    return G.locate(t.benchmark, t.documents, "item_id", "doc_id")


@query(f"WITH {_SPANS} SELECT item_id, doc_id, char_start, char_end FROM s")
def span_locate(t):
    exact = _spans(t).join(t.benchmark.select("item_id", F.col("text").alias("quote")).hint("shuffle_hash"), "item_id").where("found = quote")
    return exact.select("item_id", "doc_id", "char_start", "char_end")


@query("""WITH q AS (SELECT item_id * 3 AS quote_id, substr(text, 3, length(text) - 5) AS quote FROM benchmark UNION ALL SELECT item_id * 3 + 1, substr(text, 4, 12) FROM benchmark UNION ALL SELECT item_id * 3 + 2, substr(text, 2, 4) FROM benchmark WHERE item_id % 10 = 0)
SELECT quote_id, doc_id, strpos(text, quote) - 1 AS char_start, strpos(text, quote) - 1 + length(quote) AS char_end FROM q JOIN documents ON contains(text, quote)""")
def span_locate_inside(t):
    """Quotes that begin and end inside words: whole benchmark texts but for their ends, twelve characters, and a few of four."""
    b = t.benchmark
    cuts = [b.select((F.col("item_id") * 3 + i).alias("quote_id"), cut.alias("text")) for i, cut in enumerate((F.expr("substring(text, 3, length(text) - 5)"), F.substring("text", 4, 12)))]
    cuts.append(b.where("item_id % 10 = 0").select((F.col("item_id") * 3 + 2).alias("quote_id"), F.substring("text", 2, 4).alias("text")))
    quotes = cuts[0].union(cuts[1]).union(cuts[2])
    found = G.locate(quotes, t.documents, "quote_id", "doc_id").join(quotes.hint("shuffle_hash"), "quote_id").where("found = text")
    return found.select("quote_id", "doc_id", "char_start", "char_end")


@query(f"""WITH {_SPANS}, d AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), k AS (SELECT s.* FROM s JOIN d USING (doc_id))
SELECT source, count(*) AS n_spans, count(DISTINCT item_id) AS n_items, count(DISTINCT doc_id) AS n_documents FROM k GROUP BY 1""")
def grounding_report(t):
    """Deduplicated documents, benchmark quotes located in them, grounded by containment, counted by source."""
    docs = T.dedup_first(t.documents.select("doc_id", "text", "source"), "text", ["doc_id"])
    spans = G.locate(t.benchmark, docs, "item_id", "doc_id")
    score = T.containment_pairs(t.benchmark, docs, "item_id", "doc_id", least=1.0).select("item_id", "doc_id")
    kept = spans.join(t.benchmark.select("item_id", F.col("text").alias("quote")).hint("shuffle_hash"), "item_id").where("found = quote").join(score.hint("merge"), ["item_id", "doc_id"], "left_semi")
    return kept.join(t.documents.select("doc_id", "source").hint("merge"), "doc_id").groupBy("source").agg(F.count("*").alias("n_spans"), F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_documents"))


@query(f"WITH {_SPANS} SELECT item_id, doc_id, char_start FROM s WHERE item_id % 3 = 0")
def provenance_mismatch(t):
    """Every third item is cited one character too far and must be reported; the others must not."""
    cited = _spans(t).join(t.benchmark.select("item_id", F.col("text").alias("answer")).hint("shuffle_hash"), "item_id").where("found = answer")
    shifted = cited.withColumn("moved", (F.col("item_id") % 3 == 0).cast("int")).withColumns({"char_start": F.col("char_start") + F.col("moved"), "char_end": F.col("char_end") + F.col("moved")})
    return G.mismatches(shifted, t.documents, "doc_id").select("item_id", "doc_id", (F.col("char_start") - F.col("moved")).alias("char_start"))


@query(f"WITH {_SPANS} SELECT count(DISTINCT (doc_id, char_start, char_end)) AS n_spans, count(DISTINCT doc_id) AS n_documents, count(DISTINCT source) AS n_sources, count(*) AS n_citations FROM s")
def citation_stats(t):
    found = _spans(t).join(t.benchmark.select("item_id", F.col("text").alias("quote")).hint("shuffle_hash"), "item_id").where("found = quote").join(t.documents.select("doc_id", "source").hint("merge"), "doc_id")
    return found.agg(F.countDistinct("doc_id", "char_start", "char_end").alias("n_spans"), F.countDistinct("doc_id").alias("n_documents"), F.countDistinct("source").alias("n_sources"), F.count("*").alias("n_citations"))


@query(r"""WITH bw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM bw), dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM dw),
n AS (SELECT item_id, count(*) AS n FROM bg GROUP BY 1), k AS (SELECT item_id, doc_id, count(*) AS shared FROM bg JOIN dg USING (g) GROUP BY 1, 2), m AS (SELECT item_id, max(round(shared / n, 6)) AS best FROM k JOIN n USING (item_id) GROUP BY 1)
SELECT item_id % 10 AS concept, count(*) AS n_sentences, round(min(best), 6) AS score, min(best) >= 0.5 AS grounded FROM m GROUP BY 1""")
def claim_gate(t):
    scores = T.containment_pairs(t.benchmark, t.documents, "item_id", "doc_id", least=0.0).select((F.col("item_id") % 10).alias("concept"), "item_id", F.col("containment").alias("score"))
    return G.claim_gate(scores, "concept", "item_id")


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS p, l_tax * 10 AS c FROM lineitem), s AS (SELECT l_orderkey, l_linenumber, max((p > 0.5 AND p > c)::INT) AS ok FROM e GROUP BY 1, 2)
SELECT l_orderkey, round(avg(ok), 6) AS "partial", min(ok) = 1 AS "strict", round(1 - avg(ok), 6) AS unsupported FROM s GROUP BY 1""")
def support_scores(t):
    return G.support(t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("p_entail"), (F.col("l_tax") * 10).alias("p_contra")), "l_orderkey", "l_linenumber")


@query("""SELECT conv_id, count(*) FILTER (role = 'user') AS n_questions, count(*) FILTER (role = 'assistant') AS n_answers, string_agg(conv_id || '#' || turn, ',' ORDER BY turn) FILTER (role = 'user') AS qids FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') > 0""")
def assemble_questions(t):
    c = t.conversations
    qid = F.when(F.col("role") == "user", F.struct("turn", F.concat(F.col("conv_id").cast("string"), F.lit("#"), F.col("turn").cast("string")).alias("qid")))
    n = lambda r: F.count(F.when(F.col("role") == r, 1))
    parts = c.groupBy("conv_id").agg(n("user").alias("n_questions"), n("assistant").alias("n_answers"), F.array_join(F.transform(F.array_sort(F.collect_list(qid)), lambda x: x["qid"]), ",").alias("qids"))
    return parts.where("n_questions > 0")


_PARTS = r"""src AS (SELECT doc_id, substr(text, 8, 60) AS quote, text FROM documents),
parts AS (
  SELECT conv_id AS item, 0 AS nr, 'recognition' AS kind, role AS question, substr(text, 1, 20) AS quote, NULL::BIGINT AS cited FROM conversations WHERE turn = 1
  UNION ALL SELECT conv_id, 1, 'doctrine', role, CASE WHEN conv_id % 4 = 0 THEN reverse(quote) WHEN conv_id % 4 = 1 THEN regexp_replace(quote, '[ \n]+', ' ' || chr(10) || ' ', 'g') ELSE quote END, conv_id FROM conversations JOIN src ON doc_id = conv_id WHERE turn = 1
  UNION ALL SELECT conv_id, 2, 'reasoning', role, quote, CASE WHEN conv_id % 5 = 0 THEN -1 ELSE conv_id END FROM conversations JOIN src ON doc_id = conv_id + conv_id % 2 WHERE turn = 1),
met AS (SELECT p.*, d.text AS body, array_to_string(list_transform(list_filter(regexp_split_to_array(p.quote, '[\t-\r ]+'), lambda w: w <> ''), lambda w: regexp_escape(w)), '[\t-\r ]+') AS pattern FROM parts p LEFT JOIN src d ON d.doc_id = p.cited),
snapped AS (SELECT *, CASE WHEN quote <> '' AND contains(body, quote) THEN quote WHEN trim(quote, chr(32) || chr(9) || chr(10) || chr(13)) <> '' THEN nullif(regexp_extract(body, pattern), '') END AS found FROM met),
told AS (SELECT item, item || '#' || nr AS qid, kind, question, CASE WHEN cited IS NULL THEN quote ELSE found END AS answer, cited, strpos(body, found) - 1 AS char_start, strpos(body, found) - 1 + length(found) AS char_end, CASE WHEN cited IS NULL THEN coalesce(quote, '') <> '' ELSE found IS NOT NULL END AS kept FROM snapped)"""


def _assembled(t):
    first = t.conversations.where("turn = 1").select(F.col("conv_id").alias("item"), F.col("role").alias("question"), "text")
    src = t.documents.select("doc_id", F.substring("text", 8, 60).alias("quote"))
    by = lambda shift: first.withColumn("doc_id", F.col("item") + shift).join(src.hint("merge"), "doc_id")
    part = lambda df, nr, kind, quote, cited: df.select("item", F.lit(nr).alias("nr"), F.lit(kind).alias("kind"), "question", quote.alias("quote"), cited.cast("long").alias("cited"))
    said = F.when(F.col("item") % 4 == 0, F.reverse("quote")).when(F.col("item") % 4 == 1, F.regexp_replace("quote", "[ \\n]+", " \n ")).otherwise(F.col("quote"))
    parts = part(first, 0, "recognition", F.substring("text", 1, 20), F.lit(None))
    parts = parts.union(part(by(0), 1, "doctrine", said, F.col("item"))).union(part(by(F.col("item") % 2), 2, "reasoning", F.col("quote"), F.when(F.col("item") % 5 == 0, -1).otherwise(F.col("item"))))
    return G.assemble(parts, t.documents, "item", "nr", "kind", "question", "quote", "cited", "doc_id")


@query(f"WITH {_PARTS} SELECT item, qid, kind, question, answer, cited, char_start, char_end, kept FROM told")
def assembled_parts(t):
    """Three parts of each conversation: one without a citation, one quoted from a document exactly, with other white space, or reversed, and one quoted
    from the cited document, another one, or with an unknown citation."""
    return _assembled(t)


@query(f"WITH {_PARTS} SELECT kind, count(DISTINCT item) AS n_items, count(*) AS n_parts, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_dropped, count(*) FILTER (kept AND cited IS NOT NULL AND substr(text, char_start + 1, char_end - char_start) <> answer) AS n_bad FROM told LEFT JOIN src ON doc_id = cited GROUP BY 1")
def assembly_report(t):
    return G.assembly_report(_assembled(t), t.documents, "item", "kind", "cited", "doc_id")


@query("""SELECT c.conv_id, c.turn, CASE WHEN l.toxic = 1 AND c.role = 'assistant' THEN 'withheld' ELSE c.role END AS role FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id""")
def replace_by_type(t):
    patch = t.labels.where("toxic = 1").select(F.col("doc_id").alias("conv_id"), F.lit("assistant").alias("kind"), F.lit("withheld").alias("role"))
    items = t.conversations.select("conv_id", "turn", F.col("role").alias("kind"), "role")
    return G.replace_elements(items, patch, "conv_id", "kind", "role").drop("kind")


@query("""SELECT c.conv_id, any_value(d.source) AS attached, count(*) AS n FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id AND d.lang = 'en' GROUP BY 1""")
def attach_question(t):
    side = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("conv_id"), F.col("source").alias("attached"))
    items = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    return items.join(side.hint("merge"), "conv_id", "left")


@query("""SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'review' END, d.source) AS source, l.quality IS NOT NULL AND l.quality <> (d.n_chars > 500)::INT AS flagged FROM documents d LEFT JOIN labels l USING (doc_id)""")
def apply_patch_verdicts(t):
    d = t.documents.select("doc_id", "source", "n_chars").join(t.labels.hint("merge"), "doc_id", "left")
    flagged = F.coalesce(F.col("quality") != (F.col("n_chars") > 500).cast("int"), F.lit(False))
    return d.select("doc_id", F.coalesce(F.when(F.col("quality") == 0, "review"), F.col("source")).alias("source"), flagged.alias("flagged"))


@query("""WITH q AS (SELECT item_id, item_id % 5 AS concept, CASE WHEN item_id % 4 = 3 THEN reverse(text) ELSE text END AS quote, item_id % 3 = 0 AS base, substr(text, 1, 6) AS question FROM benchmark), f AS (SELECT * FROM q WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, quote))),
u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY concept, question ORDER BY base DESC, item_id) = 1) SELECT concept, item_id, base FROM u QUALIFY row_number() OVER (PARTITION BY concept ORDER BY base DESC, item_id) <= 4""")
def facet_inventory(t):
    """Quotes that are in no source go; the base facet comes first; a question is asked once; four of a concept stay."""
    quote = F.when(F.col("item_id") % 4 == 3, F.reverse("text")).otherwise(F.col("text"))
    q = t.benchmark.select("item_id", (F.col("item_id") % 5).alias("concept"), quote.alias("text"), (F.col("item_id") % 3 == 0).alias("base"), F.substring("text", 1, 6).alias("question"))
    found = G.locate(q.select("item_id", "text"), t.documents, "item_id", "doc_id").select("item_id", "found").distinct()
    held = q.join(found.hint("merge"), "item_id").where("found = text").select("item_id", "concept", "base", "question")
    return G.inventory(held, "concept", "question", "base", "item_id", 4).select("concept", "item_id", "base")


@query("""WITH u AS (SELECT p_brand, p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2) SELECT p_brand, p_partkey FROM u QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 4""")
def facet_inventory_cap(t):
    distinct = t.part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("p_partkey"))
    return G.capped(distinct, "p_brand", ["p_partkey"], 4).select("p_brand", "p_partkey")


#: Words that an answer seldom ends with.
STOP = "the a an of to and or in on at for with by from that which is are it be as".split()
_STOP = ", ".join(f"'{w}'" for w in STOP)


@query(rf"""WITH {_SPANS}, c AS (SELECT item_id, doc_id, substr(answer, 1, 40) AS cut, substr(body, (char_start + 41)::BIGINT, 200) AS tail FROM s WHERE length(answer) > 40), x AS (SELECT *, regexp_extract(cut, '([A-Za-z]+)\W*$', 1) AS last, regexp_extract(tail, '^[^.!?)\]]*[.!?)\]]') AS more FROM c)
SELECT item_id, doc_id, CASE WHEN lower(last) IN ({_STOP}) AND more <> '' THEN cut || more ELSE cut END AS answer, lower(last) IN ({_STOP}) AND more <> '' AS extended FROM x""")
def extend_truncated_span(t):
    """Spans cut off after 40 characters: those that end in a stop word go on to the next end of a sentence within 200 characters."""
    spans = _spans(t).join(t.benchmark.select("item_id", F.col("text").alias("quote")).hint("shuffle_hash"), "item_id").where("found = quote AND length(quote) > 40")
    c = spans.join(t.documents.select("doc_id", "text").hint("merge"), "doc_id").select("item_id", "doc_id", F.substring("quote", 1, 40).alias("cut"), F.expr("substring(text, cast(char_start + 41 AS int), 200)").alias("tail"))
    fixed = G.repaired_span(F.col("cut"), F.col("tail"), STOP)
    return c.select("item_id", "doc_id", fixed.alias("answer"), (fixed != F.col("cut")).alias("extended"))


@query(rf"""WITH {_SPANS}, e AS (SELECT item_id, doc_id, char_start + length(regexp_extract(answer, '^[^.?!]*[.?!]')) AS char_end, body FROM s), x AS (SELECT item_id, doc_id, regexp_extract(substr(body, (char_end + 1)::BIGINT), '^[ 	

]*([A-Z][^.?!]{{14,}}[.?!])', 1) AS sentence FROM e) SELECT item_id, doc_id, sentence FROM x WHERE sentence <> '' AND len(regexp_extract_all(sentence, '\S+')) <= 40""")
def append_next_sentence(t):
    """The sentence after the first sentence of each located passage."""
    spans = _spans(t).join(t.benchmark.select("item_id", F.col("text").alias("quote")).hint("shuffle_hash"), "item_id").where("found = quote")
    end = F.col("char_start") + F.length(F.regexp_extract("quote", "^[^.?!]*[.?!]", 0))
    rest = spans.withColumn("end", end).join(t.documents.select("doc_id", "text").hint("merge"), "doc_id").select("item_id", "doc_id", F.expr("substring(text, cast(end + 1 AS int))").alias("rest"))
    sentence = rest.select("item_id", "doc_id", F.regexp_extract("rest", r"^[ \t\n\r]*([A-Z][^.?!]{14,}[.?!])", 1).alias("sentence"))
    return sentence.where((F.col("sentence") != "") & (F.regexp_count("sentence", F.lit(r"\S+")) <= 40))
