"""The operators of this subpackage bound to the given tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_bpe, conversation, embedding_dedup, exact_dedup, html_text, langid, lm_score, mixing, quality, repeats, simhash, spelling
from .common import merge_join, stored


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizers' files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, trainable=~langid.held_out(), id_col="doc_id")
    return langid.predict(docs.select("doc_id", "text", langid.held_out().alias("held_out")), model).drop("text")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))
    return found.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.backoff_scores(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumn("kept", F.col("quality_score") >= 0.5)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def _bpe_digests(docs: DataFrame) -> DataFrame:
    found = bpe.encode_decode(docs.select("doc_id", "text"), tokenizer_path())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bpe_digests(_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(_table(spark, sf_dir, "embeddings"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.letter_runs(_table(spark, sf_dir, "documents"))
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    damaged = F.when(h % 199 == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    return spelling.variant_forms(spelling.word_counts(runs.select(damaged.alias("word"))))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, path).select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """`conversations` with the faults that operator 13 is asked to repair, dealt by the checksum of conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.where("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations")
    repaired = stored(conversation.repair(damaged_turns(given)))
    same = F.col("conv_id").eqNullSafe(F.col("conv"))
    found = merge_join(given.select("conv_id").distinct(), conversation.report(repaired), same, "left").drop("conv")
    found = merge_join(found, conversation.digests(repaired), same, "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_simhash, op3_mix, op4_stupid_backoff, op5_quality, op6_exact_dedup, op7_remove_repeats, op8_main_text, op9_bpe, op10_embedding_dedup, op11_spelling, op12_byte_bpe, op13_conversations)}


_OP3 = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nr FROM rows GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(nr % 3 + 1)::INT] AS weight FROM sources),
-- the sources that stop at their cap come first in the order of cap by weight
prefixes AS (
  SELECT *, coalesce(sum(3 * source_size) OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight,
         sum(source_size) OVER () AS total, row_number() OVER (ORDER BY 3 * source_size / weight::DOUBLE, nr) AS place
  FROM weighed WINDOW w AS (ORDER BY 3 * source_size / weight::DOUBLE, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rate AS (
  SELECT coalesce(arg_min((total - capped)::DOUBLE / open_weight::DOUBLE, place) FILTER (3 * source_size >= weight * ((total - capped)::DOUBLE / open_weight::DOUBLE)), 0.0) AS rate FROM prefixes),
targets AS (SELECT w.*, least(source_size * 3.0::DOUBLE, weight * rate) AS target FROM weighed w, rate),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, floor(t.target + 0.5) AS due, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][(t.nr % 3 + 1)::INT] AS slope,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h, r.doc_id NULLS LAST, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE
    (floor(due / source_size) * size + greatest(0, least(size, due - floor(due / source_size) * source_size - start)))::BIGINT END AS taken,
    least(start::DOUBLE / target, 1.0::DOUBLE) AS done FROM placed)
-- a document's first use begins when the schedule's integral (1 - slope) t + slope t^2 reaches the words before it
SELECT doc_id, size, source_size, target, taken,
  round(CASE WHEN taken = 0 THEN 1.0 WHEN slope = 0 THEN done
    ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * done) - (1 - slope)) / (2 * slope) END, 6) AS position
FROM counted
"""

_OP6 = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256,
         row_number() OVER () AS nr FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST, nr)
"""


_CRC = """
-- the table of CRC-32 by byte
crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)"""


def _crc32(key: str) -> str:
    """CRC-32 of the UTF-8 bytes of an SQL string, with `crc` in scope."""
    data = f"list_transform(range(strlen({key})), lambda i: ('0x' || substr(hex({key}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


_OP11 = rf"""
WITH RECURSIVE {_CRC},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
keyed AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM runs WHERE length(run) >= 6),
summed AS (SELECT run, {_crc32("key")} AS h FROM keyed, crc),
words AS (
  SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed)
  WHERE length(word) >= 6 GROUP BY 1 HAVING count(*) >= 5),
-- words that differ by one edit: one is the other without a code point, or both are equal without the one at the same place
less AS (SELECT DISTINCT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
one AS (
  SELECT l.word AS a, w.word AS b FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT x.word, y.word FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word),
near AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, {{'n': -w.n, 'b': b}}) AS b, max(w.n) AS n FROM near JOIN words w ON w.word = b GROUP BY 1),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * w.n THEN b END AS form, CASE WHEN best.n >= 5 * w.n THEN best.n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN forms f ON f.word = walk.next)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN walk ON walk.word = f.word AND walk.next IS NULL
"""

_OP13 = rf"""
WITH RECURSIVE {_CRC},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
dealt AS (SELECT conv_id, turn, role, text, {_crc32("key")} % 20 AS kind FROM given, crc),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM dealt WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM placed),
faulty AS (SELECT *, substr(role, 1, 1) AS r, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
counts AS (
  SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM faulty) GROUP BY 1),
-- states: nothing yet, after a system, a user's, an assistant's turn; insertions from one to another
inserted(q, r, c, a, o) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']),
         (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:'])),
steps(q, role, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits AS (
  SELECT conv_id, pos, q, q AS r, 2 AS c, 'D' AS a, []::VARCHAR[] AS o FROM faulty, (SELECT DISTINCT unnest([0, 1, 2, 3]) AS q)
  UNION ALL SELECT conv_id, pos, q, s.r, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', [f.role || ':' || text] FROM faulty f JOIN steps s ON s.role = f.r WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, pos, q, s.r, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R', [CASE s.role WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM faulty f, steps s WHERE s.role <> 's' AND fault IN ('', 'truncated')),
moves AS (SELECT conv_id, pos, e.q, i.r, min({{'c': e.c + i.c, 'a': e.a || i.a, 'o': e.o || i.o}}) AS best FROM edits e JOIN inserted i ON i.q = e.r GROUP BY ALL),
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, r, {{'c': c, 'a': a, 'o': o}} AS best FROM counts, inserted WHERE q = 0
  UNION ALL SELECT w.conv_id, w.pos + 1, m.r, min({{'c': w.best.c + m.best.c, 'a': w.best.a || m.best.a, 'o': w.best.o || m.best.o}})
  FROM walk w JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos + 1 AND m.q = w.r GROUP BY w.conv_id, w.pos + 1, m.r),
least AS (SELECT c.conv_id, min(best) AS best FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.pos = c.n WHERE w.r IN (0, 3) GROUP BY 1)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN least l ON l.conv_id IS NOT DISTINCT FROM g.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mix": _OP3, "op6_exact_dedup": _OP6, "op11_spelling": _OP11, "op13_conversations": _OP13}
