"""The pipeline's rows against a brute-force version of its five stages."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from groundset.llm import queries
from test_operators import WORD, alike, closure, slow_shingles


def test_pipeline_against_brute_force(spark, sf):
    from tokenizers import Tokenizer

    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and any(map(str.isalpha, r.text))]
    groups = defaultdict(list)
    for r in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), r.doc_id, r))
    docs = [min(g, key=lambda x: x[:2])[2] for g in groups.values()]
    sets = {r.doc_id: slow_shingles(r.text) for r in docs}
    ids = sorted(sets)
    roots = closure(ids, [(a, b) for i, b in enumerate(ids) for a in ids[:i] if alike(sets[a], sets[b])])
    docs = [r for r in docs if roots[r.doc_id] == r.doc_id]
    size = {r.doc_id: len(WORD.findall(r.text)) for r in docs}
    per = defaultdict(list)
    for r in docs:
        per[r.source].append(r.doc_id)
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {s: sum(size[i] for i in per[s]) for s in names}
    capped = set()
    while True:
        rate = (sum(total.values()) - sum(3 * total[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if 3 * total[s] < weight[s] * rate}
        if more <= capped:
            break
        capped |= more
    want = Counter()
    for s in names:
        due, start = int(min(3 * total[s], weight[s] * rate) + 0.5), 0
        for i in sorted(per[s], key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
            left = due - due // total[s] * total[s] - start
            want[i] += due // total[s] + (2 * left >= size[i])
            start += size[i]
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == +want
    tok, text = Tokenizer.from_file(queries.tokenizer_path()), {r.doc_id: r.text for r in docs}
    for r in got:
        encoded = tok.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(encoded) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, encoded)).encode()).hexdigest()


def test_pipeline_on_edge_rows(spark, tmp_path):
    """Null ids, texts, languages and sources, empty texts, repeated rows, exact and near copies, columns with inner names, a very long text; an empty table."""
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    near = " ".join(f"word{i}" for i in range(200))
    rows = [(1, "One clean text of its own, kept.", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t", "en", None), (5, "123 456 !!", "en", "a"), (6, "Twice here, the same.", "en", "b"), (6, "Twice here, the same.", "en", "b"),
            (7, "Twice  here, the\nsame.", None, "b"), (8, near, "en", None), (9, near + " end", "en", "c"), (None, "A row without an id, but with a text.", "en", "a"), (None, near.replace("word7 ", "other "), None, "c"), (10, " ".join(f"long{i % 5000}" for i in range(60_000)), "en", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(f"own {c}") for c in ("class", "bucket", "root", "key", "rank", "size", "ids", "decoded", "word", "row_key")})
    df.repartition(3).write.parquet(f"{tmp_path}/some/documents.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    # of the copies 6, 6, 7 the longest text stays, then the smallest id; of 8, 9 and the row without an id the smallest id
    texts = {1: rows[0][1], 7: rows[7][1], 8: near, 10: rows[12][1], None: rows[10][1]}
    tok = Tokenizer.from_file(queries.tokenizer_path())
    for r in got:
        encoded = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(encoded) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, encoded)).encode()).hexdigest()
    assert {r.doc_id for r in got} <= texts.keys() and max(Counter(r.doc_id for r in got).values()) <= 3
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
