"""Language identification against a plain version of the same model, without Spark."""

import math
import re
from collections import Counter

import regex

from groundset.llm import langid


def plain_model(docs):
    """Log frequencies by language of the words and framed n-grams of all labelled texts."""
    langs = sorted({lang for _, lang in docs})
    words = {lang: Counter() for lang in langs}
    for text, lang in docs:
        words[lang].update(regex.findall(r"\p{L}+", text.lower()))
    tables = {"words": words}
    for n in (5, 4, 3, 2, 1):
        tables[n] = {lang: Counter() for lang in langs}
        for lang in langs:
            for word, times in words[lang].items():
                framed = f"^{word}$"
                for i in range(len(framed) - n + 1):
                    tables[n][lang][framed[i : i + n]] += times
    logs = {}
    for name, by in tables.items():
        keys = {k for c in by.values() for k in c}
        logs[name] = {k: [math.log((by[lang][k] + 0.5) / (sum(by[lang].values()) + 0.5 * len(keys))) for lang in langs] for k in keys}
    return langs, logs


def plain_answer(text, langs, logs):
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not any(c.isalpha() for w in found for c in w):
        return "und", 0.0
    total = [0.0] * len(langs)
    for word in found:
        row = logs["words"].get(word)
        if row is None:
            row = [0.0] * len(langs)
            for n in (5, 4, 3, 2, 1):
                framed = f"^{word}$"
                hits = [logs[n][g] for g in (framed[i : i + n] for i in range(len(framed) - n + 1)) if g in logs[n]]
                if hits:
                    row = [sum(h[i] for h in hits) / len(hits) for i in range(len(langs))]
                    break
        total = [a + b for a, b in zip(total, row)]
    evidence = [t / len(found) * min(len(found), 12) for t in total]
    p = [math.exp(e - max(evidence)) for e in evidence]
    best = max(range(len(langs)), key=lambda i: (p[i], -i))
    return langs[best], p[best] / sum(p)


def test_answers_are_those_of_a_plain_model(spark, sf):
    """All rows of the table, and texts of unseen words, other scripts, one word, none."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    fold = [r for r in docs.where(~langid.held_out()).collect() if r.text is not None and r.lang is not None]
    langs, logs = plain_model([(r.text, r.lang) for r in fold])
    model = langid.fit(docs, trainable=~langid.held_out(), id_col="doc_id", fit_docs=100_000)
    assert model.langs == langs and model.words.keys() == logs["words"].keys()
    more = [(-1, None), (-2, ""), (-3, "12 34 !"), (-4, "zzqqk xqzv"), (-5, "東京都 мир"), (-6, "the"), (-7, "unthinkabletionly nichtigkeiten"), (-8, "a b c d e f g h i j k l m n")]
    asked = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r for r in langid.predict(asked, model).collect()}
    assert len(got) == docs.count() + len(more)
    for r in got.values():
        lang, score = plain_answer(r.text, langs, logs)
        assert abs(r.score - score) < 2e-3 and (r.lang_pred == lang or abs(score - 1 / len(langs)) < 0.1), (r.doc_id, r.lang_pred, lang, r.score, score)
