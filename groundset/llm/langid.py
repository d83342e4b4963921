"""Language identification: word frequencies first, then ever shorter character n-grams for unseen words."""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh, stored

#: Bound of the classifier: labelled documents that it is fitted on, in expectation. Its words and grams are all of theirs.
FIT_DOCS = 4_000
LENGTHS = (5, 4, 3, 2, 1)
SMOOTH = 0.5
#: Words after which more text makes the score no surer.
SURE_WORDS = 12
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_SLOTS = 1 << 16


@dataclass
class LanguageModel:
    """Log frequencies by language: a row of `words` or `grams[n]` for each key. Bounded by the sample it is fitted on."""

    langs: list[str]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: dict[int, dict[str, int]]
    gram_rows: dict[int, np.ndarray]


def _table(counted: DataFrame, langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Keys by row, and their log frequencies by language; `counted` (lang, key, n) is bounded by the sample."""
    found = counted.toArrow()
    at, place = found["lang"].combine_chunks().dictionary_encode(), found["key"].combine_chunks().dictionary_encode()
    keys = place.dictionary.to_pylist()
    order = np.array([langs.index(x) for x in at.dictionary.to_pylist()], np.int64)
    counts = np.zeros((len(keys), len(langs)))
    if len(found):
        counts[place.indices.to_numpy(), order[at.indices.to_numpy()]] = found["n"].to_numpy()
    total = counts.sum(0) + SMOOTH * max(1, len(keys))
    return {x: i for i, x in enumerate(keys)}, np.log((counts + SMOOTH) / total).astype(np.float32)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", trainable: Column | None = None, id_col: str | None = None, fit_docs: int = FIT_DOCS) -> LanguageModel:
    """Count words and character n-grams by language over a bounded sample of the labelled rows.

    The sample takes the same number of documents of each language, `fit_docs` in all, by a hash of the row (`id_col`, where given, and
    the text): the same rows at every run, and copies of a text come or stay one by one if their ids differ. Counting is a
    Spark job; every word and n-gram of the sample becomes part of the model, which the sample bounds.
    Rows with a null text or label are passed over; repeated rows count each; without any labelled row the model is empty.
    """
    row = F.xxhash64(*([id_col] if id_col else []), text_col)
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), row.alias("row"), (F.lit(True) if trainable is None else trainable).alias("use")).where("use AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(fit_docs)  # so many documents can't show more languages
    share = F.broadcast(cut(sizes.select("lang", (F.lit(float(fit_docs)) / F.count("*").over(W.partitionBy()) / F.col("n")).alias("share"))))
    sample = stored(labelled.join(share, "lang").where(F.pmod("row", F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "text"))
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # at most one for each sampled row
    if not langs:
        return LanguageModel([], {}, np.zeros((0, 0), np.float32), {}, {})
    words = cut(sample.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n")))
    known, word_rows = _table(words, langs)
    grams, gram_rows = {}, {}
    framed = words.withColumn("w", F.concat(F.lit("^"), F.col("key"), F.lit("$"))).withColumn("size", F.length("w"))
    for n in LENGTHS:
        cuts = framed.where(F.col("size") >= n).select("lang", "n", F.explode(F.expr(f"transform(sequence(1, size - {n - 1}), i -> substring(w, i, {n}))")).alias("key"))
        grams[n], gram_rows[n] = _table(cuts.groupBy("lang", "key").agg(F.sum("n").alias("n")), langs)
    return LanguageModel(langs, known, word_rows, grams, gram_rows)


class _Scorer:
    """Scores texts under a model; rows of unseen words are kept in a bounded table."""

    def __init__(self, model: LanguageModel):
        self.model, self.base = model, len(model.word_rows)
        self.rows = np.vstack([model.word_rows, np.zeros((_SLOTS, len(model.langs)), np.float32)])
        self.unseen: dict[str, int] = {}

    def backoff(self, word: str) -> np.ndarray:
        """The mean row of the longest n-grams of which the model knows any."""
        framed = f"^{word}$"
        for n in LENGTHS:
            known = self.model.grams[n]
            hits = [known[g] for g in (framed[i : i + n] for i in range(len(framed) - n + 1)) if g in known]
            if hits:
                return self.model.gram_rows[n][hits].mean(0)
        return np.zeros(len(self.model.langs), np.float32)

    def slot(self, word: str) -> int:
        at = self.unseen.get(word)
        if at is None:
            at = self.base + len(self.unseen)
            self.unseen[word] = at
            self.rows[at] = self.backoff(word)
        return at

    def __call__(self, text: str | None) -> tuple[str, float]:
        counts = Counter(_WORD.findall(text.lower())) if text else {}
        if not any(c.isalpha() for w in counts for c in w) or not self.model.langs:
            return UNDETERMINED, 0.0
        total, n, words = np.zeros(len(self.model.langs)), 0, list(counts)
        known = self.model.words
        for start in range(0, len(words), _SLOTS // 2):
            part = words[start : start + _SLOTS // 2]
            if len(self.unseen) > _SLOTS // 2:
                self.unseen.clear()
            at = [known[w] if w in known else self.slot(w) for w in part]
            weights = np.array([counts[w] for w in part], np.float64)
            total += weights @ self.rows[at]
            n += weights.sum()
        evidence = total / n * min(n, SURE_WORDS)
        p = np.exp(evidence - evidence.max())
        best = int(p.argmax())
        return self.model.langs[best], float(p[best] / p.sum())


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with a predicted language and a score from 0 to 1, from the text alone and from all of it.

    `und` with score 0 if the text is null, empty or has no letter, or if the model is empty. Ties go to the first language by name.
    Repeated rows get the same answer; columns named as `into` are replaced, all others kept; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample of fit()

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(shared.value)  # its table of unseen words serves a whole task
        for texts in batches:
            yield pd.DataFrame([scorer(t) for t in texts], columns=["lang", "score"])

    told = fresh(docs, "lid")
    found = docs.withColumn(told, run.asNondeterministic()(F.col(text_col)))  # or a filter on the answer would ask twice
    return found.withColumns({into[0]: F.col(told)["lang"], into[1]: F.col(told)["score"]}).drop(told)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that must not be learned from: crc32 of the id as text leaves 2 modulo 4. Null ids are not in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` whose language can be told, with their columns; a null language is filled in with the predicted one.

    Rows go whose text is null or empty or has no letter (prediction `und`). Without a labelled row there is no model: rows with a
    letter stay as they are. Repeated rows are judged each; other columns are kept whatever their names; an empty table stays empty.
    """
    model = fit(docs, text_col, lang_col, ~held_out(id_col), id_col)
    if not model.langs:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = predict(docs, model, text_col, (pred, score)).where(F.col(pred) != UNDETERMINED)
    return found.withColumn(lang_col, F.coalesce(F.col(lang_col), F.col(pred))).select(*docs.columns)
