"""Quality classifier by co-training a text view and a page-metadata view."""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import stored

#: Bounds of the classifier: labelled rows that it is fitted on, hashed words, rounds; and the shards in which pseudo-labelled rows are averaged.
FIT_ROWS, BUCKETS, ROUNDS, SHARDS = 6_000, 1 << 15, 3, 2
#: Only predictions at least so sure become pseudo-labels; their weight beside the true labels of a view.
SURE, TRUST = 0.95, 0.3
_TOKEN = re.compile(r"[^ \t-\r]+")


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of the whole text with damped counts, of length 1; and the same hash for the last character's kind."""
    counts = Counter(_TOKEN.findall(text)) if text else Counter()
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at = np.fromiter((xxh32_intdigest(w) % BUCKETS for w in counts), np.int32, len(counts))
    n = np.fromiter(counts.values(), np.float64, len(counts))
    value = np.log1p(n)
    return at, (value / np.sqrt((value**2).sum())).astype(np.float32)


META = 16 + 32 + 20


def meta_features(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """What is known of a page besides its words: hashed language and source, and the layout of the whole text."""
    x = np.zeros(META, np.float32)
    x[xxh32_intdigest(lang or "") % 16] = 1
    x[16 + xxh32_intdigest(source or "") % 32] = 1
    text = text or ""
    n = max(1, len(text))
    tokens = _TOKEN.findall(text)
    words = max(1, len(tokens))
    lines = text.split("\n")
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    digits = sum(map(str.isdigit, text))
    spaces = sum(map(str.isspace, text))
    signs = n - letters - digits - spaces if text else 0
    shape = (np.log1p(len(text)) / 10, letters / n, upper / n, digits / n, signs / n, len(set(tokens)) / words, n / words / 10, len(lines) / words, len(set(lines)) / max(1, len(lines)), upper / max(1, letters) > 0.3, signs / n > 0.1, len(tokens) < 8, len(set(tokens)) / words < 0.2)
    x[48 : 48 + len(shape)] = shape
    return x


@dataclass
class QualityModel:
    """Weights of both views, the scales of their calibration, and the weights of the calibrated views."""

    text: np.ndarray
    meta: np.ndarray
    scale: np.ndarray
    combine: np.ndarray


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Sparse:
    """Rows of hashed features, laid end to end."""

    def __init__(self, at: np.ndarray, value: np.ndarray, lengths: np.ndarray):
        self.n, self.at, self.value = len(lengths), at, value
        self.row = np.repeat(np.arange(self.n), lengths)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], self.n)

    def grad(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, self.value * r[self.row], size)


class _Dense:
    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def grad(self, r: np.ndarray, size: int) -> np.ndarray:
        return self.x.T @ r


def _fit(view, y: np.ndarray, weight: np.ndarray, size: int, steps: int = 120, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression by accelerated, per-coordinate scaled descent; the last weight is the intercept. Classes weigh the same."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    balance = weight * np.where(y > 0.5, 0.5 / max(1e-9, weight[y > 0.5].sum()), 0.5 / max(1e-9, weight[y <= 0.5].sum()))
    for i in range(1, steps + 1):
        r = (_sigmoid(view.dot(w[:-1]) + w[-1]) - y) * balance
        g = np.r_[view.grad(r, size) + l2 * w[:-1], r.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return w


class _Mixed:
    """Labelled rows, and below them a few dense rows: the averages of pseudo-labelled ones."""

    def __init__(self, rows, means: np.ndarray):
        self.rows, self.means = rows, means

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.r_[self.rows.dot(w), self.means @ w]

    def grad(self, r: np.ndarray, size: int) -> np.ndarray:
        return self.rows.grad(r[: self.rows.n], size) + self.means.T @ r[self.rows.n :]


def co_train(text, meta, y: np.ndarray, pseudo, rounds: int = ROUNDS, trust: float = TRUST) -> QualityModel:
    """Two views that label for each other. `y` is 1 or 0; every fifth row is kept back to calibrate.

    Each round both views are fitted on the labelled rows and on what the other view has handed over. `pseudo(text weights, meta weights)`
    then gives, for each view, what the other one is sure of among all unlabelled rows: (mean features, class, number) by class and
    shard. Together these weigh `trust` of the labelled rows.
    """
    back = np.arange(len(y)) % 5 == 4
    if not (y[back] > 0.5).any() or (y[back] > 0.5).all():
        back = np.zeros(len(y), bool)
    views, given, weights = {"text": (text, BUCKETS), "meta": (meta, META)}, {}, {}
    for step in range(rounds + 1):
        for k, (view, size) in views.items():
            means, label, n = given.get(k, (np.zeros((0, size)), np.zeros(0), np.zeros(0)))
            own = np.where(back, 0.0, 1.0)
            weights[k] = _fit(_Mixed(view, means), np.r_[y, label], np.r_[own, trust * own.sum() * n / max(1, n.sum())], size)
        if step < rounds:
            given = pseudo(weights["text"], weights["meta"])
    held = back if back.any() else np.ones(len(y), bool)
    logits = np.stack([view.dot(weights[k][:-1]) + weights[k][-1] for k, (view, _) in views.items()], 1)
    ones = np.ones(held.sum())
    scale = np.stack([_fit(_Dense(logits[held][:, [i]] / 10), y[held], ones, 1, l2=1e-3) for i in range(2)])
    calibrated = _calibrated(logits, scale)
    return QualityModel(weights["text"], weights["meta"], scale, _fit(_Dense(calibrated[held] / 10), y[held], ones, 2, l2=1e-3))


def _calibrated(logits: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return logits / 10 * scale[:, 0] + scale[:, 1]


_FEATURES = "at array<int>, value array<float>, meta array<float>"


def _features(text: pd.Series, lang: pd.Series, source: pd.Series) -> pd.DataFrame:
    rows = [(*text_features(t), meta_features(t, a, b)) for t, a, b in zip(text, lang, source)]
    return pd.DataFrame(rows, columns=["at", "value", "meta"])


def _views(rows: pa.Table | pa.RecordBatch) -> tuple[_Sparse, _Dense]:
    at, value, meta = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows[n] for n in ("at", "value", "meta")))
    words = _Sparse(at.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False), at.value_lengths().to_numpy(zero_copy_only=False))
    return words, _Dense(meta.flatten().to_numpy(zero_copy_only=False).reshape(len(at), META).astype(np.float64))


def _sure_sums(shared, sure: float):
    """One partition's sums of features that a view is sure of, as (view that gets them, class, shard, feature, sum); feature -1 counts rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w_text, w_meta = shared.value
        sizes = {0: BUCKETS, 1: META}
        sums = {(v, c, s): np.zeros(sizes[v] + 1) for v in sizes for c in (0, 1) for s in range(SHARDS)}
        for batch in batches:
            words, meta = _views(batch)
            p = {1: _sigmoid(words.dot(w_text[:-1]) + w_text[-1]), 0: _sigmoid(meta.dot(w_meta[:-1]) + w_meta[-1])}  # by the view that gets them
            shard = batch["shard"].to_numpy()
            for (v, c, s), total in sums.items():
                ok = ((p[v] if c else 1 - p[v]) >= sure) & (shard == s)
                total[:-1] += (words if v == 0 else meta).grad(ok.astype(np.float64), sizes[v])
                total[-1] += ok.sum()
        for (v, c, s), total in sums.items():
            at = np.flatnonzero(total)
            feature = np.where(at == len(total) - 1, -1, at)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x, np.int32)) for x in (v, c, s)] + [pa.array(feature.astype(np.int32)), pa.array(total[at])], names=["view", "class", "shard", "feature", "total"])

    return run


def featured(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, y, shard, at, value, meta) of every row, written once: hashed features of both views, and the label of at most `fit_rows` ids, taken
    by a hash of the id; null for all others."""
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    taken = F.broadcast(given.orderBy(F.xxhash64("id"), "id").limit(fit_rows))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.col(source_col).cast("string").alias("s"))
    rows = base.join(taken, "id", "left").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(SHARDS)).cast("int"))
    return stored(rows.select("id", "y", "shard", F.pandas_udf(_features, _FEATURES)("t", "l", "s").alias("f")).select("id", "y", "shard", "f.*"))


def fit_features(rows: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, sure: float = SURE) -> QualityModel | None:
    """A model from `featured` rows: at most `fit_rows` labelled ones, and all others, whose labels if any are not looked at.

    Each round scores every unlabelled row with both views, and sums the features of those that a view is sure of by class and shard; only
    these sums, whose number does not depend on the table, and the labelled sample reach the driver. None without a label of either class.
    """
    known = rows.where("y IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("id", "y", "at", "value", "meta").toArrow()
    y = np.asarray(known["y"].to_pandas(), np.float64)
    if not (y == 1).any() or not (y == 0).any():
        return None
    text, meta = _views(known)
    free = rows.where("y IS NULL").select("shard", "at", "value", "meta")

    def pseudo(w_text: np.ndarray, w_meta: np.ndarray) -> dict:
        shared = rows.sparkSession.sparkContext.broadcast((w_text, w_meta))  # BUCKETS + META weights
        sums = free.mapInArrow(_sure_sums(shared, sure), "view int, class int, shard int, feature int, total double").groupBy("view", "class", "shard", "feature").agg(F.sum("total").alias("total")).toPandas()
        out = {}
        for v, (name, size) in enumerate((("text", BUCKETS), ("meta", META))):
            own = [g for _, g in sums[sums["view"] == v].groupby(["class", "shard"])]
            total, n = np.zeros((len(own), size + 1)), np.zeros(len(own))
            for i, g in enumerate(own):
                total[i, g["feature"]] = g["total"]
            n = total[:, -1].copy()
            out[name] = total[:, :-1] / np.maximum(1, n)[:, None], np.array([float(g["class"].iloc[0]) for g in own]), n
        return out

    return co_train(text, meta, y, pseudo, rounds)


def score_features(rows: DataFrame, model: QualityModel | None) -> DataFrame:
    """`featured` rows as (id, p_text, p_meta, quality_score); without a model all three are null."""
    if model is None:
        return rows.select("id", *[F.lit(None).cast("double").alias(c) for c in ("p_text", "p_meta", "quality_score")])
    shared = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS + META weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            words, meta = _views(batch)
            views = _calibrated(np.stack([words.dot(m.text[:-1]) + m.text[-1], meta.dot(m.meta[:-1]) + m.meta[-1]], 1), m.scale)
            both = views / 10 @ m.combine[:-1] + m.combine[-1]
            yield pa.RecordBatch.from_arrays([batch["id"], *[pa.array(_sigmoid(z)) for z in (views[:, 0], views[:, 1], both)]], names=["id", "p_text", "p_meta", "quality_score"])

    return rows.select("id", "at", "value", "meta").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, p_text double, p_meta double, quality_score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, p_text, p_meta, quality_score) for every row: the probabilities (classes taken as equally common) of good quality by both views and together.

    Features of whole texts are computed once; null counts as empty, a null language or source as a value of its own. Labels other than 0 and 1
    are none; of several labels of an id the largest holds. Scores do not depend on the order of rows, but for rounding; repeated rows get
    the same scores each; null ids are never labelled. Without a label of either class the scores are null; an empty table gives
    an empty result; other columns are not read. A document is kept at 0.5 or more.
    """
    rows = featured(docs, labels, id_col, text_col, lang_col, source_col, label_col, fit_rows)
    return score_features(rows, fit_features(rows, fit_rows)).withColumnRenamed("id", id_col)
