"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

Only documents are labelled.  A sentence's score is a logistic function of the words it has;
a document's is ``1 - product(1 - score)`` over its sentences, so one offending sentence
is enough, and fitting the documents' labels finds which sentences offend.  A
sentence's features are its words and their beginnings (``STEMS`` characters), as
inflected and compound words have a stem in common.

``learn`` fits weights on a bounded sample of labelled rows: at most ``sample_rows`` of each
label (smallest hashes of the id) whose texts have at most ``most_chars`` characters, which bounds the sample's memory
(longer ones are scored, but not learned from); ``VOCABULARY`` words by
chi-square.  A share ``NOISE`` of the labels is taken to be wrong, so that a few false
labels do not teach common words.  Each step of the descent leaves out a share ``DROPPED`` of the features, so that every
word that shows an offence does so alone, and the weights are the mean of ``FOLDS`` fits, each without one part of the
documents, so that what a few documents teach counts less.  ``score`` is a narrow map over whole texts: it adds the
document's score and the offending sentences with their places.

Defined results: a null or empty text has score 0 and no offending sentence; sentences whose
score is below ``FLOOR`` add nothing, so that a clean text's score does not rise with its
length; equal texts have equal scores; with no labels of either kind every score is 0.
Labels other than 0 and 1, and null ids, are not learned from; a repeated id counts once, with the first of its texts
in order; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import absent, cut, free, need

VOCABULARY, NOISE, FLOOR, STEPS, RATE, LASSO, START = 2_000, 0.01, 0.02, 400, 0.1, 2e-4, -6.0
DROPPED, PENALTY, FOLDS, SEED = 0.4, 5e-5, 3, 1
SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6, 7)
#: Words whose features a worker remembers.
REMEMBERED = 200_000


def features(words: set[str]) -> set[str]:
    """Words, and their beginnings marked by a hyphen."""
    return words.union(w[:n] + "-" for w in words for n in STEMS if len(w) > n)


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def sentences(self, text: str | None) -> Iterator[tuple[int, int, float]]:
        """Start, stop and score of each sentence whose score reaches the floor."""
        tokens, known_of = TOKEN.findall, self.known
        for m in SENTENCE.finditer(text or "") if self.weights else ():
            known: set[str] = set()
            for w in tokens(m[0].lower()):
                found = known_of.get(w)
                if found is None:
                    if len(known_of) >= REMEMBERED:
                        known_of.clear()
                    found = known_of[w] = tuple(f for f in features({w}) if f in self.weights)
                if found:
                    known.update(found)
            if known:
                p = 1.0 / (1.0 + math.exp(-(self.bias + math.fsum(self.weights[f] for f in known))))
                if p >= FLOOR:
                    yield m.start(), m.end(), float(p)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        found = list(self.sentences(text))
        return 1.0 - math.prod(1.0 - p for _, _, p in found), found


def gradient(w: np.ndarray, b: float, feature: np.ndarray, sentence: np.ndarray, document: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The noisy-or loss of labelled documents, by ``weight``, and its gradient by the weights and the bias.

    ``feature[i]`` occurs in ``sentence[i]``; ``document[s]`` is the document of sentence ``s``.
    """
    z = b + np.bincount(sentence, w[feature], len(document))
    clean = np.exp(-np.bincount(document, np.logaddexp(0, z), len(label)))  # chance that no sentence offends
    q = NOISE + (1 - 2 * NOISE) * (1 - clean)
    loss = -float((weight * (label * np.log(q) + (1 - label) * np.log(1 - q))).sum())
    d_sum = (1 - 2 * NOISE) * clean * ((1 - label) / (1 - q) - label / q) * weight
    d_z = d_sum[document] / (1 + np.exp(-z))
    return loss, np.r_[np.bincount(feature, d_z[sentence], len(w)), d_z.sum()]


def fit(feature: np.ndarray, sentence: np.ndarray, document: np.ndarray, label: np.ndarray, n_features: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by proximal Adam on the noisy-or likelihood, with features left out at random."""
    weight = np.ones(len(label)) if weight is None else weight
    weight = weight / max(1.0, weight.sum())
    w, b, rng = np.zeros(n_features), START, np.random.default_rng(SEED)
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, STEPS + 1):
        kept = (rng.random(n_features) >= DROPPED).astype(float)
        _, g = gradient(w * kept, b, feature, sentence, document, label, weight)
        g[:-1] = g[:-1] * kept + PENALTY * np.sign(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], min(START, b - move[-1])
        w = np.sign(w) * np.maximum(0, np.abs(w) - RATE * LASSO)
    return w, b


def fit_folds(feature: np.ndarray, sentence: np.ndarray, document: np.ndarray, label: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """The mean of ``FOLDS`` fits, each without every ``FOLDS``-th document."""
    part = np.arange(len(label)) % FOLDS
    fits = [fit(feature, sentence, document, label, n_features, (part != k).astype(float)) for k in range(FOLDS)]
    return np.mean([w for w, _ in fits], axis=0), float(np.mean([b for _, b in fits]))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 4_000, most_chars: int = 50_000) -> Model:
    """A model from ``labels (id_col, label)`` of rows of ``docs``."""
    need(docs, id_col, text)
    need(labels, id_col, label)
    own = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label")).filter("_id is not null and label in (0, 1)")
    drawn = [own.filter(F.col("label") == k).groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows) for k in (0, 1)]

    @F.pandas_udf("array<array<string>>")
    def bags(texts: pd.Series) -> pd.Series:
        return pd.Series([[sorted(features(set(TOKEN.findall(s.lower())))) for s in SENTENCE.findall(t)] for t in texts], dtype=object)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.char_length("text") <= most_chars)
    # the sample is bounded by 2 * sample_rows rows of two numbers
    sample = rows.join(F.broadcast(drawn[0].union(drawn[1])), F.col("id") == F.col("_id")).select("id", "label", bags("text").alias("bags"))
    # a repeated id has the first of its texts' features, whatever order the rows come in
    sample = cut(sample.groupBy("id").agg(F.min("label").alias("label"), F.min("bags").alias("bags")))
    words = sample.select("label", F.explode(F.array_distinct(F.flatten("bags"))).alias("word"))
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model({}, START)
    a, all_ = F.col("a"), F.col("n")
    chi = F.pow(a * n0 - (all_ - a) * n1, F.lit(2)) / (all_ * (F.lit(n1 + n0) - all_) + 1)
    top = words.groupBy("word").agg(F.sum("label").alias("a"), F.count("*").alias("n")).filter("n >= 3").orderBy(chi.desc(), "word").limit(VOCABULARY).select("word").toPandas()["word"].tolist()
    code = {w: i for i, w in enumerate(sorted(top))}

    @F.pandas_udf("array<array<int>>")
    def coded(column: pd.Series) -> pd.Series:
        return pd.Series([[[code[w] for w in s if w in code] for s in doc] for doc in column], dtype=object)

    known = sample.select("id", "label", coded("bags").alias("codes")).orderBy("id").toPandas()
    feature, sentence, document = [], [], []
    for i, doc in enumerate(known["codes"]):
        for codes in doc:
            feature.extend(codes)
            sentence.extend([len(document)] * len(codes))
            document.append(i)
    as_int = lambda x: np.array(x, np.int64)
    w, b = fit_folds(as_int(feature), as_int(sentence), as_int(document), known["label"].to_numpy(float), len(code))
    return Model({word: float(w[i]) for word, i in code.items() if abs(w[i]) > 1e-6}, b)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` and ``offending``, an array of sentences ``(start, stop, score)`` in code points."""
    need(df, text)
    absent(df, "score", "offending")
    scored = free(df, "_scored")

    @F.pandas_udf("score double, offending array<struct<start: int, stop: int, score: double>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [model.score(t) for t in texts]
        spans = [[{"start": a, "stop": b, "score": p} for a, b, p in f] for _, f in found]
        return pd.DataFrame({"score": [s for s, _ in found], "offending": pd.Series(spans, dtype=object)})

    return df.withColumn(scored, of(F.col(text))).select(*df.columns, f"{scored}.*")
