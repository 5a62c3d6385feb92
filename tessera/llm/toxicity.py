"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence's probability is logistic in its words and word beginnings; a
document is toxic unless every sentence is clean and a leak (labels without any evidence) doesn't strike:
1 - (1 - leak) * prod(1 - p). Training follows the gradient of the bags' likelihood, so that sentences get scores
though only documents have labels; offending sentences are those whose own probability is high.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm._common import as_text

#: Documents learned from at most, of each label.
SAMPLE = 4000
#: Toxic documents of the sample that must have a feature.
LEAST_DOCS = 3
BEGINNINGS = (4, 5, 6)
#: Evidence is at least so many times as common in toxic documents as in clean ones.
RATIO = 5.0
#: Least prior weight of evidence; after training, evidence that leaves a sentence below this logit counts no more.
LEAST_WEIGHT = 0.3
LEAST_LOGIT = -3.5
#: Prior bias of a sentence with evidence.
BIAS = -4.0
ROUNDS = 300
#: Word weights kept at most by a worker; then it forgets them.
KEPT_WORDS = 1 << 17
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word itself and its beginnings."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


class Model:
    """Feature weights, strongest prior first, the bias of a sentence with evidence, and the leak."""

    def __init__(self, weights: dict[str, float], bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak
        self.place = {f: i for i, f in enumerate(weights)}
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.weights, self.bias, self.leak

    def __setstate__(self, state):
        self.__init__(*state)

    def weight(self, word: str) -> float:
        """The weight of the feature that a word was trained by, which is the one strongest before training; 0 for a word without evidence."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > KEPT_WORDS:
                self.known.clear()
            held = [f for f in features(word) if f in self.place]
            got = self.known[word] = self.weights[min(held, key=self.place.get)] if held else 0.0
        return got

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that hold evidence."""
        out = []
        for m in SENTENCE.finditer(text):
            held = [w for w in map(self.weight, dict.fromkeys(WORD.findall(m.group().lower()))) if w]
            if held:
                out.append((m.start(), m.end(), 1 / (1 + float(np.exp(-np.clip(self.bias + sum(held), -60, 60))))))
        return out

    def score(self, text: str) -> float:
        """The document's probability, by noisy-or over its sentences."""
        if not any(map(self.weight, set(WORD.findall(text.lower())))):
            return self.leak
        clean = 1 - self.leak
        for _, _, p in self.sentences(text):
            clean *= 1 - p
        return min(1.0, max(0.0, 1 - clean))


def _evidence(texts: list[str], labels: np.ndarray) -> dict[str, float]:
    """Features of toxic documents and their prior weights: a low estimate of how much more common they are there."""
    counts = (Counter(), Counter())
    for text, y in zip(texts, labels):
        counts[y].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
    n = np.bincount(labels, minlength=2)
    rated = []
    for f, k in counts[1].items():
        other = counts[0].get(f, 0)
        if k < LEAST_DOCS:
            continue
        a, b = (k + 0.5) / (n[1] + 1), (other + 0.5) / (n[0] + 1)
        low = np.log(a / b) - 1.5 * (1 / (k + 0.5) + 1 / (other + 0.5)) ** 0.5
        if low > LEAST_WEIGHT and a > RATIO * b:
            rated.append((-low, f))
    return {f: -low for low, f in sorted(rated)}


def loss_and_slope(theta: np.ndarray, start: np.ndarray, s: np.ndarray, f: np.ndarray, d: np.ndarray, y: np.ndarray, leak: float) -> tuple[float, np.ndarray]:
    """The bags' negative log-likelihood with a Gaussian prior about `start`, and its gradient.

    theta holds the features' weights and last the bias; sentence s[i] has feature f[i], and sentence j is in document d[j].
    """
    z = np.clip(np.bincount(s, weights=theta[f], minlength=len(d)) + theta[-1], -30, 30)
    p = 1 / (1 + np.exp(-z))
    clean = np.exp(np.log1p(-leak) + np.bincount(d, weights=np.log1p(-p), minlength=len(y)))
    toxic = np.maximum(1 - clean, 1e-9)
    loss = -np.where(y == 1, np.log(toxic), np.log(clean)).sum() + ((theta - start) ** 2).sum() / 2
    slope = np.where(y == 1, -clean / toxic, 1.0)[d] * p
    return float(loss), np.append(np.bincount(f, weights=slope[s], minlength=len(theta) - 1), slope.sum()) + theta - start


def learn(texts: list[str], labels: list[int]) -> Model:
    """Fits the model to documents and their labels 0 or 1."""
    y = np.array(labels, np.int64)
    if not len(y) or not y.any() or y.all():
        return Model({}, 0.0, float(y.mean()) if len(y) else 0.0)
    prior = _evidence(texts, y)
    names = list(prior)  # strongest first
    number = {f: i for i, f in enumerate(names)}
    word_ids: dict[str, list[int]] = {}
    sentence_of, feature_of, doc_of = [], [], []
    for d, text in enumerate(texts):
        for sentence in SENTENCE.findall(text.lower()):
            ids: list[int] = []
            for w in dict.fromkeys(WORD.findall(sentence)):
                if w not in word_ids:
                    word_ids[w] = sorted(number[f] for f in features(w) if f in number)[:1]
                ids += word_ids[w]
            if ids:
                sentence_of += [len(doc_of)] * len(ids)
                feature_of += ids
                doc_of.append(d)
    s, f, d = (np.array(x, np.int64) for x in (sentence_of, feature_of, doc_of))
    bare = np.ones(len(y), bool)
    bare[d] = False
    # documents without evidence fix the leak: the share of toxic ones among them
    leak = float(np.clip((y[bare].sum() + 0.1) / (bare.sum() + 10), 1e-4, 0.2))
    start = np.array([*prior.values(), BIAS])
    theta = start.copy()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        grad = loss_and_slope(theta, start, s, f, d, y, leak)[1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    kept = theta[:-1] + theta[-1] > LEAST_LOGIT
    return Model({n: float(w) if k else 0.0 for n, w, k in zip(names, theta, kept)}, float(theta[-1]), leak)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled documents of each label, picked by a hash of the id.

    Only the sample's ids, a list of bounded size, go to the documents; labels or ids that are null don't count,
    and an id with several labels counts as toxic if one of them is.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    marked = marked.agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    picked = [marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * sample rows of an id and a label
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    rows: pd.DataFrame = texts.join(chosen, "id").orderBy(F.xxhash64("id"), "id").limit(4 * sample).toPandas()
    return learn(rows.text.tolist(), rows.y.tolist())


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score double in [0, 1], n_offending int (sentences of probability 0.5 or more).

    Null and empty texts and texts without evidence score the leak. Texts are read whole; null ids and repeated
    rows pass through; other columns of `docs` don't matter; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, offending = [], []
            for text in as_text(batch.column(1)):
                score = model.score(text)
                scores.append(score)
                offending.append(sum(p >= 0.5 for _, _, p in model.sentences(text)) if score > model.leak else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(offending, pa.int32())], ["id", "score", "n_offending"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {kind}, score double, n_offending int").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", below: float = 0.3) -> DataFrame:
    """The rows, with their own columns, whose text scores less than `below`."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in as_text(texts)], pa.float64())

    return docs.where(score(F.col(text_col).cast("string")) < below)


def offending_sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, start int, end int, probability double, sentence): every sentence of probability `least` or more, by characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, a, b, p, t[a:b]) for i, t in zip(batch.column(0).to_pylist(), as_text(batch.column(1))) for a, b, p in model.sentences(t) if p >= least]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.float64(), pa.string()]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "start", "end", "probability", "sentence"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {kind}, start int, end int, probability double, sentence string").withColumnRenamed("id", id_col)
