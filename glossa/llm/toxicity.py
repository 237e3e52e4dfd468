"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a
logistic model of its words and word beginnings; the document's is their
noisy-or, 1 - prod(1 - p). Only documents carry labels, so the loss is taken
at the document and its gradient flows to the sentences in the share by which
each of them explains the document. The sentence probabilities then say where
the offence is.

The model is fitted on a bounded sample of labelled rows: at most
``SAMPLE_ROWS`` of each label, taken in the order of a hash of the row.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled rows of each class that the model is fitted on.
SAMPLE_ROWS = 6_000
#: Features kept for the model.
FEATURES = 2_048
#: Documents of the sample that a feature must occur in.
LEAST_DOCS = 5
#: Lengths of the word beginnings used as features beside the whole word.
PREFIXES = (4, 5, 6)
THRESHOLD = 0.5
EPOCHS = 300

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings; a beginning is marked by a star."""
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) >= n]


def document_features(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return {f for w in words for f in word_features(w)}


def _fit_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(y, text) of at most SAMPLE_ROWS labelled rows per class; texts of unlabelled rows are not moved."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter(
        "doc_id is not null and y in (0, 1)"
    ).dropDuplicates(["doc_id"])
    trained = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for y in (0, 1):
        some = trained.filter(F.col("y") == y).orderBy(*order).limit(SAMPLE_ROWS)
        chosen = some if chosen is None else chosen.unionAll(some)
    bounded = F.broadcast(cut(chosen))  # at most 2 * SAMPLE_ROWS rows
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return cut(texts.join(bounded, "doc_id").dropDuplicates(["doc_id"]).select("y", "text"))


def _choose_features(sample: DataFrame) -> tuple[list[str], dict[int, int]]:
    """The features whose share of documents differs most between the classes."""
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)

    def count(batches):
        held = {0: Counter(), 1: Counter()}
        for batch in batches:
            for y, text in zip(batch["y"], batch["text"], strict=True):
                held[y].update(document_features(text))
        for y, c in held.items():
            if c:
                yield pd.DataFrame({"feature": list(c), "y": y, "n": list(c.values())}, columns=["feature", "y", "n"])

    counts = (
        sample.mapInPandas(count, "feature string, y int, n bigint")
        .groupBy("feature")
        .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    )
    # Signed chi-square root of the two shares.
    p = (F.col("a") + F.col("b")) / F.lit(max(1, n0 + n1))
    gap = F.col("a") / F.lit(max(1, n1)) - F.col("b") / F.lit(max(1, n0))
    score = gap / F.sqrt(p * (1 - p) * F.lit(1 / max(1, n1) + 1 / max(1, n0)) + F.lit(1e-12))
    best = counts.filter(F.col("a") + F.col("b") >= LEAST_DOCS).select("feature", score.alias("z")).orderBy(F.desc(F.abs("z")), "feature").limit(FEATURES)
    return [r["feature"] for r in best.collect()], sizes


def _bags(sample: DataFrame, index: dict[str, int]) -> tuple[np.ndarray, ...]:
    """The sample as (bag of a sentence, sentence of a feature, feature, labels, plain sentences per bag)."""

    def encode(batches):
        for batch in batches:
            out = []
            for y, text in zip(batch["y"], batch["text"], strict=True):
                told, plain = sentence_features(text, index)
                out.append((y, plain, [len(f) for f in told], [i for f in told for i in f]))
            yield pd.DataFrame(out, columns=["y", "plain", "sizes", "features"])

    rows = sample.mapInPandas(encode, "y int, plain int, sizes array<int>, features array<int>").collect()
    y = np.array([r["y"] for r in rows], dtype=float)
    plain = np.array([r["plain"] for r in rows], dtype=float)
    bag = np.repeat(np.arange(len(rows)), [len(r["sizes"]) for r in rows])
    sizes = np.array([n for r in rows for n in r["sizes"]], dtype=int)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    feature = np.array([f for r in rows for f in r["features"]], dtype=int)
    return bag, sentence, feature, y, plain


def sentence_features(text: str, index: dict[str, int], spans: bool = False):
    """Feature lists of the sentences that have any, and the number of the others."""
    found, plain = [], 0
    lower = text.lower()
    for m in _SENTENCE.finditer(lower):
        got = {index[f] for w in _WORD.findall(m.group()) for f in word_features(w) if f in index}
        if got:
            found.append((sorted(got), m.start(), m.end()) if spans else sorted(got))
        elif not m.group().isspace():
            plain += 1
    return found, plain


def fit(bag, sentence, feature, y, plain, n_features: int, epochs: int = EPOCHS, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the sentence model by Adam on the noisy-or likelihood of the documents.

    Classes weigh alike. A sentence without features has the bias alone, so
    documents need only say how many such sentences they have.
    """
    weights, bias = np.zeros(n_features), -5.0
    n_bags, n_sentences = len(y), len(bag)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, epochs + 1):
        z = np.bincount(sentence, weights[feature], n_sentences) + bias
        # log(1 - p) of a sentence is -softplus(z).
        soft, soft0 = np.logaddexp(0, z), np.logaddexp(0, bias)
        none = np.bincount(bag, soft, n_bags) + plain * soft0
        # d loss / d none: 1 for y = 0; -P(none) / (1 - P(none)) for y = 1.
        slope = share * np.where(y == 1, -1 / np.expm1(np.maximum(none, 1e-9)), 1.0)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
        dz = slope[bag] * p
        grad = np.append(np.bincount(feature, dz[sentence], n_features) + ridge * weights, dz.sum() + (slope * plain).sum() * p0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        weights -= step[:-1]
        bias = min(bias - step[-1], -3.0)
    return weights, float(bias)


class ToxicityModel:
    """Fitted sentence weights; small enough to travel with the tasks (at most FEATURES words)."""

    def __init__(self, features: list[str], weights: np.ndarray, bias: float):
        self.index = {f: i for i, f in enumerate(features)}
        self.weights, self.bias = weights, bias

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that hold any feature."""
        found, _ = sentence_features(text, self.index, spans=True)
        return [(a, b, float(1 / (1 + np.exp(-(self.weights[f].sum() + self.bias))))) for f, a, b in found]

    def score(self, text: str) -> float:
        found, plain = sentence_features(text, self.index)
        log_none = -plain * np.logaddexp(0, self.bias) - sum(np.logaddexp(0, self.weights[f].sum() + self.bias) for f in found)
        return float(-np.expm1(log_none))


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0. Without both classes every score is near 0."""
    sample = _fit_sample(docs, labels)
    features, sizes = _choose_features(sample)
    if not sizes.get(0) or not sizes.get(1):
        return ToxicityModel([], np.zeros(0), -12.0)
    index = {f: i for i, f in enumerate(features)}
    return ToxicityModel(features, *fit(*_bags(sample, index), len(features)))


def score_documents(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """``keep`` columns, score, and the offending sentences as (start, end, score) where 0.5 or more."""

    def run(batches):
        for batch in batches:
            texts = batch.pop("_text")
            scores = [model.score(t) for t in texts]
            spans = [
                [{"start": a, "end": b, "score": p} for a, b, p in model.sentences(t) if p >= THRESHOLD] if s >= THRESHOLD else []
                for t, s in zip(texts, scores, strict=True)
            ]
            yield batch.assign(score=scores, sentences=spans)

    given = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "_text")
    return given.mapInPandas(run, f"{kept}, score double, sentences array<struct<start:int,end:int,score:double>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences), one row per document.

    A null or empty text has no sentence and scores 0. Repeated rows are scored
    alike. Labels that are null, not 0 or 1, or without a document are not used
    for training; of several labels of a doc_id any one is. Without labels of
    both kinds all scores are near 0. Columns other than doc_id and text are
    ignored.
    """
    model = train(docs, labels)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score_documents(ids, model, ["doc_id"]).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "sentences"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that score 0.5 or more; all columns stay as they are."""
    model = train(docs, labels)
    toxic = F.pandas_udf(lambda texts: pd.Series([model.score(t) >= THRESHOLD for t in texts]), "boolean")
    return docs.filter(~toxic(F.coalesce("text", F.lit(""))))
