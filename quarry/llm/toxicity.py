"""Toxicity by multiple-instance learning (operator 3).

A document is toxic if at least one of its sentences is: the scores p_s of its sentences combine by noisy-or,
1 - prod(1 - p_s).  p_s is the logistic function of a bias and the weights of the sentence's words, each word
counting as itself and by its beginnings.  The weights are fitted to document labels through the noisy-or;
sentences have no labels.  The fitted scores then locate the offending sentences.

Fitting uses a bounded sample: at most ``per_class`` labelled documents of each class, those with the least hash
of their id, all from rows that are not held out.  Everything else covers all documents.

Defined results: null and empty texts have no sentence with a word and get the bias's score; a null doc_id is
held out (its remainder is unknown, so its label is not used); a document that repeats in ``labels`` is toxic if
any of its rows says so; labels that are null are not used; without labels of both classes nothing can be
learned and all scores are the share of toxic labels (0 without labels); an empty table gives no rows; further columns are ignored by the query and kept by the stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Cache, documents, small_batches

PER_CLASS, LEAST_DOCS, LEAST_LIFT, ROUNDS, THRESHOLD = 3000, 4, 5.0, 150, 0.3
L1, L2 = 5e-5, 1e-5
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-"
PREFIXES = (3, 4, 5, 6, 7, 8, 10)


def features(word: str) -> list[str]:
    """The features of a word: itself and its beginnings, without case and punctuation at its ends."""
    word = word.strip(EDGES).lower()
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) >= k)] if word else []


class WordWeights(Cache):
    """The summed weights of a word's features."""

    def __init__(self, weights: dict[str, float]):
        super().__init__(100 << 20)
        self.weights = weights

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        w = sum(get(f, 0.0) for f in features(word))
        self.put(word, w, len(word))
        return w


class Model:
    """Bias and weights by feature; ``constant`` is set where nothing could be learned."""

    def __init__(self, bias: float, weights: dict[str, float], constant: float | None = None):
        self.bias, self.weights, self.constant = bias, weights, constant

    def sentences(self, text: str | None, cache: WordWeights) -> tuple[list[str], np.ndarray]:
        """Sentences with a word, and the logits of their scores."""
        parts = [s for s in SENTENCE.split(text or "") if s and not s.isspace()] or [""]
        get = cache.__getitem__
        return parts, np.array([self.bias + sum(map(get, s.split())) for s in parts])

    def score(self, logits: np.ndarray) -> float:
        """Noisy-or of the sentences' scores."""
        return float(-np.expm1(-np.logaddexp(0, logits).sum())) if self.constant is None else self.constant

    def locate(self, text: str | None, at_least: float = 0.5) -> list[tuple[int, str, float]]:
        """(number, sentence, score) of the sentences that score ``at_least`` that much."""
        parts, z = self.sentences(text, WordWeights(self.weights))
        p = np.exp(-np.logaddexp(0, -z))
        return [(i, parts[i], float(p[i])) for i in np.flatnonzero(p >= at_least)]


def loss_and_slopes(w: np.ndarray, b: float, ids: np.ndarray, sentence_of: np.ndarray, doc_of: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[float, np.ndarray, float]:
    """The weighted negative log-likelihood of the labels under the noisy-or, and its slopes by the weights and the bias.

    ``ids`` and ``sentence_of`` name a weight and its sentence for each feature that stands, ``doc_of`` each sentence's document.
    """
    z = b + np.bincount(sentence_of, w[ids], len(doc_of))
    total = np.bincount(doc_of, np.logaddexp(0, z), len(y))  # minus the logarithm of the chance that no sentence offends
    held = np.clip(total, 1e-6, 500)
    slope = cost * np.where(y, -1 / np.expm1(held), 1.0)
    dz = slope[doc_of] * np.exp(-np.logaddexp(0, -z))
    loss = float((cost * np.where(y, -np.log(-np.expm1(-held)), total)).sum())
    return loss, np.bincount(ids, dz[sentence_of], len(w)), float(dz.sum())


def fit(texts: list[str | None], labels: list[int], rounds: int = ROUNDS, lift: float = LEAST_LIFT, l1: float = L1, l2: float = L2) -> Model:
    """Weights that maximise the labels' likelihood under the noisy-or, with small penalties, by Adam with full batches.

    Only features that stand in more toxic documents than chance has it, by ``lift`` standard deviations, get a
    weight: in this model a sentence offends by what it contains, not by what it lacks.
    """
    y = np.array(labels, bool)
    if y.all() or not y.any():
        return Model(0.0, {}, float(y.mean()) if len(y) else 0.0)
    seen: dict[str, list[int]] = {}
    for text, toxic in zip(texts, y):
        for f in {f for w in set((text or "").split()) for f in features(w)}:
            seen.setdefault(f, [0, 0])[int(toxic)] += 1
    share = y.mean()
    chance = lambda n: share * n + lift * (n * share * (1 - share)) ** 0.5
    names = {f: i for i, f in enumerate(sorted(f for f, (c, t) in seen.items() if c + t >= LEAST_DOCS and t > chance(c + t)))}
    del seen
    ids, sentence_of, doc_of, known = [], [], [], {}
    for d, text in enumerate(texts):
        for s in SENTENCE.split(text or ""):
            for w in s.split():
                own = known.get(w)
                if own is None:
                    own = known[w] = [names[f] for f in features(w) if f in names]
                ids += own
                sentence_of += [len(doc_of)] * len(own)
            doc_of.append(d)
    ids, sentence_of, doc_of = (np.array(a, np.int32) for a in (ids, sentence_of, doc_of))
    cost = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    w, b = np.zeros(len(names)), -4.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        _, dw, db = loss_and_slopes(w, b, ids, sentence_of, doc_of, y, cost)
        g = np.append(dw + l1 * np.sign(w) + l2 * w, db)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return Model(float(b), {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3})


def held_out(doc_id):
    """Rows whose labels are not used."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from a bounded sample of the labelled documents that are not held out."""
    usable = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("__y"))
    order = [F.xxhash64("__id"), F.col("__id")]
    sample = usable.where("__y = 1").orderBy(*order).limit(per_class).union(usable.where("__y = 0").orderBy(*order).limit(per_class))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__y").collect()
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    return fit([r[1] for r in rows], [int(r[2]) for r in rows])


FOUND = "score double, n_offending int, worst_sentence int"


def scorer(model: Model):
    """A vectorised function of texts: score, how many sentences offend, and the number of the worst (null if none)."""

    @F.pandas_udf(FOUND)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = WordWeights(model.weights)
        for texts in batches:
            rows = []
            for text in texts:
                z = model.sentences(text, cache)[1]
                n = int((z >= 0).sum())
                rows.append((model.score(z), n, int(z.argmax()) if n else None))
            yield pd.DataFrame(rows, columns=["score", "n_offending", "worst_sentence"]).astype({"worst_sentence": "Int32"})

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and where the document offends."""
    rows = small_batches(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)("text").alias("x"))
    return rows.select("doc_id", "held_out", "x.score", F.when(F.col("x.score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "x.n_offending", "x.worst_sentence")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    rows = small_batches(docs).select(F.struct("*").alias("row"), scorer(train(docs, labels))("text").alias("x"))
    return rows.where(F.col("x.score") < THRESHOLD).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
