"""Toxicity by non-negative positive-unlabelled learning.

A numpy classifier is trained from confirmed toxic texts (P) and texts taken without regard to
their labels (U). Its risk is prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)): what U wrongly
charges the positives hidden in it is taken back, and where that makes the negative part fall below
zero the step goes the other way, so that it cannot be fitted below zero.

Features are whether a lower-cased word, or the start of one, occurs in the text; the vocabulary is
those that P has significantly more often than U. P and U are bounded samples (``MAX_POSITIVE``,
``MAX_UNLABELLED``) of rows outside the held-out fold, U of all documents, labelled or not; scores cover every
whole text.

Defined cases: null and empty texts have no features and get the score of the bias; null labels and
labels of unknown documents are ignored; of several labels of a document the mean counts, 1 from one
half; a null doc_id takes part in no fit; without confirmed examples every score is the prior (0
without any label); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.boosted_trees import training_labels
from quirelake.llm.common import held_out, materialize, table

MAX_POSITIVE, MAX_UNLABELLED, VOCABULARY = 6_000, 12_000, 4_096
STARTS = range(3, 9)
#: Least z value of a feature's excess in P, least positive texts that have it, and words a worker remembers.
LEAST_Z, LEAST_TEXTS, MEMORY = 3.0, 3, 400_000
_EDGES = ".,;:!?\"'()[]{}<>|#$%&*_-/\\«»„“”‘’…"


def word_features(word: str) -> list[str]:
    """Of one lower-cased word: itself, and its starts marked by a final ``*``."""
    word = word.strip(_EDGES)
    return [word, *(word[:k] + "*" for k in STARTS if k <= len(word))] if word else []


def text_features(text: str | None) -> set[str]:
    return {f for w in set((text or "").lower().split()) for f in word_features(w)}


class Vocabulary:
    """Feature numbers of texts; a bounded memory holds what words seen before gave."""

    def __init__(self, features: list[str]):
        self.ids = {f: i for i, f in enumerate(features)}
        self.memory: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> list[int]:
        memory, found = self.memory, set()
        for w in set((text or "").lower().split()):
            hit = memory.get(w)
            if hit is None:
                if len(memory) >= MEMORY:
                    memory.clear()
                hit = memory[w] = tuple(self.ids[f] for f in word_features(w) if f in self.ids)
            if hit:
                found.update(hit)
        return sorted(found)


class NonNegativePU:
    """A linear classifier on sparse binary features with logistic loss, trained by Adam on the whole sample."""

    def __init__(self, width: int, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 5e-5, beta: float = 0.0, weights: np.ndarray | None = None):
        self.width, self.prior, self.steps, self.rate, self.l2, self.beta = width, prior, steps, rate, l2, beta
        self.weights = np.zeros(width + 1) if weights is None else weights

    def risk(self, w: np.ndarray, columns: np.ndarray, owners: np.ndarray, n_p: int, n_u: int) -> tuple[float, bool, np.ndarray]:
        """The risk, whether its negative part is at least -beta, and the gradient of the step: that of the risk, or,
        where the negative part fell below, that of its opposite. Rows are the n_p positives, then the n_u unlabelled."""
        z = np.bincount(owners, w[columns], n_p + n_u) + w[-1]
        s, softplus = 1 / (1 + np.exp(-z)), np.logaddexp(0, z)
        negative = softplus[n_p:].mean() - self.prior * softplus[:n_p].mean()
        positive = self.prior * np.logaddexp(0, -z[:n_p]).mean()
        slope, sound = np.zeros(n_p + n_u), negative >= -self.beta
        if sound:
            slope[n_p:] = s[n_p:] / n_u
            slope[:n_p] = -self.prior * s[:n_p] / n_p - self.prior * (1 - s[:n_p]) / n_p
        else:
            slope[n_p:] = -s[n_p:] / n_u
            slope[:n_p] = self.prior * s[:n_p] / n_p
        return positive + max(0.0, negative), sound, np.append(np.bincount(columns, slope[owners], self.width), slope.sum())

    def fit(self, positive: list[list[int]], unlabelled: list[list[int]]) -> NonNegativePU:
        rows = positive + unlabelled
        columns = np.array([c for r in rows for c in r], np.int64)
        owners = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        w, m, v = self.weights, np.zeros(self.width + 1), np.zeros(self.width + 1)
        w[-1] = np.log(self.prior / (1 - self.prior))
        for step in range(1, self.steps + 1):
            _, _, g = self.risk(w, columns, owners, len(positive), len(unlabelled))
            g[:-1] += self.l2 * w[:-1]
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, rows: list[list[int]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        columns = np.array([c for r in rows for c in r], np.int64)
        z = np.bincount(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), self.weights[columns], len(rows)) + self.weights[-1]
        return 1 / (1 + np.exp(-z))


def _feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, p, u): texts of P and of U that have it; summed in each batch before the exchange."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                p, u = Counter(), Counter()
                for text, in_p, in_u in zip(part["text"], part["in_p"], part["in_u"], strict=True):
                    found = text_features(text)
                    if in_p:
                        p.update(found)
                    if in_u:
                        u.update(found)
                names = list(p.keys() | u.keys())
                yield pd.DataFrame({"feature": names, "p": [p[f] for f in names], "u": [u[f] for f in names]})

    return sample.select("text", "in_p", "in_u").mapInPandas(run, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def toxicity_model(rows: DataFrame, labels: DataFrame, column: str = "toxic", prior: float | None = None) -> tuple[float, list[str], NonNegativePU | None]:
    """The prior, the vocabulary and the classifier fitted on rows (doc_id, text); no classifier without examples."""
    if prior is None:
        prior = labels.where(~held_out(F.col("doc_id"))).agg(F.avg(F.col(column).cast("double"))).first()[0] or 0.0
    one = training_labels(labels.where(F.col(column) == 1), column, MAX_POSITIVE).select("doc_id", F.lit(True).alias("in_p"))
    # U: documents of any kind, labelled or not, outside the held-out fold; the least hashes of their ids.
    outside = rows.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    any_ = outside.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_UNLABELLED).withColumn("in_u", F.lit(True))
    chosen = one.join(any_, "doc_id", "full").select("doc_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_p", "in_u")])
    chosen = materialize(chosen, "sample-ids")
    # At most MAX_POSITIVE + MAX_UNLABELLED ids, so they may go to every executor.
    sample = materialize(rows.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "sample")
    n_p, n_u = (int(x or 0) for x in sample.agg(F.sum(F.col("in_p").cast("int")), F.sum(F.col("in_u").cast("int"))).first())
    if not n_p or not n_u:
        return prior, [], None
    share = (F.col("p") + F.col("u")) / (n_p + n_u)
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n_p + 1 / n_u))
    best = _feature_counts(sample).where(F.col("p") >= LEAST_TEXTS).withColumn("z", (F.col("p") / n_p - F.col("u") / n_u) / spread).where(F.col("z") >= LEAST_Z)
    features = [r.feature for r in best.orderBy(F.desc("z"), "feature").limit(VOCABULARY).select("feature").collect()]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(features)
        for batch in batches:
            yield pd.DataFrame({"in_p": batch["in_p"], "in_u": batch["in_u"], "f": [vocabulary(t) for t in batch["text"]]})

    coded = sample.select("text", "in_p", "in_u").mapInPandas(encode, "in_p boolean, in_u boolean, f array<int>").toPandas()  # the bounded sample
    of = lambda c: [list(f) for f in coded.loc[coded[c], "f"]]
    return prior, features, NonNegativePU(len(features), min(max(prior, 1e-3), 0.999)).fit(of("in_p"), of("in_u"))


def with_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    column: str = "toxic",
    threshold: float = 0.5,
    prior: float | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    score_name: str = "score",
    predicted_name: str = "predicted",
) -> DataFrame:
    """``documents`` with score and predicted (under the names given, in place of columns so called). ``prior``: share of toxic texts; None: that of the labels outside the held-out fold."""
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prior, features, model = toxicity_model(rows, labels, column, prior)
    score = F.lit(float(prior))
    if model is not None:
        shared = documents.sparkSession.sparkContext.broadcast((features, model.weights))

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            features, weights = shared.value
            vocabulary, model = Vocabulary(features), NonNegativePU(len(features), 0.5, weights=weights)
            for batch in batches:
                yield pd.Series(model.score([vocabulary(t) for t in batch]))

        score = scored(F.col(text).cast("string"))
    return documents.withColumn(score_name, score).withColumn(predicted_name, (F.col(score_name) >= threshold).cast("int"))


def toxicity_scores(documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return with_toxicity(rows, labels, **options).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_pu_toxicity": op9_pu_toxicity}
SQL: dict[str, str] = {}
