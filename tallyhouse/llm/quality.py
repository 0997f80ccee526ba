"""Quality classifier: regularised quadratic discriminant over transformed
document statistics.

Each class is a Gaussian with its own mean and shrunk covariance. The score is
the logistic of the difference of the classes' log densities plus log priors;
a density needs the Mahalanobis distance only, taken with the inverse Cholesky
factor that the model caches for each class.

Training gathers sufficient statistics (count, sum, sum of products) per
class by a Spark aggregate over all labelled rows: no sample, and a few
hundred numbers reach the driver whatever the input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bounded_batches, held_out, map_batches, repeated_words, stored, texts, training_labels, unused, word_codes

FEATURES = ("words", "word_length", "symbols", "upper", "exclaims", "repeats", "dup_lines", "distinct", "line_words", "top_word", "doubled", "stops")
SHRINK = 0.1      # least share of the scaled identity in a class covariance
THRESHOLD = 0.3   # of ``predicted``
_SYMBOLS, _UPPER, _STOPS = b"#*$%&|<>", bytes(range(65, 91)), b".,;:?"


def features(text: bytes) -> list[float]:
    """Transformed statistics of a whole text; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    ids, distinct = word_codes(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = len(text)
    chars = len(text.translate(None, SPACE))
    count = lambda these: size - len(text.translate(None, these))
    rate = lambda k, of: math.log1p(20 * k / (of + 20))  # noqa: E731  20 more: rates of short texts vary less
    return [math.log1p(n), math.log((chars + 50) / (n + 10)), rate(count(_SYMBOLS), n), rate(count(_UPPER), chars), rate(text.count(b"!"), n),
            repeated_words(ids, distinct) / (n + 20), (len(lines) - len(set(lines))) / (len(lines) + 5), (distinct + 20) / (n + 20) ** 0.9,
            math.log((n + 20) / (len(lines) + 2)), int(np.bincount(ids).max()) / (n + 20), rate(int((ids[1:] == ids[:-1]).sum()), n), rate(count(_STOPS), n)]


def feature_matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([features(t) for t in texts(batch)], float).reshape(-1, len(FEATURES))


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the feature vector of each row."""
    def rows(batch: pa.RecordBatch) -> dict:
        x = feature_matrix(batch)
        return {"doc_id": batch.column(0), "x": pa.array(list(x), pa.list_(pa.float64()))}

    return map_batches(docs.select("doc_id", "text"), rows, f"doc_id {dict(docs.select('doc_id').dtypes)['doc_id']}, x array<double>")


@dataclass(frozen=True)
class Model:
    """Scaling, and per class: log prior, mean, inverse Cholesky factor and log
    determinant. A class without rows has a log prior of -inf."""

    centre: np.ndarray
    scale: np.ndarray
    log_prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) of each row."""
        if not np.isfinite(self.log_prior).all():
            return np.full(len(x), 0.5 if not np.isfinite(self.log_prior).any() else float(np.isfinite(self.log_prior[1])))
        z = (x - self.centre) / self.scale
        log = [self.log_prior[k] - 0.5 * (((z - self.mean[k]) @ self.whiten[k].T) ** 2).sum(1) - 0.5 * self.log_det[k] for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def oas_shrinkage(cov: np.ndarray, n: float) -> float:
    """Oracle-approximating shrinkage intensity of a sample covariance."""
    p, tr, tr2 = len(cov), float(np.trace(cov)), float((cov * cov).sum())
    low = (n + 1 - 2 / p) * (tr2 - tr * tr / p)
    return 1.0 if low <= 0 else min(1.0, ((1 - 2 / p) * tr2 + tr * tr) / low)


def model_from_sums(n: np.ndarray, total: np.ndarray, products: np.ndarray, shrink: float = SHRINK) -> Model:
    """n[k], sum of x, sum of x x^T by class k in (0, 1)."""
    p, every = total.shape[1], max(1.0, n.sum())
    centre = total.sum(0) / every
    scale = np.sqrt(np.maximum(np.diag(products.sum(0)) / every - centre**2, 1e-6))
    mean, whiten, log_det = np.zeros((2, p)), np.zeros((2, p, p)), np.zeros(2)
    with np.errstate(divide="ignore"):
        log_prior = np.log(n / every)
    for k in (0, 1):
        if not n[k]:
            continue
        m = total[k] / n[k]
        cov = (products[k] / n[k] - np.outer(m, m)) / np.outer(scale, scale)
        rho = max(shrink, oas_shrinkage(cov, n[k]))
        cov = (1 - rho) * cov + rho * max(np.trace(cov) / p, 0.05) * np.eye(p)
        chol = np.linalg.cholesky(cov)
        mean[k], whiten[k], log_det[k] = (m - centre) / scale, np.linalg.inv(chol), 2 * np.log(np.diag(chol)).sum()
    return Model(centre, scale, log_prior, mean, whiten, log_det)


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", shrink: float = SHRINK) -> Model:
    """Model from (doc_id, x) rows and their labels, held-out ids left aside.
    Labels other than 0 and 1 count as 1; without any label all scores are 0.5."""
    known = rows.join(training_labels(labels, label), "doc_id").select(F.least(F.col("label"), F.lit(1)).alias("k"), "x")
    p = len(FEATURES)
    cols = [F.col("x")[i] for i in range(p)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)] + [F.sum(cols[i] * cols[j]).alias(f"p{i}_{j}") for i in range(p) for j in range(i + 1)]
    n, total, products = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
    for r in known.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # two rows
        k = r["k"]
        n[k] = r["n"]
        total[k] = [r[f"s{i}"] for i in range(p)]
        for i in range(p):
            for j in range(i + 1):
                products[k, i, j] = products[k, j, i] = r[f"p{i}_{j}"]
    return model_from_sums(n, total, products, shrink)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of ``docs``.
    Null and empty texts are scored like any other, from zero statistics; a
    null doc_id is never labelled and not held out."""
    rows = stored(feature_table(docs))
    model = fit(rows, labels)

    def score(batch: pa.RecordBatch) -> dict:
        x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
        return {"doc_id": batch.column(0), "score": model.scores(x)}

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    scored = map_batches(rows, score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def with_features(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the feature vector as column ``name``. Only the text goes to
    the Python workers, and only the vector comes back."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("array<double>")
    def vector(text: pa.Array) -> pa.Array:
        return pa.array(list(feature_matrix(pa.RecordBatch.from_arrays([text], ["text"]))), pa.list_(pa.float64()))

    return docs.withColumn(name, vector(F.col("text")))


def score_of(model: Model, vector: str) -> Column:
    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.scores(np.array(x.to_pylist(), float).reshape(-1, len(FEATURES))), pa.float64())

    return score(F.col(vector))


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored at the threshold or above, with their own
    columns; the model is fitted on the labelled rows among them. Features are
    worked out once and written with the rows; the labels meet them by id, the
    texts are not shuffled."""
    name = unused(docs.columns, "_features")
    rows = stored(with_features(docs, name))
    model = fit(rows.select("doc_id", F.col(name).alias("x")), labels)
    return rows.where(score_of(model, name) >= threshold).drop(name)
