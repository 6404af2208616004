"""Quality scores by a regularised quadratic discriminant.

Each text becomes ``len(FEATURES)`` log-transformed statistics. Every class has a mean and a
covariance shrunk towards the pooled one and towards its diagonal; a score is the
logistic of the difference of the two log-densities, whose Mahalanobis distances come
from Cholesky factors that are computed once and kept with the model.

The class moments are sums over all labelled rows that may be learnt from, so nothing
is sampled. Defined results: a null text is the empty text, which is scored like any
other; a null doc_id is kept and never learnt from; repeated rows give repeated results;
a doc_id with several labels counts once for each different one; labels other than 0 and
1 are ignored; without two rows of each class every score is 0.5.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .store import Store

FEATURES = ("bytes", "words", "word bytes", "upper", "digit", "white space", "common marks", "other marks", "bars", "beyond ASCII", "repeated words", "repeated lines", "line ends", "marks after marks")
#: Shares of the pooled covariance and of its diagonal in a class's covariance.
POOLED, DIAGONAL = 0.15, 0.05


def _kinds() -> np.ndarray:
    kind = np.full(256, 8, np.uint8)  # lower-case letters
    kind[65:91], kind[48:58] = 0, 1
    kind[[32, 9, 13]] = 2
    kind[list(b".,;:'\"?-()")] = 3
    kind[list(b"!#$%&*+/<=>@[\\]^_`{}~")] = 4
    kind[ord("|")] = 5
    kind[128:] = 6
    kind[10] = 7
    return kind


_KIND = _kinds()


def statistics(texts: list[str]) -> np.ndarray:
    """(texts, len(FEATURES)) transformed statistics of whole texts."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        raw = text.encode()
        kind = _KIND[np.frombuffer(raw, np.uint8)]
        n = np.bincount(kind, minlength=9)
        marks = (kind == 4) | (kind == 3)
        pairs = int((marks[1:] & marks[:-1]).sum())
        words, lines = text.split(), text.split("\n")
        size = len(raw) + 1.0

        def share(x, of=size):
            return math.log((x + 0.5) / of)

        out[i] = (
            math.log(size), math.log1p(len(words)), math.log((len(raw) + 1) / (len(words) + 1)),
            share(n[0]), share(n[1]), share(n[2]), share(n[3]), share(n[4]), share(n[5]), share(n[6]),
            share(len(words) - len(set(words)), len(words) + 1.0), share(len(lines) - len(set(lines)), len(lines) + 1.0), share(n[7]), share(pairs),
        )
    return out


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log-determinants and log-priors of classes 0 and 1."""

    mean: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray

    @classmethod
    def fit(cls, n: np.ndarray, total: np.ndarray, square: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant | None:
        """From each class's count, sum and sum of outer products."""
        if min(n) < 2:
            return None
        mean = total / n[:, None]
        cov = square / n[:, None, None] - mean[:, :, None] * mean[:, None]
        every = (cov * n[:, None, None]).sum(0) / n.sum()
        spread = np.diag(np.maximum(np.diag(every), 1e-6))
        factors = [np.linalg.cholesky((1 - pooled - diagonal) * c + pooled * every + diagonal * spread + 1e-6 * np.eye(len(c))) for c in cov]
        return cls(mean, np.stack([np.linalg.inv(f) for f in factors]), np.array([2 * np.log(np.diag(f)).sum() for f in factors]), np.log(n / n.sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        dense = [p - 0.5 * (d + (((x - m) @ inv.T) ** 2).sum(1)) for m, inv, d, p in zip(self.mean, self.inverse, self.log_det, self.log_prior)]
        return 1 / (1 + np.exp(np.clip(dense[0] - dense[1], -500, 500)))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in small_batches(batch):
                x = statistics([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], [id_col, "x"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, x array<double>")


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Learn from (doc_id, x) and distinct (doc_id, label); only sums of each class reach the driver."""
    d = len(FEATURES)

    def moments(batches):
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
            y = np.asarray(batch.column(0))
            for k in range(2):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], sums.shape[1])), pa.array(np.tile(np.arange(sums.shape[1]), 2)), pa.array(sums.ravel())], ["label", "i", "value"])

    rows = stats.join(labels, "doc_id").select(F.col("label").cast("int"), "x").mapInArrow(moments, "label long, i long, value double").groupBy("label", "i").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros((2, 1 + d + d * d))
    for r in rows:
        sums[r["label"], r["i"]] = r["value"]
    return Discriminant.fit(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d))


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, score) of every whole text, learnt from the labels whose row satisfies ``learn`` (over column ``doc_id``)."""
    store = Store(spark, "quality")
    stats = store.put(document_statistics(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id"), "statistics")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).where(learn).distinct()
    sent = spark.sparkContext.broadcast(fit(stats, known))

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            s = np.full(len(x), 0.5) if sent.value is None else sent.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], [id_col, "score"])

    return stats.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
