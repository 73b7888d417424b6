"""Quality classifier by a regularised quadratic discriminant (operator 3).

Each whole text becomes a vector of transformed statistics.  Class means and
covariances come from sums over all labelled rows outside the held-out fold;
covariances are shrunk towards the pooled one and towards its diagonal, and
their Cholesky factors are kept in the model.  A score is the logistic of the
difference of the two log densities (squared Mahalanobis distances and
log determinants) plus the log ratio of the class shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, staged
from .text_stats import NAMES, text_statistics

FOLDS = 5
CUT = 0.3


def held_out(doc_id: Column) -> Column:
    """Whether a row is in the held-out fold; a NULL id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors and log weights of the classes 0 and 1; with
    one class or none, ``share`` is every text's score."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    weights: list[float]
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        density = []
        for mean, factor, weight in zip(self.means, self.factors, self.weights):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(weight - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum())
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -60.0, 60.0)))


def statistics_of(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` for every row of ``docs``: one pass over whole texts."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            x = [text_statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))],
                                             names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(measure, "doc_id long, x array<double>")


def fit_discriminant(stats: DataFrame, labels: DataFrame, pooled: float = 0.05, diagonal: float = 0.05) -> Discriminant:
    """Fits on the labelled rows of ``stats`` (``doc_id, x``) outside the
    held-out fold.  Rows of ``labels`` without an id or a 0/1 label are left
    out, repeated ones count once; only sums come to the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")) \
        .where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    dim = len(NAMES)
    x = [F.get("x", F.lit(i)) for i in range(dim)]
    sums = stats.join(known, "doc_id").groupBy("y").agg(
        F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"),
        F.array(*[F.sum(x[i] * x[j]) for i in range(dim) for j in range(dim)]).alias("q")).collect()
    by = {r["y"]: r for r in sums if r["n"] > 1}
    total = sum(r["n"] for r in sums)
    share = sum(r["n"] for r in sums if r["y"] == 1) / total if total else 0.5
    if len(by) < 2:
        return Discriminant([], [], [], share)
    moments = {y: (r["n"], np.array(r["s"]) / r["n"], np.array(r["q"]).reshape(dim, dim) / r["n"]) for y, r in by.items()}
    n = sum(m[0] for m in moments.values())
    mean = sum(m[0] * m[1] for m in moments.values()) / n
    both = sum(m[0] * m[2] for m in moments.values()) / n - np.outer(mean, mean)
    means, factors, weights = [], [], []
    for y in (0, 1):
        count, centre, second = moments[y]
        cov = (1 - pooled) * (second - np.outer(centre, centre)) + pooled * both
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(both)) + 1e-5 * np.eye(dim)
        means.append(centre)
        factors.append(np.linalg.cholesky(cov))
        weights.append(math.log(count / n))
    return Discriminant(means, factors, weights, share)


def score_statistics(stats: DataFrame, model: Discriminant) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x), pa.float64())],
                                             names=["doc_id", "score"])

    scored = stats.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    NULL and empty texts have the all-zero vector and are scored like others.
    Without labels of both classes every score is the share of label 1 (0.5
    without any).  Repeated rows get equal scores; an empty table gives an
    empty result.
    """
    stats = staged(statistics_of(docs), "statistics")
    return score_statistics(stats, fit_discriminant(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` without the rows scored below ``cut``.  Two passes over the
    texts and no shuffle of them."""
    model = fit_discriminant(staged(statistics_of(docs), "statistics"), labels)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            x = np.array([text_statistics(t) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(model.scores(x) >= cut))

    return docs.mapInArrow(keep, docs.schema)
