"""Toxicity by a counterfactual-regularised classifier (operator 5).

A logistic model over the presence of selected word and stem features (and of
identity terms) in a whole text.  Sentences of labelled rows that mention an
identity term are copied with the term swapped for another group's and with
it left out; the fit penalises the square of the change in the linear score
between a sentence and its copies.  The weight that a group's name would get
from the company it keeps in the training rows is thus driven to zero, so
that a neutral mention does not raise a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .lexicon import Lookup, bounded_sample, features, select_features
from .quality_classifier import held_out
from .words import word_hashes

#: Group names, swapped within a language; a parameter of the operator.
IDENTITY_TERMS = (
    ("women", "men", "muslims", "christians", "jews", "hindus", "immigrants", "gays", "lesbians", "blacks", "whites",
     "asians", "africans", "americans", "europeans"),
    ("frauen", "männer", "muslime", "christen", "juden", "hindus", "einwanderer", "schwule", "lesben", "schwarze",
     "weiße", "asiaten", "afrikaner", "amerikaner", "europäer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "hindous", "immigrés", "homosexuels", "lesbiennes", "noirs",
     "blancs", "asiatiques", "africains", "américains", "européens"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "hindúes", "inmigrantes", "homosexuales", "lesbianas",
     "negros", "blancos", "asiáticos", "africanos", "americanos", "europeos"),
)
CUT = 0.5
#: Most labelled rows used for the fit.
SAMPLE = 20_000


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the features (sorted) and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        lookup = Lookup(self.features)

        def score(text: str | None) -> float:
            z = self.bias + self.weights[lookup.in_text(text)].sum()
            return float(1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0))))

        return score


def _swaps(terms) -> dict[str, str]:
    return {a: b for group in terms for a, b in zip(group, group[1:] + group[:1])}


def _examples(wanted: np.ndarray, terms):
    """Active features of each sample row (kind 0: ``y, a``) and of sentences
    with an identity term and their copies (kind 1: ``a, b``)."""
    lookup, swap = Lookup(wanted), _swaps(terms)
    named = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, swap), key=len, reverse=True)) + r")\b", re.IGNORECASE) if swap else None

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, known = [], set()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                rows.append((0, y, lookup.in_text(text), None))
                if named and text and named.search(text):
                    for sentence in re.split(r"[.!?\n]+", text):
                        if named.search(sentence):
                            a = lookup.in_text(sentence)
                            for other in (lambda m: swap[m[0].lower()], lambda m: " "):
                                b = lookup.in_text(named.sub(other, sentence))
                                if (pair := (a.tobytes(), b.tobytes())) not in known:  # equal pairs count once
                                    known.add(pair)
                                    rows.append((1, y, a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                names=["kind", "y", "a", "b"])

    return examples


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of each entry."""
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return rows, np.array([f for x in lists for f in x], np.int64)


def _train(y: np.ndarray, active: list[list[int]], pairs: list[tuple[list[int], list[int]]], size: int,
           ridge: float, fairness: float, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Minimises mean log loss + ridge |w|^2 + fairness * mean squared change
    of the linear score over the pairs (Adam, full batch)."""
    rows, cols = _flat(active)
    left, right = _flat([a for a, _ in pairs]), _flat([b for _, b in pairs])
    w, n = np.zeros(size + 1), len(y)
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(rows, w[cols], n)
        off = (1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))) - y) * balance
        grad = np.append(np.bincount(cols, off[rows], size)[:size], off.sum())
        grad[:-1] += 2 * ridge * w[:-1]
        if pairs:
            change = np.bincount(left[0], w[left[1]], len(pairs)) - np.bincount(right[0], w[right[1]], len(pairs))
            step = 2 * fairness * change / len(pairs)
            grad[:-1] += np.bincount(left[1], step[left[0]], size)[:size] - np.bincount(right[1], step[right[0]], size)[:size]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms=IDENTITY_TERMS,
                 ridge: float = 1e-5, fairness: float = 10.0) -> ToxicityModel:
    """Fits on at most ``sample`` labelled rows outside the held-out fold.
    Rows of ``labels`` without an id or a 0/1 label are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")) \
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    rows = staged(bounded_sample(docs, known, sample).select("doc_id", "text", "y").coalesce(32), "sample")
    chosen, _ = select_features(rows)
    names = [w for group in terms for w in group]
    wanted = np.unique(np.concatenate([chosen, *[word_hashes(w) for w in names], *[features(w) for w in names]]))
    got = rows.orderBy("doc_id", "y").mapInArrow(_examples(wanted, terms), "kind int, y int, a array<long>, b array<long>").collect()
    y = np.array([r["y"] for r in got if r["kind"] == 0], float)
    if not y.size or y.min() == y.max():
        share = float(np.clip(y.mean() if y.size else 0.5, 1e-6, 1 - 1e-6))
        return ToxicityModel(wanted, np.zeros(wanted.size), float(np.log(share / (1 - share))))
    weights, bias = _train(y, [r["a"] for r in got if r["kind"] == 0], [(r["a"], r["b"]) for r in got if r["kind"] == 1],
                           wanted.size, ridge, fairness)
    return ToxicityModel(wanted, weights, bias)


def classify_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    NULL and empty texts hold no feature and get the bias's score.  Without
    labels of both classes every score is the share of label 1 (0.5 without
    any).  Repeated rows get equal scores; an empty table gives an empty
    result.
    """
    model = fit_toxicity(docs, labels, **options)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            scores = [of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())],
                                             names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))
