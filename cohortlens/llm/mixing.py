"""Mixing to target weights by soft membership (operator 10).

A softmax classifier, fitted on labelled rows, gives each text posteriors over
the domains *clean*, *low* (quality 0) and *toxic*.  Documents then get
nonnegative rates such that the expected number of tokens of each domain (the
posterior-weighted sum of rate times words) matches its target.  The rates
minimise

    sum_k ((A(r)_k - T_k) / S)^2  +  pull * sum_d (t_d / S) (r_d - 1)^2

by projected gradient steps with momentum.  The gradient of a rate depends on
its document only through the posteriors, so documents with the same posterior
cell (a grid of ``GRID`` steps, at most (GRID + 1)(GRID + 2) / 2 cells) share
their rate: texts are read once, cells are summed once, and every step is one
Spark job over the cells that returns the three domain totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .lexicon import STEMS, Lookup, bounded_sample, select_features
from .text_stats import NAMES, text_statistics
from .words import stem_hashes, word_hashes

DOMAINS = ("clean", "low", "toxic")
#: Share of tokens wanted of each domain.
WEIGHTS = (0.96, 0.02, 0.02)
GRID = 64
SAMPLE = 20_000
PULL = 1e-3
STEPS = 60
#: Rates this close to a whole number count as it when copies are drawn.
SNAP = 0.02


@dataclass(frozen=True)
class DomainModel:
    """A softmax over standardised statistics, their squares and the evidence
    of selected features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    features: np.ndarray
    odds: np.ndarray

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        return self.measured(texts)[0]

    def measured(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """The posteriors and the numbers of words."""
        lookup = Lookup(self.features)
        words = [word_hashes(t) for t in texts]
        x = np.array([raw_features(t, lookup, self.odds, w) for t, w in zip(texts, words)]).reshape(-1, len(NAMES) + 1)
        z = _expanded((x - self.mean) / self.scale) @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), [w.size for w in words]


def raw_features(text: str | None, lookup: Lookup, odds: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    found = lookup.find(stem_hashes(text, STEMS))
    return np.append(text_statistics(text, words), np.log1p(odds[found].sum()))


def _expanded(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -8, 8)
    return np.hstack([x, np.minimum(x * x, 16), np.ones((len(x), 1))])


def _softmax_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 500, rate: float = 0.05) -> np.ndarray:
    w = np.zeros((x.shape[1], len(DOMAINS)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    want = np.eye(len(DOMAINS))[y]
    for t in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = x.T @ (p - want) / len(x) + 2 * ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return w


def fit_domains(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DomainModel:
    """Fits on at most ``sample`` labelled rows.  Rows of ``labels`` without an
    id or with a NULL label are left out; without any, all texts are equally
    likely to be of each domain."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    known = labels.where(F.col("toxic").isNotNull() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()) \
        .select(F.col("doc_id").cast("long").alias("doc_id"), domain.cast("int").alias("y")).distinct()
    rows = staged(bounded_sample(docs, known, sample).select("doc_id", "text", "y").coalesce(32), "sample")
    found, odds = select_features(rows.select("text", (F.col("y") == 2).cast("int").alias("y")))
    order = np.argsort(found)
    found, odds = found[order], odds[order]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(found)
        for batch in batches:
            x = [raw_features(t, lookup, odds) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))],
                                             names=["doc_id", "y", "x"])

    got = rows.mapInArrow(measure, "doc_id long, y int, x array<double>").orderBy("doc_id", "y").toArrow()
    dim = len(NAMES) + 1
    if not got.num_rows:
        return DomainModel(np.zeros(dim), np.ones(dim), np.zeros((2 * dim + 1, len(DOMAINS))), found, odds)
    x = np.array(got.column("x").to_pylist())
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    return DomainModel(mean, scale, _softmax_fit(_expanded((x - mean) / scale), got.column("y").to_numpy()), found, odds)


def memberships(docs: DataFrame, model: DomainModel) -> DataFrame:
    """``doc_id, n_tokens, p0, p1, p2, c0, c1`` of every row: words, posteriors
    and the posterior's cell."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            p, n = model.measured(texts)
            cell = np.floor(p * GRID + 0.5).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()),
                 *[pa.array(p[:, k]) for k in range(3)], pa.array(cell[:, 0]), pa.array(cell[:, 1])],
                names=["doc_id", "n_tokens", "p0", "p1", "p2", "c0", "c1"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(measure, "doc_id long, n_tokens long, p0 double, p1 double, p2 double, c0 long, c1 long")


def _rates(history: list[np.ndarray], p: np.ndarray, pull: float) -> np.ndarray:
    """The rates after the steps of ``history`` (the domain residuals at each
    step) of cells with mean posteriors ``p``: replays the projected steps."""
    eta = 0.5 / (1.0 + pull)
    rate = np.ones(len(p))
    ahead, t = rate, 1.0
    for residual in history:
        new = np.maximum(0.0, ahead - eta * (2 * p @ residual + 2 * pull * (ahead - 1)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = np.maximum(0.0, new + (t - 1) / t_new * (new - rate))
        rate, t = new, t_new
    return np.vstack([rate, ahead])


def fit_rates(members: DataFrame, weights=WEIGHTS, pull: float = PULL, steps: int = STEPS) -> tuple[DataFrame, list[float]]:
    """``(cells with their rate, targets)``.  The total is chosen so that the
    first domain is used as it is; a domain is never asked for more tokens
    than it has."""
    token = F.col("n_tokens")
    cells = staged(members.groupBy("c0", "c1").agg(
        F.sum(token).cast("double").alias("t"), *[F.sum(token * F.col(f"p{k}")).alias(f"t{k}") for k in range(3)])
        .where("t > 0").coalesce(8), "cells")
    have = np.array(cells.agg(*[F.coalesce(F.sum(f"t{k}"), F.lit(0.0)) for k in range(3)]).first(), float)
    total = max(1.0, have.sum())
    lead = int(np.argmax(np.array(weights) > 0))
    wanted = np.minimum(np.array(weights) * have[lead] / weights[lead], have)
    history: list[np.ndarray] = []

    def step(which: int, known: list[np.ndarray]):
        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = np.column_stack([batch.column(f"t{k}").to_numpy() for k in range(3)])
                rate = _rates(known, sums / batch.column("t").to_numpy()[:, None], pull)
                if which >= 0:
                    yield pa.RecordBatch.from_arrays([pa.array(s) for s in (sums * rate[which][:, None]).sum(axis=0).reshape(3, 1)],
                                                     names=["a0", "a1", "a2"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("c0"), batch.column("c1"), pa.array(rate[0])], names=["c0", "c1", "rate"])

        return expected

    for _ in range(steps):
        sums = cells.mapInArrow(step(1, list(history)), "a0 double, a1 double, a2 double") \
            .agg(*[F.coalesce(F.sum(f"a{k}"), F.lit(0.0)) for k in range(3)]).first()
        history.append((np.array(sums, float) - wanted) / total)
        if len(history) > 5 and np.abs(history[-1] - history[-2]).max() < 1e-7:
            break
    return staged(cells.mapInArrow(step(-1, history), "c0 long, c1 long, rate double"), "rates"), [float(w) for w in wanted]


def copies_of(rate: Column, doc_id: Column) -> Column:
    """How often a document is used: its rate, rounded up with the probability
    of its fraction, by a hash of its id."""
    near = F.when(F.abs(rate - F.round(rate)) <= SNAP, F.round(rate)).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(near + draw).cast("int")


def mix_sources(docs: DataFrame, labels: DataFrame, weights=WEIGHTS, **options) -> DataFrame:
    """``doc_id, n_tokens, p_clean, p_low, p_toxic, rate, copies`` of every row
    of ``docs``.

    NULL and empty texts have no tokens; they weigh nothing and get the rate
    of their posterior's cell, or 1 where no text with words shares it.
    Repeated rows get equal rates; an empty table gives an empty result.
    """
    model = fit_domains(docs, labels, **options)
    members = staged(memberships(docs, model), "members")
    rates, _ = fit_rates(members, weights)
    rate = F.coalesce("rate", F.lit(1.0))
    # at most (GRID + 1)(GRID + 2) / 2 cells
    return members.join(F.broadcast(rates), ["c0", "c1"], "left").select(
        "doc_id", "n_tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)], rate.alias("rate"),
        copies_of(rate, F.col("doc_id")).alias("copies"))


def apply_mixture(docs: DataFrame, labels: DataFrame, weights=WEIGHTS, **options) -> DataFrame:
    """``docs`` with each row as often as its rate says; texts are read three
    times and never shuffled."""
    model = fit_domains(docs, labels, **options)
    rates, _ = fit_rates(staged(memberships(docs, model), "members"), weights)
    table = {(r["c0"], r["c1"]): r["rate"] for r in rates.collect()}  # bounded by the grid
    at = docs.columns.index("text")

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = np.floor(model.posteriors(batch.column(at).to_pylist()) * GRID + 0.5).astype(int)
                rate = pa.array([table.get((a, b), 1.0) for a, b in cell[:, :2].tolist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, rate], names=[f"v{k}" for k in range(batch.num_columns)] + ["rate"])

    names = [f"v{k}" for k in range(len(docs.columns))]
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))
    drawn = docs.toDF(*names).mapInArrow(rated, f"{fields}, rate double")
    drawn = drawn.withColumn("copies", copies_of(F.col("rate"), F.col(names[docs.columns.index("doc_id")]).cast("long"))) \
        .where("copies > 0")
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*names).toDF(*docs.columns)
