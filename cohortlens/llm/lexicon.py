"""Word and stem features that mark labelled texts.

A feature is the hash of a word or of its first 4, 5 or 6 bytes.  Over a
bounded sample of labelled rows, features are counted in marked and unmarked
texts; those that occur in marked texts far more often than chance allows are
selected (likelihood-ratio statistic against the number of features tried).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import stem_hashes

STEMS = (4, 5, 6)
#: Bound of the features counted in unmarked texts, and of those selected.
CANDIDATES = 1 << 18
SELECTED = 4096


def features(text: str | None) -> np.ndarray:
    """The sorted distinct features of a text."""
    return np.unique(stem_hashes(text, STEMS))


class Lookup:
    """Membership in a small sorted set, with a bitmap in front of it."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = np.unique(wanted)
        self.bitmap = np.zeros(1 << 18, bool)
        self.bitmap[self.wanted >> np.uint64(46)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The sorted distinct places in ``wanted`` of those hashes it holds."""
        some = hashes[self.bitmap[hashes >> np.uint64(46)]]
        if not some.size or not self.wanted.size:
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.wanted, some), self.wanted.size - 1)
        return np.unique(at[self.wanted[at] == some])

    def in_text(self, text: str | None) -> np.ndarray:
        return self.find(stem_hashes(text, STEMS))


def bounded_sample(docs: DataFrame, known: DataFrame, bound: int) -> DataFrame:
    """The texts of at most ``bound`` labelled rows (``doc_id, y``), the least
    by a hash of the id: a bounded table, so it may be broadcast."""
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(bound)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .join(F.broadcast(some), "doc_id")


def _counter(wanted: np.ndarray | None):
    """Counts features per task: all of them, or those wanted."""
    lookup = None if wanted is None else Lookup(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            met = [features(t) if lookup is None else lookup.wanted[lookup.in_text(t)] for t in texts]
            ids, n = np.unique(np.concatenate(met) if met else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n)], names=["f", "n"])

    return count


def select_features(sample: DataFrame, chance: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """``(features, log odds)`` of the features that mark ``y = 1`` in
    ``sample`` (``text, y``), strongest first, at most ``SELECTED``."""
    rows = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = rows.get(0, 0), rows.get(1, 0)
    empty = np.zeros(0, np.uint64), np.zeros(0)
    if not n0 or not n1:
        return empty
    total = lambda y, wanted: (sample.where(F.col("y") == y).select("text")
                               .mapInArrow(_counter(wanted), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")))
    marked = total(1, None).where("n >= 3").orderBy(F.desc("n"), "f").limit(CANDIDATES).toArrow()
    ids = marked.column("f").to_numpy().view(np.uint64)
    if not ids.size:
        return empty
    order = np.argsort(ids)
    ids, a = ids[order], marked.column("n").to_numpy()[order].astype(float)
    other = total(0, ids).toArrow()
    b = np.zeros(ids.size)
    b[np.searchsorted(ids, other.column("f").to_numpy().view(np.uint64))] = other.column("n").to_numpy()
    share = n1 / (n0 + n1)
    p = a / (a + b)
    gain = 2 * (a * np.log(p / share) + np.where(b > 0, b * np.log(np.maximum(1 - p, 1e-12) / (1 - share)), 0.0))
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    good = np.flatnonzero((odds > 1.0) & (gain > 2 * math.log(ids.size / chance)))
    good = good[np.argsort(-gain[good], kind="stable")][:SELECTED]
    return ids[good], odds[good]
