"""Benchmark decontamination by rare seeds and local alignment (operator 4).

Test items are taken in blocks of bounded size.  A first pass over all texts
counts, for every three-word gram of the block, the documents that hold it.
In each window of consecutive grams of an item the rarest of those that some
document holds becomes a seed, so every stretch of ``seed_words + window - 1``
unedited words holds one, however common or widely copied the item is.  A second pass joins texts to items on
the seeds; where two or more seeds of an item fall close together (one, where
the item has no more or at most ``seed_words + 2`` words), the passage around
them is aligned with the item word by word (Smith-Waterman).  A match is a
passage whose score reaches ``threshold`` of the item's own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import gram_hashes, word_hashes

#: Words of test items handled at once: the size bound of what every task gets.
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: The count of a gram that no document holds: above all others, so such a gram
#: takes no seed from the grams that an edited copy still holds.
ABSENT = np.iinfo(np.int64).max
SCHEMA = "doc_id long, item_id long, score double, start_word long, n_words long, n_seeds long"


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the end (exclusive) of the passage part
    it covers.  One numpy pass per word of the item; gaps along the passage
    are resolved by a running maximum."""
    ramp = np.arange(passage.size + 1, dtype=np.int32) * -GAP
    row = np.zeros(passage.size + 1, np.int32)
    best, end = 0, 0
    for word in item:
        step = np.maximum(row + GAP, 0)
        np.maximum(step[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH), out=step[1:])
        row = np.maximum.accumulate(step + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _rarest(counts: np.ndarray, window: int) -> np.ndarray:
    """The places that are rarest in some window (the last of equals)."""
    size = min(window, counts.size)
    views = np.lib.stride_tricks.sliding_window_view(counts[::-1], size)
    return np.unique(counts.size - 1 - (np.arange(len(views)) + views.argmin(axis=1)))


class Block:
    """The words, grams and seeds of some test items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], seed_words: int):
        self.items, self.seed_words = items, seed_words
        grams = [gram_hashes(w, seed_words) for _, w in items]
        self._index(np.concatenate(grams), np.repeat(np.arange(len(items)), [g.size for g in grams]),
                    np.concatenate([np.arange(g.size) for g in grams]))

    def _index(self, grams: np.ndarray, item: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(grams, kind="stable")
        self.grams, self.item, self.at = grams[order], item[order], at[order]
        self.n_seeds = np.bincount(item, minlength=len(self.items))
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.grams >> np.uint64(44)] = True

    def keep_rarest(self, counts: dict[int, int], window: int) -> None:
        number = np.array([counts.get(int(g), ABSENT) for g in self.grams.view(np.int64)])
        keep = np.zeros(self.grams.size, bool)
        order = np.lexsort((self.at, self.item))
        for part in np.split(order, np.flatnonzero(np.diff(self.item[order])) + 1):
            keep[part[_rarest(number[part], window)]] = True
        keep &= number != ABSENT
        self._index(self.grams[keep], self.item[keep], self.at[keep])

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place in the text, place in the index)`` of every seed met."""
        some = np.flatnonzero(self.bitmap[grams >> np.uint64(44)])
        left = np.searchsorted(self.grams, grams[some], "left")
        count = np.searchsorted(self.grams, grams[some], "right") - left
        place = np.repeat(some, count)
        entry = np.repeat(left - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return place, entry

    def matches(self, words: np.ndarray, threshold: float) -> list[tuple]:
        """``(item_id, score, start_word, n_words, n_seeds)`` of the best
        passage for each item that reaches the threshold."""
        place, entry = self.hits(gram_hashes(words, self.seed_words))
        if not place.size:
            return []
        item, begin = self.item[entry], place - self.at[entry]
        order = np.lexsort((begin, item))
        item, begin, entry = item[order], begin[order], entry[order]
        found: dict[int, tuple] = {}
        length = np.array([self.items[i][1].size for i in item])
        cuts = np.flatnonzero((np.diff(item) != 0) | (np.diff(begin) > np.maximum(4, length[1:] // 2))) + 1
        for group in np.split(np.arange(item.size), cuts):
            k = int(item[group[0]])
            item_id, own = self.items[k]
            seeds = np.unique(entry[group]).size
            if seeds < min(2, self.n_seeds[k]) and own.size > self.seed_words + 2:
                continue
            pad = max(3, own.size // 3)
            low = max(0, int(begin[group[0]]) - pad)
            passage = words[low:int(begin[group[-1]]) + own.size + pad]
            score, end = align(own, passage)
            score /= MATCH * own.size
            if score >= threshold and (k not in found or score > found[k][1]):
                start = end - align(own[::-1], passage[:end][::-1])[1]
                found[k] = (item_id, score, low + start, end - start, seeds)
        return list(found.values())


def _blocks(benchmark: DataFrame, seed_words: int) -> Iterator[Block]:
    """Blocks of test items; items with fewer than ``seed_words`` words or a
    NULL id have no part in them."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / 4 / BLOCK_WORDS))
    for k in range(n):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        words = [(r["item_id"], word_hashes(r["text"])) for r in got]
        words = [(i, w) for i, w in words if w.size >= seed_words]
        if words:
            yield Block(words, seed_words)


def _count_grams(docs: DataFrame, block: Block) -> dict[int, int]:
    """The number of documents that hold each gram of the block."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = []
            for text in batch.column("text").to_pylist():
                place, entry = block.hits(gram_hashes(word_hashes(text), block.seed_words))
                met.append(np.unique(block.grams[entry]))
            ids, n = np.unique(np.concatenate(met) if met else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n)], names=["gram", "n"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "gram long, n long") \
        .groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in got.collect()}  # no more than the block's grams


def seeded_blocks(docs: DataFrame, benchmark: DataFrame, seed_words: int = 3, window: int = 4) -> Iterator[Block]:
    for block in _blocks(benchmark, seed_words):
        block.keep_rarest(_count_grams(docs, block), window)
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, seed_words: int = 3,
                       window: int = 4) -> DataFrame:
    """One row per document and test item that a passage of it matches:
    ``doc_id, item_id, score, start_word, n_words, n_seeds`` (the best
    passage, in words of the text).

    NULL and empty texts match nothing.  Equal items match each; repeated
    rows of ``docs`` give repeated rows.  Empty tables give an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for block in seeded_blocks(docs, benchmark, seed_words, window):
        out = out.unionByName(rows.mapInArrow(_matcher(block, threshold), SCHEMA))
    return out


def _matcher(block: Block, threshold: float) -> Callable:
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [(doc_id, *m) for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                    for m in block.matches(word_hashes(text), threshold)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return match


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, seed_words: int = 3,
                      window: int = 4) -> DataFrame:
    """``docs`` without the rows that hold a match; texts are not shuffled."""
    at = docs.columns.index("text")
    out = docs
    for block in seeded_blocks(docs, benchmark, seed_words, window):
        def keep(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield batch.filter(pa.array([not block.matches(word_hashes(t), threshold)
                                                 for t in batch.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
