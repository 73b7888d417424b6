"""Byte-level BPE encoding and decoding (operator 13).

A piece of text (a match of the split pattern) is encoded in linear time
without merging: an Aho-Corasick automaton over the vocabulary, whose bytes
are mapped to Latin-1 characters, gives the longest token at every position;
the encoder appends longest tokens from the left as long as each is
*compatible* with the one before, tries shorter tokens where it is not, and
steps back where none is left, never entering a dead position twice.  Two
adjacent tokens are compatible if the merges by rank would have left the
border between them alone; that is found by taking the two tokens apart and is
memoised.  A sequence all of whose neighbours are compatible is the one that
the merges produce.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds per task: bytes of remembered pieces, remembered pairs of tokens, and
#: the longest piece that is remembered.
PIECE_BYTES, PAIRS, LONGEST = 48 << 20, 1 << 18, 128
#: Characters split at once, and bytes of text whose ids are sent on at once.
SPAN, SLICE = 1 << 20, 4 << 20
#: How far beyond its match the pattern may look (contractions: two).
LOOKAHEAD = 4


class Vocabulary:
    """Token bytes by rank, the automaton of the tokens of two bytes or more,
    and how each token is merged."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.length = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        by_rank = sorted(ranks.items(), key=lambda item: item[1])
        self.flat = np.frombuffer(b"".join(t for t, _ in by_rank), np.uint8)
        self.start = np.zeros(size, np.int64)
        order = np.array([r for _, r in by_rank])
        self.start[order] = np.cumsum(self.length[order]) - self.length[order]
        self.sizes = self.length.tolist()
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        # the two tokens whose merge makes a token (a byte: itself twice); a
        # token that no merge makes is none for the automaton
        self.halves: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int] = {}
        for token, rank in by_rank:
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
        for token, rank in by_rank:
            if len(token) > 1:
                self._add(token, rank)
        automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if rank in self.halves and len(token) > 1:
                automaton.add_word(token.decode("latin-1"), (len(token), rank))
                prefix = next((p for p in (ranks.get(token[:k]) for k in range(len(token) - 1, 0, -1))
                               if p is not None and p in self.halves), None)
                if prefix is not None:
                    self.shorter[rank] = prefix
        automaton.make_automaton()
        self.matches = automaton.iter if len(automaton) else lambda text: ()  # one without a token has no iter

    def _add(self, token: bytes, rank: int) -> None:
        for cut in range(len(token) - 1, 0, -1):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left in self.halves and right in self.halves and left < rank and right < rank \
                    and self.compatible(left, right):
                self.halves[rank] = (left, right)
                self.merges[left, right] = rank
                return
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left is not None and right is not None and max(left, right) > rank:
                raise ValueError(f"the ranks are no order of merges: {token!r} comes before its part")

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between two adjacent
        tokens: undo the merges at the border from the last on; no pair met on
        the way may merge before the one that was undone."""
        merges, halves = self.merges, self.halves
        limit = None  # a pair across the border is made if its rank is below
        while True:
            pair = merges.get((left, right))
            if pair is not None and (limit is None or pair < limit):
                return False
            inner, outer = halves[left][1], halves[right][0]
            if left == inner and right == outer:
                return True
            # the merge with the higher rank came last; a byte has no merge
            if right == outer or (left != inner and left > right):
                limit, left = left, inner
            else:  # of two merges with one rank the left one came first
                limit, right = right + 1, outer

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``; fails on an id that is no token."""
        if ids.size and (ids.min() < 0 or ids.max() >= self.length.size or not self.length[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        out = []
        for at in range(0, ids.size, 1 << 18):
            part = ids[at:at + (1 << 18)]
            size = self.length[part]
            ends = np.cumsum(size)
            out.append(self.flat[np.repeat(self.start[part] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file (base64 of the bytes, rank): one per
    worker, of a size that the file fixes."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})


class Encoder(dict):
    """Piece -> ids (32 bits each, as bytes), filled on demand, in two generations of half of
    ``PIECE_BYTES`` each, so that common pieces stay known."""

    def __init__(self, words: Vocabulary):
        super().__init__()
        self.words, self.bytes, self.before, self.pairs = words, 0, {}, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            data = piece.encode("utf-8")
            rank = self.words.ranks.get(data)
            ids = array("i", (rank,) if rank is not None else self.backtrack(data)).tobytes()
        if len(piece) <= LONGEST:
            if 2 * self.bytes > PIECE_BYTES:
                self.before = dict(self)
                self.clear()
                self.bytes = 0
            self[piece] = ids
            self.bytes += 200 + len(piece) + len(ids)  # the objects and the slot
        return ids

    def fits(self, left: int, right: int) -> bool:
        """``compatible``, remembered."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[left, right] = self.words.compatible(left, right)
        return found

    def backtrack(self, data: bytes) -> list[int]:
        words, known, size_of = self.words, self.pairs.get, self.words.sizes
        longest = list(map(words.bytes.__getitem__, data))
        for end, (size, token) in words.matches(data.decode("latin-1")):
            longest[end + 1 - size] = token  # ends rise, so the longest comes last
        out: list[int] = []
        dead: set[int] = set()  # positions from which no sequence reaches the end
        at, last, token, size = 0, -1, longest[0], len(data)
        while True:
            end = at + size_of[token]
            fit = last < 0 or known((last, token))
            if fit is None:
                fit = self.fits(last, token)
            if fit and end not in dead:
                out.append(token)
                if end == size:
                    return out
                at, last, token = end, token, longest[end]
            elif token in words.shorter:
                token = words.shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                last = out[-1] if out else -1
                at -= size_of[token]


def pieces(pattern: regex.Pattern, text: str) -> Iterator[list[str]]:
    """All matches of ``pattern``, in lists of bounded size.  What lies within
    ``LOOKAHEAD`` characters of a cut is matched again after it."""
    at, span = 0, SPAN
    while len(text) - at > span:
        found, keep = [], at
        for match in pattern.finditer(text, at, at + span):
            if match.end() > at + span - LOOKAHEAD:
                break
            found.append(match.group())
            keep = match.end()
        if keep == at:  # a match longer than the span
            span *= 2
            continue
        yield found
        at, span = keep, SPAN
    yield [match.group() for match in pattern.finditer(text, at)] if pattern.groups else pattern.findall(text, at)


def _round_trip(ranks: str, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, split = vocabulary(ranks), regex.compile(pattern)
        encoder = Encoder(words)
        ids_of = encoder.__getitem__

        def send(rows: list[tuple]) -> pa.RecordBatch:
            ids = [r[1] for r in rows]
            offsets = np.concatenate(([0], np.cumsum([x.size for x in ids]))).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                 pa.array([words.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                text = text.as_py() or ""
                ids = b"".join([b"".join(map(ids_of, found)) for found in pieces(split, text)])
                rows.append((doc_id.as_py(), np.frombuffer(ids, np.int32)))
                held += len(text)
                if held > SLICE:
                    yield send(rows)
                    rows, held = [], 0
            if rows:
                yield send(rows)

    return encode


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>, decoded binary`` of every row of ``docs``: the
    ids of the whole text by the rank file ``ranks`` (a path on every worker),
    each match of ``pattern`` by itself, and the bytes that these ids decode
    to.

    NULL and empty texts have no ids.  Texts of any length are taken whole, in
    spans of bounded size; only a single match is held at once.  Rows keep
    their number and doc_id, repeated or NULL; an empty table gives an empty
    result.  Further columns, clashing names included, are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_round_trip(ranks, pattern), "doc_id long, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded rows."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
