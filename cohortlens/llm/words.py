"""Vectorised word hashes of whole texts.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of
the lower-cased text.  Word hashes are 64-bit polynomial hashes of the UTF-8
bytes, taken from prefix sums, so a text costs a fixed number of numpy passes
and no Python step per word; words of more than ``LONG`` bytes, which could be
chosen so that their polynomials agree, are hashed by BLAKE2b instead.  Texts are cut at word ends into segments of
about ``SEGMENT`` bytes, which bounds the memory of the passes.
"""

from __future__ import annotations

import hashlib

import numpy as np

SEGMENT = 1 << 20
LONG = 64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or table.size < n:
        steps = np.full(1 << max(12, (n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        table = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return table[:n]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base of the byte hashes, and of its inverse."""
    return _power_table(_BASE, n), _power_table(_INVERSE, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole hash."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _segments(raw: np.ndarray):
    at = 0
    while at < raw.size:
        end = min(raw.size, at + SEGMENT)
        if end < raw.size:
            gaps = np.flatnonzero(~_WORD[raw[at:end]])
            if gaps.size:
                end = at + int(gaps[-1]) + 1
            else:  # one word longer than a segment: up to its end
                rest = np.flatnonzero(~_WORD[raw[end:]])
                end = end + int(rest[0]) + 1 if rest.size else raw.size
        yield raw[at:end]
        at = end


def _segment_hashes(raw: np.ndarray, stems: tuple[int, ...] = ()) -> list[np.ndarray]:
    """The hashes of the words, then of the first ``k`` bytes of the words
    longer than ``k``, for each ``k`` of ``stems``."""
    inside = np.zeros(raw.size + 2, np.int8)
    inside[1:-1] = _WORD[raw]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(raw.size + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, raw.size), out=sums[1:])
    inverse = _power_table(_INVERSE, raw.size)
    words = mix((sums[ends] - sums[starts]) * inverse[starts])
    for k in np.flatnonzero(ends - starts > LONG):
        digest = hashlib.blake2b(raw[starts[k]:ends[k]].tobytes(), digest_size=8).digest()
        words[k] = int.from_bytes(digest, "little")
    out = [words]
    for k in stems:
        at = starts[ends - starts > k]
        out.append(mix((sums[at + k] - sums[at]) * inverse[at] + np.uint64(k * 0x51ED270B)))
    return out


def word_hashes(text: str | None) -> np.ndarray:
    """The 64-bit hash of each word of ``text``, in order."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    parts = [_segment_hashes(s)[0] for s in _segments(raw)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def stem_hashes(text: str | None, stems: tuple[int, ...]) -> np.ndarray:
    """The hashes of all words and of their first ``k`` bytes (``stems``),
    in no order; words and stems of one length never share a hash on purpose."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    parts = [part for s in _segments(raw) for part in _segment_hashes(s, stems)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of ``n`` words; none if there are fewer."""
    if words.size < n:
        return np.zeros(0, np.uint64)
    size = words.size - n + 1
    out = words[:size].copy()
    for k in range(1, n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[k:k + size]
    return mix(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct n-word shingles; a shorter text is one shingle."""
    if 0 < words.size < n:
        return gram_hashes(words, words.size)
    return np.unique(gram_hashes(words, n))


def sequence_key(words: np.ndarray) -> bytes:
    """A 128-bit key of the word sequence."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()
