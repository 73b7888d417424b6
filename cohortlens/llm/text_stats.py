"""Transformed statistics of whole texts, for the classifiers."""

from __future__ import annotations

import math

import numpy as np

from .words import gram_hashes, word_hashes

NAMES = ("word_length", "symbols", "capitals", "repeated_lines", "adjacent_repeats", "variety",
         "repeated_grams", "exclamations", "digits", "length", "commonest", "gaps")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _share(part: float, whole: float) -> float:
    """Arcsine of the root of a share: evens out the variance of shares."""
    return math.asin(math.sqrt(min(1.0, part / whole))) if whole > 0 else 0.0


def text_statistics(text: str | None, words: np.ndarray | None = None) -> np.ndarray:
    """The statistics named in ``NAMES``; all 0 for a text without a word.
    Capitals are those of ASCII and Latin-1.  ``words``: the text's word
    hashes, if they are at hand."""
    out = np.zeros(len(NAMES))
    words = word_hashes(text) if words is None else words
    if not words.size:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    solid = max(1, int(counts[33:128].sum() + counts[192:].sum()))
    capitals = int(counts[65:91].sum() + ((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)).sum())
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum() + counts[192:].sum()))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    _, each = np.unique(words, return_counts=True)
    grams = gram_hashes(words, 4)
    _, of_gram = np.unique(grams, return_counts=True)
    n = words.size
    out[0] = math.log(letters / n + 1)
    out[1] = _share(int(counts[_SYMBOLS].sum()), solid)
    out[2] = _share(capitals, letters)
    out[3] = _share(len(lines) - len(set(lines)), len(lines))
    out[4] = _share(int((words[1:] == words[:-1]).sum()), n + 5)
    out[5] = math.log(each.size + 1) - 0.8 * math.log(n + 1)
    out[6] = _share(int(of_gram[of_gram > 1].sum()), grams.size + 5)
    out[7] = _share(int(counts[33]), solid)
    out[8] = _share(int(counts[48:58].sum()), solid)
    out[9] = math.log(n + 1)
    out[10] = _share(int(each.max()) + 1, n + 10)
    out[11] = _share(int(counts[124]), n)
    return out
