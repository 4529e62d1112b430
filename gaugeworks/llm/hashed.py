"""Hashed features of texts for linear models: sparse rows over a batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gaugeworks.llm.arrowtext import by_text, eights, mixed, span_hashes, words

PREFIXES = (4, 5)


@dataclass
class Sparse:
    """Rows of (index, value), one after the other; ``at`` has the n+1 offsets."""

    index: np.ndarray
    value: np.ndarray
    at: np.ndarray

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.at[i], self.at[i + 1])
        return self.index[part], self.value[part]

    def times(self, weights: np.ndarray) -> np.ndarray:
        return by_text(self.value * weights[self.index], self.at)


def counted(bucket: np.ndarray, at: np.ndarray, bits: int) -> Sparse:
    """Distinct buckets of each text with their counts."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key, count = np.unique((text.astype(np.uint64) << np.uint64(bits)) | bucket.astype(np.uint64), return_counts=True)
    index = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    own = (key >> np.uint64(bits)).astype(np.int64)
    return Sparse(index, count.astype(np.float32), np.searchsorted(own, np.arange(len(at))))


def word_counts(raw: np.ndarray, at: np.ndarray, bits: int, prefixes: bool = False) -> tuple[Sparse, np.ndarray, np.ndarray]:
    """(counts of hashed words, word hashes, word offsets).  With ``prefixes``, words
    longer than one of ``PREFIXES`` also count by so many first bytes."""
    low, start, end, word_at = words(raw, at)
    whole = span_hashes(low, start, end)
    if not prefixes:
        return counted(whole >> np.uint64(64 - bits), word_at, bits), whole, word_at
    text = np.repeat(np.arange(len(at) - 1), np.diff(word_at))
    both, own, view = [whole], [text], eights(low)
    for size in PREFIXES:
        long = np.flatnonzero(end - start > size)
        both.append(mixed((view[start[long]] & np.uint64((1 << (8 * size)) - 1)) + np.uint64(size)))
        own.append(text[long])
    both, own = np.concatenate(both), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return counted(both[order] >> np.uint64(64 - bits), np.searchsorted(own[order], np.arange(len(at))), bits), whole, word_at


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
