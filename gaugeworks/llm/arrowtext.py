"""Texts of an Arrow column as one byte array, with words, hashes and shingles
found by numpy.

A word is a maximal run of ``0-9``, ``a-z`` and bytes from 0x80, after ``A-Z``
is lower-cased; in UTF-8 that is the class ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

MIX = np.uint64(0x9E3779B97F4A7C15)
SHINGLE_STEP = np.uint64(0xD6E8FEB86659FD93)


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n+1 offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if ends is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(ends, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(at: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes each, or of one longer row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one integer; zero bytes follow the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, strides=(1,))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step."""
    if not len(start):
        return np.zeros(0, np.uint64)
    view, size = eights(raw), end - start
    left = np.minimum(size, 8).astype(np.uint64)
    mask = np.where(left == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (left * np.uint64(8) % np.uint64(64))) - np.uint64(1))
    out = mixed((view[start] & mask) + size.astype(np.uint64) * MIX)
    step, live = 8, np.flatnonzero(size > 8)
    while len(live):
        rest = np.minimum(size[live] - step, 8).astype(np.uint64)
        mask = np.where(rest == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (rest * np.uint64(8) % np.uint64(64))) - np.uint64(1))
        out[live] = mixed(out[live] * SHINGLE_STEP + (view[start[live] + step] & mask))
        step += 8
        live = live[size[live] > step]
    return out


def same_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, as_start: np.ndarray, as_end: np.ndarray) -> np.ndarray:
    """Whether each byte span equals the other one, byte by byte."""
    size = end - start
    same = size == as_end - as_start
    view, step, live = eights(raw), 0, np.flatnonzero(same)
    while len(live):
        left = np.minimum(size[live] - step, 8).astype(np.uint64)
        unlike = view[start[live] + step] ^ view[as_start[live] + step]
        part = left < 8
        unlike[part] &= (np.uint64(1) << (left[part] * np.uint64(8))) - np.uint64(1)
        same[live[unlike != 0]] = False
        step += 8
        live = live[(size[live] > step) & (unlike == 0)]
    return same


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, n+1 word offsets of the texts)."""
    low = LOWER[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = IS_WORD[low]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    first[edge] = inside[1:-1][edge]
    last[edge - 1] = inside[1:-1][edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, start, end, np.searchsorted(start, at)


def shingles(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``n`` consecutive words and their n+1 text offsets.  A text
    of fewer words, but not none, has its whole word sequence as one shingle."""
    count = np.diff(at)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    out_at = np.concatenate([[0], np.cumsum(made)])
    if not out_at[-1]:
        return np.zeros(0, np.uint64), out_at
    own = np.repeat(np.arange(len(count)), made)
    begin = at[:-1][own] + (np.arange(out_at[-1]) - out_at[:-1][own])
    size = np.minimum(count[own], n)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    out = size.astype(np.uint64) * MIX
    for k in range(n):
        nxt = out * SHINGLE_STEP + padded[begin + k]
        out = nxt if (size > k).all() else np.where(size > k, nxt, out)
    return mixed(out), out_at


def by_text(values: np.ndarray, at: np.ndarray, how=np.add) -> np.ndarray:
    """``how`` reduced over each text's values; 0 for texts without values."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = how.reduceat(values, at[:-1][full], axis=0)
    return out
