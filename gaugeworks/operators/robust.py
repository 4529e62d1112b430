"""Robust fits: Theil-Sen lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Slopes held at a time.
HELD = 1 << 20
#: Rows up to which all slopes are computed, again for each of four digits.
SQUARE_ROWS = 1 << 13


def slope_blocks(x: np.ndarray, y: np.ndarray, least_gap: float) -> Iterator[np.ndarray]:
    """The slopes of all pairs of distinct ``x``, about ``HELD`` at a time."""
    found, n = [], 0
    for lag in range(1, len(x)):
        run, rise = x[lag:] - x[:-lag], y[lag:] - y[:-lag]
        good = np.abs(run) > least_gap
        found.append(rise[good] / run[good] + 0.0)
        n += len(found[-1])
        if n >= HELD:
            yield np.concatenate(found)
            found, n = [], 0
    if n:
        yield np.concatenate(found)


def pairs_not_rising(z: np.ndarray) -> int:
    """Pairs of places i < j with ``z[j] <= z[i]``: by the bits of the ranks, from the
    highest on, ones that stand before zeros among values equal in the bits above."""
    _, rank, count = np.unique(z, return_inverse=True, return_counts=True)
    found = int((count * (count - 1) // 2).sum())
    begin = np.zeros(len(z), np.int64)  # where each value's group of equal higher bits begins
    for shift in range(max(1, int(len(count) - 1).bit_length()) - 1, -1, -1):
        one = rank >> shift & 1
        ones = np.cumsum(one)
        before = ones - one - np.where(begin > 0, ones[begin - 1], 0)  # ones of the group before each place
        zero = one == 0
        found += int(before[zero].sum())
        if not shift:
            break
        # zeros of a group first, then its ones, each in their order
        last = np.append(begin[1:] != begin[:-1], True)
        size = np.zeros(len(z), np.int64)
        starts = begin[last]
        zeros = np.add.reduceat(zero.astype(np.int64), starts)
        size[starts] = zeros
        place = np.arange(len(z))
        to = np.where(zero, place - before, begin + size[begin] + before)
        new_begin = np.where(zero, begin, begin + size[begin])
        rank_, begin_ = np.empty_like(rank), np.empty_like(begin)
        rank_[to], begin_[to] = rank, new_begin
        rank, begin = rank_, begin_
    return found


def slopes_at_most(x: np.ndarray, y: np.ndarray, slope: float) -> int:
    """Pairs of distinct ``x`` whose slope is at most ``slope``; ``x`` is sorted.  A pair's slope
    is so where what the line leaves does not rise from the one to the other."""
    left = y - slope * x
    order = np.lexsort((left, x))
    xs, z = x[order], left[order]
    new = np.append(True, (xs[1:] != xs[:-1]) | (z[1:] != z[:-1]))
    tied = np.diff(np.append(np.flatnonzero(new), len(z)))  # equal x in rising order: only ties count
    return pairs_not_rising(z) - int((tied * (tied - 1) // 2).sum())


def by_digits(x: np.ndarray, y: np.ndarray, least_gap: float) -> float | None:
    """The median of the slopes of all pairs, exactly: the middle ones are found 16 bits at a
    time from counts over all of them."""

    def nth(k: int) -> float:
        prefix = 0
        for shift in (48, 32, 16, 0):
            counts = np.zeros(1 << 16, np.int64)
            for block in slope_blocks(x, y, least_gap):
                u = block.view(np.uint64)
                u = np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))  # in the order of the floats
                if shift < 48:
                    u = u[u >> np.uint64(shift + 16) == np.uint64(prefix)]
                counts += np.bincount((u >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            sums = np.cumsum(counts)
            digit = int(np.searchsorted(sums, k, "right"))
            k -= int(sums[digit] - counts[digit])
            prefix = prefix << 16 | digit
        bits = prefix ^ (1 << 63) if prefix >> 63 else ~prefix & (1 << 64) - 1
        return float(np.array([bits], np.uint64).view(np.float64)[0])

    n = sum(map(len, slope_blocks(x, y, least_gap)))
    if not n:
        return None
    return nth(n // 2) if n % 2 else (nth(n // 2 - 1) + nth(n // 2)) / 2


def slopes_median(x: np.ndarray, y: np.ndarray, least_gap: float = 1e-9) -> float | None:
    """Median slope over all pairs of ``x`` further apart than ``least_gap``.

    Up to ``HELD`` pairs they are all held, and up to ``SQUARE_ROWS`` rows all are computed.
    Beyond, the middle ones are found by narrowing bounds, each time counting the slopes
    below in n log n, so memory grows with the rows and time hardly faster; the result is
    right but for the rounding of what a line leaves, and ``x`` that differ by less than
    ``least_gap`` count as the first of them."""
    if len(x) * (len(x) - 1) // 2 <= HELD:
        slopes = np.concatenate([np.zeros(0), *slope_blocks(x, y, least_gap)])
        return float(np.median(slopes)) if len(slopes) else None
    if len(x) <= SQUARE_ROWS:
        return by_digits(x, y, least_gap)
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    x = x[np.maximum.accumulate(np.where(np.append(True, np.diff(x) > least_gap), np.arange(len(x)), 0))]
    _, same = np.unique(x, return_counts=True)
    n = len(x) * (len(x) - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not n:
        return None
    x0, y0 = x[0], y[len(y) // 2]
    x, y = x - x0, y - y0  # a smaller remainder, the same slopes
    # the extreme slopes are between neighbours in x, by the least and greatest y of each
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    low_y, high_y, at = np.minimum.reduceat(y, first), np.maximum.reduceat(y, first), x[first]
    run = np.diff(at)
    bottom, top = float(((low_y[1:] - high_y[:-1]) / run).min()), float(((high_y[1:] - low_y[:-1]) / run).max())

    def between(a: float, b: float) -> float:
        """Halfway in the order of the floats, so that powers of two are halved too."""
        bits = np.array([a, b]).view(np.int64)
        u = [int(v) if v >= 0 else -int(v & (1 << 63) - 1) for v in bits]
        m = (u[0] + u[1]) // 2
        return float(np.copysign(np.array([abs(m)], np.int64).view(np.float64)[0], m))

    # bounds that random pairs suggest, each of them counted before it is believed
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, len(x), (2, 100_000))
    some = np.sort((y[b] - y[a])[x[a] != x[b]] / (x[b] - x[a])[x[a] != x[b]])
    known = [(float(np.nextafter(bottom, -np.inf)) - 1e-12 * abs(bottom), 0), (top, n)]
    if len(some):
        known += [(s, slopes_at_most(x, y, s)) for s in (float(some[int(len(some) * q)]) for q in (0.49, 0.51)) if known[0][0] < s < top]

    def nth(k: int) -> float:
        """The k-th slope, from 1, to 12 digits."""
        low, under = max(p for p in known if p[1] < k)
        high, over = min(p for p in known if p[1] >= k)
        slow = False
        for step in range(200):
            wide = high - low
            if wide <= 1e-12 * max(abs(low), abs(high)) + 1e-300:
                break
            part = (k - under - 0.5) / (over - under) + (0.02 if step % 2 else -0.02)  # a little on either side
            middle = between(low, high) if slow else low + wide * min(0.98, max(0.02, part))
            if not low < middle < high:
                break
            count = slopes_at_most(x, y, middle)
            known.append((middle, count))
            if count >= k:
                high, over = middle, count
            else:
                low, under = middle, count
            slow = not slow and step % 2 == 1 and high - low > wide / 2
        return high

    if n % 2:
        return nth(n // 2 + 1)
    first_ = nth(n // 2)
    return first_ if slopes_at_most(x, y, first_) > n // 2 else (first_ + nth(n // 2 + 1)) / 2


def theil_sen(df: DataFrame, key: str, x: str, y: str, most: float | None = None) -> DataFrame:
    """(key, slope, intercept, n): the median slope, within ``+-most`` if given, and the
    median of what it leaves; a constant if all ``x`` are the same.

    The rows of a key come to one task, which holds them and at most ``HELD`` slopes; its
    time grows as their number times its logarithm, about 40 times (a count each)."""
    rows = df.select(key, x, y).dropna()
    kind = rows.schema[key].dataType.simpleString()

    def fit(group: pa.Table) -> pa.Table:
        xs, ys = group.column(x).to_numpy().astype(float), group.column(y).to_numpy().astype(float)
        slope = slopes_median(xs, ys)
        slope = 0.0 if slope is None else slope if most is None else min(most, max(-most, slope))
        return pa.table({key: group.column(key)[:1], "slope": [slope], "intercept": [float(np.median(ys - slope * xs))], "n": pa.array([len(xs)], pa.int64())})

    return rows.groupBy(key).applyInArrow(fit, f"{key} {kind}, slope double, intercept double, n long")
