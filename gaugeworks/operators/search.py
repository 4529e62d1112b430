"""Bracketed search for the cheapest setting that passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

STEP = 1000
LIMIT = 8


class Probes:
    """Settings tried so far, each once and at most ``limit``; ``known`` ones are free."""

    def __init__(self, measure: Callable[[int], float], target: float, limit: int = LIMIT, known: Mapping[int, float] | None = None):
        self.measure, self.target, self.left = measure, target, max(0, min(limit, LIMIT))
        self.tried: dict[int, float] = dict(known or {})
        self.spent = 0

    def passes(self, setting: int) -> bool | None:
        """Whether a setting passes; null if no try is left for it."""
        setting = max(STEP, setting // STEP * STEP)
        if setting not in self.tried:
            if self.spent >= self.left:
                return None
            self.tried[setting] = self.measure(setting)
            self.spent += 1
        return self.tried[setting] >= self.target

    def narrow(self, fails: int, holds: int, tolerance: int) -> None:
        """Halve the gap between one that fails and one that passes."""
        while holds - fails > tolerance and self.spent < self.left:
            middle = max(STEP, (fails + holds) // 2 // STEP * STEP)
            if middle in self.tried:
                return
            if self.passes(middle):
                holds = middle
            else:
                fails = middle

    def cheapest(self, fits: Callable[[int], bool] | None = None) -> int | None:
        return min((s for s, q in self.tried.items() if q >= self.target and (fits is None or fits(s))), default=None)


def search(
    measure: Callable[[int], float],
    least: int,
    budget: int,
    ceiling: int,
    target: float,
    tolerance: int = STEP,
    first: int | None = None,
    spare: float = 0.8,
    limit: int = LIMIT,
    known: Mapping[int, float] | None = None,
    fits: Callable[[int], bool] | None = None,
) -> tuple[Probes, int | None, int | None]:
    """(probes, selected, required): the cheapest tried that passes and ``fits``, and the
    cheapest that passes.

    The budget is tried first: if it passes, the search goes down to ``least``, else up to
    ``ceiling``; without a size to fit, what is found up there is over the budget and only
    required.  A ``first`` guess that passes ends the search, after one try below it if it
    has ``spare`` quality.  At most ``limit`` settings are tried, those ``known`` before
    not counted."""
    p = Probes(measure, target, limit, known)
    low = max(STEP, -(-least // STEP) * STEP)
    high = max(STEP, budget // STEP * STEP)
    top = max(high, ceiling // STEP * STEP)
    tolerance = max(STEP, tolerance)
    if first is not None:
        guess = min(max(low, first // STEP * STEP), top)
        if p.passes(guess):
            if p.tried[guess] >= target + spare and p.spent < p.left:
                p.passes(max(low, guess - max(tolerance, (guess - low) // 3)))
            return p, p.cheapest(fits), p.cheapest()
    good = p.passes(high)
    if good:
        if p.passes(low) is not True:
            p.narrow(low, high, tolerance)
        return p, p.cheapest(fits), p.cheapest()
    if good is None or top == high or not p.passes(top):
        return p, None, None
    p.narrow(high, top, tolerance)
    return p, p.cheapest(fits) if fits else None, p.cheapest()


def by_step(measured: DataFrame, key: str, setting: str, quality: str) -> DataFrame:
    """(key, low, high, first, steps): one row a source: the least and greatest measured
    setting, the least one's quality, and the last measured row of every ``STEP`` in order.
    A search tries multiples of ``STEP`` only, so it needs no other rows."""
    row = F.struct(F.col(setting).alias("x"), F.col(quality).alias("y"))
    rows = measured.groupBy(key, F.ceil(F.col(setting) / STEP).alias("step")).agg(F.min(row).alias("first"), F.max(row).alias("last"))
    ordered = F.array_sort(F.collect_list(F.struct("step", F.col("last.y").alias("y"))))
    return rows.groupBy(key).agg(F.min("first.x").alias("low"), F.max("last.x").alias("high"), F.min("first")["y"].alias("first"), ordered.alias("steps"))


def search_measured(measured: DataFrame, key: str, setting: str, quality: str, target: float, tolerance: int = STEP) -> DataFrame:
    """The searches of many sources over curves already measured: between two measured
    settings the lower one's quality holds.  (key, tries, selected, required).

    A source is one row with a place for every ``STEP`` of its settings, however many were
    measured; the tries, at most ``LIMIT``, are look-ups in it, batch by batch."""
    kind = measured.schema[key].dataType
    schema = StructType([StructField(key, kind), *(StructField(n, LongType()) for n in ("tries", "selected", "required"))])
    whole = F.transform("steps", lambda s: s["step"]).alias("at"), F.transform("steps", lambda s: s["y"].cast("double")).alias("y")
    rows = by_step(measured, key, setting, quality).select(key, F.col("low").cast("long"), F.col("high").cast("long"), F.col("first").cast("double"), *whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for batch in batches:
            out = []
            for low, high, first, at, y in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):

                def quality_at(value: int, at=at, y=y, first=first) -> float:
                    place = bisect_right(at, value // STEP) - 1
                    return y[place] if place >= 0 else first

                p, selected, required = search(quality_at, low, (low + high) // 2, high + STEP, target, tolerance)
                out.append((len(p.tried), selected, required))
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    return rows.mapInArrow(run, schema)
