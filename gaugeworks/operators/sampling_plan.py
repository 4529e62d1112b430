"""Sample plans of timelines: which scouted windows to search, hold out and reserve.

A source has at most ``MOST_SCOUTS`` scouted windows, so it is one row with an array of
them, and its plan is one small fold; sources are independent and go through in batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

EPS = 1e-9
MOST_SCOUTS = 128
SCALES = {"spatial": 100.0, "motion": 50.0, "transition": 100.0}
# The weights of the risk dimensions.
WEIGHTS = {"spatial": 0.27, "motion": 0.30, "transition": 0.17, "dark": 0.08, "flat": 0.08, "noise": 0.10}
WEIGHED = np.array(list(WEIGHTS.values()))
# Why a window was taken.
SPATIAL, MOTION, HARDEST = ("highest_spatial_risk", "highest_si"), ("highest_motion_risk", "highest_ti"), ("global_compression_risk", "global_hardest")
TRANSITION, COVERAGE, HARD = "transition_risk", "coverage_bin_{}", "hardship"
HELD_OUT, RESERVED = "holdout_difficulty_and_diversity", "reserve_risk_and_timeline_diversity"


class NoPlan(ValueError):
    """A source's windows leave no room for the pools that its settings ask for."""


@dataclass
class PlanSettings:
    whole_sec: float = 20.0
    sample_sec: float = 5.0
    search_min: int = 3
    search_max: int = 6
    holdouts: int = 2
    holdouts_over_180m: int = 2
    holdout_min: int = 1
    holdout_max: int = 2
    reserves: int = 2


def midranks(values: np.ndarray) -> np.ndarray:
    """Places of the values, ties sharing their middle, in 0..1."""
    n = len(values)
    if n == 1:
        return np.array([0.5])
    ordered = np.sort(values)
    return (np.searchsorted(ordered, values, "left") + np.searchsorted(ordered, values, "right") - 1) / 2 / (n - 1)


@dataclass
class Timeline:
    """Scouted windows projected onto sample windows, with picks so far."""

    ids: list[str]
    centre: list[float]
    start: list[float]
    size: float
    duration: float
    taken: list[int] = field(default_factory=list)
    reasons: dict[int, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        self.by_end = sorted(range(len(self.ids)), key=lambda i: (self.start[i], self.ids[i]))

    def clash(self, i: int, others: Sequence[int]) -> int | None:
        """The first of ``others`` that overlaps window ``i``: all are of one size."""
        at, near = self.start[i], self.size - EPS
        return next((j for j in others if abs(self.start[j] - at) < near), None)

    def room(self, others: Sequence[int]) -> int:
        """How many more windows fit beside ``others``: earliest end first."""
        used, near, free, n = set(others), self.size - EPS, -math.inf, 0
        stand = sorted(self.start[j] for j in others)
        k, start = 0, self.start
        for i in self.by_end:
            at = start[i]
            if at < free or i in used:
                continue
            while k < len(stand) and stand[k] <= at - near:
                k += 1
            if k < len(stand) and stand[k] < at + near:
                continue
            free, n = at + near, n + 1
        return n

    def note(self, i: int, *why: str) -> None:
        held = self.reasons.setdefault(i, [])
        held += [w for w in why if w not in held]

    def add(self, i: int, why: tuple[str, ...], limit: int, spare: int, merge: bool = True) -> bool:
        """Take window ``i``, or give its reasons to the one it stands on; refused if that
        leaves too little room for what is still to come."""
        other = i if i in self.taken else self.clash(i, self.taken)
        if other is not None:
            if merge:
                self.note(other, *why)
            return merge
        if len(self.taken) >= limit or self.room([*self.taken, i]) < limit - len(self.taken) - 1 + spare:
            return False
        self.taken.append(i)
        self.note(i, *why)
        return True


def diverse(line: Timeline, difficulty: np.ndarray, beside: list[int], count: int) -> list[int]:
    """Hard windows far from all others: the best of 0.7 difficulty and 0.3 distance,
    again and again."""
    chosen: list[int] = []
    left = [i for i in range(len(line.ids)) if i not in beside]
    reach = max(line.duration / max(count + len(beside), 1), 1.0)
    far = {i: min((abs(line.centre[i] - line.centre[j]) for j in beside), default=line.duration) for i in left}
    while left and len(chosen) < count:
        best = max(left, key=lambda i: (0.70 * difficulty[i] + 0.30 * min(1.0, far[i] / reach), difficulty[i], -line.centre[i], line.ids[i]))
        left.remove(best)
        others = [*beside, *chosen]
        if line.clash(best, others) is None and line.room([*others, best]) >= count - len(chosen) - 1:
            first = not beside and not chosen
            chosen.append(best)
            for i in left:
                near = abs(line.centre[i] - line.centre[best])
                far[i] = near if first else min(far[i], near)
    return chosen


def content(risks: np.ndarray, cuts: int) -> tuple[float, float]:
    """A5: (uncertainty, heterogeneity) of risk vectors; a seventh dimension is always 0."""
    n = len(risks)
    dispersion = float(np.append(risks.std(axis=0), 0.0).mean())
    high = float((risks.max(axis=0) >= 0.65).mean())
    varied = min(1.0, 2.2 * dispersion + 0.12 * cuts / n + 0.25 * high)
    mean = float((risks @ WEIGHED).mean())
    return min(1.0, 0.55 * varied + 0.30 * mean + 0.15 / math.sqrt(n)), varied


def plan_source(scouts: Sequence[dict], duration: float, s: PlanSettings) -> list[tuple[str, str, float, str]]:
    """(pool, scout id, start, reasons) of one source.  ``scouts`` have id, centre, spatial,
    motion, transition, dark, flat, noise and cuts.  Raises :class:`NoPlan` where a pool
    can't be filled."""
    if not math.isfinite(duration) or duration <= 0:
        raise NoPlan("duration is not positive")
    if duration <= s.whole_sec:
        return [("search", "whole", 0.0, "whole_video")]
    if not scouts or len(scouts) > MOST_SCOUTS:
        raise NoPlan(f"{len(scouts)} scouts")
    rows = sorted(scouts, key=lambda r: (r["centre"], r["id"]))
    ids = [str(r["id"]) for r in rows]
    if len(set(ids)) < len(ids):
        raise NoPlan("scouts repeat")
    raw = {k: np.array([r[k] for r in rows], float) for k in WEIGHTS}
    table = np.array(list(raw.values()))
    if not np.isfinite(table).all():
        raise NoPlan("a metric is not finite")
    rank = {k: midranks(raw[k]) for k in SCALES}
    risks = np.minimum(np.maximum(table.T / np.array([[SCALES.get(k, 1.0) for k in WEIGHTS]]), 0), 1)
    for place, k in enumerate(WEIGHTS):
        if k in SCALES:
            risks[:, place] = 0.55 * risks[:, place] + 0.45 * rank[k]
    risks = np.ascontiguousarray(risks)
    hard = risks @ WEIGHED
    centre = [float(r["centre"]) for r in rows]
    size = min(s.sample_sec, duration)
    line = Timeline(ids, centre, [min(max(0.0, c - size / 2), max(0.0, duration - size)) for c in centre], size, duration)
    cuts = [int(r["cuts"]) for r in rows]
    unsure, varied = content(risks, sum(cuts))
    asked = s.holdouts_over_180m if duration > 180 * 60 else s.holdouts
    holdouts = min(s.holdout_max, max(asked, s.holdout_min + round((s.holdout_max - s.holdout_min) * unsure)))
    room = line.room([])
    reserves = min(s.reserves, max(0, room - holdouts - 1))
    long = min(1.0, math.log1p(duration / 600) / math.log1p(18))
    wish = min(s.search_max, s.search_min + max(0, round((s.search_max - s.search_min) * (0.30 * long + 0.45 * unsure + 0.25 * varied))))
    target = max(1, min(wish, room - holdouts - reserves))
    spare = holdouts + reserves

    def order(score: np.ndarray, anchor: float | None) -> list[int]:
        off = [0.0 if anchor is None else abs(c - anchor) for c in centre]
        return sorted(range(len(ids)), key=lambda i: (-score[i], off[i], centre[i], ids[i]))

    for score, at, why in ((rank["spatial"], 0.25, SPATIAL), (rank["motion"], 0.75, MOTION), (hard, 0.5, HARDEST)):
        line.add(order(score, duration * at)[0], why, target, spare)
    turn = min(range(len(ids)), key=lambda i: (-risks[i, 2], -raw["transition"][i], centre[i]))
    if raw["transition"][turn] >= 10 or cuts[turn]:
        line.add(turn, (TRANSITION,), target, spare)
    bins = target // 2
    for b in range(bins):
        low, high = duration * b / bins, duration * (b + 1) / bins
        inside = [i for i in order(hard, (low + high) / 2) if low <= centre[i] < high or (b == bins - 1 and centre[i] <= high)]
        why = COVERAGE.format(b + 1)
        if inside and not any(line.add(i, (why,), target, spare, merge=False) for i in inside) and line.taken:
            middle = lambda i: line.start[i] + size / 2
            line.note(min(line.taken, key=lambda i: (abs(middle(i) - (low + high) / 2), line.start[i], ids[i])), why)
    for i in order(hard, duration / 2):
        if len(line.taken) >= target:
            break
        line.add(i, (HARD,), target, spare)
    if len(line.taken) != target:
        raise NoPlan("too few windows to search")
    held = diverse(line, hard, line.taken, holdouts)
    if len(held) != holdouts:
        raise NoPlan("too few holdouts")
    kept = diverse(line, hard, [*line.taken, *held], reserves)
    if len(kept) != reserves:
        raise NoPlan("too few reserves")
    out = [("search", i, ",".join(line.reasons[i])) for i in line.taken] + [("holdout", i, HELD_OUT) for i in held] + [("reserve", i, RESERVED) for i in kept]
    return [(pool, ids[i], float(line.start[i]), why) for pool, i, why in sorted(out, key=lambda r: (r[0], line.start[r[1]], ids[r[1]]))]


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` by key over as many tasks as the session has partitions or cores.  Rows of a
    plan are small and slow, and Spark would join such partitions by their bytes until a few
    tasks did all plans."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def sample_plan(scouts: DataFrame, key: str, duration: str, settings: PlanSettings | None = None) -> DataFrame:
    """(key, pool, scout_id, start_sec, reasons) for every source of ``scouts``.
    A source that is short is searched whole; one that can't be planned has one row of
    the pool ``none`` with the reason.  A source is refused beyond ``MOST_SCOUTS`` scouts:
    they are counted before any are gathered."""
    s = settings or PlanSettings()
    names = ["id", "centre", *WEIGHTS, "cuts"]
    sized = scouts.groupBy(key).agg(F.count("*").alias("n"), F.first(duration).alias("d"))
    few = sized.where(F.col("n") <= MOST_SCOUTS)
    each = scouts.select(key, F.struct(F.col("id").cast("string").alias("id"), *(F.col(n).cast("double").alias(n) for n in names[1:])).alias("scout"))
    held = dealt(each, key).join(few, key).groupBy(key).agg(F.first("d").alias("d"), F.collect_list("scout").alias("scouts"))
    over = sized.where(F.col("n") > MOST_SCOUTS).select(key, F.lit("none").alias("pool"), F.lit(None).cast("string").alias("scout_id"), F.lit(None).cast("double").alias("start_sec"), F.concat(F.col("n").cast("string"), F.lit(" scouts")).alias("reasons"))
    schema = StructType([StructField(key, scouts.schema[key].dataType), StructField("pool", StringType()), StructField("scout_id", StringType()), StructField("start_sec", DoubleType()), StructField("reasons", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, out = [], []
            for k, (total, rows) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                try:
                    found = plan_source(rows, float(total), s)
                except NoPlan as e:
                    found = [("none", None, None, str(e))]
                out += found
                place += [k] * len(found)
            columns = zip(*out) if out else ((), (), (), ())
            kinds = (pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=schema.names)

    return held.select(key, F.col("d").cast("double"), "scouts").mapInArrow(run, schema).unionByName(over)


def keep_apart(windows: Sequence[tuple[float, float]], moved: Sequence[float]) -> list[tuple[float, bool]]:
    """Move each window to its new start unless it then overlaps one already placed or one
    still at its old place; (start, flagged)."""
    placed: list[tuple[float, bool]] = []
    for k, ((start, size), to) in enumerate(zip(windows, moved, strict=True)):
        others = [(s, windows[j][1]) for j, (s, _) in enumerate(placed)] + [w for j, w in enumerate(windows) if j != k]
        hits = any(to < s + d - EPS and s < to + size - EPS for s, d in others)
        placed.append((start, True) if hits else (to, False))
    return placed


def aligned_plans(plans: DataFrame, moved: DataFrame, key: str, size: float) -> DataFrame:
    """The windows of plans (key, pool, scout_id, start_sec) at their new starts
    (``moved``: key, scout_id, new_start, crosses), in the order search, holdout, reserve;
    one whose new place would overlap another stays and is flagged.  A plan has as many
    windows as its settings allow, so it is one row with an array of them."""
    rank = F.when(F.col("pool") == "search", 0).when(F.col("pool") == "holdout", 1).otherwise(2)
    one = F.struct(rank.alias("rank"), "start_sec", "scout_id", "pool", F.coalesce("new_start", "start_sec").alias("to"), F.coalesce("crosses", F.lit(False)).alias("crosses"))
    held = dealt(plans.where("pool in ('search', 'holdout', 'reserve')").join(moved, [key, "scout_id"], "left"), key).groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("windows"))
    row = StructType([StructField("pool", StringType()), StructField("scout_id", StringType()), StructField("start_sec", DoubleType()), StructField("crosses", StringType())])
    schema = StructType([StructField(key, plans.schema[key].dataType), StructField("windows", ArrayType(row))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pool", pa.string()), ("scout_id", pa.string()), ("start_sec", pa.float64()), ("crosses", pa.string())]))
        for batch in batches:
            out = []
            for windows in batch.column(1).to_pylist():
                places = keep_apart([(w["start_sec"], size) for w in windows], [w["to"] for w in windows])
                out.append([{"pool": w["pool"], "scout_id": w["scout_id"], "start_sec": at, "crosses": str(flag or w["crosses"]).lower()} for w, (at, flag) in zip(windows, places)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=schema.names)

    found = held.mapInArrow(run, schema).select(key, F.inline("windows"))
    return found.withColumn("crosses", F.col("crosses") == "true")
