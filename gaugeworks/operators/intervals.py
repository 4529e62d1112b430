"""Joins and folds on intervals of an axis, within a key.

Overlap and containment joins get an equality from bins of every size: an interval lies in
one or two bins of the power of two that is just as long as it, and so in one or two of
every greater one.  Of two intervals that meet, the longer one's own bins are among the
bins of that size that the shorter one touches.  So each interval is in a few rows for
every size that occurs, however long it is and wherever it lies, no join is a nested loop,
and a pair counts only in the later of the two first bins, so none comes twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.longkeys import LONG, Keys

EPS = 1e-9
#: Powers of two that bins have: shorter intervals count as the least, others as the
#: greatest, in which all finite numbers are in bin -1 or 0.
LEAST, GREATEST = -20, 1000


def level_of(low: Column, high: Column) -> Column:
    """The power of two from which bins are as long as the interval."""
    return F.when(high - low < 2.0**GREATEST, F.greatest(F.lit(LEAST), F.ceil(F.log2(F.greatest(high - low, F.lit(2.0**LEAST)))))).otherwise(F.lit(GREATEST)).cast("int")


def bin_of(at: Column, level: Column) -> Column:
    place = F.when(level < GREATEST, F.floor(at / F.pow(F.lit(2.0), level)))
    return F.coalesce(place, F.when(at < 0, -1).otherwise(0)).cast("long")


def levels_in(*tables: DataFrame) -> list[int]:
    """The levels that occur, a few dozen at most: all that reaches the driver."""
    found: set[int] = set()
    for df in tables:
        found |= set(df.agg(F.collect_set("__level")).first()[0])
    return sorted(found)


def levelled(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, id, start, end) with bounds in order and their level; rows without bounds go."""
    rows = df.select(key, "id", F.col(start).cast("double").alias("start"), F.col(end).cast("double").alias("end"))
    rows = rows.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    rows = rows.withColumns({"__low": F.least("start", "end"), "__high": F.greatest("start", "end")})
    return rows.withColumn("__level", level_of(F.col("__low"), F.col("__high")))


def in_bins(rows: DataFrame, levels: list[int]) -> DataFrame:
    """A row for every bin of the levels from an interval's own on that it touches:
    ``__at`` its level, ``__first`` the first bin, ``__bin`` and ``__own``, whether the level
    is its own."""
    at = F.explode(F.filter(F.array(*(F.lit(n) for n in levels)), lambda n: n >= F.col("__level"))) if levels else F.explode(F.array().cast("array<int>"))
    placed = rows.withColumn("__at", at)
    placed = placed.withColumns({"__first": bin_of(F.col("__low"), F.col("__at")), "__last": bin_of(F.col("__high"), F.col("__at")), "__own": F.col("__at") == F.col("__level")})
    return placed.withColumn("__bin", F.explode(F.sequence("__first", "__last"))).drop("__last", "__low", "__high", "__level")


def overlap_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of intervals of one key that overlap by more than rounding.  Both sides
    have (key, id, start, end), of any length and order; right columns get the suffix
    ``_r``.  Rows with a null bound meet nothing."""
    a, b = levelled(left, key), levelled(right, key)
    levels = levels_in(a, b)
    a, b = in_bins(a, levels), in_bins(b, levels)
    b = b.select(key, F.col("id").alias("id_r"), F.col("start").alias("start_r"), F.col("end").alias("end_r"), F.col("__first").alias("__first_r"), F.col("__own").alias("__own_r"), "__at", "__bin")
    once = (F.col("__bin") == F.greatest("__first", "__first_r")) & (F.col("__own") | F.col("__own_r"))
    meets = (F.col("start") < F.col("end_r") - EPS) & (F.col("start_r") < F.col("end") - EPS)
    columns = [key, "id", "start", "end", "id_r", "start_r", "end_r"]
    # the longer of two has its own bins; of two of one level the left one does
    longer = a.where("__own").join(b, [key, "__at", "__bin"]).where(once & meets).select(*columns)
    shorter = a.where("not __own").join(b.where("__own_r"), [key, "__at", "__bin"]).where(once & meets).select(*columns)
    return longer.unionByName(shorter)


def overlap_anti(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The intervals of ``left`` that overlap none of ``right``; ids are unique in a key."""
    hit = overlap_join(left, right, key).select(key, "id").distinct()
    return left.join(hit, [key, "id"], "left_anti")


def points_inside(intervals: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """(key, id, point): points strictly inside an interval."""
    a = levelled(intervals, key)
    levels = levels_in(a)
    a = in_bins(a, levels).where("__own")
    at = F.explode(F.array(*(F.lit(n) for n in levels))) if levels else F.explode(F.array().cast("array<int>"))
    p = points.select(key, "point").where(F.col("point").isNotNull()).withColumn("__at", at).withColumn("__bin", bin_of(F.col("point"), F.col("__at")))
    inside = (F.col("point") > F.col("start") + EPS) & (F.col("point") < F.col("end") - EPS)
    return a.join(p, [key, "__at", "__bin"]).where(inside).select(key, "id", "point")


#: Rows of a key up to which its fold is one pass of one task.
FOLD_ROWS = 1 << 17


def capacity(df: DataFrame, key: str, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """G1: the most intervals of each key that don't overlap: by earliest end, then start,
    then id, each one that the last taken leaves free.

    A key of at most ``FOLD_ROWS`` rows is one sorted pass; the choices of longer ones are
    found by all tasks (:func:`chained`)."""
    rows = df.select(key, "id", "start", "end")
    counts = rows.groupBy(key).count()
    hot = settle(counts.where(F.col("count") > FOLD_ROWS))
    if hot.isEmpty():
        return folded(rows, key)
    wide = [F.col(key).eqNullSafe(F.col("__hot"))]
    named = hot.select(F.col(key).alias("__hot"))
    short = rows.join(named, wide, "left_anti")
    return folded(short, key).unionByName(chained(rows.join(named, wide, "left_semi"), key, settle))


def folded(df: DataFrame, key: str) -> DataFrame:
    """The choices of each key by a fold over its sorted rows, read as a stream."""
    ordered = df.repartition(key).sortWithinPartitions(key, "end", "start", "id")

    def fold(batches: Iterator[Any]) -> Iterator[Any]:
        now, free = object(), 0.0
        for batch in batches:
            keep = []
            for k, start, end in zip(batch[key].tolist(), batch["start"].tolist(), batch["end"].tolist(), strict=True):
                fresh = k != now
                take = fresh or start >= free - EPS
                if take:
                    now, free = k, end
                keep.append(take)
            yield batch[keep]

    return ordered.mapInPandas(fold, df.schema)


def next_free(rows: DataFrame, key: str, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, n, to): for every interval the one that is taken next if it is taken: the first
    by (end, start, id) of those that begin after its end.

    Begins and ends stand in one line, dealt by ranges of it, so a key is spread over tasks:
    each takes the least of what follows within its range, and what later ranges have
    comes as one row a range.  An interval no longer than rounding may begin after an end
    and yet be before that one in the order; such are looked up in a second line, the order
    itself."""
    order = F.struct("end", "start", "id", "n")
    kind = rows.select(order.alias("o")).schema["o"].dataType
    none, tiny = F.lit(None).cast(kind), F.col("end") - F.col("start") <= EPS
    place = lambda which, a, b, c, o: [key, F.lit(which).alias("which"), a.alias("a"), b.alias("b"), c.cast(rows.schema["id"].dataType).alias("c"), "n", o.alias("o")]
    begins = rows.where(~tiny).select(*place(0, F.col("start"), F.lit(1.0), F.lit(None), order))
    ends = rows.select(*place(0, F.col("end") - EPS, F.lit(0.0), F.lit(None), none))
    ordered = rows.select(*place(1, F.col("end"), F.col("start"), F.col("id"), F.when(tiny, order)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = begins.unionByName(ends).unionByName(ordered)
    line = settle(both.repartitionByRange(parts, key, "which", "a", "b", "c", "n").withColumn("part", F.spark_partition_id()))
    backwards = Window.partitionBy(key, "which", "part").orderBy(*(F.desc(c) for c in "abcn")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(key, "which").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = line.groupBy(key, "which", "part").agg(F.min("o").alias("least")).withColumn("beyond", F.min("least").over(later)).drop("least")
    seen = line.withColumn("own", F.min("o").over(backwards)).where("which = 1 or b = 0.0").join(ranges, [key, "which", "part"])
    return seen.groupBy(key, "n").agg(F.min(F.least("own", "beyond"))["n"].alias("to")).where("to is not null")


def chained(df: DataFrame, key: str, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The choices of keys of any length, whose ends are not before their starts: every interval points to the one that would be
    taken next; pointers are doubled by joins until none is left, and from each key's first
    interval the longest jumps mark the choices, then those half as long, and so on.  So many
    joins as the logarithm of the longest chain."""
    rows = settle(df.withColumn("n", F.monotonically_increasing_id()))
    jumps = [settle(next_free(rows, key, settle))]
    while True:
        a, b = jumps[-1].select("n", F.col("to").alias("via"), key), jumps[-1].select(F.col("n").alias("via"), "to")
        further = settle(a.join(b, "via").select(key, "n", "to"))
        if further.isEmpty():
            break
        jumps.append(further)
    taken = rows.groupBy(key).agg(F.min(F.struct("end", "start", "id", "n"))["n"].alias("n")).select("n")
    for step in reversed(jumps):
        taken = settle(taken.unionByName(step.join(taken, "n").select(F.col("to").alias("n"))))
    return rows.join(taken, "n").select(*df.columns)


def align_to_segments(windows: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Move each window (key, id, start, end) into the nearest segment that can hold it;
    (key, id, new_start, moved, held): ``held`` is false where none can.  Where windows have
    a column ``fixed``, those that are (a transition is looked for there) never move, and
    ``held`` says whether they lie within a segment as they are.

    Segments of a key don't overlap, so the nearest one is the last that begins at or
    before the window or the first that begins after it, among those of sufficient size:
    one sorted pass each way over a key and size."""
    fixed = F.coalesce(F.col("fixed"), F.lit(False)) if "fixed" in windows.columns else F.lit(False)
    sized = windows.select(key, "id", "start", (F.col("end") - F.col("start")).alias("__size"), fixed.alias("__fixed"))
    s = parts.select(F.col(key), F.col("start").alias("s"), F.col("end").alias("e"))
    fits = s.join(sized.select(key, "__size").distinct(), key).where(F.col("e") - F.col("s") >= F.col("__size") - EPS)
    segment = F.struct("s", "e").alias("__segment")
    both = sized.unionByName(fits.select(key, F.col("s").alias("start"), "__size", segment), allowMissingColumns=True)
    by = Window.partitionBy(key, "__size")
    below = F.max("__segment").over(by.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    above = F.min("__segment").over(by.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    seen = both.select(key, "id", "start", "__size", "__fixed", "__segment", below.alias("__below"), above.alias("__above")).where("__segment is null")

    def choice(near: str):
        to = F.least(F.greatest(F.col("start"), F.col(near)["s"]), F.col(near)["e"] - F.col("__size"))
        return F.when(F.col(near).isNotNull(), F.struct(F.abs(to - F.col("start")).alias("d"), to.alias("to")))

    best = seen.withColumn("best", F.least(choice("__below"), choice("__above")))
    new = F.when(F.col("__fixed"), F.col("start")).otherwise(F.coalesce(F.col("best.to"), F.col("start")))
    within = F.coalesce((F.col("best.d") <= EPS) | ~F.col("__fixed"), F.lit(False)) & F.col("best").isNotNull()
    return best.select(key, "id", new.alias("new_start"), (F.abs(new - F.col("start")) > EPS).alias("moved"), within.alias("held"))


def nearest_distance(candidates: DataFrame, anchors: DataFrame, key: str, at: str, default, long: int = LONG) -> DataFrame:
    """(candidate columns, distance): to the nearest anchor of the key, found as the
    neighbour on either side in sorted passes, which go by ranges for keys of more than
    ``long`` rows; ``default`` without anchors."""
    both = candidates.select("*", F.lit(False).alias("__anchor")).unionByName(anchors.select(key, at, F.lit(True).alias("__anchor")), allowMissingColumns=True)
    mark, keys = F.when(F.col("__anchor"), F.col(at)), Keys(both, key, long)
    sides = keys.running(both, [at], {"__below": ("max", mark)}, peers=True)
    sides = keys.running(sides, [at], {"__above": ("min", mark)}, after=True, peers=True)
    near = F.least(F.col(at) - F.col("__below"), F.col("__above") - F.col(at))
    return sides.withColumn("distance", F.coalesce(near, F.lit(default))).where(~F.col("__anchor")).drop("__anchor", "__below", "__above")
