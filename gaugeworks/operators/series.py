"""Aggregates of ordered metric series: nearest-rank percentiles, rolling worst
values and gate scores, record numbering.  ``key`` names the series, ``order`` its
axis, ``metric`` its values; every window is partitioned by the key, or by ranges of a
long one (``longkeys``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.longkeys import LONG, Keys, medians, nearest_ranks

def nearest_rank(metric: str, share: float) -> Column:
    """The element at ``ceil(n * share)`` of the sorted values."""
    return F.expr(f"percentile_disc({share}) within group (order by {metric})")


def rolled(df: DataFrame, key: str, order: Sequence[str], metric: str, rows: int, long: int) -> DataFrame:
    """(key, mean, full, worst): of the frames of ``rows`` rows those with the most values,
    whether these are ``rows`` or all values of the key, and the least mean of them."""
    framed, by = Keys(df, key, long).blocks(df.select(key, *order, metric), order, rows)
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - rows, 0)
    means = framed.select(key, "__own", F.col(metric).alias("v"), F.avg(metric).over(frame).alias("m"), F.count(metric).over(frame).alias("n"))
    out = means.where("__own").groupBy(key).agg(F.avg("v").alias("mean"), F.count("v").alias("all"), F.min(F.struct((-F.col("n")).alias("less"), "m")).alias("w"))
    return out.select(key, "mean", (F.least(F.lit(rows), F.col("all")) + F.col("w.less") == 0).alias("full"), F.col("w.m").alias("worst"))


def rolling_worst(df: DataFrame, key: str, order: Sequence[str], metric: str, rows: int, long: int = LONG) -> DataFrame:
    """(key, worst): the least mean of ``rows`` successive values; series shorter than
    that have one mean, of all.  A series of more than ``long`` rows is cut into blocks."""
    return rolled(df, key, order, metric, rows, long).where("full").select(key, "worst")


def gate_score(df: DataFrame, key: str, order: Sequence[str], metric: str, rows: int, allowance: float = 4.0, long: int = LONG) -> DataFrame:
    """(key, mean, worst, gate): gate is the lower of the mean and the worst rolling
    mean plus ``allowance``.  A series of more than ``long`` rows is cut into blocks."""
    worst = F.when(F.col("full"), F.col("worst"))
    out = rolled(df, key, order, metric, rows, long).select(key, "mean", worst.alias("worst"))
    return out.withColumn("gate", F.least(F.col("mean"), F.col("worst") + allowance))


def series_metrics(df: DataFrame, key: str, order: Sequence[str], metric: str, cut: Column) -> DataFrame:
    """Count, 90th percentiles over all values and over those that are neither first nor
    a cut, the greatest value at a cut (0 without one) and the number of cuts."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    marked = df.select(key, F.col(metric).alias("v"), cut.alias("cut"), first.alias("first"))
    inner = "percentile_disc(0.9) within group (order by v) filter (where not cut and not first)"
    return marked.groupBy(key).agg(F.count("*").alias("n"), nearest_rank("v", 0.9).alias("p90"), F.expr(inner).alias("p90_inner"), F.coalesce(F.max(F.when(F.col("cut"), F.col("v"))), F.lit(0.0)).alias("max_cut"), F.count_if(F.col("cut")).alias("n_cuts"))


def number_records(df: DataFrame, key: str, order: Sequence[str], begins: Column, long: int = LONG) -> DataFrame:
    """``record``: how many rows that begin a record stand at or before each row; 0 for
    rows before the first."""
    return Keys(df, key, long).running(df, order, {"record": ("sum", F.when(begins, 1).otherwise(0))})


def upper_median_gap(df: DataFrame, key: str, order: str, long: int = LONG, keys: Keys | None = None) -> DataFrame:
    """(key, gap): the upper median of the steps of an axis, the one at place
    ``floor(n / 2)``: of the negated steps the lower median, which is a discrete
    percentile, so no key's steps are listed."""
    keys = keys or Keys(df, key, long)
    framed, by = keys.blocks(df.select(key, order), [order], 2)
    step = F.col(order) - F.lag(order).over(Window.partitionBy(*by).orderBy(order))
    gaps = framed.select(key, "__own", (-step).alias("back")).where("__own and back is not null")
    return nearest_ranks(gaps, key, "back", {"back": 0.5}, keys=keys).select(key, (-F.col("back")).alias("gap"))


def cadenced_worst(df: DataFrame, key: str, order: str, metric: str, rate: str | None = None, default_rate: float = 30.0, long: int = LONG) -> DataFrame:
    """(key, gap, rows, worst): the least mean of the values of one second.  A second
    has ``min(n, max(1, ceil(rate / gap)))`` values, by the series' own rate (``rate``, a
    column of one value a key) and the upper median gap of its frame numbers (1 without
    gaps), so the number of rows differs from key to key: the means come from running sums
    and the sum so many rows before.  Null keys are no series."""
    df = df.where(F.col(key).isNotNull())
    keys = Keys(df, key, long)
    gaps = upper_median_gap(df, key, order, keys=keys)
    fps = F.max(rate) if rate else F.lit(None).cast("double")
    sized = df.groupBy(key).agg(F.count("*").alias("n"), fps.alias("__fps")).join(gaps, key, "left")
    gap = F.greatest(F.lit(1.0), F.coalesce(F.col("gap"), F.lit(1)).cast("double"))
    wide = F.least(F.col("n"), F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce("__fps", F.lit(default_rate)) / gap).cast("long")))
    sized = sized.select(key, gap.alias("gap"), wide.alias("rows"))
    summed = keys.meet(keys.running(df.select(key, order, metric), [order], {"i": ("sum", F.lit(1)), "s": ("sum", F.col(metric))}), sized)
    ends = summed.where(F.col("i") >= F.col("rows")).select(key, "gap", "rows", F.col("i"), "s", (F.col("i") - F.col("rows")).alias("b"))
    before = summed.select(F.col(key).alias("__k"), F.col("i").alias("__i"), F.col("s").alias("__s"))
    joined = ends.join(before, (F.col(key) == F.col("__k")) & (F.col("b") == F.col("__i")), "left")
    mean = (F.col("s") - F.coalesce("__s", F.lit(0.0))) / F.col("rows")
    return joined.groupBy(key).agg(F.first("gap").alias("gap"), F.first("rows").alias("rows"), F.min(mean).alias("worst"))


def cut_times(df: DataFrame, key: str, time: str, cut: Column) -> DataFrame:
    """(key, cuts): the sorted distinct times of a series' cuts; an empty array
    for a series without one."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(F.when(cut, F.col(time)))).alias("cuts"))


def median_deviation(df: DataFrame, key: str, metric: str, long: int = LONG) -> DataFrame:
    """(key, median, mad): the median and the median distance from it; no row for a null key."""
    keys = Keys(df, key, long)
    mid = medians(df, key, metric, keys=keys)
    away = keys.meet(df.select(key, metric), mid).select(key, F.abs(F.col(metric) - F.col("median")).alias("away"))
    mad = medians(away, key, "away", keys=keys).withColumnRenamed("median", "mad")
    return mid.join(mad, key)


# What each of the first six dimensions of a risk weighs.
WEIGHTS = (0.27, 0.30, 0.17, 0.08, 0.08, 0.10)
HIGH = 0.65


def content_statistics(df: DataFrame, key: str, risks: str, cuts: str) -> DataFrame:
    """A5: (key, n, dispersion, density, high_modes, heterogeneity, uncertainty) of each
    key's risk vectors, arrays of seven: the mean spread of the dimensions, cuts a row, the
    share of the first six whose greatest value is high, and what follows.  One row of a
    key has no dispersion."""
    spreads = [F.coalesce(F.stddev_pop(F.get(risks, k)), F.lit(0.0)) for k in range(len(WEIGHTS) + 1)]
    highs = [(F.max(F.get(risks, k)) >= HIGH).cast("int") for k in range(len(WEIGHTS))]
    mean = F.avg(sum((w * F.get(risks, k) for k, w in enumerate(WEIGHTS)), F.lit(0.0)))
    out = df.groupBy(key).agg(
        F.count("*").alias("n"),
        (sum(spreads[1:], spreads[0]) / len(spreads)).alias("dispersion"),
        (F.sum(cuts) / F.count("*")).alias("density"),
        (sum(highs[1:], highs[0]) / len(highs)).alias("high_modes"),
        mean.alias("__mean"),
    )
    varied = F.least(F.lit(1.0), 2.2 * F.col("dispersion") + 0.12 * F.col("density") + 0.25 * F.col("high_modes"))
    out = out.withColumn("heterogeneity", varied)
    unsure = F.least(F.lit(1.0), 0.55 * F.col("heterogeneity") + 0.30 * F.col("__mean") + 0.15 / F.sqrt("n"))
    return out.withColumn("uncertainty", unsure).drop("__mean")
