"""Size predictions of many sources at once, as DataFrames.

A source is measured in a few windows, each of which got some rate for the rate asked
for.  Its arrays stay arrays, so a source is one row and a prediction is one expression:
no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.expr import clamp, predicted_size, whole

# Limits of ratios, slopes and uncertainty, and the uncertainty's terms.
RATIO = (0.0001, 4.0)
SLOPE = 0.75
UNSURE = (0.05, 0.30)
BASE, BY_COUNT, BY_RESIDUAL, BY_TIMELINE = 0.03, 0.14, 1.5, 0.20
FITTED, PLAIN = "risk_distribution_clipped_theil_sen", "robust_median_window_ratio"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: an expression named several times, or inside
    a lambda, is computed each time and for each element, and so is all that it holds."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def median(values: Column) -> Column:
    """The median of the numbers of an array, nulls left out; null if there are none."""

    def middle(ordered: Column) -> Column:
        low, high = F.shiftright(F.size(ordered) - 1, 1), F.shiftright(F.size(ordered), 1)
        return F.when(F.size(ordered) > 0, (F.get(ordered, low) + F.get(ordered, high)) / 2)

    return once(F.sort_array(F.array_compact(values)), middle)


def mean(values: Column) -> Column:
    return once(values, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)))


def spread(values: Column) -> Column:
    """Population standard deviation of an array; 0 for fewer than two values."""
    off = once(mean(values), lambda centre: F.transform(values, lambda x: (x - centre) * (x - centre)))
    return F.when(F.size(values) > 1, F.sqrt(mean(off))).otherwise(0.0)


def line(risks: Column, ratios: Column) -> Column:
    """(low, slope): the median of the pairwise slopes, limited, and the median of what it
    leaves; a constant where all risks are the same."""

    def slopes(points: Column) -> Column:
        def from_(p: Column, i: Column) -> Column:
            later = F.filter(F.slice(points, i + 2, F.size(points)), lambda q: F.abs(q["x"] - p["x"]) > 1e-9)
            return F.transform(later, lambda q: (q["y"] - p["y"]) / (q["x"] - p["x"]))

        return F.flatten(F.transform(points, from_))

    def fit(points: Column) -> Column:
        slope = once(median(slopes(points)), lambda m: F.when(m.isNotNull(), clamp(m, -SLOPE, SLOPE)).otherwise(0.0))
        return once(slope, lambda s: F.struct(median(F.transform(points, lambda p: p["y"] - s * p["x"])).alias("low"), s.alias("slope")))

    return once(F.arrays_zip(risks.alias("x"), ratios.alias("y")), fit)


def predicted_sizes(df: DataFrame, requested: str, observed: str, duration: str, audio: str, source_bytes: str, risks: str | None = None, timeline: str | None = None) -> DataFrame:
    """``df`` with ``mean_rate``, ``upper_rate``, ``predicted_bytes``,
    ``predicted_ratio``, ``uncertainty`` and ``method``.

    ``observed`` holds the rates of the windows (none: as requested), ``risks`` their
    risks and ``timeline`` those of the whole source.  With a risk for each window, a
    limited Theil-Sen line is averaged over the timeline; else the median ratio holds.
    The line's values are limited like ratios before the residuals are taken, and the
    residuals are not centred.  Rows whose rate or duration is not positive get nulls."""
    good = (F.col(requested) > 0) & (F.col(duration) > 0)
    rate = F.when(good, F.col(requested).cast("double"))
    seen = F.when(F.size(observed) > 0, F.col(observed)).otherwise(F.array(F.col(requested)))
    ratios = F.transform(seen, lambda v: clamp(F.greatest(F.lit(0.0), v.cast("double")) / rate, *RATIO))
    out = df.withColumn("__ratios", ratios)
    ratios = F.col("__ratios")
    if risks and timeline:
        fitted = F.coalesce((F.size(risks) == F.size(ratios)) & (F.size(timeline) > 0), F.lit(False))
        out = out.withColumn("__fit", F.when(fitted, line(F.col(risks), ratios)))
        on_line = lambda r: clamp(F.col("__fit.low") + F.col("__fit.slope") * r, *RATIO)
        central = F.coalesce(mean(F.transform(F.col(timeline), on_line)), median(ratios))
        left = F.zip_with(ratios, F.col(risks), lambda y, r: F.abs(y - on_line(r)))
        varied = F.when(fitted, spread(F.col(timeline))).otherwise(0.0)
    else:
        fitted, central, left, varied = F.lit(False), median(ratios), None, F.lit(0.0)
    out = out.withColumns({"__central": F.when(fitted, central).otherwise(median(ratios)), "__varied": varied})
    flat = F.transform(ratios, lambda y: F.abs(y - F.col("__central")))
    residual = median(flat if left is None else F.when(fitted, left).otherwise(flat))
    unsure = clamp(BASE + BY_COUNT / F.sqrt(F.size(ratios)) + BY_RESIDUAL * residual + BY_TIMELINE * F.col("__varied"), *UNSURE)
    out = out.withColumn("uncertainty", F.when(good, unsure))
    average = F.greatest(F.lit(1).cast("long"), whole(rate * F.col("__central")))
    out = out.withColumn("mean_rate", F.when(good, average))
    out = out.withColumn("upper_rate", F.greatest(F.col("mean_rate"), whole(F.col("mean_rate") * (1 + F.col("uncertainty")))))
    out = out.withColumn("predicted_bytes", predicted_size(F.col("upper_rate"), F.greatest(F.lit(0), F.col(audio)), F.col(duration)))
    out = out.withColumn("predicted_ratio", F.when(F.col(source_bytes) > 0, F.col("predicted_bytes") / F.col(source_bytes)))
    out = out.withColumn("method", F.when(good, F.when(fitted, FITTED).otherwise(PLAIN)))
    return out.drop("__ratios", "__fit", "__central", "__varied")


def refreshed(candidates: DataFrame, prior: str, requested: str, observed: str, duration: str, audio: str, source_bytes: str, sizes: Sequence[str] = ()) -> DataFrame:
    """Predictions of candidates under a new audio budget.  One with a prior
    prediction (a struct ``mean_rate, upper_rate, uncertainty, method``) keeps its rates
    and gets new bytes; another is predicted from its observed rates, or from the bytes
    and durations of its windows (two arrays, ``sizes``) where it has none."""
    out = candidates
    if sizes:
        taken, lasted = sizes
        pairs = F.filter(F.arrays_zip(F.col(taken).alias("b"), F.col(lasted).alias("d")), lambda p: p["d"] > 0)
        rates = F.transform(pairs, lambda p: F.ceil(p["b"] * 8.0 / p["d"]).cast("long"))
        out = out.withColumn(observed, F.when(F.size(observed) > 0, F.col(observed)).otherwise(rates))
    held = F.col(prior)
    new = predicted_sizes(out, requested, observed, duration, audio, source_bytes)
    for name in ("mean_rate", "upper_rate", "uncertainty", "method"):
        new = new.withColumn(name, F.when(held.isNotNull(), held[name]).otherwise(F.col(name)))
    bytes_ = predicted_size(F.col("upper_rate"), F.greatest(F.lit(0), F.col(audio)), F.col(duration))
    new = new.withColumn("predicted_bytes", bytes_)
    return new.withColumn("predicted_ratio", F.when(F.col(source_bytes) > 0, F.col("predicted_bytes") / F.col(source_bytes)))
