"""Corpus evaluation: case metrics with nulls for what was not observed, and summaries
that carry their denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def analysis_cost(analysis: Column, final: Column) -> Column:
    """Share of the final time spent on analysis; null unless the final time is positive."""
    return F.when(final > 0, analysis / final)


def false_pass(passed: Column, truth: Column) -> Column:
    return F.when(passed.isNotNull() & truth.isNotNull(), passed & ~truth)


def false_block(blocked: Column, actual: Column, most: Column) -> Column:
    """A10: blocked for its size although the whole output fits; null if one of the three
    is missing or a size is not positive."""
    seen = blocked.isNotNull() & (actual > 0) & (most > 0)
    return F.when(seen, blocked & (actual <= most))


def regret(selected: Column, best: Column) -> tuple[Column, Column]:
    """Absolute regret, and relative where the best is positive."""
    gap = selected - best
    return gap, F.when(best > 0, gap / best)


def rate(df_flag: str) -> list[Column]:
    """Count, observed and rate of a boolean column; the rate is null if none is observed."""
    hit, seen = F.count_if(F.col(df_flag)), F.count(df_flag)
    return [hit.alias(f"{df_flag}_count"), seen.alias(f"{df_flag}_observed"), F.try_divide(hit.cast("double"), seen.cast("double")).alias(f"{df_flag}_rate")]


def summary(cases: DataFrame, failed: Column, flags: list[str], means: list[str], totals: list[str]) -> DataFrame:
    """One row: cases, successes, failures; rates of ``flags`` and means of ``means`` over
    the successes that have them; totals of the non-negative values of ``totals``."""
    ok = ~failed
    kept = cases.withColumns({c: F.when(ok, F.col(c)) for c in [*flags, *means]} | {"__ok": ok})
    out = [F.count("*").alias("n_cases"), F.count_if("__ok").alias("n_ok"), F.count_if(~F.col("__ok")).alias("n_failed")]
    for f in flags:
        out += rate(f)
    for m in means:
        out += [F.avg(m).alias(f"{m}_mean"), F.count(m).alias(f"{m}_observed")]
    for t in totals:
        out.append(F.coalesce(F.sum(F.when(F.col(t) >= 0, F.col(t))), F.lit(0)).alias(f"{t}_total"))
    return kept.agg(*out)
