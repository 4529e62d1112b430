"""Choosing candidates under limits: cheapest that passes, best that fits, failure kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def choose(df: DataFrame, key: str, cost: str, quality: str, fits: Column, target: float, margin: float = 0.0, least_budget: Column | None = None) -> DataFrame:
    """One row a key: ``required`` (cheapest that passes), ``selected`` (cheapest that
    passes and fits, with ``margin`` to spare if any has it), ``best_fit`` (the cost of
    the best that fits, cheaper on ties) and ``outcome``: found, budget_too_small,
    size_blocked or unreachable."""
    passes = F.col(quality) >= target
    chosen = passes & fits
    spare = chosen & (F.col(quality) >= target + margin)
    least = F.lit(False) if least_budget is None else least_budget
    best = F.max(F.when(fits, F.struct(F.col(quality).alias("q"), (-F.col(cost)).alias("c"))))
    out = df.groupBy(key).agg(
        F.min(F.when(passes, F.col(cost))).alias("required"),
        F.coalesce(F.min(F.when(spare, F.col(cost))), F.min(F.when(chosen, F.col(cost)))).alias("selected"),
        (-best["c"]).alias("best_fit"),
        F.bool_or(least).alias("small"),
    )
    outcome = F.when(F.col("selected").isNotNull(), "found").when(F.col("small"), "budget_too_small").when(F.col("required").isNotNull(), "size_blocked").otherwise("unreachable")
    return out.withColumn("outcome", outcome).drop("small")


def until_first(df: DataFrame, key: str, order: Sequence[str], stop: Column) -> DataFrame:
    """The rows of each key up to and including the first that ``stop`` holds for."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.sum(F.when(stop, 1).otherwise(0)).over(before), F.lit(0))
    return df.withColumn("__s", stopped).where("__s = 0").drop("__s")


def search_bounds(df: DataFrame, key: str, cost: str, quality: str, target: float) -> DataFrame:
    """(key, lower, seed): the dearest that fails and the cheapest that passes."""
    return df.groupBy(key).agg(F.max(F.when(F.col(quality) < target, F.col(cost))).alias("lower"), F.min(F.when(F.col(quality) >= target, F.col(cost))).alias("seed"))


def complete(scores: Column, minimum: Column, n: int) -> Column:
    """Whether there is one score a window and the minimum is theirs."""
    return (F.size(scores) == n) & (F.abs(F.array_min(scores) - minimum) <= 1e-9)
