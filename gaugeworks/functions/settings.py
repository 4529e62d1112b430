"""The settings of an analysis: what the named profiles hold, and the ranges of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Each setting in the profiles fast, balance and precise, its least and its
# most.  A name as least is another setting, taken as given.
PROFILES = ("fast", "balance", "precise")
SETTINGS: dict[str, tuple] = {
    "whole_video_max_sec": (12.0, 20.0, 30.0, 1.0, None),
    "scout_duration_sec": (1.5, 2.0, 2.5, 0.5, None),
    "scout_multiplier": (3, 4, 6, 1, 10),
    "scout_max_windows": (12, 32, 64, 1, 128),
    "sample_duration_sec": (4.0, 5.0, 6.0, 1.0, None),
    "sample_count_under_10m": (3, 4, 6, 1, 16),
    "sample_count_10_to_60m": (3, 5, 7, 1, 16),
    "sample_count_60_to_180m": (4, 6, 8, 1, 16),
    "sample_count_over_180m": (4, 6, 10, 1, 16),
    "holdout_window_count": (1, 2, 3, 0, 8),
    "holdout_window_count_over_180m": (1, 2, 4, 0, 8),
    "coarse_max_candidates": (3, 4, 5, 1, 8),
    "exact_max_candidates": (2, 3, 4, 2, 8),
    "coarse_vmaf_subsample": (5, 3, 3, 1, None),
    "exact_vmaf_subsample": (1, 1, 1, 1, None),
    "min_search_tolerance_bps": (100_000, 50_000, 25_000, 1_000, None),
    "search_tolerance_ratio": (0.06, 0.03, 0.015, 0.005, 0.25),
    "max_refinement_rounds": (1, 2, 2, 0, 4),
    "preferred_vmaf_margin": (0.2, 0.4, 0.5, 0.0, 5.0),
    "search_min_windows": (2, 3, 4, 1, 16),
    "search_max_windows": (4, 6, 10, "search_min_windows", 16),
    "holdout_target_min": (1, 1, 2, 0, 8),
    "holdout_target_max": (1, 2, 4, "holdout_target_min", 8),
    "reserve_window_count": (1, 2, 4, 0, 8),
    "quality_confidence_band": (0.7, 0.7, 0.7, 0.1, 2.0),
}
#: These are odd: an even number becomes the one below it.
ODD = ("coarse_vmaf_subsample", "exact_vmaf_subsample")


def clamped(given: dict[str, Column]) -> dict[str, Column]:
    """Each setting within its range; what is null or not given is the balance profile's."""
    default = PROFILES.index("balance")
    raw = {name: F.coalesce(given.get(name, F.lit(None)), F.lit(values[default])) for name, values in SETTINGS.items()}
    out = {}
    for name, values in SETTINGS.items():
        least, most = values[3:]
        kind = "double" if isinstance(values[0], float) else "int"
        low = raw[least].cast(kind) if isinstance(least, str) else F.lit(least).cast(kind)
        value = F.greatest(low, raw[name].cast(kind))
        if name in ODD:
            value = value - F.when(value % 2 == 0, 1).otherwise(0)
        out[name] = value if most is None else F.least(F.lit(most).cast(kind), value)
    return out


def profiles(spark: SparkSession) -> DataFrame:
    """Three rows: a profile's name and its settings."""
    rows = [(name, *(values[k] for values in SETTINGS.values())) for k, name in enumerate(PROFILES)]
    kinds = ", ".join(f"{n} {'double' if isinstance(v[0], float) else 'int'}" for n, v in SETTINGS.items())
    return spark.createDataFrame(rows, f"profile string, {kinds}")


def bound(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the settings of their named profile, clamped; an unknown name in
    any case counts as balance.  Settings that ``rows`` already has are replaced."""
    own = rows.drop(*SETTINGS)
    text = F.col(name).cast("string")
    known = F.when(text.isin(*PROFILES), text).otherwise("balance")
    held = profiles(rows.sparkSession)
    held = held.select("profile", *(c.alias(n) for n, c in clamped({n: F.col(n) for n in SETTINGS}).items()))
    joined = own.withColumn("__profile", known).join(F.broadcast(held), F.col("__profile") == F.col("profile"))
    return joined.select(*(own[f"`{c}`"] for c in own.columns), *SETTINGS)
