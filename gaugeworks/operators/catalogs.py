"""Overlays, key comparisons, first-match rules and small lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlay(base: DataFrame, layers: Sequence[DataFrame], key: str, value: str, default=None) -> DataFrame:
    """(key, value) of ``base``'s keys: the first layer that has one wins, then the base,
    then ``default``.  Keys are unique in each layer."""
    out = base.select(key, F.col(value).alias("__base"))
    names = []
    for k, layer in enumerate(layers):
        names.append(f"__l{k}")
        out = out.join(layer.select(key, F.col(value).alias(names[-1])), key, "left")
    choices = [F.col(n) for n in [*names, "__base"]]
    if default is not None:
        choices.append(F.lit(default))
    return out.select(key, F.coalesce(*choices).alias(value))


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has, ``missing`` from the left or ``extra``."""
    missing = right.select(key).distinct().join(left.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    extra = left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def glob_pattern(glob: str) -> str:
    """An anchored pattern: ``**/`` any folders, ``*`` anything, ``?`` one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i] == "*":
            out, i = out + ".*", i + (2 if glob.startswith("**", i) else 1)
        else:
            c = glob[i]
            out, i = out + ("." if c == "?" else c if c.isalnum() or c in "/_-" else "\\" + c), i + 1
    return f"^{out}$"


def first_rule(text: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first rule whose pattern matches."""
    out = F.lit(otherwise)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def required_features(paths: DataFrame, path: str, rules: Sequence[tuple[str, Sequence[str]]], everything: Sequence[str]) -> DataFrame:
    """One row: the sorted union of what the changed paths need; a path without a rule,
    or no path at all, needs everything."""
    needs = F.array(*(F.lit(e) for e in everything))
    for glob, features in reversed(rules):
        needs = F.when(F.col(path).rlike(glob_pattern(glob)), F.array(*(F.lit(f) for f in features))).otherwise(needs)
    found = paths.select(F.explode(needs).alias("f")).agg(F.array_sort(F.collect_set("f")).alias("features"))
    full = F.array(*(F.lit(e) for e in sorted(everything)))
    return found.select(F.when(F.size("features") == 0, full).otherwise(F.col("features")).alias("features"))


def placeholders(template: Column) -> Column:
    """The sorted distinct names in braces, whatever format follows a name."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)[^}]*\}"), 1)))


def distinct_in_order(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values): the distinct values by first appearance."""
    firsts = df.groupBy(key, value).agg(F.min(order).alias("o"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda s: s[value]).alias("values"))


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("__r")).select(key, "__r.*")


def first_runnable(candidates: DataFrame, key: str, priority: str, name: str, runnable: str, message: str) -> DataFrame:
    """(key, name, runnable, error) of each key's candidates, which are few: the first
    that runs by priority (ties by name), else the last one with what all of them said,
    ``name: message`` joined in order of priority."""
    runs, place = F.coalesce(F.col(runnable), F.lit(False)), F.struct(priority, name)
    said = F.when(~runs & (F.coalesce(message, F.lit("")) != ""), F.struct(priority, name, message))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda s: F.concat_ws(": ", s[name], s[message])), "; ")
    found = candidates.groupBy(key).agg(F.min_by(name, F.when(runs, place)).alias("__first"), F.max_by(name, place).alias("__last"), told.alias("__told"))
    fine = F.col("__first").isNotNull()
    error = F.when(~fine, F.when(F.col("__told") != "", F.col("__told")).otherwise("no candidate can run"))
    return found.select(key, F.coalesce("__first", "__last").alias(name), fine.alias("runnable"), error.alias("error"))
