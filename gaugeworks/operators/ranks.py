"""Ranks, strata, neighbours and top-k, per key or over the whole table.

Whole-table ranks are computed without one global window: values are counted, the
distinct values' running sums are taken over range partitions, so no task holds the
table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.plans.shared import settled


def midrank(df: DataFrame, metric: str, key: Sequence[str] = (), out: str = "midrank") -> DataFrame:
    """``df`` with the mid-rank of ``metric`` in 0..1 within ``key``: ties share the mean
    of their places; a lone row gets 0.5."""
    return keyed_midrank(df, metric, key, out) if key else global_midrank(df, metric, out)


def _ranged(df: DataFrame, parts: int, order: Sequence[str]) -> DataFrame:
    """``df`` dealt into ranges, with the range as ``__p``.  Both readers must see the
    same bounds, which are sampled, so the ranges are written once dealt: a lost executor
    costs nothing of them."""
    return settled(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))


def global_midrank(df: DataFrame, metric: str, out: str = "midrank", parts: int | None = None) -> DataFrame:
    """The same over the whole table: counts by value, running sums inside ranges of
    values, and one offset a range (as many rows as ranges)."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(F.col(metric).alias("__v")).agg(F.count("*").alias("__c"))
    ranged = _ranged(counts, parts, ["__v"])
    totals = ranged.groupBy("__p").agg(F.sum("__c").alias("__t"))
    offsets = totals.select("__p", (F.sum("__t").over(Window.orderBy("__p")) - F.col("__t")).alias("__o"), F.sum("__t").over(Window.partitionBy()).alias("__n"))
    inner = F.sum("__c").over(Window.partitionBy("__p").orderBy("__v")) - F.col("__c")
    placed = ranged.withColumn("__i", inner).join(F.broadcast(offsets), "__p")
    low = F.col("__o") + F.col("__i")
    rank = F.when(F.col("__n") == 1, 0.5).otherwise((low + (F.col("__c") - 1) / F.lit(2.0)) / (F.col("__n") - 1))
    ranked = placed.select("__v", rank.alias(out))
    return df.join(ranked, F.col(metric).eqNullSafe(F.col("__v"))).drop("__v")


def keyed_midrank(df: DataFrame, metric: str, key: Sequence[str], out: str = "midrank", parts: int | None = None) -> DataFrame:
    """The same within each key, which may be a large part of the table: counts by key
    and value, running sums inside ranges, and one offset a key and range."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"__k{i}" for i in range(len(key))]
    counts = df.groupBy(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col(metric).alias("__v")).agg(F.count("*").alias("__c"))
    ranged = _ranged(counts, parts, [*names, "__v"])
    totals = ranged.groupBy("__p", *names).agg(F.sum("__c").alias("__t"))
    before = F.sum("__t").over(Window.partitionBy(*names).orderBy("__p")) - F.col("__t")
    offsets = totals.select(F.col("__p").alias("__q"), *[F.col(n).alias(f"{n}o") for n in names], before.alias("__o"), F.sum("__t").over(Window.partitionBy(*names)).alias("__n"))
    inner = F.sum("__c").over(Window.partitionBy("__p", *names).orderBy("__v")) - F.col("__c")
    same = F.col("__p") == F.col("__q")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}o"))
    placed = ranged.withColumn("__i", inner).join(offsets, same)
    low = F.col("__o") + F.col("__i")
    rank = F.when(F.col("__n") == 1, 0.5).otherwise((low + (F.col("__c") - 1) / F.lit(2.0)) / (F.col("__n") - 1))
    ranked = placed.select(*names, "__v", rank.alias(out))
    of = F.col(metric).eqNullSafe(F.col("__v"))
    for k, n in zip(key, names):
        of = of & F.col(k).eqNullSafe(F.col(n))
    return df.join(ranked, of).drop("__v", *names)


def risk(raw: Column, rank: Column, scale: float) -> Column:
    """0.55 of the value on its scale and 0.45 of its rank."""
    return 0.55 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw / scale)) + 0.45 * rank


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key.  ``order`` should end in a unique column."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def stratum(position: Column, length: Column, bins: int) -> Column:
    """Which of ``bins`` equal parts of 0..length a position lies in; the last is closed."""
    out = F.lit(bins - 1)
    for k in range(bins - 2, -1, -1):
        out = F.when(position < length * (k + 1) / bins, k).otherwise(out)
    return out


def falls(df: DataFrame, key: str, order: Sequence[str], metric: str, tolerance: float) -> DataFrame:
    """Rows whose next value is lower by more than ``tolerance``, with ``next_value``."""
    after = F.lead(metric).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("next_value", after).where(F.col("next_value") < F.col(metric) - tolerance)


def threshold_crossing(df: DataFrame, key: str, x: str, y: str, target: float) -> DataFrame:
    """(key, x_at): where a curve first passes ``target`` between neighbours, linearly;
    else the least ``x`` that passes; keys that never pass have no row."""
    by = Window.partitionBy(key).orderBy(x)
    pairs = df.select(key, x, y, F.lead(x).over(by).alias("x2"), F.lead(y).over(by).alias("y2"))
    crosses = (F.col(y) < target) & (F.col("y2") >= target)
    at = F.col(x) + (target - F.col(y)) / (F.col("y2") - F.col(y)) * (F.col("x2") - F.col(x))
    found = pairs.groupBy(key).agg(F.min_by(F.when(crosses, F.bround(at, 0)), F.when(crosses, F.col(x))).alias("c"), F.min(F.when(F.col(y) >= target, F.col(x))).alias("p"))
    return found.select(key, F.coalesce("c", "p").alias("x_at")).where("x_at is not null")


def segments(df: DataFrame, key: str, point: str, low: Column, high: Column) -> DataFrame:
    """(key, start, end): the parts that the points cut ``low``..``high`` into."""
    inner = df.where((F.col(point) > low) & (F.col(point) < high)).select(key, F.col(point).alias("p"))
    ends = df.select(key, low.alias("p")).unionByName(df.select(key, high.alias("p")))
    cuts = inner.unionByName(ends).distinct()
    return cuts.select(key, F.col("p").alias("start"), F.lead("p").over(Window.partitionBy(key).orderBy("p")).alias("end")).where("end is not null")


def even_starts(last: Column, n: Column) -> Column:
    """``n`` evenly spaced starts over 0..last; a lone one is centred."""
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * last / (n - 1))
    return F.when(n == 1, F.array(last / 2)).otherwise(spread)


def round_robin(df: DataFrame, order: Sequence[str], lanes: int, parts: int | None = None) -> DataFrame:
    """``lane``: the place of a row in the whole order modulo ``lanes``, by running
    numbers inside ranges and one offset a range."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = _ranged(df, parts, order)
    totals = ranged.groupBy("__p").agg(F.count("*").alias("__t"))
    offsets = totals.select("__p", (F.sum("__t").over(Window.orderBy("__p")) - F.col("__t")).alias("__o"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return ranged.withColumn("__i", place).join(F.broadcast(offsets), "__p").withColumn("lane", F.pmod(F.col("__o") + F.col("__i"), F.lit(lanes)).cast("int")).drop("__p", "__i", "__o")
