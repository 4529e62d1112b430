"""Ordered work on keys of any length.

A window function sorts a key in one task, and an exact percentile keeps a map of a key's
values there.  Both are right for short keys.  The rows of a long key are dealt into ranges
of their order instead, over all tasks: a running fold is the fold inside a range and that
of the ranges before it, a frame of few rows is whole in a block of successive rows and those
just before it, and a percentile is the value at which the running count reaches its place.

Long keys are found by one count a key.  They have more rows than a number that callers
give and than a 50,000th of all rows of such keys, so there are fewer than 50,000: tables of
them, and of them and ranges, are broadcast."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.plans.shared import settled

#: Rows beyond which a key is long.
LONG = 1 << 20
#: Most long keys there can be.
KEYS = 50_000
#: Successive rows of a long key that are put into one block, if frames are no longer.
BLOCK = 1 << 16


def added(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


#: Folds by kind: over rows, and of two parts of them.
FOLDS = {"sum": (F.sum, added), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def folded(by: Sequence[str], order: Sequence[str], folds: Mapping[str, tuple[str, Column]], after: bool, peers: bool) -> dict[str, Column]:
    """The running folds as window functions."""
    ends = (Window.currentRow, Window.unboundedFollowing) if after else (Window.unboundedPreceding, Window.currentRow)
    over = Window.partitionBy(*by).orderBy(*order)
    over = over.rangeBetween(*ends) if peers else over.rowsBetween(*ends)
    return {name: FOLDS[kind][0](column).over(over) for name, (kind, column) in folds.items()}


class Keys:
    """The keys of ``df``, told apart by their number of rows.  A null key is a key."""

    def __init__(self, df: DataFrame, key: str, long: int = LONG):
        self.key, self.hot = key, None
        counts = df.groupBy(F.col(key).alias("__h")).agg(F.count("*").alias("__rows"))
        found = settled(counts.where(F.col("__rows") > long))
        total = found.agg(F.sum("__rows")).first()[0]
        if total:
            self.hot = found.where(F.col("__rows") * KEYS > total).select("__h", F.lit(True).alias("__long"))

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The rows of short keys, and those of long ones if there are any."""
        if self.hot is None:
            return df, None
        marked = df.join(F.broadcast(self.hot), F.col(self.key).eqNullSafe(F.col("__h")), "left")
        return (marked.where(rows).drop("__h", "__long") for rows in ("__long is null", "__long"))

    def meet(self, df: DataFrame, other: DataFrame) -> DataFrame:
        """``df`` with the columns of ``other``, which has one row a key: long keys' rows
        stay where they are."""
        theirs = other.withColumnRenamed(self.key, "__o")

        def join(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.join(b, F.col(self.key).eqNullSafe(F.col("__o"))).drop("__o")

        short, long = self.split(df)
        if long is None:
            return join(short, theirs)
        few = theirs.join(F.broadcast(self.hot), F.col("__o").eqNullSafe(F.col("__h")), "left_semi")
        return join(short, theirs).unionByName(join(long, F.broadcast(few)))

    def running(self, df: DataFrame, order: Sequence[str], folds: Mapping[str, tuple[str, Column]], after: bool = False, peers: bool = False) -> DataFrame:
        """``df`` with, for each name of ``folds``, the sum, least or greatest of a column
        from the key's first row to each row, or ``after`` it to the last one; with
        ``peers`` rows that tie in ``order`` count as one place.  Sums of doubles of a long
        key are added range by range, which rounds otherwise than row by row."""
        short, long = self.split(df)
        out = short.withColumns(folded([self.key], order, folds, after, peers))
        if long is None:
            return out
        return out.unionByName(self.by_ranges(long, order, folds, after, peers).select(*out.columns))

    def by_ranges(self, long: DataFrame, order: Sequence[str], folds: Mapping[str, tuple[str, Column]], after: bool = False, peers: bool = False) -> DataFrame:
        """``running`` for rows of long keys.  Both readers of the ranges must see the same
        bounds, which are sampled, so the ranges are written once dealt."""
        parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = settled(long.repartitionByRange(parts, self.key, *order).withColumn("__p", F.spark_partition_id()))
        totals = ranged.groupBy(F.col(self.key).alias("__k"), F.col("__p").alias("__q")).agg(*(FOLDS[kind][0](column).alias(f"__t_{name}") for name, (kind, column) in folds.items()))
        rest = Window.partitionBy("__k").orderBy("__q")
        rest = rest.rowsBetween(1, Window.unboundedFollowing) if after else rest.rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select("__k", "__q", *(FOLDS[kind][0](f"__t_{name}").over(rest).alias(f"__c_{name}") for name, (kind, _) in folds.items()))
        inside = ranged.withColumns(folded(["__p", self.key], order, folds, after, peers))
        held = inside.join(F.broadcast(carried), (F.col("__p") == F.col("__q")) & F.col(self.key).eqNullSafe(F.col("__k")))
        return held.withColumns({name: FOLDS[kind][1](F.col(f"__c_{name}"), F.col(name)) for name, (kind, _) in folds.items()}).select(*long.columns, *folds)

    def blocks(self, df: DataFrame, order: Sequence[str], rows: int) -> tuple[DataFrame, list[str]]:
        """``df`` with ``__own``, and the columns to partition a window by whose frames end
        at the current row and have at most ``rows`` rows.  Rows that are not ``__own`` are
        there for the frames of later rows only, at most once each."""
        short, long = self.split(df)
        if long is None:
            return short.withColumn("__own", F.lit(True)), [self.key]
        size = max(BLOCK, rows)
        placed = self.by_ranges(long, order, {"__i": ("sum", F.lit(1))})
        own, last = F.floor((F.col("__i") - 1) / size), F.floor((F.col("__i") + (rows - 2)) / size)
        dealt = placed.withColumn("__b", F.explode(F.sequence(own, F.greatest(own, last)))).withColumn("__own", F.col("__b") == own).drop("__i")
        whole = short.withColumns({"__b": F.lit(0).cast("long"), "__own": F.lit(True)})
        return whole.unionByName(dealt.select(*whole.columns)), [self.key, "__b"]

    def at_places(self, df: DataFrame, metric: str, places: Mapping[str, Callable[[Column], Column]], whole: Mapping[str, Column]) -> DataFrame:
        """(key, name of each place): the value at a place, from 1, of a key's sorted
        values; ``places`` say it by the number of values, ``whole`` as an aggregate, which
        short keys use.  Nulls are no values; a key without any has nulls."""
        short, long = self.split(df.select(self.key, metric))
        out = short.groupBy(self.key).agg(*(c.alias(name) for name, c in whole.items()))
        if long is None:
            return out
        kind = df.schema[metric].dataType
        counts = long.groupBy(self.key, F.col(metric).alias("__v")).agg(F.count(metric).alias("__c"))
        upto = self.by_ranges(counts, ["__v"], {"__s": ("sum", F.col("__c"))})
        sizes = long.groupBy(F.col(self.key).alias("__k")).agg(F.count(metric).alias("__n"))
        found = upto.join(F.broadcast(sizes), F.col(self.key).eqNullSafe(F.col("__k"))).groupBy(self.key).agg(*(F.min(F.when((F.col("__s") >= place(F.col("__n"))) & (F.col("__c") > 0), F.col("__v"))).cast(kind).alias(name) for name, place in places.items()))
        return out.unionByName(found)


def nearest_ranks(df: DataFrame, key: str, metric: str, shares: Mapping[str, float], long: int = LONG, keys: Keys | None = None) -> DataFrame:
    """A1, A2: (key, name of each share): the element at ``ceil(n * share)`` of the key's
    sorted values.  Only keys of at most ``long`` rows are listed in a task."""
    places = {name: lambda n, s=share: F.greatest(F.lit(1), F.ceil(n * F.lit(s))) for name, share in shares.items()}
    whole = {name: F.expr(f"percentile_disc({share}) within group (order by {metric})") for name, share in shares.items()}
    return (keys or Keys(df, key, long)).at_places(df, metric, places, whole)


def medians(df: DataFrame, key: str, metric: str, long: int = LONG, keys: Keys | None = None) -> DataFrame:
    """(key, median): the mean of the two middle values, doubles."""
    keys = keys or Keys(df, key, long)
    short, long_ = keys.split(df)
    out = short.groupBy(key).agg(F.median(metric).alias("median"))
    if long_ is None:
        return out
    middle = {"__lo": lambda n: F.floor((n + 1) / 2), "__hi": lambda n: F.floor(n / 2) + 1}
    two = keys.at_places(long_, metric, middle, {name: F.max(metric) for name in middle})
    return out.unionByName(two.select(key, ((F.col("__lo") + F.col("__hi")) / 2).alias("median")))
