"""Bracketed searches of many sources at once, in rounds of measurements.

Every source is one row with the state of its search.  A round takes the settings that all
open searches ask for next, has them measured as one table, joins the results back and
moves each search on.  Nothing needs to be measured beforehand: ``evaluate`` gets the
(key, rate) pairs of a round and returns them with what was found, in tasks.  Finished
sources leave the rounds, so a round carries and writes open ones only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 1000
LIMIT = 8
#: Quality above the target from which a first guess is worth one try below it.
SPARE = 0.8

Evaluate = Callable[[DataFrame], DataFrame]
Settle = Callable[[DataFrame], DataFrame]

#: What is kept of a measured rate.  ``observed`` are its windows' rates, ``central`` and
#: ``bytes`` the sizes they lead to, ``complete`` whether all windows were measured.
TRIED = "array<struct<rate:bigint,quality:double,central:bigint,bytes:bigint,observed:array<bigint>,complete:boolean>>"
FIELDS = ("rate", "quality", "central", "bytes", "observed", "complete")


def none_tried() -> Column:
    return F.array().cast(TRIED)


def down(x: Column) -> Column:
    return F.greatest(F.lit(STEP).cast("long"), (F.floor(x / STEP) * STEP).cast("long"))


def up(x: Column) -> Column:
    return F.greatest(F.lit(STEP).cast("long"), (F.ceil(x / STEP) * STEP).cast("long"))


def opened(searches: DataFrame, key: str, carried: Sequence[str] = ()) -> DataFrame:
    """The first state of each search, with the columns ``carried``."""
    longs = {c: F.col(c).cast("long") for c in ("least", "budget", "ceiling", "tolerance", "first")}
    budget, low = down(longs["budget"]), up(longs["least"])
    top = down(F.greatest(longs["ceiling"], budget))
    guess = F.least(down(F.greatest(low, longs["first"])), top)
    return searches.select(
        key,
        *carried,
        F.col("target").cast("double").alias("target"),
        F.least(F.lit(LIMIT), F.greatest(F.lit(0), F.col("limit"))).cast("int").alias("limit"),
        F.greatest(F.lit(STEP).cast("long"), F.coalesce(longs["tolerance"], F.lit(STEP))).alias("tolerance"),
        low.alias("floor"),
        budget.alias("budget"),
        top.alias("top"),
        F.coalesce(F.col("known").cast(TRIED), none_tried()).alias("tried"),
        F.lit(0).alias("spent"),
        F.when(longs["first"].isNull(), "budget").otherwise("first").alias("stage"),
        F.when(longs["first"].isNull(), budget).otherwise(guess).alias("probe"),
        F.lit(None).cast("long").alias("low"),
        F.lit(None).cast("long").alias("high"),
    )


def quality_of(tried: Column, rate: Column) -> Column:
    return F.try_element_at(F.transform(F.filter(tried, lambda t: t["rate"] == rate), lambda t: t["quality"]), F.lit(1))


def holds(tried: Column, rate: Column) -> Column:
    return F.exists(tried, lambda t: t["rate"] == rate)


def transitions() -> tuple[list[Column], list[Column], list[Column]]:
    """How every search moves on from the result of its probe: what ``tried`` holds of it,
    or nothing where no try was left.  A stage that has ended is ``none`` (neither rate is
    chosen), ``both`` or ``required``.  Three steps of columns, each over the one before: a
    lambda that reads a column would find one of the same name in its own step instead."""
    c = F.col
    got = c("got")
    passes = F.coalesce(c("quality") >= c("target"), F.lit(False))
    at = lambda name: c("stage") == name
    ample = passes & (c("quality") >= c("target") + SPARE) & (c("spent") < c("limit"))
    nearby = down(F.greatest(c("floor"), c("probe") - F.greatest(c("tolerance"), F.floor((c("probe") - c("floor")) / 3).cast("long"))))
    bisecting = c("stage").isin("down", "up")
    # (when, stage, probe, low, high); stages that bisect get their probe below
    cases: Sequence[tuple[Column, str | None, Column | None, Column | None, Column | None]] = [
        (at("first") & ample, "nearby", nearby, None, None),
        (at("first") & passes | at("nearby"), "both", None, None, None),
        (at("first"), "budget", c("budget"), None, None),
        (at("budget") & passes, "minimum", c("floor"), None, None),
        (at("budget") & got & (c("top") > c("budget")), "ceiling", c("top"), None, None),
        (at("budget"), "none", None, None, None),
        (at("minimum") & passes, "both", None, None, None),
        (at("minimum"), "down", None, c("floor"), c("budget")),
        (at("ceiling") & passes, "up", None, c("budget"), c("top")),
        (at("ceiling"), "none", None, None, None),
        (bisecting & passes, None, None, c("low"), c("probe")),
        (bisecting & got, None, None, c("probe"), c("high")),
    ]

    def field(index: int, held: Column, empty: Column | None = None) -> Column:
        out = held if empty is None else empty
        for case in reversed(cases):
            value = case[index]
            if value is not None:
                out = F.when(case[0], F.lit(value) if isinstance(value, str) else value).otherwise(out)
            elif empty is not None or index == 1:
                out = F.when(case[0], held if empty is None else empty).otherwise(out)
        return out

    none = F.lit(None).cast("long")
    kept = [c(n) for n in ("target", "limit", "tolerance", "floor", "budget", "top", "tried", "spent")]
    read = [*kept, c("stage"), c("probe"), c("low"), c("high"), quality_of(c("tried"), c("probe")).alias("quality"), holds(c("tried"), c("probe")).alias("got")]
    there = [*kept, (bisecting & ~got).alias("lost"), field(1, c("stage")).alias("stage"), field(2, none, none).alias("next"), field(3, c("low")).alias("low"), field(4, c("high")).alias("high")]
    middle = down(F.floor((c("low") + c("high")) / 2))
    halves = c("stage").isin("down", "up")
    open_ = ~c("lost") & (c("spent") < c("limit")) & (c("high") - c("low") > c("tolerance")) & ~holds(c("tried"), middle)
    ended = F.when(c("stage") == "up", "required").otherwise("both")
    after = [*kept, F.when(halves & ~open_, ended).otherwise(c("stage")).alias("stage"), F.when(halves & open_, middle).when(~halves, c("next")).alias("probe"), c("low"), c("high")]
    return read, there, after


def search_rounds(searches: DataFrame, key: str, evaluate: Evaluate, settle: Settle, carried: Sequence[str] = ()) -> DataFrame:
    """(key, tried, spent, ended) of every search.

    ``searches``: key, ``least``, ``budget``, ``ceiling`` (rates), ``target``, ``limit`` (at most
    so many rates are measured, never more than ``LIMIT``), ``tolerance``, ``first`` (a guess,
    or null) and ``known`` (an array like ``TRIED``, or null: results that cost no try).
    The budget is tried first: if it passes, the search goes down to ``least``, else up to
    ``ceiling``.  A ``first`` guess that passes ends the search, after one try below it if
    it has quality to spare.  ``evaluate`` takes (key, rate) and returns these with the other
    ``FIELDS`` it knows; a pair it does not return has failed.  It gets the columns ``carried``
    of ``searches`` too, so that a search which holds what it measures needs no join for it.
    The first round reads ``searches`` twice, so settle what is dear to compute."""
    now, done, steps = opened(searches, key, carried), [], transitions()
    asks = (F.col("spent") < F.col("limit")) & ~holds(F.col("tried"), F.col("probe"))
    while True:
        probes = now.where(asks).select(key, *carried, F.col("probe").alias("rate"))
        found = evaluate(probes)
        held = [F.col(f) if f in found.columns else F.lit(None).alias(f) for f in FIELDS]
        results = found.select(key, F.struct(*held).alias("result"))
        joined = now.join(results, key, "left")
        failed = F.struct(*(F.col("probe").alias(f) if f == "rate" else F.lit(False).alias(f) if f == "complete" else F.lit(None).alias(f) for f in FIELDS))
        new = F.array(F.coalesce(F.col("result"), failed.cast(TRIED[6:-1]))).cast(TRIED)
        tried = F.when(asks, F.concat("tried", new)).otherwise(F.col("tried"))
        spent = F.col("spent") + F.when(asks, 1).otherwise(0)
        after = joined.withColumns({"tried": tried, "spent": spent})
        for step in steps:
            after = after.select(key, *carried, *step)
        after = settle(after)
        ended = F.col("stage").isin("none", "both", "required")
        done.append(after.where(ended).select(key, "tried", "spent", F.col("stage").alias("ended")))
        now = after.where(~ended)
        if now.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def chosen(found: DataFrame, target: Column, most: Column) -> DataFrame:
    """``found`` with ``required``, the cheapest rate tried that passes, and ``selected``, the
    cheapest that passes and whose bytes are at most ``most`` (null: no limit, and then none
    above the budget); null where the search ended without them."""
    rates = lambda holds_: F.array_min(F.transform(F.filter("tried", holds_), lambda t: t["rate"]))
    passes = lambda t: F.coalesce(t["quality"] >= target, F.lit(False))
    fits = lambda t: passes(t) & F.coalesce(most.isNull() | (t["bytes"] <= most), F.lit(False))
    over = (F.col("ended") == "required") & most.isNull()
    selected = F.when((F.col("ended") != "none") & ~over, rates(fits))
    return found.withColumn("required", F.when(F.col("ended") != "none", rates(passes))).withColumn("selected", selected)


def exact_bounds(found: DataFrame, key: str, target: str = "target", least: str = "least", budget: str = "budget", ceiling: str = "ceiling") -> DataFrame:
    """``found`` (a coarse search's ``tried`` with its limits) with the limits of the
    exact one and its ``first`` guess, where the rates tried cross the target."""
    ordered = F.array_sort(F.col("tried"))
    passes = lambda t: F.coalesce(t["quality"] >= F.col(target), F.lit(False))
    seed = F.array_min(F.transform(F.filter(ordered, passes), lambda t: t["rate"]))
    lower = F.array_max(F.transform(F.filter(ordered, lambda t: ~passes(t)), lambda t: t["rate"]))
    found = found.withColumns({"__seed": seed, "__lower": lower, "__next": F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), "__at": ordered})
    pairs = F.filter(F.arrays_zip(F.col("__at").alias("a"), F.col("__next").alias("b")), lambda p: p["b"].isNotNull() & ~passes(p["a"]) & passes(p["b"]))
    cross = F.try_element_at(pairs, F.lit(1))
    found = found.withColumn("__cross", cross)
    a, b = F.col("__cross.a"), F.col("__cross.b")
    gap = b["quality"] - a["quality"]
    between = F.bround(a["rate"] + (F.col(target) - a["quality"]) / gap * (b["rate"] - a["rate"]), 0).cast("long")
    first = F.when(F.col("__cross").isNotNull(), F.when(gap <= 1e-9, b["rate"]).otherwise(between)).otherwise(F.col("__seed"))
    some = F.col("__seed").isNotNull()
    return found.withColumns({
        "first": first,
        least: F.when(some, F.greatest(F.col(least), F.col("__lower"))).otherwise(F.col(least)),
        budget: F.when(some, F.col("__seed")).otherwise(F.col(budget)),
        ceiling: F.when(some, F.greatest("__seed", ceiling)).otherwise(F.col(ceiling)),
    }).drop("__seed", "__lower", "__next", "__at", "__cross")


def in_tasks(function: Callable[..., dict], results: str) -> Evaluate:
    """An evaluator out of a Python function of one row's values, run in tasks batch by
    batch.  ``results`` names and types what it returns (``"quality double"``); a row for
    which it returns null is left out."""
    import pyarrow as pa

    def evaluate(probes: DataFrame) -> DataFrame:
        made = probes.sparkSession.createDataFrame([], results).schema
        names = probes.columns

        def run(batches):
            for batch in batches:
                kept, found = [], []
                for i, row in enumerate(batch.to_pylist()):
                    value = function(**row)
                    if value is not None:
                        kept.append(i)
                        found.append(value)
                own = batch.take(pa.array(kept, pa.int64()))
                columns = [own.column(n) for n in names] + [pa.array([v.get(f.name) for v in found], arrow[f.name]) for f in made]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *made.names])

        from pyspark.sql.pandas.types import to_arrow_type

        arrow = {f.name: to_arrow_type(f.dataType) for f in made}
        return probes.mapInArrow(run, type(made)([*probes.schema.fields, *made.fields]))

    return evaluate
