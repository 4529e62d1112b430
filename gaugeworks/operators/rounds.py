"""Rounds of verification: settings are searched on some windows of a source, held against
windows they were not chosen on, and chosen again where those fail them (G10 to G13).

All sources go through a step together, each as one row with its windows in an array, so that
only measuring needs windows as rows; only the sources that a step concerns are in it.  If
``settle`` keeps tables in buckets by the key, no step moves a row.  Nothing is measured beforehand: what a step needs to know is asked of ``measure``,
a function from rows to rows that runs in tasks.

Tables: ``sources`` (key, ``target`` quality, ``least``, ``budget`` and ``ceiling`` rates,
``cap`` (a greatest rate, or null), ``most`` bytes, ``tolerance``, ``duration``, ``audio``,
``middle`` (the middle risk of the timeline)); ``windows`` (key, window, pool, start, reasons,
risk, centre and what else ``measure`` needs): pools ``search``, ``holdout``, ``reserve`` and
how many reasons a window was chosen for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.expr import predicted_size
from gaugeworks.operators.frontier import FIELDS, TRIED, Evaluate, Settle, exact_bounds, none_tried, search_rounds
from gaugeworks.operators.sizes import predicted_sizes

AMBIGUOUS = 0.5
CONFIDENT = 0.7

#: The column that holds a source's windows.
MARKS = "__marks"

#: From windows with ``rate`` and ``tier`` (coarse, exact, size, holdout, again) to the same
#: rows with ``quality`` and ``observed`` (the rate the window got; may be absent).
Measure = Callable[[DataFrame], DataFrame]


def sized(rows: DataFrame, observed: str = "observed") -> DataFrame:
    """``rows`` (rate, ``observed``, duration, audio) with ``central`` and ``bytes``, the sizes
    without and with the uncertainty of the prediction."""
    made = predicted_sizes(rows.withColumn("__source", F.lit(None).cast("long")), "rate", observed, "duration", "audio", "__source")
    made = made.withColumns({"central": predicted_size(F.col("mean_rate"), F.greatest(F.lit(0), F.col("audio")), F.col("duration")), "bytes": F.col("predicted_bytes")})
    return made.drop("__source", "mean_rate", "upper_rate", "predicted_bytes", "predicted_ratio", "uncertainty", "method")


def within(marks: str, pool: str) -> Column:
    """The windows of a pool, out of the column that holds all of a source."""
    return F.filter(marks, lambda m: m["pool"] == pool)


def over_windows(key: str, measure: Measure, tier: str, sizes: bool = True) -> Evaluate:
    """Measures rates over the search windows: a rate has the quality of its worst window, and
    unless ``sizes`` is false what the windows' rates say of its size."""

    def evaluate(probes: DataFrame) -> DataFrame:
        own = within(MARKS, "search")
        rows = probes.select(key, "rate", "duration", "audio", F.size(own).alias("__n"), F.inline(own))
        seen = measure(rows.withColumn("tier", F.lit(tier)))
        if not sizes:
            return seen.groupBy(key, "rate").agg(F.min("quality").alias("quality"))
        got = F.col("observed") if "observed" in seen.columns else F.col("rate")
        observed = F.transform(F.sort_array(F.collect_list(F.when(F.col("quality").isNotNull(), F.struct("window", got.cast("long").alias("o"))))), lambda r: r["o"])
        each = seen.groupBy(key, "rate").agg(F.min("quality").alias("quality"), observed.alias("observed"), (F.count("quality") == F.max("__n")).alias("complete"), F.max("duration").alias("duration"), F.max("audio").alias("audio"))
        return sized(each).select(key, *FIELDS)

    return evaluate


def reselected(now: DataFrame, margin: float = 0.0) -> DataFrame:
    """``now`` (sources with ``tried``) with ``outcome``, ``selected``, ``quality`` and
    ``required``: of the candidates within the rates allowed, the cheapest that passes and
    fits, first of all one with ``margin`` to spare; else the cheapest that passes."""
    c = F.col
    low = (F.ceil(c("least") / 1000) * 1000).cast("long")
    within = F.filter("tried", lambda t: (t["rate"] >= F.least(c("least"), low)) & (c("cap").isNull() | (c("cap") <= 0) | (t["rate"] <= c("cap"))))
    out = now.withColumn("__in", within)
    passing = F.filter("__in", lambda t: F.coalesce(t["quality"] >= c("target"), F.lit(False)))
    out = out.withColumn("__pass", passing).withColumn("__fit", F.filter("__pass", lambda t: F.coalesce(t["bytes"] <= c("most"), F.lit(False))))
    spare = F.filter("__fit", lambda t: t["quality"] >= c("target") + margin)
    cheapest = lambda rows: F.array_min(F.transform(rows, lambda t: F.struct(t["rate"], t["quality"], t["bytes"])))
    out = out.withColumn("__best", F.coalesce(cheapest(spare), cheapest(c("__fit")))).withColumn("__least", cheapest(c("__pass")))
    blocked = F.coalesce(c("__least.bytes") > c("most"), F.lit(False))
    outcome = F.when(c("budget") < c("least"), "budget_too_small").when(c("__best").isNotNull(), "found").when(blocked, "size_blocked").otherwise("unreachable")
    out = out.withColumn("outcome", outcome)
    found = c("outcome") == "found"
    out = out.withColumns({"selected": F.when(found, c("__best.rate")), "quality": F.when(found, c("__best.quality")), "required": F.when(~found, c("__least.rate"))})
    return out.drop("__in", "__pass", "__fit", "__best", "__least")


def complete_or_all(tried: Column) -> Column:
    """The candidates that were measured in all windows, or all if none was."""
    whole = F.filter(tried, lambda t: t["complete"])
    return F.when(F.size(whole) > 0, whole).otherwise(tried)


def replaced(tried: Column, new: Column) -> Column:
    """``tried`` with the candidate of ``new``'s rate replaced; null changes nothing."""
    return F.when(new.isNull(), tried).otherwise(F.transform(tried, lambda t: F.when(t["rate"] == new["rate"], new).otherwise(t)))


def drops(tried: Column) -> Column:
    """Whether some rate is worse than the next lower one by more than ``AMBIGUOUS``."""
    ordered = F.array_sort(tried)
    later = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0)))
    return F.exists(F.arrays_zip(ordered.alias("a"), later.alias("b")), lambda p: F.coalesce(p["b"]["quality"] < p["a"]["quality"] - AMBIGUOUS, F.lit(False)))


def first_reserve(marks: str, by_reasons: bool) -> Column:
    """Of a source's reserves the window with most reasons, then the earliest (T12), or just
    the earliest; null if there is none."""
    order = lambda m: F.struct(-m["reasons"] if by_reasons else F.lit(0), m["start"], m["window"].alias("window"))
    return F.array_min(F.transform(within(marks, "reserve"), order))["window"]


def moved_to(marks: str, which: Callable[[Column], Column], pool: str) -> Column:
    """``marks`` with those windows for which ``which`` holds in another pool."""
    return F.transform(marks, lambda m: m.withField("pool", F.when(which(m), F.lit(pool)).otherwise(m["pool"])))


def calibrated_near(now: DataFrame, key: str, measure: Measure) -> DataFrame:
    """(key, candidate) for size-blocked sources whose required candidate fits without
    its uncertainty only: its sizes predicted anew with up to two reserves more."""
    at = F.try_element_at(F.filter("tried", lambda t: t["rate"] == F.col("required")), F.lit(1))
    asked = now.where("outcome = 'size_blocked'").withColumn("c", at)
    asked = asked.where(near_boundary("c.central", "c.bytes", "most")).withColumn("half", F.col("duration") / 2)
    off = lambda m: F.struct(F.abs(F.coalesce(m["risk"], F.lit(0.5)) - F.col("middle")), F.abs(m["centre"] - F.col("half")), m["window"].alias("window"))
    nearest = F.slice(F.sort_array(F.transform(within(MARKS, "reserve"), off)), 1, 2)
    asked = asked.withColumn("__near", F.transform(nearest, lambda n: n["window"]))
    chosen = F.filter(within(MARKS, "reserve"), lambda m: F.array_contains("__near", m["window"]))
    rows = asked.select(key, "middle", "duration", "audio", "half", "c", F.inline(chosen)).withColumns({"risk": F.coalesce("risk", F.lit(0.5)), "rate": F.col("c.rate"), "tier": F.lit("size")})
    more = F.transform(F.sort_array(F.collect_list(F.struct(F.abs(F.col("risk") - F.col("middle")).alias("r"), F.abs(F.col("centre") - F.col("half")).alias("d"), "window", F.col("observed").cast("long").alias("o")))), lambda r: r["o"])
    seen = measure(rows).groupBy(key).agg(more.alias("more"), F.first("c").alias("c"), F.max("duration").alias("duration"), F.max("audio").alias("audio"))
    made = sized(seen.select(key, "duration", "audio", "c", F.col("c.rate").alias("rate"), F.concat("c.observed", "more").alias("observed")))
    fields = [F.col(f) if f in ("rate", "central", "bytes", "observed") else F.col(f"c.{f}").alias(f) for f in FIELDS]
    return made.select(key, F.struct(*fields).cast(TRIED[6:-1]).alias("candidate"))


def verified(sources: DataFrame, windows: DataFrame, key: str, measure: Measure, settle: Settle, coarse: int = 4, exact: int = 3, rounds: int = 2, band: float = CONFIDENT, margin: float = 0.0) -> DataFrame:
    """(key, selected, quality, outcome, required, rounds, expanded, calibrated, ambiguous,
    held) of every source; ``held`` is the worst holdout at the selected rate.

    1. A coarse search bounds the exact one, which starts where the coarse one crosses the
       target (G7, G8).  Sources with ``known`` candidates go straight to the exact search.
    2. Where only the uncertainty of the size blocks a source, two reserves of about the
       middle risk are measured at the required rate, and it is selected again (G12).
    3. Where the quality found passes by less than ``band``, the reserve with most reasons
       joins the search, which goes on from the selected rate (G11).
    4. The selected rate is measured on the holdouts.  Those that fail it (or give no
       result) join the search, which goes on upward; with no holdout left the earliest
       reserve becomes one.  That is repeated at most ``rounds`` times; a source that still
       fails has the outcome ``limit``, one without an independent window ``exhausted``, one
       whose search then finds no quality ``refinement_failed`` (G10).
    5. Of sources that step 4 has not ended: where the last search found a higher rate worse
       by more than ``AMBIGUOUS``, the candidate nearest the target is measured again and
       the source selected anew, whatever its outcome was (G13)."""
    given = sources if "known" in sources.columns else sources.withColumn("known", none_tried())
    given = given.withColumn("known", F.coalesce(F.col("known").cast(TRIED), none_tried()))
    marks = windows.groupBy(key).agg(F.collect_list(F.struct(*(c for c in windows.columns if c != key))).alias(MARKS))
    none = F.array().cast(marks.schema[MARKS].dataType)
    given = settle(given.join(marks, key, "left").withColumn(MARKS, F.coalesce(MARKS, none)))

    def searched(asked: DataFrame, tier: str, limit: int) -> DataFrame:
        evaluate = over_windows(key, measure, tier, sizes=tier != "coarse")  # coarse results only bound the exact search
        return search_rounds(asked.withColumn("limit", F.lit(limit)), key, evaluate, settle, (MARKS, "duration", "audio")).select(key, "tried")

    needed = [key, "target", "least", "budget", "ceiling", "tolerance", "first", "known", within(MARKS, "search").alias(MARKS), "duration", "audio"]
    fresh = given.where(F.size("known") == 0).withColumn("first", F.lit(None).cast("long")).select(*needed)
    rough = searched(fresh, "coarse", coarse)
    bounded = exact_bounds(given.join(rough, key, "left").withColumn("tried", F.coalesce("tried", none_tried())), key)
    first = searched(settle(bounded.select(*needed)), "exact", exact)
    now = settle(reselected(given.join(first.withColumn("tried", complete_or_all(F.col("tried"))), key), margin))

    closer = calibrated_near(now, key, measure)
    now = now.join(closer, key, "left").withColumn("tried", replaced(F.col("tried"), F.col("candidate")))
    now = reselected(now.withColumn("calibrated", F.col("candidate").isNotNull()).drop("candidate"), margin)
    close = F.coalesce((F.col("outcome") == "found") & (F.col("quality") - F.col("target") < band), F.lit(False))
    now = now.withColumn("__best", F.when(close, first_reserve(MARKS, True)))
    now = now.withColumns({"expanded": F.col("__best").isNotNull(), MARKS: moved_to(MARKS, lambda m: m["window"] == F.col("__best"), "search")}).drop("__best")
    now = settle(now.withColumns({"rounds": F.lit(0), "held": F.lit(None).cast("double"), "ended": F.lit(False)}))

    def again(open_: DataFrame) -> DataFrame:
        """Selections of a new search upward from the selected rate."""
        asked = open_.select(key, "target", F.col("selected").alias("least"), F.greatest("selected", "budget").alias("budget"), "ceiling", "tolerance", F.lit(None).cast("long").alias("first"), none_tried().alias("known"), within(MARKS, "search").alias(MARKS), "duration", "audio")
        new = searched(asked, "exact", exact).withColumn("tried", complete_or_all(F.col("tried")))
        return reselected(open_.drop("tried", "outcome", "selected", "quality", "required").join(new, key), margin)

    now = now.where("not expanded").unionByName(again(now.where("expanded")))
    now, closed = settle(now.withColumn("open", F.col("outcome") == "found")), []

    for nth in range(rounds + 1):
        last = nth == rounds
        asked = now.where("open").select(key, "target", F.col("selected").alias("rate"), F.inline(within(MARKS, "holdout")))
        seen = measure(asked.withColumn("tier", F.lit("holdout"))).groupBy(key).agg(F.collect_list(F.struct("window", "quality")).alias("__seen"))
        now = now.join(seen, key, "left")
        passed = F.transform(F.filter("__seen", lambda w: w["quality"] >= F.col("target")), lambda w: w["window"])
        now = now.withColumns({"__passed": passed, "held": F.coalesce(F.array_min(F.transform("__seen", lambda w: w["quality"])), "held")})
        missed = lambda m: F.col("open") & (m["pool"] == "holdout") & ~F.coalesce(F.array_contains("__passed", m["window"]), F.lit(False))
        if last:
            now = now.withColumn("open", F.exists(MARKS, missed)).drop("__seen", "__passed")
            now = settle(now.withColumns({"outcome": F.when(F.col("open"), "limit").otherwise(F.col("outcome")), "ended": F.col("open") | F.col("ended")}))
            break
        now = now.withColumns({"open": F.exists(MARKS, missed), MARKS: moved_to(MARKS, missed, "search")}).drop("__seen", "__passed")
        short = F.col("open") & (F.size(within(MARKS, "holdout")) == 0)
        now = now.withColumns({"__short": short, "__fresh": F.when(short, first_reserve(MARKS, False))})
        gone = F.col("__short") & F.col("__fresh").isNull()
        now = now.withColumns({MARKS: moved_to(MARKS, lambda m: m["window"] == F.col("__fresh"), "holdout"), "outcome": F.when(gone, "exhausted").otherwise(F.col("outcome")), "ended": F.col("ended") | gone, "rounds": F.col("rounds") + F.col("open").cast("int"), "open": F.col("open") & ~gone})
        now = settle(now.drop("__short", "__fresh"))
        if now.where("open").isEmpty():
            break
        new = again(now.where("open"))
        lost = F.col("outcome") != "found"
        new = new.withColumns({"ended": lost, "open": ~lost, "outcome": F.when(lost & (F.col("outcome") != "size_blocked"), "refinement_failed").otherwise(F.col("outcome"))})
        closed.append(now.where("not open"))
        now = settle(new.select(*now.columns))

    for done in closed:
        now = done.unionByName(now)
    now = now.withColumn("ambiguous", ~F.col("ended") & drops(F.col("tried")))
    point = F.array_min(F.transform("tried", lambda t, i: F.struct(F.abs(t["quality"] - F.col("target")).alias("d"), i.alias("i"), t["rate"].alias("rate"))))
    odd = now.where("ambiguous").select(key, point["rate"].alias("rate"), MARKS, "duration", "audio")
    repeat = over_windows(key, measure, "again")(odd)
    repeat = repeat.select(key, F.struct(*FIELDS).cast(TRIED[6:-1]).alias("candidate"))
    odd_rows = now.where("ambiguous").join(repeat, key, "left").withColumn("tried", replaced(F.col("tried"), F.col("candidate"))).drop("candidate")
    out = now.where("not ambiguous").unionByName(reselected(odd_rows, margin).select(*now.columns))
    return out.select(key, "selected", "quality", "outcome", "required", "rounds", "expanded", "calibrated", "ambiguous", "held")


def size_representatives(reserves: DataFrame, key: str, risk: str, middle: str, centre: str, half: str, k: int = 2) -> DataFrame:
    """Of each key's reserves the ``k`` whose risk is closest to the middle risk, then
    those closest to the middle of the timeline."""
    by = Window.partitionBy(key).orderBy(F.abs(F.col(risk) - F.col(middle)), F.abs(F.col(centre) - F.col(half)), "window")
    return reserves.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= k).drop("__n")


def near_boundary(central: str, predicted: str, most: str):
    """The central size fits but the predicted one, with its uncertainty, does not."""
    return (F.col(central) <= F.col(most)) & (F.col(most) < F.col(predicted))


def calibrated(required: DataFrame, representatives: DataFrame, key: str, observed: str, rate: str) -> DataFrame:
    """``required`` candidates with the rates that their sources' representatives got
    (key, ``rate``) after those already in ``observed``; sources near no boundary have no
    representatives and stay as they are.  Predict the sizes anew from the result."""
    more = representatives.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("window", rate))), lambda r: r[rate]).alias("__more"))
    joined = required.join(more, key, "left")
    return joined.withColumn(observed, F.concat(F.col(observed), F.coalesce(F.col("__more").cast(required.schema[observed].dataType), F.array().cast(required.schema[observed].dataType)))).drop("__more")
