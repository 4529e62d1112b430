"""Searches and rounds of verification against loops over each source."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import frontier, rounds
from gaugeworks.plans import folds
from gaugeworks.plans.shared import settled

DATA = "/root/testdata/sf0.001"


def floor_step(x):
    return max(1000, x // 1000 * 1000)


def ceil_step(x):
    return max(1000, -(-x // 1000) * 1000)


def loop_search(measure, least, budget, ceiling, target, limit, tolerance=1000, first=None, known=()):
    """(results by rate in order, how it ended) of one search."""
    tried, spent = dict(known), 0
    limit, tolerance = min(8, max(0, limit)), max(1000, tolerance)

    def test(rate):
        nonlocal spent
        rate = floor_step(rate)
        if rate not in tried and spent < limit:
            tried[rate] = measure(rate)
            spent += 1
        return tried.get(rate)

    def passes(result):
        return result is not None and result["quality"] is not None and result["quality"] >= target

    def halve(low, high):
        while spent < limit and high - low > tolerance:
            middle = floor_step((low + high) // 2)
            if middle in tried:
                break
            low, high = (low, middle) if passes(test(middle)) else (middle, high)

    budget, low = floor_step(budget), ceil_step(least)
    top = floor_step(max(ceiling, budget))
    if first is not None:
        guess = min(floor_step(max(low, first)), top)
        found = test(guess)
        if passes(found):
            if found["quality"] >= target + 0.8 and spent < limit:
                test(max(low, guess - max(tolerance, (guess - low) // 3)))
            return tried, "both"
    found = test(budget)
    if found is None:
        return tried, "none"
    if passes(found):
        if not passes(test(low)):
            halve(low, budget)
        return tried, "both"
    if top == budget or not passes(test(top)):
        return tried, "none"
    halve(budget, top)
    return tried, "required"


def curve(k, rate):
    rng = random.Random(k * 1_000_003 + rate)
    return 84 + rate / 1000 * (0.8 + k % 7 / 5) / 10 + rng.choice([0, 0, 0, -3, 2])


def test_searches_equal_loops(spark):
    rng = random.Random(7)
    rows = []
    for k in range(60):
        least, budget = rng.randrange(500, 9000), rng.randrange(2000, 90000)
        known = [(r, curve(k, r), None, r * 7, None, True) for r in rng.sample(range(1000, 90000, 1000), rng.choice([0, 0, 1, 3]))]
        rows.append((k, least, budget, budget + rng.choice([-5000, 0, 40000]), 90.0, rng.choice([0, 1, 2, 5, 8, 20]), rng.choice([1000, 4000, None]), rng.choice([None, None, 30000, 500]), known or None, rng.choice([None, 200_000])))
    schema = f"k int, least long, budget long, ceiling long, target double, limit int, tolerance long, first long, known {frontier.TRIED}, most long"
    searches = spark.createDataFrame(rows, schema)
    asked = []
    python = frontier.in_tasks(lambda k, rate: {"quality": curve(k, rate), "bytes": rate * 7} if rate % 13000 else None, "quality double, bytes long")

    def evaluate(probes):
        asked.extend((r.k, r.rate) for r in probes.collect())
        return python(probes)

    found = frontier.search_rounds(searches, "k", evaluate, settled).join(searches.select("k", "most", "target"), "k")
    got = {r.k: r for r in frontier.chosen(found, F.col("target"), F.col("most")).collect()}
    measured = 0
    for k, least, budget, ceiling, target, limit, tolerance, first, known, most in rows:
        def measure(rate, k=k):
            return {"quality": curve(k, rate) if rate % 13000 else None, "bytes": rate * 7}

        tried, ended = loop_search(measure, least, budget, ceiling, target, limit, tolerance or 1000, first, [(r[0], {"quality": r[1], "bytes": r[3]}) for r in known or ()])
        measured += len(tried) - len(known or ())
        assert [(t.rate, t.quality) for t in got[k].tried] == [(r, x["quality"]) for r, x in tried.items()] and got[k].ended == ended, k
        passing = [r for r, x in tried.items() if x["quality"] is not None and x["quality"] >= target]
        fits = [r for r in passing if most is None or (tried[r]["bytes"] or 0) <= most]
        assert got[k].required == (min(passing, default=None) if ended != "none" else None)
        assert got[k].selected == (min(fits, default=None) if ended != "none" and not (ended == "required" and most is None) else None), k
    assert len(asked) == len(set(asked)) == measured


def line_quality(part, rate, tier):
    look = {"coarse": (part % 3 - 1) * 0.3, "again": 0.25}.get(tier, 0.0)
    return 84.0 + rate / 1000 * 1.9 - part % 17 / 17.0 * 4 - (3.0 if (part + rate // 1000) % 11 == 0 else 0.0) + look


def line_rate(part, rate):
    return rate * (90 + part % 5 * 5) // 100


def loop_source(source, marks, coarse=4, exact=3, limit=2, band=0.7):
    """One source from its coarse search to its repeated measurement."""
    s, target = source, source["target"]
    pools = {p: [w for w in marks if w["pool"] == p] for p in ("search", "holdout", "reserve")}

    def sizes(rate, got):
        """(central, predicted) by the median ratio and what it leaves unsure."""
        ratios = [min(4.0, max(0.0001, max(0, x) / rate)) for x in got]
        middle = statistics.median(ratios)
        left = statistics.median(abs(x - middle) for x in ratios)
        unsure = min(0.30, max(0.05, 0.03 + 0.14 / math.sqrt(len(ratios)) + 1.5 * left))
        mean = max(1, round(rate * middle))
        upper = max(mean, round(mean * (1 + unsure)))
        return tuple(math.ceil((v + s["audio"]) * s["duration"] / 8 / 0.98) for v in (mean, upper))

    def candidate(tier):
        def measure(rate):
            own = sorted(pools["search"], key=lambda w: w["window"])
            got = [line_rate(w["l_partkey"], rate) for w in own]
            central, predicted = sizes(rate, got)
            return {"quality": min(line_quality(w["l_partkey"], rate, tier) for w in own), "observed": got, "central": central, "bytes": predicted}

        return measure

    def select(tried):
        inside = {r: x for r, x in tried.items() if r >= s["least"] and (not s["cap"] or r <= s["cap"])}
        good = [r for r, x in inside.items() if x["quality"] >= target]
        fit = [r for r in good if inside[r]["bytes"] <= s["most"]]
        if s["budget"] < s["least"]:
            return "budget_too_small", None, None, None
        if fit:
            return "found", min(fit), inside[min(fit)]["quality"], None
        required = min(good, default=None)
        return ("size_blocked" if good and inside[required]["bytes"] > s["most"] else "unreachable"), None, None, required

    rough, _ = loop_search(candidate("coarse"), s["least"], s["budget"], s["ceiling"], target, coarse, s["tolerance"])
    good = sorted(r for r, x in rough.items() if x["quality"] >= target)
    bad = [r for r, x in rough.items() if x["quality"] < target]
    least, budget, ceiling, first = s["least"], s["budget"], s["ceiling"], None
    if good:
        least, budget, ceiling = max([least, *bad]), good[0], max(good[0], ceiling)
        first = good[0]
        ordered = sorted(rough)
        for a, b in zip(ordered, ordered[1:]):
            qa, qb = rough[a]["quality"], rough[b]["quality"]
            if qa < target <= qb:
                first = b if qb - qa <= 1e-9 else round(a + (target - qa) / (qb - qa) * (b - a))
                break
    tried, _ = loop_search(candidate("exact"), least, budget, ceiling, target, exact, s["tolerance"], first)
    outcome, rate, quality, required = select(tried)

    calibrated = False
    if outcome == "size_blocked" and pools["reserve"]:
        x = tried[required]
        if x["central"] <= s["most"] < x["bytes"]:
            nearest = sorted(pools["reserve"], key=lambda w: (abs(w["risk"] - s["middle"]), abs(w["centre"] - s["duration"] / 2), w["window"]))[:2]
            x["observed"] = x["observed"] + [line_rate(w["l_partkey"], required) for w in nearest]
            x["central"], x["bytes"] = sizes(required, x["observed"])
            calibrated = True
            outcome, rate, quality, required = select(tried)

    def onward():
        return loop_search(candidate("exact"), rate, max(rate, s["budget"]), s["ceiling"], target, exact, s["tolerance"])[0]

    expanded = False
    if outcome == "found" and quality - target < band and pools["reserve"]:
        best = min(pools["reserve"], key=lambda w: (-w["reasons"], w["start"], w["window"]))
        pools["reserve"].remove(best)
        pools["search"].append(best)
        expanded, tried = True, onward()
        outcome, rate, quality, required = select(tried)
    n, held, ended = 0, None, False
    while outcome == "found" and pools["holdout"]:
        scores = {w["window"]: line_quality(w["l_partkey"], rate, "holdout") for w in pools["holdout"]}
        held = min(scores.values())
        failed = [w for w in pools["holdout"] if scores[w["window"]] < target]
        if not failed:
            break
        if n == limit:
            outcome, ended = "limit", True
            break
        n += 1
        pools["search"] += failed
        pools["holdout"] = [w for w in pools["holdout"] if w not in failed]
        if not pools["holdout"] and pools["reserve"]:
            fresh = min(pools["reserve"], key=lambda w: (w["start"], w["window"]))
            pools["reserve"].remove(fresh)
            pools["holdout"].append(fresh)
        if not pools["holdout"]:
            outcome, ended = "exhausted", True
            break
        tried = onward()
        outcome, rate, quality, required = select(tried)
        if outcome != "found":
            ended, outcome = True, outcome if outcome == "size_blocked" else "refinement_failed"
    ordered = sorted(tried)
    odd = not ended and any(tried[b]["quality"] < tried[a]["quality"] - 0.5 for a, b in zip(ordered, ordered[1:]))
    if odd:
        point = min(tried, key=lambda r: abs(tried[r]["quality"] - target))
        tried[point] = candidate("again")(point)
        outcome, rate, quality, required = select(tried)
    return rate, quality, outcome, required, n, expanded, calibrated, odd, held


def same(a, b):
    return a == pytest.approx(b, abs=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


def test_rounds_equal_loops_over_every_source(spark):
    windows, sources = folds.line_windows(folds.table(spark, DATA, "lineitem"))
    marks = {}
    for w in windows.collect():
        marks.setdefault(w.source, []).append(w.asDict())
    got = {r.source: r for r in folds.verified_rounds(spark, DATA).collect()}
    wanted = {s.source: loop_source(s.asDict(), marks[s.source]) for s in sources.collect()}
    assert set(got) == set(wanted)
    for k, want in wanted.items():
        r = got[k]
        found = (r.selected, r.quality, r.outcome, r.required, r.rounds, r.expanded, r.calibrated, r.ambiguous, r.held)
        assert all(map(same, found, want)), (k, found, want)
    assert {r.outcome for r in got.values()} >= {"found", "size_blocked", "exhausted", "unreachable", "refinement_failed"}
    assert any(r.ambiguous and r.outcome == "size_blocked" for r in got.values()) and any(r.calibrated and r.outcome == "found" for r in got.values())


def test_a_holdout_without_a_result_does_not_pass(spark):
    windows, sources = folds.line_windows(folds.table(spark, DATA, "lineitem").where("l_orderkey < 400"))
    lost = lambda rows: folds.measured_lines(rows).where("tier <> 'holdout'")
    got = rounds.verified(sources, windows, "source", lost, settled)
    has = {r.source for r in windows.where("pool = 'holdout'").select("source").distinct().collect()}
    assert has and all(r.outcome != "found" or r.source not in has for r in got.collect())


def test_settled_tables_are_broadcast_by_their_rows(spark, monkeypatch):
    """A table of many rows that is a small file is not gathered on the driver for a join."""
    from gaugeworks.plans import shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 100)
    many, few = shared.settled(spark.range(5000)), shared.settled(spark.range(50))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for kind in ("inner", "left", "left_semi", "left_anti"):
        assert "Broadcast" not in plan(many.join(many.where("id % 2 = 0").select("id"), "id", kind))
        assert "BroadcastHashJoin" in plan(many.join(few, "id", kind))
    assert many.join(few, "id").count() == 50 and many.join(many.where("id % 2 = 0"), "id", "left_anti").count() == 2500


def test_tables_in_buckets_meet_without_a_shuffle(spark):
    """Steps between measurements move no row: tables lie in buckets by the key."""
    from gaugeworks.plans.shared import Tables

    tables = Tables("k", 3)
    left, right = (tables(spark.range(30_000).selectExpr("id % 25000 k", f"id {c}", f"array(id) x{c}")) for c in "ab")
    per = right.groupBy("k").agg(F.max("b").alias("b"))
    joined = left.join(per, "k", "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    again = tables(joined)
    assert again.count() == 30_000 and len(again.inputFiles()) == 3
    names = [name for _, _, name in tables.held]
    assert tables.last(again).count() == 30_000 and not any(map(spark.catalog.tableExists, names))
