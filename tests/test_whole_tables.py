"""Queries over whole tables leave no key out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import intervals, ranks, robust, search
from gaugeworks.plans import folds, rules
from gaugeworks.plans import queries as plans
from gaugeworks.streaming import fold

DATA = "/root/testdata/sf0.001"

assert rules


def keys(df, name):
    return {r[0] for r in df.select(name).distinct().collect()}


def test_every_customer_and_order_has_its_rows(spark):
    customers = keys(plans.table(spark, DATA, "customer"), "c_custkey")
    orders = plans.table(spark, DATA, "orders")
    ids, buyers = keys(orders, "o_orderkey"), keys(orders, "o_custkey")
    whole = {name: plans.QUERIES[name](spark, DATA) for name in ("segments", "shot_align", "payload_round_trip", "base_uncertainty")}
    assert max(customers) >= 100 and max(ids) >= 1000
    assert keys(whole["segments"], "k") == customers
    assert keys(whole["shot_align"], "id") == ids
    assert keys(whole["payload_round_trip"], "o_orderkey") == ids
    assert keys(whole["base_uncertainty"], "k") == buyers


def test_windows_go_to_the_nearest_segment_that_fits(spark):
    rng = random.Random(4)
    cuts = {k: sorted(rng.sample(range(100), rng.randint(2, 12))) for k in range(20)}
    parts = [(k, float(a), float(b)) for k, c in cuts.items() for a, b in zip(c, c[1:])]
    windows = [(k, n, float(a), float(a + rng.choice([3, 9, 20]))) for k in range(21) for n, a in enumerate(rng.choices(range(-5, 105), k=15))]

    def brute(k, a, b):
        fits = [min(max(a, s), e - (b - a)) for j, s, e in parts if j == k and e - s >= b - a - 1e-9]
        to = min(fits, key=lambda x: (abs(x - a), x), default=a)
        return to, abs(to - a) > 1e-9, bool(fits)

    w = spark.createDataFrame(windows, "k long, id long, start double, end double")
    joined = intervals.align_to_segments(w, spark.createDataFrame(parts, "k long, start double, end double"), "k")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan
    assert sorted(map(tuple, joined.collect())) == sorted((k, n, *brute(k, a, b)) for k, n, a, b in windows)


def test_the_least_score_may_lie_at_any_place(spark):
    vectors = {r.vec_id: r.embedding for r in plans.table(spark, DATA, "embeddings").collect()}
    rows = plans.QUERIES["hardest_first"](spark, DATA).collect()
    first = {r.vec_id: r.pos for r in rows if r["rank"] == 1}
    assert len(rows) == sum(map(len, vectors.values()))
    assert first == {k: v.index(min(v)) for k, v in vectors.items()} and max(first.values()) >= 8


def test_live_state_lies_in_files_not_in_the_driver(spark, tmp_path):
    got = folds.live_state_fold(spark, DATA)
    assert got.inputFiles() and all(f.endswith(".parquet") for f in got.inputFiles())
    events = plans.table(spark, DATA, "events")
    assert keys(got, "user_id") == keys(events, "user_id")
    events.limit(0).write.parquet(f"{tmp_path}/none.parquet")
    none = fold.read_events(spark, f"{tmp_path}/none.parquet")
    assert fold.settled(fold.live_fold(none, "user_id", ["event_id"], {"last": F.col("event_id")}), f"{tmp_path}/out").count() == 0
    events.repartition(3).write.parquet(f"{tmp_path}/some.parquet")
    some = fold.read_events(spark, f"{tmp_path}/some.parquet", files_per_batch=1)
    assert keys(fold.settled(fold.live_fold(some, "user_id", ["event_id"], {"last": F.col("event_id")}), f"{tmp_path}/many"), "user_id") == keys(events, "user_id")


def test_ranks_of_a_hot_key_need_no_window_over_its_rows(spark):
    rng = random.Random(2)
    rows = [(n, "hot" if n % 10 else rng.choice(["a", None]), rng.choice([None, *map(float, range(40))])) for n in range(400)] + [(400, "lone", 1.0)]
    ranked = ranks.midrank(spark.createDataFrame(rows, "n long, k string, v double"), "v", ["k"])
    assert "rank(" not in ranked._jdf.queryExecution().optimizedPlan().toString()
    got = {r.n: r.midrank for r in ranked.collect()}
    for n, k, v in rows:
        own = [-1.0 if w is None else w for _, j, w in rows if j == k]
        at = -1.0 if v is None else v
        low, ties = sum(w < at for w in own), own.count(at) - 1
        assert got[n] == pytest.approx(0.5 if len(own) == 1 else (low + ties / 2) / (len(own) - 1))
    assert len(got) == len(rows)


def test_searches_hold_a_row_a_step_and_find_the_same(spark):
    rng = random.Random(6)
    rows = [(k, rng.randint(1, 9000 * (k % 5 + 1)), float(rng.randint(0, 60))) for k in range(12) for _ in range(rng.choice([1, 2, 9, 900]))]
    measured = spark.createDataFrame(rows, "k long, x long, y double")
    assert search.by_step(measured, "k", "x", "y").groupBy("k").count().agg(F.max("count")).first()[0] <= 45
    got = {r.k: (r.tries, r.selected, r.required) for r in search.search_measured(measured, "k", "x", "y", 40.0).collect()}
    for k in range(12):
        own = sorted((x, y) for j, x, y in rows if j == k)
        at = lambda v: ([y for x, y in own if x <= v] or [own[0][1]])[-1]
        p, selected, required = search.search(at, own[0][0], (own[0][0] + own[-1][0]) // 2, own[-1][0] + search.STEP, 40.0)
        assert got[k] == (len(p.tried), selected, required)


@pytest.mark.parametrize("n", [2, 3, 60, 61, 63])
def test_middle_slopes_from_counts_equal_the_median(n, monkeypatch):
    rng = np.random.default_rng(n)
    x, y = rng.permutation(n).astype(float), rng.integers(-9, 9, n) * rng.choice([1.0, 1e-7, 1e9])
    want = robust.slopes_median(x, y)
    monkeypatch.setattr(robust, "HELD", 0)
    assert robust.slopes_median(x, y) == want
    assert robust.slopes_median(np.ones(n), y) is None
    monkeypatch.setattr(robust, "HELD", 100)
    assert robust.slopes_median(x, y) == want and max(map(len, robust.slope_blocks(x, y, 1e-9))) < 100 + n
