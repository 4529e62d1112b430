"""Interval joins against all pairs, and their folds against loops."""

import random

from gaugeworks.operators import intervals as I
from gaugeworks.plans.shared import settled

INF = float("inf")


def some(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        start = rng.choice([rng.uniform(-50, 50), rng.uniform(-1e6, 1e6), float(rng.randint(-5, 5))])
        length = rng.choice([0.0, rng.uniform(0, 1), rng.uniform(0, 100), 2.0 ** rng.randint(-30, 20), 1e-12, -3.0])
        rows.append((rng.randint(0, 2), k, start, start + length))
    return rows + [(0, n, -1e9, 1e9), (1, n, 0.0, 1e18), (2, n, -INF, INF), (0, n + 1, 5.0, INF), (0, n + 2, None, 1.0), (1, n + 2, 1.0, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, id int, start double, end double").repartition(3)


def meet(a, b):
    return a[0] == b[0] and None not in a + b and a[2] < b[3] - 1e-9 and b[2] < a[3] - 1e-9


def test_overlaps_of_any_length_equal_all_pairs(spark):
    left, right = some(1, 150), some(2, 150)
    got = [(r.k, r.id, r.id_r) for r in I.overlap_join(frame(spark, left), frame(spark, right), "k").collect()]
    assert sorted(got) == sorted((a[0], a[1], b[1]) for a in left for b in right if meet(a, b))
    free = [(r.k, r.id) for r in I.overlap_anti(frame(spark, left[:150]), frame(spark, right[:120]), "k").collect()]
    assert sorted(free) == sorted((a[0], a[1]) for a in left[:150] if not any(meet(a, b) for b in right[:120]))
    none = I.overlap_join(frame(spark, []), frame(spark, right), "k")
    assert none.count() == 0 and none.columns == ["k", "id", "start", "end", "id_r", "start_r", "end_r"]


def test_points_inside_equal_all_pairs(spark):
    rows = some(3, 150)
    points = [(r[0], x) for r in some(4, 150) for x in (r[2], r[3]) if x is not None and abs(x) != INF] + [(0, None)]
    got = [tuple(r) for r in I.points_inside(frame(spark, rows), spark.createDataFrame(points, "k int, point double"), "k").collect()]
    want = [(a[0], a[1], x) for a in rows for k, x in points if None not in a and x is not None and k == a[0] and a[2] + 1e-9 < x < a[3] - 1e-9]
    assert sorted(got) == sorted(want)


def test_a_long_interval_is_in_few_rows(spark):
    rows = I.levelled(frame(spark, [(0, 1, 0.0, 1e9), (0, 2, 3.0, 103.0), (0, 3, -INF, INF)]), "k")
    counts = {r.id: r["count"] for r in I.in_bins(rows, I.levels_in(rows)).groupBy("id").count().collect()}
    assert all(n <= 2 * 3 for n in counts.values())


def taken(rows):
    out, free = [], {}
    for k, i, start, end in sorted(rows, key=lambda r: (r[3], r[2], r[1])):
        if k not in free or start >= free[k] - 1e-9:
            out.append((k, i))
            free[k] = end
    return sorted(out)


def test_capacity_of_long_keys_equals_the_fold(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for n in range(900):
        start = rng.choice([rng.uniform(0, 3000), float(rng.randint(0, 40))])
        rows.append((rng.choice([0, 0, 0, 1, 2]), n, start, start + rng.choice([0.0, 1.0, rng.uniform(0, 30), 2000.0])))
    rows += [(3, 1, 0.0, 1.0), (3, 2, 1.0, 2.0), (3, 3, 1.0, 2.0), (4, 1, 5.0, 5.0), (4, 2, 5.0, 5.0)]
    want = taken(rows)
    for most in (1 << 17, 100, 0):
        monkeypatch.setattr(I, "FOLD_ROWS", most)
        got = I.capacity(frame(spark, rows), "k", settled)
        assert got.columns == ["k", "id", "start", "end"] and sorted((r.k, r.id) for r in got.collect()) == want
