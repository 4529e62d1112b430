"""Operators 11 and 13 against plain loops, awkward rows included."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from gaugeworks.llm import hard_negatives as H
from gaugeworks.llm import near_vectors as V

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("label", IntegerType()), StructField("id", StringType()), StructField("cell", StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(k, x, label, "mine", "too") for k, x, label in rows], SCHEMA).repartition(3)


def some_rows(seed=5, n=160, size=12):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(c) for c in rng.standard_normal(size)], int(rng.integers(0, 3))) for k in range(n)]
    for k in range(40):  # near copies at every distance around the threshold
        x = np.array(rows[k % 8][1])
        y = x + rng.standard_normal(size) * 0.06 * (k % 7) * np.abs(x).mean()
        rows.append((200 + k, [float(c) for c in y], rows[k % 8][2]))
    rows += [(300, list(rows[0][1]), rows[0][2]), (300, list(rows[0][1]), rows[0][2]), (301, list(rows[0][1]), (rows[0][2] + 1) % 3)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * size, 1), (403, [1.0, None] + [0.0] * (size - 2), 1), (404, [float("nan")] * size, 1), (405, [float("inf")] * size, 1), (406, [1.0] * size, None)]
    rows += [(407, [1.0, 2.0], 1), (408, [2.0, 4.0], 1), (None, list(rows[1][1]), rows[1][2]), (409, [1e300] * size, 2), (410, [1e-300] * size, 2), (-1, list(rows[2][1]), rows[2][2])]
    return rows


def usable(x, label):
    return label is not None and x is not None and len(x) > 0 and all(c is not None and math.isfinite(c) for c in x)


def near(a, b):
    if len(a) != len(b):
        return False
    a, b = (np.array(v) / max(abs(c) for c in v) for v in (a, b))
    return a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.98


def linked(rows):
    n = len(rows)
    good = [usable(x, label) and any(x) for _, x, label in rows]
    links, root = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and near(rows[i][1], rows[j][1]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    out = []
    for i in range(n):
        keys = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        low = min(keys) if keys else None
        out.append((rows[i][0], links[i], low, rows[i][0] is not None and rows[i][0] == low))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell,chunk", [(1024, 2048), (4, 2048), (1024, 16)])
def test_near_vectors_equal_all_pairs(spark, monkeypatch, cell, chunk):
    monkeypatch.setattr(V, "CELL_ROWS", cell)
    monkeypatch.setattr(V, "CHUNK_ROWS", chunk)
    rows = some_rows()
    got = sorted((tuple(r) for r in V.near_vectors(frame(spark, rows)).collect()), key=repr)
    assert got == linked(rows)


def test_near_vectors_of_nothing(spark):
    empty = V.near_vectors(frame(spark, []))
    assert empty.columns == ["vec_id", "n_links", "component_id", "kept"] and empty.count() == 0
    alone = V.near_vectors(frame(spark, [(1, None, 1), (None, [1.0], None)])).collect()
    assert sorted(map(tuple, alone), key=repr) == [(1, 0, 1, True), (None, 0, None, False)]


def test_windows_are_calibrated():
    """A pair at the threshold, in many random positions, is found as often as planned."""
    plan = V.plan_for(100_000, 0.98, 0.999)
    rng = np.random.default_rng(1)
    a = V.unit(rng.standard_normal((20_000, 64)))
    b = rng.standard_normal((20_000, 64))
    b = V.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * b
    hit = np.abs(V.projected(a, plan.projections) - V.projected(b, plan.projections)) <= plan.reach
    tables = hit[:, : plan.tables * plan.cuts].reshape(len(a), plan.tables, plan.cuts).all(axis=2).any(axis=1)
    assert (tables & (hit.sum(axis=1) >= plan.least)).mean() >= 0.998
    assert plan.cuts > V.plan_for(1000).cuts


def test_counts_equal_windows():
    rng = np.random.default_rng(2)
    plan = V.Plan(reach=300, width=600, cuts=2, tables=2, projections=9, least=6)
    lines = rng.integers(0, 1000, (9, 70))
    a, b = V.colliding(lines[2][:30], lines[2][30:], plan.reach)
    hit = np.abs(lines[:, :30, None] - lines[:, None, 30:]) <= plan.reach
    assert sorted(zip(a, b)) == sorted(zip(*np.nonzero(hit[2])))
    u, v = V.counted(lines, a, b + 30, plan, 1)
    assert sorted(zip(u, v - 30)) == sorted(zip(*np.nonzero(hit[2] & hit[3] & (hit.sum(axis=0) >= 6)))) and len(u)


def mined(rows, anchors, low=50, high=95):
    own = []
    for k, x, label in rows:
        if k is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            whole = [math.floor(256 * c) for c in x]
            if sum(c * c for c in whole) < 2**62:
                own.append((k, whole, label))
    out = []
    for k, x, label in own:
        if k not in anchors:
            continue
        score = lambda y, x=x: sum(a * b for a, b in zip(x, y))
        same = sorted((-score(y), j) for j, y, other in own if other == label and j != k and len(y) == len(x))[:5]
        rest = sorted((-score(y), j) for j, y, other in own if other != label and len(y) == len(x))
        for ps, p in same:
            fits = [(s, j) for s, j in rest if -low * ps <= -100 * s <= -high * ps][:3]
            out += [(k, p, n + 1, j, -ps, -s) for n, (s, j) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("leaf,part", [(64, 2048), (4, 32)])
def test_hard_negatives_equal_all_scores(spark, monkeypatch, leaf, part):
    monkeypatch.setattr(H, "LEAF_ROWS", leaf)
    monkeypatch.setattr(H, "PART_ROWS", (part, part))
    monkeypatch.setattr(H, "QUERIES", 7)
    rows = some_rows(seed=9)
    rng = random.Random(4)
    rows += [(500 + k, [rng.choice([0.0, 1.0]) for _ in range(12)], k % 3) for k in range(60)]  # ties
    anchors = {k for k, _, _ in rows if k is not None and k % 10 == 0}
    got = H.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined(rows, anchors)


def test_hard_negatives_of_nothing(spark):
    assert H.hard_negatives(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert H.hard_negatives(frame(spark, [(0, [1.0], 1)]), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 8)) * 2000
    x = (centres[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 8)) * 20).astype(np.int64)
    tree = H.Tree.of(x, np.arange(3000), np.zeros(3000, np.int64), 32)
    q = x[:50]
    norm = np.sqrt(np.square(q.astype(float)).sum(axis=1))
    for level, (first, last) in enumerate(tree.levels):
        under, over = tree.bounds(level, q.astype(float), norm)
        for node, (a, b) in enumerate(zip(first, last)):
            found = q @ tree.x[a:b].T
            assert (found.min(axis=1) >= under[:, node]).all() and (found.max(axis=1) <= over[:, node]).all()
    kth = np.sort(q @ x.T, axis=1)[:, -5]
    assert (over < kth[:, None]).mean() > 0.5  # most leaves need no scoring
