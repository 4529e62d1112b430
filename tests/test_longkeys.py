"""Long keys by ranges and blocks give what short keys give in one task."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import intervals, longkeys, series

SHORT, ALL = 1 << 20, 40  # no key is long, the keys of more than 40 rows are


@pytest.fixture(scope="module")
def rows(spark):
    """A hot key with ties, nulls and two values of one place; short keys; a null key."""
    rng = random.Random(5)
    sizes = {1: 700, 2: 60, 3: 7, 4: 1, None: 90}
    data = [(k, i // 2 * 3 if k == 2 else i * 2 + rng.randint(0, 1), i, rng.choice([None, float(rng.randint(0, 20)), rng.random()]), float(25 + (k or 0))) for k, n in sizes.items() for i in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k int, at int, id int, v double, fps double").repartition(5)


def same(a, b):
    def listed(df):
        cells = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()]
        return sorted(cells, key=repr)

    assert listed(a) == listed(b) and len(listed(a)) > 0


def test_blocks_equal_windows(rows, monkeypatch):
    monkeypatch.setattr(longkeys, "BLOCK", 8)
    for width in (1, 10, 500):
        same(series.gate_score(rows, "k", ["at", "id"], "v", width, long=ALL), series.gate_score(rows, "k", ["at", "id"], "v", width, long=SHORT))
    same(series.rolling_worst(rows, "k", ["at", "id"], "v", 9, long=ALL), series.rolling_worst(rows, "k", ["at", "id"], "v", 9, long=SHORT))
    same(series.upper_median_gap(rows, "k", "at", long=ALL), series.upper_median_gap(rows, "k", "at", long=SHORT))
    whole = rows.withColumn("v", F.coalesce("v", F.lit(1.0))).where("k <> 2")  # one row a place
    same(series.cadenced_worst(whole, "k", "at", "v", "fps", long=ALL), series.cadenced_worst(whole, "k", "at", "v", "fps", long=SHORT))


def test_percentiles_and_medians(rows):
    shares = {"a": 0.9, "b": 0.1, "c": 0.0, "d": 1.0, "e": 0.5}
    same(longkeys.nearest_ranks(rows, "k", "v", shares, long=ALL), longkeys.nearest_ranks(rows, "k", "v", shares))
    same(series.median_deviation(rows, "k", "v", long=ALL), series.median_deviation(rows, "k", "v"))


def test_running_folds(rows):
    same(series.number_records(rows, "k", ["at", "id"], F.col("v") > 10, long=ALL), series.number_records(rows, "k", ["at", "id"], F.col("v") > 10))
    points = rows.select("k", "id", F.coalesce("v", F.lit(3.0)).alias("at"))
    odd, even = points.where("id % 7 = 1"), points.where("id % 7 <> 1")
    same(intervals.nearest_distance(even, odd, "k", "at", 99.0, long=ALL), intervals.nearest_distance(even, odd, "k", "at", 99.0))


def test_empty(spark, rows):
    none = rows.limit(0)
    assert series.gate_score(none, "k", ["at"], "v", 3).count() == 0
    assert longkeys.nearest_ranks(none, "k", "v", {"a": 0.9}).count() == 0


def test_one_key_uses_all_tasks(spark):
    """No task sees the whole key: its rows lie in as many ranges as there are."""
    df = spark.range(400_000).select(F.lit(1).alias("k"), F.hash("id").alias("at"), F.xxhash64("id").alias("v"))
    keys = longkeys.Keys(df, "k", 1000)
    dealt = keys.by_ranges(df, ["at"], {"i": ("sum", F.lit(1))}).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) >= 4 and max(r["count"] for r in dealt) < 200_000
    got = longkeys.nearest_ranks(df, "k", "v", {"p": 0.9}, keys=keys).first().p
    assert got == float(sorted(r.v for r in df.collect())[360_000 - 1])
