"""Live state against the batch fold, after every batch."""

import os

from pyspark.sql import functions as F

from gaugeworks.operators.state import fold as batch_fold
from gaugeworks.plans import folds
from gaugeworks.streaming import fold, live

EVENTS = "/root/testdata/sf0.001/events.parquet"


def dealt(spark, folder, parts):
    """The events in files of their own, the later ones first and some of them twice."""
    events = spark.read.parquet(EVENTS).orderBy("event_id").toPandas()
    folder.mkdir()
    for k in range(parts):
        own = events.iloc[parts - 1 - k :: parts]
        spark.createDataFrame(own).coalesce(1).write.parquet(str(folder / f"f{k}"))
    names = []
    for k in range(parts):
        (file,) = (folder / f"f{k}").glob("*.parquet")
        to = folder / f"part-{k}.parquet"
        os.rename(file, to)
        os.utime(to, (1_700_000_000 + k, 1_700_000_000 + k))
        names.append(str(to))
    return names


def test_changes_equal_the_batch_fold_after_every_batch(spark, tmp_path):
    files = dealt(spark, tmp_path / "in", 4)
    events = spark.readStream.schema(spark.read.parquet(EVENTS).schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "part-*").parquet(str(tmp_path / "in"))
    fields, out = folds.queue_fields(), str(tmp_path / "out")
    totals = live.Totals(spark, out, folds.queue_shares)
    live.kept_changes(live.changes(events, "user_id", ["event_id"], fields), out, totals)
    log = spark.read.parquet(f"{out}/changes").cache()
    rewritten = 0
    for n in range(len(files)):
        seen = spark.read.parquet(*files[: n + 1])
        want = batch_fold(seen, "user_id", ["event_id"], fields).select("user_id", "status", "percent")
        got = log.where(F.col("batch") <= n).groupBy("user_id").agg(F.max_by(F.struct("status", "percent"), "batch").alias("s")).select("user_id", "s.status", "s.percent")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        shares = want.agg(*(F.sum(c).alias(k) for k, c in folds.queue_shares(F.col).items())).first().asDict()
        assert totals.after(n) == shares
        changed = {r.user_id for r in log.where(F.col("batch") == n).collect()}
        assert changed <= {r.user_id for r in spark.read.parquet(files[n]).select("user_id").distinct().collect()}
        rewritten += len(changed)
    assert log.where("not is_new and status <=> was_status and percent <=> was_percent").isEmpty()
    assert rewritten < len(files) * want.count()
    log.unpersist()


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    changed = spark.createDataFrame([(1, "done", 5.0, "queued", 1.0, False), (2, "queued", 0.0, None, None, True)], "user_id long, status string, percent double, was_status string, was_percent double, is_new boolean")
    totals = live.Totals(spark, str(tmp_path), folds.queue_shares)
    totals(changed.where("user_id = 2"), 0)
    for _ in range(2):
        totals(changed, 1)
    assert totals.after(1)["n"] == 2 and totals.after(1)["n_queued"] == 1 and totals.after(1)["finished"] == 99


def test_finished_keys_are_forgotten(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", 1, 1, True), ("2024-01-01 00:00:01", 2, 2, False), ("2024-01-01 01:00:00", 3, 3, False), ("2024-01-01 02:00:00", 3, 4, False), ("2024-01-01 02:00:01", 1, 5, None), ("2024-01-01 02:00:02", 2, 6, None)]
    for k, row in enumerate(rows):
        spark.createDataFrame([row], "t string, key long, n long, over boolean").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "x" / f"{k}"))
        (file,) = (tmp_path / "x" / f"{k}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        os.rename(file, tmp_path / "in" / f"part-{k}.parquet")
        os.utime(tmp_path / "in" / f"part-{k}.parquet", (1_700_000_000 + k,) * 2)
    stream = spark.readStream.schema("t timestamp, key long, n long, over boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fields = {"n": F.col("n"), "over": F.col("over")}
    live.kept_changes(live.changes(stream, "key", ["n"], fields, done="over", forget=60_000, time="t"), str(tmp_path / "out"))
    log = spark.read.parquet(str(tmp_path / "out" / "changes"))
    assert sorted((r.key, r.n, r.is_new, r.over) for r in log.where("n >= 5").collect()) == [(1, 5, True, None), (2, 6, False, False)]


def test_lines_of_the_stream_are_still_read(spark):
    assert fold.read_events(spark, EVENTS).isStreaming
