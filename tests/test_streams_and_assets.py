"""Log lines as a stream, windowed counts, and the small readers of tools and assets."""

from pyspark.sql import functions as F

from gaugeworks.sources import readers as R
from gaugeworks.streaming import fold


def test_log_lines_are_flushed_once(spark, tmp_path):
    came, out, held = (str(tmp_path / n) for n in ("in", "out", "check"))
    batches = [["$ run it", "frame=1", "Error: no"], ["it FAILED", "$ error in a command", ""]]
    for k, text in enumerate(batches):
        spark.createDataFrame([(t,) for t in text], "value string").coalesce(1).write.mode("append").text(came)
        fold.flushed_lines(spark.readStream.text(came), out, held, "error", every=None).awaitTermination()
        assert spark.read.text(out).count() == k + 1
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["Error: no", "it FAILED"]
    live = fold.flushed_lines(spark.readStream.text(came), str(tmp_path / "all"), str(tmp_path / "all-check"))
    try:
        live.processAllAvailable()
    finally:
        live.stop()
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "all")).collect()) == sorted(sum(batches, []))


def test_windows_count_what_is_not_late(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:01:10", "b"), ("2024-01-01 01:00:00", "a")]
    spark.createDataFrame(rows, "t string, k string").write.parquet(str(tmp_path / "events"))
    stream = fold.windowed_counts(fold.read_events(spark, str(tmp_path / "events")), "t", "k", "1 minute", "10 minutes")
    got = fold.drain(stream, "counted", str(tmp_path / "c"), "append").select(F.minute("start").alias("m"), "k", "n").collect()
    assert sorted(map(tuple, got)) == [(0, "a", 2), (1, "b", 1)]  # the last window is still open


def test_tools_and_assets(spark):
    found = spark.createDataFrame([("x", 1, "/given", False), ("x", 2, "/project", True), ("x", 3, "/path", True), ("y", 1, "/given", False)], "tool string, place int, at string, there boolean")
    assert [tuple(r) for r in R.first_found(found, "tool", "place", "at", F.col("there")).collect()] == [("x", "/project")]
    good = ("a" * 64, "b" * 40, "https://x/y")
    assets = [good, ("A" * 64, *good[1:]), (good[0], "b" * 39, good[2]), (*good[:2], "http://x/y"), (None, *good[1:])]
    assert [r.reason for r in R.pinned_assets(spark.createDataFrame(assets, "sha256 string, commit string, url string")).collect()] == [None, "sha256", "commit", "url", "sha256"]
    rel = lambda *names: spark.createDataFrame([(n,) for n in names], "rel string")
    assert [r.rel for r in R.missing_files(rel("a", "b/c"), rel("a", "d")).collect()] == ["b/c"]
