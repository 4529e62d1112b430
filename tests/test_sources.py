"""Readers and writers on small files."""

import io
import json
import random
import re
import tarfile
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from gaugeworks.plans.shared import settled
from gaugeworks.sources import readers as R
from gaugeworks.sources import sinks as K
from gaugeworks.sources.batches import BatchLog


def lines(spark, *text):
    return spark.createDataFrame([(k, t) for k, t in enumerate(text)], "line long, value string")


def test_listing_and_sidecars(spark, tmp_path):
    for name in ("B.MKV", "a.mp4", "a.en.srt", "a.srt", "ab.srt", "notes.txt", "sub/c.mov"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x")
    media = R.list_files(spark, str(tmp_path))
    assert [r.rel for r in media.collect()] == ["a.mp4", "B.MKV", "sub/c.mov"]
    assert [r.rel for r in R.list_files(spark, str(tmp_path), recursive=False).collect()] == ["a.mp4", "B.MKV"]
    side = R.sidecars(media, R.list_files(spark, str(tmp_path), R.SIDECARS))
    assert sorted(r.order for r in side.collect()) == ["a.en.srt", "a.srt"]


def test_media_rows(spark):
    full = {"format": {"duration": "10.0", "bit_rate": "1000000"}, "streams": [{"codec_type": "audio", "bit_rate": "128000", "codec_name": "aac"}, {"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "avg_frame_rate": "0/0", "r_frame_rate": "30000/1001", "pix_fmt": "yuv420p", "bits_per_raw_sample": "10", "color_transfer": "SMPTE2084"}]}
    bare = {"format": {"duration": "0"}, "streams": [{"codec_type": "video", "duration": "8"}]}
    loud = {"format": {"duration": "8", "bit_rate": "100000"}, "streams": [{"codec_type": "video"}, {"codec_type": "audio", "bit_rate": "200000"}]}
    still = {"format": {"duration": "8"}, "streams": [{"codec_type": "audio"}]}
    rows = spark.createDataFrame([(json.dumps(full), 999), (json.dumps(bare), 1_000_000), (json.dumps(loud), 5), (json.dumps(still), 5), ("garbage", 5)], "value string, size long")
    a, b, c, d, e = R.media_rows(rows).collect()
    assert (a.duration, a.rate, a.audio_rate, a.video_rate, a.bits, a.hdr, a.audio_codec, a.reason) == (10.0, 1_000_000, 128_000, 872_000, 10, True, "aac", None) and abs(a.fps - 29.97) < 0.01
    assert (b.duration, b.rate, b.video_rate, b.audio_streams, b.codec, b.audio_codec) == (8.0, 1_000_000, 1_000_000, 0, "unknown", None)  # no audio: the whole rate
    assert c.video_rate == 300_000 and c.audio_rate == 200_000  # nothing left beside the audio
    assert d.reason == e.reason == "no video stream" and e.duration is None


def test_listing_is_by_fixed_sets_and_whole_paths(spark, tmp_path):
    assert sorted(R.MEDIA) == sorted("mp4 mkv avi mov wmv flv webm m4v ts m2ts mts mpg mpeg 3gp ogv".split()) and len(R.SIDECARS) == 12 and {"sami", "usf"} <= set(R.SIDECARS)
    odd = tmp_path / "a+b(1)" / "a+b(1)"
    odd.mkdir(parents=True)
    (odd / "x.ogv").write_bytes(b"x")
    (odd / "x.vob").write_bytes(b"x")
    assert [r.rel for r in R.list_files(spark, str(tmp_path / "a+b(1)")).collect()] == ["a+b(1)/x.ogv"]
    assert [r.rel for r in R.list_files(spark, str(odd / "x.ogv")).collect()] == ["x.ogv"]
    with pytest.raises(ValueError):
        R.list_files(spark, str(odd / "x.vob"))
    with pytest.raises(FileNotFoundError):
        R.list_files(spark, str(tmp_path / "none"))


def test_progress_lines(spark):
    got = R.progress(lines(spark, "frame=  12 time=00:00:05.00 speed=1.5x", "speed=2x", "time=N/A", "hello frame=3", "time=00:01:00"), 20.0).collect()
    assert [(r.kind, r.percent, r.speed, r.frame) for r in got] == [("progress", 25.0, 1.5, 12), ("progress", None, 2.0, None), ("progress", None, None, None), ("log", None, None, None), ("progress", 100.0, None, None)]


def test_frame_text(spark):
    rows = lines(spark, "frame:0 pts:0", "si=1.5", "frame:1 pts:1", "si=2.5", "ti=nan", "x=oops").withColumn("k", F.lit(1))
    got = {r.frame: (r["values"], r.bad) for r in R.frame_records(rows, "k", "line").collect()}
    assert got == {0: ({"si": 1.5}, 0), 1: ({"si": 2.5}, 2)}


def test_frame_scores(spark):
    text = json.dumps({"frames": [{"frameNum": 0, "metrics": {"vmaf": 95.0}}, {"metrics": {"vmaf": 101.0}}, {"frameNum": 0, "metrics": {"vmaf": 50.0}}]})
    got = [(r.frame, r.score, r.valid) for r in R.frame_scores(lines(spark, text), "line").orderBy("pos").collect()]
    assert got == [(0, 95.0, True), (1, 101.0, False), (0, 50.0, False)]


@pytest.mark.parametrize("size", [64, 1000])
def test_texts_by_ranges_of_bytes(spark, tmp_path, size):
    """Files in many ranges give what one pass gives, wherever the borders fall."""
    rng = random.Random(size)
    logs, scores = tmp_path / "logs", tmp_path / "scores"
    logs.mkdir(), scores.mkdir()
    expected = {}
    for name, n in (("a.log", 60), ("b.log", 1), ("c.log", 0)):
        body = "early=1\n" + "".join(f"frame:{i} pts:{i}\n" + "".join(f"k{j}={rng.choice([i + j / 8, 'nan', 'oops'])}\n" for j in range(rng.randint(0, 4))) for i in range(n))
        (logs / name).write_text(body)
        expected[name] = body.splitlines()
        frames = [{"frameNum": i + rng.choice([0, 0, -1]), "metrics": {"psnr": 1.5, "vmaf": rng.choice([50.0, 101.0, 99.5])}} for i in range(1, n + 1)]
        for f in frames[::5]:
            del f["frameNum"]
        for f in frames[1::5]:
            f["frameNum"] = f.pop("frameNum")  # after the metrics
        text = json.dumps({"version": "1", "frames": frames, "pooled_metrics": {"vmaf": {"mean": 1.0}}}, indent=rng.choice([None, 2]))
        (scores / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        found, judged = (settled(f(spark, str(d))) for f, d in ((R.frame_logs, logs), (R.score_files, scores)))
        assert R.text_pieces(spark, str(logs)).select("path", "block").distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    name = F.regexp_extract("path", "([^/]+)$", 1)
    rows = spark.createDataFrame([(k, i, v) for k, lines_ in expected.items() for i, v in enumerate(lines_)], "k string, i int, value string")
    plain = R.frame_records(rows, "k", "i")
    key = lambda r: (r[0], r.record, r.frame, sorted(r["values"].items()), r.bad)
    assert sorted(map(key, found.withColumn("path", name).collect()), key=repr) == sorted(map(key, plain.collect()), key=repr)
    whole = spark.createDataFrame([(n, (scores / n).read_text()) for n in expected], "k string, value string")
    cells = ("pos", "frame", "score", "valid")
    want = [(r.k, *(r[c] for c in cells)) for r in R.frame_scores(whole, "k").collect()]
    assert sorted((r.k, *(r[c] for c in cells)) for r in judged.withColumn("k", name).collect()) == sorted(want) and len(want) == 61


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"schema_version": 1, "cases": [{"id": "a", "command": ["x"]}, {"id": "b/..", "command": ["x"]}, {"id": "c"}, {"id": "d", "command": ["x"]}, {"id": "d", "command": ["x"]}]}))
    got = [(r.id, r.reason) for r in R.manifest_cases(spark, str(path)).collect()]
    assert sorted(got) == sorted([("a", None), ("b/..", "id"), ("c", "measurement"), ("d", "repeated"), ("d", "repeated")])


def test_resume_lines(spark):
    rows = lines(spark, '{"case_id":"a","v":1}', "", '{"case_id":"a","v":2}', "oops")
    got = {(r.case_id, r.record, r.line, r.bad) for r in R.resume_records(rows, "line").collect()}
    assert got == {("a", '{"case_id":"a","v":2}', 2, False), (None, "oops", 3, True)}


def test_tool_output(spark):
    got = {r.name for r in R.tool_names(lines(spark, " T.. libvmaf  VV->V\n ... scale V->V\n"), r"^\s*[T.][S.][C.]\s+(\S+)").collect()}
    assert got == {"libvmaf", "scale"}
    a, b = R.progress(lines(spark, "frame= 50 time=00:00:05.00 bitrate=1 speed=2.5x", "hello"), 4.0).collect()
    assert (a.kind, a.percent, a.speed, a.frame) == ("progress", 100.0, 2.5, 50) and (b.kind, b.percent) == ("log", None)


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("bin/tool", b"one")
        z.writestr("other/tool", b"two")
    with tarfile.open(tmp_path / "b.tar.xz", "w:xz") as t:
        info = tarfile.TarInfo("x/probe")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    got = R.archive_members(spark, str(tmp_path), ["tool", "probe"]).orderBy("name").collect()
    assert [(r.name, r["size"]) for r in got] == [("probe", 3), ("tool", 3)]


def test_receipts_fail_closed(spark, tmp_path):
    folder = str(tmp_path / "r")
    w = [("search", 0.0, 5.0), ("holdout", 10.0, 5.0)]
    good = ("a" * 64, 5, "s", w, [(1000, 90.0, [90.0])])
    bad = [("b" * 64, 5, "s", w, [(1000, 89.0, [90.0])]), ("c" * 64, 5, "s", w, [(1000, 101.0, [101.0])]), ("d" * 64, 5, "s", [("search", 0.0, 5.0), ("holdout", 4.0, 5.0)], [(1000, 90.0, [90.0])]), ("e" * 64, 4, "s", w, []), ("f" * 64, 5, "s", [], [])]
    K.save_receipts(spark.createDataFrame([good, *bad], K.RECEIPT), folder)
    (tmp_path / "r" / ("fingerprint=" + "9" * 64)).mkdir()
    (tmp_path / "r" / ("fingerprint=" + "9" * 64) / "x.json").write_text("{broken")
    assert [r.fingerprint for r in K.load_receipts(spark, folder).collect()] == ["a" * 64]
    K.save_receipts(spark.createDataFrame([("a" * 64, 5, "new", w, [])], K.RECEIPT), folder)
    assert K.load_receipts(spark, folder).first().source == "new"


def test_receipt_log(spark, tmp_path):
    """Batches count once and whole; look-ups, few and many, find the latest."""
    folder = str(tmp_path / "log")
    w = [("search", 0.0, 5.0)]
    made = lambda n, source: spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"), F.lit(5).alias("schema_version"), F.lit(source).alias("source"), F.from_json(F.lit(json.dumps([dict(zip(("pool", "start", "size"), w[0]))])), "array<struct<pool:string,start:double,size:double>>").alias("windows"), F.from_json(F.lit("[]"), "array<struct<rate:long,minimum:double,scores:array<double>>>").alias("candidates"))
    assert K.log_receipts(made(3000, "old"), folder, 0) and not K.log_receipts(made(5000, "again"), folder, 0)
    assert K.logged_receipts(spark, folder).count() == 3000
    with pytest.raises(Exception, match="valid receipt"):
        K.log_receipts(made(10, "x").withColumn("fingerprint", F.lit("zz")), folder, 1)
    assert K.logged_receipts(spark, folder).count() == 3000
    assert K.log_receipts(made(100, "new"), folder, 1)
    log = BatchLog(spark, folder, "fingerprint")
    for _ in range(2):
        got = {r.source: r["count"] for r in K.logged_receipts(spark, folder).groupBy("source").count().collect()}
        assert got == {"old": 2900, "new": 100}
        for n, new in ((5, 5), (150, 100), (1000, 100)):
            found = K.logged_receipts(spark, folder, made(n, "?").select("fingerprint"))
            assert found.count() == n and found.where("source = 'new'").count() == new
        log.compact()
        assert not K.log_receipts(made(7, "late"), folder, 1)
    assert len(list((tmp_path / "log" / "data").glob("*/*.parquet"))) < 20
    assert K.log_receipts(made(1, "last"), folder, 2)
    log.compact()
    assert len(list((tmp_path / "log" / "log").glob("0*"))) == 3  # the last two summaries and what came between
    assert K.logged_receipts(spark, folder).where("source = 'last'").count() == 1
    (tmp_path / "log" / "log" / "000000000003").write_text('{"da')
    assert K.log_receipts(made(2, "after"), folder, 3) and not K.log_receipts(made(2, "twice"), folder, 3)
    assert K.logged_receipts(spark, folder).where("source = 'after'").count() == 2
    with pytest.raises(FileNotFoundError):
        BatchLog(spark, str(tmp_path / "none"), "fingerprint").rows()


def test_reuse_ladder(spark):
    wanted = spark.createDataFrame([("d1", "m1"), ("d2", "m1"), ("d3", "m3")], "decision string, measurement string")
    got = K.reuse(wanted, spark.createDataFrame([("d1",)], "decision string"), spark.createDataFrame([("m1",)], "measurement string"))
    assert {r.decision: r.source for r in got.collect()} == {"d1": "decision", "d2": "measurement", "d3": "measure"}


def test_outputs(spark, tmp_path):
    row = spark.createDataFrame([("50%\nx", ["a", "b"], None)], "note string, items array<string>, none string")
    assert sorted(r.value for r in K.output_lines(row).collect()) == ['items=["a","b"]', "none=", "note=50%25%0Ax"]
    assert json.loads(K.summary_text(row).first().value)["none"] is None
    K.append_lines(row, str(tmp_path / "n"))
    K.append_lines(row, str(tmp_path / "n"))
    assert spark.read.json(str(tmp_path / "n")).count() == 2
    K.write_table_text(row, str(tmp_path / "c"), {"note": "note", "first": "items[0]"})
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["note", "first"]
    out = spark.createDataFrame([("p", 5, 10), ("/a.b/q", 11, 10), ("/a.b/q.x.mp4", 11, 10)], "path string, n long, most long")
    fits, bare, named = K.publish_split(out, "most", "n", "path").collect()
    assert (fits.accepted, fits.to) == (True, "p") and not bare.accepted
    assert re.fullmatch(r"/a\.b/q\.size-miss-[0-9a-f]{8}", bare.to) and re.fullmatch(r"/a\.b/q\.x\.size-miss-[0-9a-f]{8}\.mp4", named.to)


def test_presets_and_settings(spark, tmp_path):
    from gaugeworks.sources import presets

    folder = str(tmp_path / "p")
    presets.save_preset(folder, "a.b", {"rate": 5, "name": ""})
    assert presets.list_presets(folder) == ["a.b"]
    assert presets.load_preset(folder, "a.b", {"rate": 1, "name": "x", "more": True}) == {"rate": 5, "name": None, "more": True}
    for bad in ("../x", "", "a/b"):
        try:
            presets.save_preset(folder, bad, {})
            raise AssertionError(bad)
        except ValueError:
            pass
    assert presets.delete_preset(folder, "a.b") and not presets.delete_preset(folder, "a.b")
    path = str(tmp_path / "c.json")
    presets.update_settings(path, {"n": 1}, lambda d: d | {"n": d["n"] + 1})
    assert presets.update_settings(path, {"n": 1, "m": 0}, lambda d: d | {"n": d["n"] + 1}) == {"n": 3, "m": 0}


def test_deleting_receipts_and_exporting_lines(spark, tmp_path):
    folder = str(tmp_path / "r")
    w = [("search", 0.0, 5.0)]
    K.save_receipts(spark.createDataFrame([("a" * 64, 5, "s", w, []), ("b" * 64, 5, "s", w, [])], K.RECEIPT), folder)
    (tmp_path / "beside").mkdir()
    for bad in ("", "../..", "../../..", "A" * 64, "a" * 63, None):
        with pytest.raises(ValueError):
            K.delete_receipts(spark, folder, bad)
    assert K.delete_receipts(spark, folder, "a" * 64) and not K.delete_receipts(spark, folder, "a" * 64)
    assert [r.fingerprint for r in K.load_receipts(spark, folder).collect()] == ["b" * 64]
    (tmp_path / "r" / "notes").mkdir()
    assert K.clear_receipts(spark, folder) == 1 and K.clear_receipts(spark, folder) == 0 and (tmp_path / "r" / "notes").is_dir()
    assert K.clear_receipts(spark, str(tmp_path / "nothing")) == 0 and (tmp_path / "beside").is_dir()
    for bad in ([("a" * 64, 5, "s", [("search", float("nan"), 5.0)], [])], [("a" * 63, 5, "s", w, [])]):
        with pytest.raises(Exception, match="not a valid receipt"):
            K.save_receipts(spark.createDataFrame(bad, K.RECEIPT), folder)
    K.export_lines(lines(spark, "$ run", "it failed", "fine"), str(tmp_path / "t"), kind="error")
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["it failed"]


def test_settings_are_not_lost_and_options_are_checked(tmp_path):
    from gaugeworks.sources import presets

    path = str(tmp_path / "c.json")

    def add(_):
        for _ in range(25):
            presets.update_settings(path, {"n": 0}, lambda d: d.update(n=d["n"] + 1))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(4)))
    assert presets.update_settings(path, {"n": 0}, lambda d: None) == {"n": 100}
    folder = str(tmp_path / "p")
    for bad in ({"codec": "vp9"}, {"parallel_backends": ["cpu", "gpu"]}, {"ratio": 0}, {"min_vmaf": 101}, {"max_output_ratio": 1.5}):
        presets.save_preset(folder, "x", bad)
        with pytest.raises(ValueError):
            presets.load_preset(folder, "x", {k: None for k in bad})
    presets.save_preset(folder, "x", {"codec": "av1", "preset": "  "})
    assert presets.load_preset(folder, "x", {"codec": "hevc", "preset": "slow", "ratio": 0.5}) == {"codec": "av1", "preset": None, "ratio": 0.5}


def test_files_are_copied_or_refused_with_a_reason(spark, tmp_path):
    (tmp_path / "a.mkv").write_bytes(b"a" * 100_000)
    (tmp_path / "a.en.srt").write_text("one")
    (tmp_path / "old.mkv").write_text("old")
    at = lambda name: f"file://{tmp_path}/{name}"
    asked = [(1, at("a.mkv"), at("out/deep/b.mkv"), False), (2, at("none.mkv"), at("x.mkv"), True), (3, at("a.mkv"), at("old.mkv"), False), (4, at("a.mkv"), at("a.mkv"), True), (5, None, at("y"), True)]
    got = {r.k: (r.copied, r.reason) for r in K.copy_files(spark.createDataFrame(asked, "k int, source string, target string, overwrite boolean")).collect()}
    assert got == {1: (True, None), 2: (False, "source is missing"), 3: (False, "output exists"), 4: (False, "source and output are the same file"), 5: (False, "no path")}
    assert (tmp_path / "out/deep/b.mkv").read_bytes() == b"a" * 100_000 and (tmp_path / "old.mkv").read_text() == "old"
    side = spark.createDataFrame([(at("a.mkv"), at("a.en.srt"), at("out/deep/b.mkv"))], "source string, sidecar string, target string")
    assert [r.copied for r in K.copy_files(K.sidecar_targets(side), "sidecar", "to").collect()] == [True] and (tmp_path / "out/deep/b.en.srt").read_text() == "one"


def test_summary_is_one_file_with_sorted_keys(spark, tmp_path):
    row = spark.createDataFrame([(2, None, 1.5)], "b int, a string, c double")
    for _ in range(2):
        K.write_summary(row, str(tmp_path / "s.json"))
    assert (tmp_path / "s.json").read_text() == '{"a":null,"b":2,"c":1.5}\n' and not [p for p in tmp_path.iterdir() if "tmp" in p.name]


def test_keys_and_receipts(spark, tmp_path):
    names = list(K.MEASURED_BY)
    assert len(names) == len(set(names)) == 56
    decided = [c for c in K.DECIDED_BY if c not in names and c != "measurement_fingerprint"]
    rows = spark.createDataFrame([tuple(range(len(names) + len(decided)))], [*names, *decided])
    keyed = lambda df: df.withColumn("measurement_fingerprint", K.measurement_key()).select("measurement_fingerprint", K.decision_key().alias("d")).first()
    base, policy, media = keyed(rows), keyed(rows.withColumn("min_vmaf", F.lit(-1))), keyed(rows.withColumn("source_fps", F.lit(-1)))
    assert policy[0] == base[0] != media[0] and len({base.d, policy.d, media.d}) == 3
    full = rows.withColumns({"search": F.expr("array(named_struct('start', 0, 'size', 5))"), "holdout": F.expr("array(named_struct('start', 5, 'size', 5))"), "reserve": F.lit(None).cast("array<struct<start:double,size:double>>"), "candidates": F.expr("array(named_struct('rate', 1000L, 'scores', array(95.5D)))")})
    K.save_receipts(K.receipt_rows(full), str(tmp_path / "r"))
    (held,) = K.load_receipts(spark, str(tmp_path / "r")).collect()
    assert held.fingerprint == base[0] and [w.pool for w in held.windows] == ["search", "holdout"] and held.candidates[0].minimum == 95.5


def test_actions_apply_where_the_state_allows(spark):
    from gaugeworks.operators import state

    rows = spark.createDataFrame([("a", "needs_decision", True), ("b", "done", True), ("c", "queued", True), ("d", "failed", True), ("e", "cancelled", False)], "k string, status string, smart boolean")
    acts = spark.createDataFrame([("a", 1, "skip"), ("a", 2, "accept"), ("b", 1, "retry"), ("d", 1, "retry"), ("d", 2, "cancel"), ("d", 3, "skip"), ("e", 1, "retry"), ("e", 2, "no such"), ("z", 1, "skip")], "k string, n long, action string")
    got = {r.k: (r.status, r.applied) for r in state.apply_actions(rows, acts, "k", "n").collect()}
    assert got == {"a": ("skipped", 1), "b": ("done", 0), "c": ("queued", 0), "d": ("cancelled", 2), "e": ("queued", 1)}
    plan = spark.createDataFrame([("x", True), (None, True), (None, False)], "skip string, smart boolean")
    assert [(r.status, r.file_percent, r.total_passes) for r in state.initial(plan, "skip", F.col("smart"), ~F.col("smart")).collect()] == [("skipped", 100.0, 1), ("waiting_analysis", 0.0, 1), ("queued", 0.0, 2)]


def test_a_decision_changes_the_fields_of_its_row(spark):
    from gaugeworks.operators import state

    schema = "k string, status string, smart boolean, rejected string, error string, file_percent double, target_rate long, started_at double"
    rows = spark.createDataFrame([(k, "needs_decision", True, r, "old", 80.0, 5, 3.0) for k, r in (("a", None), ("b", None), ("c", None), ("d", "x"), ("e", "x"), ("f", "x"))], schema)
    acts = [("a", 1, "reselect", False, False, None, "too large"), ("a", 2, "reselect", True, None, 9, None), ("a", 3, "skip", None, None, None, None), ("b", 1, "reselect", False, True, None, None), ("c", 1, "reselect", False, False, None, "nothing fits"), ("d", 1, "accept", None, None, None, None), ("e", 1, "skip", None, None, None, None), ("f", 1, "retry", None, None, None, None), ("f", 2, "accept", None, None, None, None)]
    given = spark.createDataFrame(acts, "k string, n long, action string, found boolean, requires_analysis boolean, rate long, message string")
    got = {r.k: (r.status, r.error, r.file_percent, r.target_rate, r.started_at, r.applied) for r in state.apply_actions(rows, given, "k", "n").collect()}
    assert got["a"] == ("waiting_analysis", None, 0.0, 9, None, 2) and got["b"] == ("waiting_analysis", None, 0.0, 5, None, 1)
    assert got["c"] == ("needs_decision", "nothing fits", 80.0, 5, 3.0, 1) and got["d"] == ("done", None, 100.0, 5, 3.0, 1)
    assert got["e"] == ("needs_decision", "old", 80.0, 5, 3.0, 0) and got["f"] == ("waiting_analysis", None, 0.0, 5, None, 1)
    plan = spark.createDataFrame([("a", None), ("g", "too short")], "k string, why string")
    more = {r.k: (r.status, r.error) for r in state.inserted(rows.select("k", "status", "error"), plan, "k", "why", F.lit(True)).collect()}
    assert more["a"] == ("needs_decision", "old") and more["g"] == ("skipped", "too short")
    assign = spark.createDataFrame([("a", 1, "assign", 1.0, None, "gpu", "x265")], "k string, n long, command string, at double, message string, backend string, encoder string")
    held = rows.withColumns({"backend": F.lit("cpu"), "encoder": F.lit(None).cast("string")})
    assert [(r.backend, r.encoder) for r in state.transition(held, assign, "k", "n").where("k < 'c'").orderBy("k").collect()] == [("gpu", "x265"), ("cpu", None)]


def test_equal_records_have_equal_keys(spark):
    a = spark.sql("select named_struct('b', 1, 'a', array(named_struct('y', 2, 'x', map('q', 1, 'p', 2)))) as r, 5 as n")
    b = spark.sql("select 5 as n, named_struct('a', array(named_struct('x', map('p', 2, 'q', 1), 'y', 2)), 'b', 1) as r")
    other = spark.sql("select 5 as n, named_struct('a', array(named_struct('x', map('p', 1, 'q', 2), 'y', 2)), 'b', 1) as r")
    keys = [df.select(K.fingerprint(df.columns, df.schema)).first()[0] for df in (a, b, other)]
    assert keys[0] == keys[1] != keys[2]


def test_events_say_what_they_say(spark):
    from gaugeworks.operators import state

    rows = [("analyzing", 2, 37.5, "", None), ("running_pass", None, 150.0, "1.5x", "hm"), ("finished_file", None, 5.0, None, None), ("failed_file", None, None, None, "  it   broke ")]
    e = spark.createDataFrame(rows, "state string, candidate int, percent double, speed string, message string")
    got = e.select(*(c.alias(k) for k, c in state.event_fields(F.col("state"), **{k: F.col(k) for k in ("candidate", "percent", "speed", "message")}).items())).collect()
    assert [tuple(r) for r in got] == [("analyzing", 2, 37.5, None, None), ("encoding", None, 100.0, "1.5x", None), (None, None, None, None, None), (None, None, None, None, "it broke")]


def test_language_packs(spark, tmp_path):
    from gaugeworks.sources import packs as P

    def packs(name, **files):
        folder = tmp_path / name
        folder.mkdir()
        for file, held in files.items():
            (folder / f"{file}.json").write_text(held if isinstance(held, str) else json.dumps(held))
        return P.pack_entries(spark, str(folder))

    en = {"language.name": "English", "a": "{n} of {m:.1f}", "b": "plain"}
    de = {"language.name": "Deutsch", "a": "{m} zu {n}", "b": "schlicht"}
    held = P.builtin_packs(packs("good", en=en, de=de, Odd="[]"))
    assert held.count() == 6
    for k, (bad, fault) in enumerate([({**de, "c": "x"}, "extra key"), ({"language.name": "D", "a": "{m}{n}"}, "missing key"), ({**de, "a": "{x}"}, "placeholder"), ({**de, "b": 5}, "no text"), ("[1]", "not an object"), ("{", "corrupt"), ({"language.name": "", "a": "{m}{n}", "b": ""}, "language name")]):
        with pytest.raises(ValueError, match=fault):
            P.builtin_packs(packs(f"bad{k}", en=en, de=bad))
    with pytest.raises(ValueError, match="missing base"):
        P.builtin_packs(packs("baseless", de=de))
    user = P.override_packs(packs("user", de={"language.name": "D2", "b": "neu", "a": "{n}", "zz": "x"}, fr={"b": "sans nom"}, sv={"language.name": "Svenska", "b": 3}, X={"language.name": "X"}, it="[]", pl="{"), held)
    got = {(r.locale, r.key): (r.value, r.reason) for r in user.collect()}
    assert got[("de", "b")] == ("neu", None) and got[("de", "a")][1] == "placeholder mismatch" and got[("de", "zz")][1] == "unknown key" and got[("sv", "b")] == (None, "no text")
    assert {k[0]: v[1] for k, v in got.items() if k[1] is None} == {"fr": "missing language name", "X": "invalid filename", "it": "root is not an object", "pl": "corrupt JSON"}
    assert {r.key: r.value for r in P.messages(held, user, "de").collect()} == {"language.name": "D2", "a": "{m} zu {n}", "b": "neu"}
    assert {r.key: r.value for r in P.messages(held, user, "none").collect()} == en


def test_preserved_outputs_are_settled(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    for name in ("a.miss", "b.miss", "c.miss", "f"):
        (tmp_path / name).write_text(name)
    rows = [(1, "accept", "a", "a", "a.miss", True), (2, "discard", "b", "b", "b.miss", True), (3, "accept", "c", "other", "c.miss", True), (4, "accept", "d", "d", None, True), (5, "accept", "e", "e", "e.miss", True), (6, "accept", "f", "f", "f.miss", True), (7, "?", "g", "g", "c.miss", True), (8, "discard", "h", "h", "c.miss", False)]
    rows = [(k, act, at(o), at(p), r and at(r), False, False, n) for k, act, o, p, r, n in rows]
    df = spark.createDataFrame(rows, "k int, action string, output string, planned string, rejected string, success boolean, skipped boolean, needs_decision boolean")
    got = {r.k: (r.success, r.skipped, r.needs_decision, r.rejected is None, r.reason) for r in K.settle_preserved(df).collect()}
    assert got[1] == (True, False, False, True, None) and (tmp_path / "a").read_text() == "a.miss" and not (tmp_path / "a.miss").exists()
    assert got[2] == (False, True, False, True, None) and not (tmp_path / "b.miss").exists()
    assert [got[k][4] for k in (3, 4, 5, 7, 8)] == ["another output", "nothing kept aside", "the preserved output is missing", "unknown action", "nothing kept aside"]
    assert got[3][:4] == (False, False, True, False) and (tmp_path / "c.miss").exists()
    assert got[6] == (True, False, False, True, None)  # moved by an attempt before


def test_cases_are_measured_by_their_commands(spark, tmp_path):
    import sys

    from gaugeworks.sources.runner import measured

    (tmp_path / "s.mkv").write_text("12345")
    write = "import sys, json; json.dump({'size': len(open(sys.argv[1]).read()), 'tool': sys.argv[3], 'case': sys.argv[4]}, open(sys.argv[2], 'w'))"
    script = tmp_path / "run.py"
    script.write_text(write)
    good = ["{python}", str(script), "{source}", "{result_path}", "{ffmpeg}", "{case_id}"]
    sleepy = tmp_path / "sleep.py"
    sleepy.write_text("import time; time.sleep(60)")
    cases = {"a": good, "c": ["{python}", "-c", "raise SystemExit(3)"], "d": ["{nothing}"], "e": ["{python}", "-c", "0"], "f": ["/no/such"], "g": ["{python}", str(sleepy)], "k": ["{"], "l": []}
    rows = [(k, str(tmp_path / "s.mkv"), c, None, None) for k, c in cases.items()]
    rows += [("h", str(tmp_path / "none"), good, None, None), ("i", str(tmp_path / "s.mkv"), None, '{"x": 1}', None), ("j", None, good, None, "repeated")]
    df = spark.createDataFrame(rows, "id string, source string, command array<string>, measurement string, reason string")
    got = {r.id: (r.measurement and json.loads(r.measurement), r.reason) for r in measured(df, f"file://{tmp_path}/out", {"ffmpeg": "ff", "python": sys.executable}, 4, 5.0).collect()}
    assert got["a"] == ({"size": 5, "tool": "ff", "case": "a"}, None) and got["i"] == ({"x": 1}, None)
    assert {k: v[1] for k, v in got.items() if k not in "ai"} == {"c": "exit code 3", "d": "unknown placeholder nothing", "e": "no valid JSON", "f": "cannot run: No such file or directory", "g": "out of time", "h": "source is not a file", "j": "repeated", "k": "malformed command", "l": "no command"}
