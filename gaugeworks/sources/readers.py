"""Scans: file listings, media metadata, frame text and scores, tool output, manifests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import expr as X
from gaugeworks.functions.rules import first_reason
from gaugeworks.operators.series import number_records

# Extensions of media and of sidecar files.
MEDIA = ["mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "m4v", "ts", "m2ts", "mts", "mpg", "mpeg", "3gp", "ogv"]
SIDECARS = ["srt", "ass", "ssa", "vtt", "sub", "idx", "sup", "ttml", "dfxp", "smi", "sami", "usf"]

PROBE = """format struct<duration:string, bit_rate:string, size:string>,
streams array<struct<codec_type:string, codec_name:string, duration:string, bit_rate:string, width:int, height:int,
avg_frame_rate:string, r_frame_rate:string, pix_fmt:string, bits_per_raw_sample:string, color_transfer:string>>"""
SCORES = "pooled_metrics struct<vmaf:struct<mean:double>>, frames array<struct<frameNum:long, metrics:struct<vmaf:double>>>"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def list_files(spark: SparkSession, folder: str, extensions: Sequence[str] = MEDIA, recursive: bool = True) -> DataFrame:
    """(path, rel, length, modified) of the files with these extensions, contents
    unread, in order of the lower-cased relative path.  A path that is not there is an
    error, and so is a single file with another extension."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        raise FileNotFoundError(folder)
    status = files.getFileStatus(root)
    base = status.getPath().toString()
    if status.isFile():
        if base.rpartition(".")[2].lower() not in extensions or "." not in base.rpartition("/")[2]:
            raise ValueError(f"not such a file: {folder}")
        base = base.rpartition("/")[0]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    rel = F.substr("path", F.lit(len(base.rstrip("/")) + 2))
    kept = found.select("path", rel.alias("rel"), "length", F.col("modificationTime").alias("modified"))
    return kept.where(extension(F.col("path")).isin(list(extensions))).orderBy(F.lower("rel"), "rel")


def sidecars(media: DataFrame, files: DataFrame) -> DataFrame:
    """(path, sidecar): files beside a medium that share its stem or begin with it.
    Every leading part of a sidecar's name is a key, so the join is an equality."""

    def parts(df: DataFrame) -> DataFrame:
        return df.withColumn("dir", F.regexp_replace("path", r"[^/]+$", "")).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))

    own = parts(media).select("path", "dir", F.regexp_replace("name", r"\.[^.]+$", "").alias("stem"))
    side = parts(files).where(extension(F.col("path")).isin(SIDECARS)).withColumn("bits", F.split("name", r"\."))
    stems = F.transform(F.sequence(F.lit(1), F.size("bits") - 1), lambda k: F.array_join(F.slice("bits", 1, k), "."))
    side = side.where(F.size("bits") > 1).select(F.col("path").alias("sidecar"), "dir", "name", F.explode(stems).alias("stem"))
    return own.join(side, ["dir", "stem"]).select("path", "sidecar", F.lower("name").alias("order"))


def media_rows(probes: DataFrame, text: str = "value", size: str = "size") -> DataFrame:
    """One media row a probe, with a ``reason`` where it is none: no
    video, or no positive duration.  Duration: container, else video stream, zeros passed
    over.  Total rate: as given, else from the size.  Video rate: as given, else the total
    less all audio, else 0.85 of the total and at least 300,000.  Bits: as given, else by
    the pixel format."""
    parsed = probes.withColumn("__p", F.from_json(text, PROBE))
    streams = F.coalesce(F.col("__p.streams"), F.array())
    video = F.try_element_at(F.filter(streams, lambda s: s.codec_type == "video"), F.lit(1))
    audio = F.filter(streams, lambda s: s.codec_type == "audio")
    form = F.col("__p.format")
    duration = F.coalesce(F.nullif(form.duration.try_cast("double"), F.lit(0.0)), F.nullif(video.duration.try_cast("double"), F.lit(0.0)))
    given = X.lenient_long(form.bit_rate)
    total = F.when(given > 0, given).otherwise(F.greatest(F.lit(1).cast("long"), X.whole(F.col(size) * 8 / duration)))
    sound = F.aggregate(audio, F.lit(0).cast("long"), lambda acc, s: acc + X.lenient_long(s.bit_rate))
    reason = F.when(video.isNull(), "no video stream").when(~F.coalesce(duration > 0, F.lit(False)), "no duration")
    rows = parsed.withColumns({"duration": duration, "rate": total, "audio_rate": sound, "audio_streams": F.size(audio), "reason": reason})
    estimated = F.greatest(F.lit(300_000).cast("long"), X.whole(F.col("rate") * 0.85))
    left, own = F.col("rate") - F.col("audio_rate"), X.lenient_long(video.bit_rate)
    picture = F.when(own > 0, own).when(left > 0, left).otherwise(estimated)
    fps = F.coalesce(X.parse_fraction(video.avg_frame_rate), X.parse_fraction(video.r_frame_rate))
    bits = X.lenient_long(video.bits_per_raw_sample)
    out = {
        "video_rate": picture,
        "width": video.width,
        "height": video.height,
        "codec": F.coalesce(F.nullif(video.codec_name, F.lit("")), F.lit("unknown")),
        "audio_codec": F.try_element_at(audio, F.lit(1)).codec_name,
        "fps": fps,
        "bits": F.when(bits > 0, bits.cast("int")).otherwise(X.bit_depth(video.pix_fmt)),
        "hdr": F.coalesce(F.lower(video.color_transfer).isin("smpte2084", "arib-std-b67"), F.lit(False)),
    }
    return rows.withColumns(out).drop("__p")


def frame_entries(lines: DataFrame, *kept: str, text: str = "value") -> DataFrame:
    """What lines of frame text say: ``__b`` the number where one begins a frame, else empty,
    and the name and text of a ``key=value`` line."""
    pair = r"^([^=\s]+)=(.*)$"
    return lines.select(*kept, F.regexp_extract(text, r"^frame:(\d+)", 1).alias("__b"), F.regexp_extract(text, pair, 1).alias("__k"), F.regexp_extract(text, pair, 2).alias("__v"))


def gathered_frames(marked: DataFrame, key: str) -> DataFrame:
    number = F.col("__v").try_cast("double")
    fine = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    entry = F.when((F.col("__k") != "") & fine & (F.col("record") > 0), F.struct("__k", number.alias("v")))
    bad = F.count_if((F.col("__k") != "") & (~fine | (F.col("record") == 0)))
    return marked.groupBy(key, "record").agg(F.max("__b").try_cast("long").alias("frame"), F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("values"), bad.alias("bad"))


def frame_records(lines: DataFrame, key: str, order: str, text: str = "value") -> DataFrame:
    """One row a frame, (key, frame, values): ``frame:N`` begins a record and
    ``key=value`` lines fill it.  ``bad`` counts values that are not finite numbers and
    lines before the first frame."""
    marked = frame_entries(lines, key, order, text=text)
    return gathered_frames(number_records(marked, key, [order], F.col("__b") != ""), key)


def text_pieces(spark: SparkSession, folder: str, separator: str = "\n") -> DataFrame:
    """(path, block, place, value): the pieces of text files between separators.  Spark reads
    a file by ranges of bytes, each piece in the range where it begins; a range (``block``)
    is read front to back, so ``place`` orders its pieces, and blocks order a file."""
    found = spark.read.option("lineSep", separator).option("recursiveFileLookup", True).text(folder)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")


def numbered_pieces(pieces: DataFrame, begins: Column) -> DataFrame:
    """``record``: how many pieces of the file that begin a record stand at or before each
    one.  They are counted inside a range of bytes and added up over the ranges before it,
    so a record cut at a border goes on under its number and no task holds a file."""
    one = F.when(begins, 1).otherwise(0)
    counts = pieces.groupBy("path", "block").agg(F.sum(one).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("path", "block", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum(one).over(Window.partitionBy("path", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("__inside", inside).join(offsets, ["path", "block"]).withColumn("record", F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def frame_logs(spark: SparkSession, folder: str) -> DataFrame:
    """``frame_records`` of the text files of a folder, key ``path``.  A file of any
    size is read in ranges of ``spark.sql.files.maxPartitionBytes``."""
    marked = frame_entries(text_pieces(spark, folder), "path", "block", "place")
    return gathered_frames(numbered_pieces(marked, F.col("__b") != ""), "path")


def judged_scores(rows: DataFrame, previous: Column) -> DataFrame:
    fine = F.col("score").between(0, 100) & (previous.isNull() | (F.col("frame") > previous))
    return rows.withColumn("valid", F.coalesce(fine, F.lit(False)))


def frame_scores(texts: DataFrame, key: str, text: str = "value") -> DataFrame:
    """(key, pos, frame, score, valid) of score texts: the frame number defaults to
    the place and must rise, the score lie in 0..100.  A text is parsed whole; files of
    any size are for ``score_files``."""
    each = texts.select(key, F.posexplode(F.from_json(text, SCORES)["frames"]).alias("pos", "f"))
    rows = each.select(key, "pos", F.coalesce("f.frameNum", F.col("pos").cast("long")).alias("frame"), F.col("f.metrics.vmaf").alias("score"))
    return judged_scores(rows, F.lag("frame").over(Window.partitionBy(key).orderBy("pos")))


def score_files(spark: SparkSession, folder: str) -> DataFrame:
    """``frame_scores`` of the score files of a folder, key ``path``.  Files are read in
    ranges of bytes, cut at closing braces; a piece with ``"metrics": {`` begins a frame, whose
    number stands before it or in a piece after it.  Metrics are flat objects of numbers; a
    frame without metrics has no row.  The frame before is found by a join on its place."""
    inner = r'"metrics"\s*:\s*(\{[^{}]*)$'
    number = r'"frameNum"\s*:\s*(\d+)'
    pieces = text_pieces(spark, folder, "}").where("trim(value) <> ''")
    cut = pieces.select("path", "block", "place", F.regexp_extract("value", inner, 1).alias("__m"), F.regexp_extract("value", r"(?s)^\s*[,{\[]?.*?" + number, 1).alias("__f"), F.col("value").rlike(r"^\s*,\s*" + number).alias("__after"))
    begins = F.col("__m") != ""
    marked = numbered_pieces(cut, begins).where("record > 0").where(begins | F.col("__after"))
    score = F.from_json(F.concat("__m", F.lit("}")), "vmaf double")["vmaf"]
    frames = marked.groupBy("path", "record").agg(F.max(F.when(begins, score)).alias("score"), F.max(F.nullif("__f", F.lit(""))).try_cast("long").alias("__frame"))
    pos = (F.col("record") - 1).cast("int")
    rows = frames.select("path", pos.alias("pos"), F.coalesce("__frame", pos.cast("long")).alias("frame"), "score")
    earlier = rows.select("path", (F.col("pos") + 1).alias("pos"), F.col("frame").alias("__earlier"))
    return judged_scores(rows.join(earlier, ["path", "pos"], "left"), F.col("__earlier")).drop("__earlier")


def manifest_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a versioned manifest with a ``reason`` where one is unfit: wrong
    version, unsafe or repeated id, not exactly one of command and measurement.  A relative
    source is taken from the manifest's folder."""
    shape = "schema_version int, cases array<struct<id:string, source:string, command:array<string>, measurement:string>>"
    cases = spark.read.schema(shape).option("multiLine", True).json(path).select("schema_version", F.inline("cases"))
    twice = F.count("*").over(Window.partitionBy("id")) > 1
    both = F.col("command").isNotNull() == F.col("measurement").isNotNull()
    reason = F.when(~F.col("schema_version").eqNullSafe(F.lit(1)), "version").when(F.col("id").isNull() | ~F.col("id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), "id").when(twice, "repeated").when(both, "measurement")
    folder = F.lit(path.rpartition("/")[0])
    whole = F.when(F.col("source").rlike("^(/|[a-z][a-z0-9+.-]*:)"), F.col("source")).otherwise(F.concat(folder, F.lit("/"), F.regexp_replace("source", r"^(\./)+", "")))
    return cases.withColumn("reason", reason).withColumn("source", whole)


def resume_records(lines: DataFrame, order: str, text: str = "value") -> DataFrame:
    """(case_id, record, line, bad): the last line of each case, and the lines that
    are not JSON objects with a case."""
    rows = lines.where(F.trim(text) != "").select(F.col(order).alias("line"), F.col(text).alias("record"), F.get_json_object(text, "$.case_id").alias("case_id"))
    bad = rows.where("case_id is null").select("case_id", "record", "line", F.lit(True).alias("bad"))
    last = rows.where("case_id is not null").groupBy("case_id").agg(F.max_by("record", "line").alias("record"), F.max("line").alias("line"))
    return last.withColumn("bad", F.lit(False)).unionByName(bad)


def tool_names(lines: DataFrame, pattern: str, text: str = "value") -> DataFrame:
    """The distinct first groups of ``pattern`` over the lines of a listing."""
    each = lines.select(F.explode(F.split(text, "\n")).alias("line"))
    return each.select(F.regexp_extract("line", pattern, 1).alias("name")).where("name <> ''").distinct()


def progress(lines: DataFrame, duration: float, text: str = "value") -> DataFrame:
    """(kind, percent, elapsed, speed, frame) of encoder lines: those with ``time=`` or
    ``speed=`` tell progress, as far as their numbers can be read; others are ``log`` lines."""
    tells = F.col(text).contains("time=") | F.col(text).contains("speed=")
    at = F.when(tells, X.parse_clock(F.regexp_extract(text, r"time=(\d+:\d+:\d+(?:\.\d+)?)", 1)))
    speed = F.when(tells, F.nullif(F.regexp_extract(text, r"speed=\s*([0-9.]+x)", 1), F.lit("")))
    frame = F.when(tells, F.nullif(F.regexp_extract(text, r"frame=\s*(\d+)", 1), F.lit("")).try_cast("long"))
    percent = F.when(at.isNotNull(), X.clamp(at / duration * 100, 0.0, 100.0)) if duration and duration > 0 else F.lit(None).cast("double")
    return lines.select(text, F.when(tells, "progress").otherwise("log").alias("kind"), percent.alias("percent"), at.alias("elapsed"), X.parse_speed(speed).alias("speed"), frame.alias("frame"))


def first_found(candidates: DataFrame, key: str, priority: str, value: str, usable: Column) -> DataFrame:
    """Of each key the usable value of best priority."""
    return candidates.where(usable).groupBy(key).agg(F.min_by(value, F.struct(priority, value)).alias(value))


def pinned_assets(assets: DataFrame) -> DataFrame:
    """Assets with a ``reason`` where digest, commit or address is missing or not
    pinned."""
    fixed = {"sha256": "^[0-9a-f]{64}$", "commit": "^[0-9a-f]{40}$", "url": "^https://"}
    checks = [(~F.coalesce(F.col(name).rlike(pattern), F.lit(False)), name) for name, pattern in fixed.items()]
    return assets.withColumn("reason", first_reason(checks))


def archive_members(spark: SparkSession, folder: str, wanted: Sequence[str]) -> DataFrame:
    """(archive, name, size, sha256) of the wanted members of zip and tar archives,
    the first of each name; archives spread over tasks, members stay there."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    names = set(wanted)

    def run(batches: Iterator) -> Iterator:
        import hashlib
        import io
        import tarfile
        import zipfile

        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                seen = set()
                if zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members = [(m.filename, lambda m=m: z.read(m)) for m in z.infolist() if not m.is_dir()]
                        rows += [(path, n, data) for n, read in members if (b := n.rpartition("/")[2]) in names and b not in seen and not seen.add(b) and (data := read()) is not None]
                else:
                    with tarfile.open(fileobj=io.BytesIO(content)) as z:
                        for m in z:
                            b = m.name.rpartition("/")[2]
                            if m.isfile() and b in names and b not in seen:
                                seen.add(b)
                                rows.append((path, m.name, z.extractfile(m).read()))
            yield pd.DataFrame([(p, n.rpartition("/")[2], len(d), hashlib.sha256(d).hexdigest()) for p, n, d in rows], columns=["archive", "name", "size", "sha256"])

    return files.mapInPandas(run, "archive string, name string, size long, sha256 string")


def missing_files(source: DataFrame, target: DataFrame) -> DataFrame:
    """Relative paths of ``source`` that ``target`` lacks."""
    return source.select("rel").join(target.select("rel"), "rel", "left_anti")
