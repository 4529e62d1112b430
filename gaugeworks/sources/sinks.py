"""Writers: receipts, result lines, summaries, key=value outputs, accepted outputs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, MapType, StringType, StructField, StructType

from gaugeworks.functions.expr import classify_line, file_name, parent, stem, suffix
from gaugeworks.sources.batches import BatchLog

RECEIPT = "fingerprint string, schema_version int, source string, windows array<struct<pool:string,start:double,size:double>>, candidates array<struct<rate:long,minimum:double,scores:array<double>>>"


def canonical(column: Column, kind: DataType) -> Column:
    """A value whose names are in order on every level: structs by field, maps by key."""
    if isinstance(kind, StructType):
        inner = F.struct(*(canonical(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
        return F.when(column.isNotNull(), inner)
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, MapType):
        turned = F.transform_values(column, lambda _, v: canonical(v, kind.valueType))
        return F.map_from_entries(F.array_sort(F.map_entries(turned), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return column


def fingerprint(columns: Sequence[str], schema: StructType | None = None) -> Column:
    """SHA-256 of a row's fields in name order, nulls kept.  With the row's
    ``schema`` the names inside its fields are put in order too: equal records have equal
    keys, however they are nested."""
    fields = [canonical(F.col(c), schema[c].dataType).alias(c) if schema else F.col(c) for c in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


FINGERPRINT = r"[0-9a-f]{64}"


def finite(df: DataFrame) -> Column:
    """whether no number anywhere in a row, in arrays, structs and maps too, is NaN
    or infinite."""

    def check(column: Column, kind: DataType) -> Column | None:
        if isinstance(kind, (DoubleType, FloatType)):
            return F.coalesce(~F.isnan(column) & (F.abs(column) < float("inf")), F.lit(True))
        if isinstance(kind, StructType):
            parts = [c for f in kind.fields if (c := check(column[f.name], f.dataType)) is not None]
            return reduce(lambda a, b: a & b, parts) if parts else None
        if isinstance(kind, ArrayType):
            inner = check(F.lit(None).cast(kind.elementType), kind.elementType)
            return None if inner is None else F.coalesce(F.forall(column, lambda x: check(x, kind.elementType)), F.lit(True))
        if isinstance(kind, MapType):
            return check(F.map_values(column), ArrayType(kind.valueType))
        return None

    found = [c for f in df.schema.fields if (c := check(F.col(f"`{f.name}`"), f.dataType)) is not None]
    return reduce(lambda a, b: a & b, found) if found else F.lit(True)


def checked_receipts(receipts: DataFrame) -> DataFrame:
    """Receipts with fields in name order on every level; one that is not fit is an error."""
    good = F.coalesce(F.col("fingerprint").rlike(f"^{FINGERPRINT}$"), F.lit(False)) & finite(receipts)
    checked = receipts.withColumn("fingerprint", F.when(good, F.col("fingerprint")).otherwise(F.raise_error(F.lit("not a valid receipt"))))
    return checked.select(*(canonical(F.col(f"`{c}`"), receipts.schema[c].dataType).alias(c) for c in sorted(receipts.columns)))


def save_receipts(receipts: DataFrame, folder: str) -> None:
    """K1: one partition a fingerprint, replaced as a whole; other receipts stay.  A
    receipt with a malformed fingerprint or a number that is not finite fails the write
    before anything is replaced.  Fields are written in name order on every level."""
    checked_receipts(receipts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint").json(folder)


def valid_receipt(version: int = 5) -> Column:
    """Whether a receipt is consistent: key and version, sane windows that
    don't overlap, one finite score a search window in 0..100, minima that agree."""
    near = lambda a, b: F.abs(a - b) <= 1e-9
    search = F.filter("windows", lambda w: w.pool == "search")
    apart = F.forall("windows", lambda a: F.size(F.filter("windows", lambda b: (a.start < b.start + b["size"] - 1e-9) & (b.start < a.start + a["size"] - 1e-9))) == 1)
    sane = F.forall("windows", lambda w: (w.start >= 0) & (w["size"] > 0))
    scored = F.forall("candidates", lambda c: (F.size(c.scores) == F.size(search)) & near(c.minimum, F.array_min(c.scores)) & F.forall(c.scores, lambda s: (s >= 0) & (s <= 100)) & (c.rate > 0))
    good = F.col("fingerprint").rlike("^[0-9a-f]{64}$") & (F.col("schema_version") == version) & (F.size("windows") > 0) & sane & apart & scored
    return F.coalesce(good, F.lit(False))


def load_receipts(spark: SparkSession, folder: str, keys: DataFrame | None = None) -> DataFrame:
    """The consistent receipts, of ``keys`` (fingerprint) if given; text that does not
    parse or agree loads as nothing."""
    body = RECEIPT.split(", ", 1)[1]
    rows = spark.read.schema(f"{body}, fingerprint string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    rows = rows.where("_corrupt is null").where(valid_receipt()).drop("_corrupt")
    return rows if keys is None else rows.join(keys, "fingerprint", "left_semi")


def log_receipts(receipts: DataFrame, folder: str, batch: int) -> bool:
    """K1 for very many receipts: one batch of a log, in few files, instead of a folder a
    fingerprint.  Unfit receipts fail the batch; a batch that is there adds nothing."""
    return BatchLog(receipts.sparkSession, folder, "fingerprint").append(checked_receipts(receipts), batch)


def logged_receipts(spark: SparkSession, folder: str, keys: DataFrame | None = None) -> DataFrame:
    """The latest consistent receipts of a log, of ``keys`` (fingerprint) if given."""
    return BatchLog(spark, folder, "fingerprint").rows(keys).where(valid_receipt()).drop("__batch")


def reuse(wanted: DataFrame, exact: DataFrame, measured: DataFrame) -> DataFrame:
    """C4: where each wanted (decision, measurement) pair's result comes from: an exact
    decision, a measurement to decide again on, or nothing yet."""
    a = exact.select("decision", F.lit(True).alias("__a")).distinct()
    b = measured.select("measurement", F.lit(True).alias("__b")).distinct()
    source = F.when(F.col("__a"), "decision").when(F.col("__b"), "measurement").otherwise("measure")
    return wanted.join(a, "decision", "left").join(b, "measurement", "left").withColumn("source", source).drop("__a", "__b")


def same_identity(now: Mapping[str, Column], held: Mapping[str, Column]) -> Column:
    """Whether all parts of an identity are the same, nulls too."""
    out = F.lit(True)
    for name, value in now.items():
        out = out & value.eqNullSafe(held[name])
    return out


def append_lines(rows: DataFrame, folder: str) -> None:
    """K3: append rows as JSON lines."""
    rows.write.mode("append").json(folder)


def write_table_text(rows: DataFrame, folder: str, columns: Mapping[str, str]) -> None:
    """K4: CSV of fixed columns, nested ones flattened by expressions."""
    rows.select(*(F.expr(path).alias(name) for name, path in columns.items())).write.mode("overwrite").option("header", True).csv(folder)


def summary_text(row: DataFrame) -> DataFrame:
    """One JSON text with the fields in name order, nulls kept."""
    return row.select(F.to_json(F.struct(*sorted(row.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_summary(row: DataFrame, path: str) -> None:
    """K5: the JSON text of a one-row summary as one file, renamed into place when it is
    whole.  The row is an aggregate: it alone passes through the driver."""
    spark = row.sparkSession
    (text,) = (r.value for r in summary_text(row.limit(1)).collect())
    hadoop = spark._jvm.org.apache.hadoop.fs
    to, part = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(part, False)
    out.write((text + "\n").encode())
    out.close()
    files.delete(to, False)
    if not files.rename(part, to):
        raise OSError(f"cannot rename to {path}")


def output_lines(row: DataFrame) -> DataFrame:
    """``name=value`` lines of one row, with ``%`` and line ends escaped and lists as
    compact JSON."""
    pairs = []
    for f in row.schema.fields:
        value = F.to_json(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name).cast("string")
        escaped = F.replace(F.replace(F.replace(value, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
        pairs.append(F.concat(F.lit(f.name + "="), F.coalesce(escaped, F.lit(""))))
    return row.select(F.explode(F.array(*pairs)).alias("value"))


def publish_split(outputs: DataFrame, limit: str, size: str, path: str) -> DataFrame:
    """K6: where each output goes: its own path if small enough, else beside it under its
    name with ``size-miss`` and eight hex digits before the suffix.  An own path that exists by now (``target_exists``, if
    such a column is there) is refused: ``to`` is null."""
    token = F.substring(F.sha2(F.concat_ws("|", path, F.col(size).cast("string")), 256), 1, 8)
    fits = F.col(limit).isNull() | (F.col(size) <= F.col(limit))
    free = ~F.coalesce(F.col("target_exists"), F.lit(False)) if "target_exists" in outputs.columns else F.lit(True)
    own = F.when(free, F.col(path))
    folder = F.substr(F.col(path), F.lit(1), F.length(path) - F.length(file_name(F.col(path))))
    missed = F.concat(folder, stem(F.col(path)), F.lit(".size-miss-"), token, suffix(F.col(path)))
    return outputs.withColumn("accepted", fits & free).withColumn("to", F.when(fits, own).otherwise(missed))


def copy_reasons(skipped: DataFrame) -> DataFrame:
    """Whether a skipped source can be copied, and why not, the first reason that
    holds: it is missing, its target exists and may not be overwritten, or is the source."""
    reason = F.when(~F.col("source_exists"), "source is missing").when(F.col("target_exists") & ~F.col("overwrite"), "output exists").when(F.col("source") == F.col("target"), "source and output are the same file")
    return skipped.withColumn("reason", reason).withColumn("copied", F.col("reason").isNull())


def eligible_skips(rows: DataFrame) -> Column:
    """Skipped, with no decision pending and no reason from planning, and there."""
    return F.col("skipped") & ~F.col("needs_decision") & (F.coalesce(F.col("skip_reason"), F.lit("")) == "") & F.col("source_exists")


def plan_reason(two_pass: Column, supports_two_pass: Column) -> Column:
    """Why a planned row is not valid, else null."""
    reason = F.when(F.col("source") == F.col("target"), "output is the source").when(F.col("target_exists") & ~F.col("overwrite"), "output exists")
    return reason.when(two_pass & ~supports_two_pass, "two passes are not supported")


def sidecar_targets(pairs: DataFrame) -> DataFrame:
    """K8: (source, sidecar, target) with the sidecar's new path ``to``: what follows the
    source's stem in its name follows the target's, or else its suffix does."""
    name, stem_, at = file_name(F.col("sidecar")), stem(F.col("source")), stem(F.col("target"))
    rest = F.when(name.startswith(stem_), F.nullif(F.substr(name, F.length(stem_) + 1), F.lit("")))
    return pairs.withColumn("to", F.concat(parent(F.col("target")), F.lit("/"), at, F.coalesce(rest, suffix(F.col("sidecar")))))


def _place(uri: str):
    """pyarrow filesystem and path of a URI, usable in a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def copy_files(rows: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """K7, K8: copy each file from ``source`` to ``target`` in the tasks, by blocks and
    renamed into place, and return the rows with ``copied`` and ``reason``: null, or why
    it was refused or failed.  Folders of targets are made.  A target that exists is
    replaced only if ``overwrite`` is true (or there is no such column)."""
    kept = [f for f in rows.schema.fields if f.name not in ("copied", "reason")]
    schema = StructType([*kept, StructField("copied", BooleanType()), StructField("reason", StringType())])
    may = F.coalesce(F.col("overwrite"), F.lit(False)) if "overwrite" in rows.columns else F.lit(True)
    asked = rows.select(*(f"`{f.name}`" for f in kept), F.col(source).alias("__from"), F.col(target).alias("__to"), may.alias("__may"))

    def one(came: str, to: str, may_replace: bool) -> str | None:
        from pyarrow import fs

        if came is None or to is None:
            return "no path"
        if came == to:
            return "source and output are the same file"
        (files, path), (others, goal) = _place(came), _place(to)
        if files.get_file_info(path).type != fs.FileType.File:
            return "source is missing"
        if not may_replace and others.get_file_info(goal).type != fs.FileType.NotFound:
            return "output exists"
        others.create_dir(goal.rpartition("/")[0], recursive=True)
        part = f"{goal}.{uuid.uuid4().hex}.tmp"
        with files.open_input_stream(path) as read, others.open_output_stream(part) as write:
            while block := read.read(8 << 20):
                write.write(block)
        others.move(part, goal)
        return None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            why = []
            for came, to, may_replace in zip(*(batch.column(len(kept) + k).to_pylist() for k in range(3)), strict=True):
                try:
                    why.append(one(came, to, may_replace))
                except OSError as e:
                    why.append(str(e))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array([w is None for w in why]), pa.array(why, pa.string())], names=schema.names)

    return asked.mapInArrow(run, schema)


def settle_preserved(rows: DataFrame, action: str = "action") -> DataFrame:
    """Outputs that were kept aside (``rejected``) are accepted, moved to ``output``, or
    discarded, deleted, and the result rows (success, skipped, needs_decision, rejected) say
    so; ``reason`` tells why a row stays as it is: nothing is kept aside or to be decided, the
    planned output (``planned``) is another one, the action is unknown or storage failed.
    A move that an earlier attempt of the task made counts as made."""
    made = ("success", "skipped", "needs_decision", "rejected", "reason")
    kept = [f for f in rows.schema.fields if f.name not in made]
    schema = StructType([*kept, *(StructField(n, StringType() if n in ("rejected", "reason") else BooleanType()) for n in made)])
    act = F.col(action)
    reason = F.when(~F.coalesce(F.col("needs_decision"), F.lit(False)) | F.col("rejected").isNull(), "nothing kept aside").when(~F.col("output").eqNullSafe(F.col("planned")), "another output").when(~F.coalesce(act.isin("accept", "discard"), F.lit(False)), "unknown action")
    asked = rows.withColumn("reason", reason).select(*(f"`{f.name}`" for f in kept), *made, act.alias("__act"), F.col("output").alias("__to"))

    def one(act_: str, came: str, to: str) -> str | None:
        from pyarrow import fs

        files, path = _place(came)
        there = files.get_file_info(path).type == fs.FileType.File
        if act_ == "discard":
            if there:
                files.delete_file(path)
            return None
        goal = _place(to)[1]
        if there:
            files.move(path, goal)
        elif files.get_file_info(goal).type != fs.FileType.File:
            return "the preserved output is missing"
        return None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n = len(kept)
        for batch in batches:
            columns = [batch.column(n + k).to_pylist() for k in range(len(made) + 2)]
            out = []
            for success, skipped, needs, rejected, why, act_, to in zip(*columns, strict=True):
                if why is None:
                    try:
                        why = one(act_, rejected, to)
                    except OSError as e:
                        why = str(e)
                    if why is None:
                        success, skipped, needs, rejected = act_ == "accept", act_ == "discard", False, None
                out.append((success, skipped, needs, rejected, why))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), *(pa.array([r[k] for r in out], pa.string() if k > 2 else pa.bool_()) for k in range(5))], names=schema.names)

    return asked.mapInArrow(run, schema)


def delete_receipts(spark: SparkSession, folder: str, fingerprint: str) -> bool:
    """K2: delete one receipt; whether there was one.  What is not 64 hex digits names no
    receipt and is an error."""
    if not re.fullmatch(FINGERPRINT, fingerprint or ""):
        raise ValueError(f"not a fingerprint: {fingerprint!r}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/fingerprint={fingerprint}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_receipts(spark: SparkSession, folder: str) -> int:
    """K2: delete all receipts of a folder, and nothing else there; how many there were."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return 0
    found = [s.getPath() for s in files.listStatus(path) if re.fullmatch(f"fingerprint={FINGERPRINT}", s.getPath().getName())]
    return sum(files.delete(p, True) for p in found)


# The fields of a measurement's key, and those of a decision's key.
MEASURED_BY = [
    "source", "ffmpeg", "codec", "encoder", "backend", "preset",
    "pix_fmt", "two_pass", "maxrate_factor", "bufsize_factor", "sample_scheme_version", "whole_video_max_sec",
    "scout_duration_sec", "scout_multiplier", "scout_max_windows", "sample_duration_sec", "sample_count_under_10m", "sample_count_10_to_60m",
    "sample_count_60_to_180m", "sample_count_over_180m", "holdout_window_count", "holdout_window_count_over_180m", "search_min_windows", "search_max_windows",
    "holdout_target_min", "holdout_target_max", "reserve_window_count", "max_refinement_rounds", "source_width", "source_height",
    "source_fps", "source_pix_fmt", "source_bit_depth", "candidate_encode_width", "candidate_encode_height", "candidate_encode_bit_depth",
    "vmaf_generation", "vmaf_resolution_mode", "viewing_context", "vmaf_pooling", "temporal_drop_tolerance", "risk_vector_version",
    "adaptive_planner_version", "size_prediction_version", "vmaf_model", "vmaf_hfr", "vmaf_display_width", "vmaf_display_height",
    "vmaf_measurement_pix_fmt", "vmaf_measurement_bit_depth", "vmaf_measurement_pipeline_version", "vmaf_scale_algorithm", "vmaf_aspect_policy", "vmaf_subsample",
    "vmaf_backend", "analysis_algorithm_version",
]
DECIDED_BY = ["measurement_fingerprint", "min_vmaf", "max_output_ratio", "audio_mode", "audio_bitrate", "min_video_kbps", "max_video_kbps", "container", "coarse_max_candidates", "exact_max_candidates", "coarse_vmaf_subsample", "exact_vmaf_subsample", "min_search_tolerance_bps", "search_tolerance_ratio", "preferred_vmaf_margin", "analysis_algorithm_version"]


def measurement_key() -> Column:
    """The key of everything that changes a measurement: the same key, the same
    measurement.  Policies are not in it."""
    return fingerprint(MEASURED_BY)


def decision_key() -> Column:
    """The measurement's key (``measurement_fingerprint``) and the policies, so that a
    changed policy finds the same measurement."""
    return fingerprint(DECIDED_BY)


def receipt_rows(measured: DataFrame, version: int = 5) -> DataFrame:
    """A receipt a row of ``measured`` (source, measurement fields, search, holdout
    and reserve windows as arrays of ``start, size``, candidates), as ``save_receipts``
    writes it."""
    pools = [_pool(pool) for pool in ("search", "holdout", "reserve")]
    return measured.select(
        measurement_key().alias("fingerprint"),
        F.lit(version).alias("schema_version"),
        F.col("source").cast("string").alias("source"),
        F.concat(*pools).alias("windows"),
        F.transform("candidates", lambda c: F.struct(c["rate"].alias("rate"), F.array_min(c["scores"]).alias("minimum"), c["scores"].alias("scores"))).alias("candidates"),
    )


def _pool(pool: str) -> Column:
    empty = F.array().cast("array<struct<start:double,size:double>>")
    return F.transform(F.coalesce(F.col(pool), empty), lambda w: F.struct(F.lit(pool).alias("pool"), w["start"].cast("double").alias("start"), w["size"].cast("double").alias("size")))


def export_lines(lines: DataFrame, folder: str, text: str = "value", kind: str | None = None) -> None:
    """K9: the log lines of a kind (or all) as text."""
    rows = lines if kind is None else lines.where(classify_line(F.col(text)) == kind)
    rows.select(F.col(text).alias("value")).write.mode("overwrite").text(folder)
