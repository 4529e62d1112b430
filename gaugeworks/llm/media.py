"""Operator 6: media columns over archive directories.

Texts (or any payloads) are stored as 8-bit grey images in zip archives, a few
bounded archives a task.  The data source ``media-archives`` plans byte ranges over
the archives of a directory: a partition reads an archive's member directory, takes
the members that begin in its range and streams them in Arrow batches.  A member
that can't be read is tried again alone, at its own offset; the others go on, and a
member that stays unreadable becomes a row with its error.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType

from gaugeworks.llm.arrowtext import column_bytes
from gaugeworks.llm.cluster import fields, filesystem, new_folder, put, ready, written

ROW = 192
ARCHIVE_BYTES = 16 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 8 << 20
TRIES = 4
MEMBERS = "archive string, offset long, name string, media binary, error string"


def padded(raw: bytes) -> bytes:
    """``raw`` and blanks up to a positive multiple of a row of samples."""
    return raw + b" " * (-len(raw) % ROW or ROW * (not raw))


def as_image(payload: bytes, n_bytes: int, level: int = 6) -> bytes:
    """A grey 8-bit PNG of rows of 192 samples; a text chunk keeps ``n_bytes``."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)  # filter byte 0 before each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + chunk(b"IDAT", zlib.compress(rows, level)) + chunk(b"IEND", b"")


def from_image(media: bytes) -> tuple[bytes, int]:
    """The samples of such an image and its ``n_bytes``."""
    at, packed, n_bytes, width = 8, [], 0, ROW
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged image")
        if kind == b"IHDR":
            (width,) = struct.unpack_from(">I", data)
        elif kind == b"tEXt" and data.startswith(b"n_bytes\0"):
            n_bytes = int(data[8:])
        elif kind == b"IDAT":
            packed.append(data)
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    if not len(rows):
        raise ValueError("an image without rows")
    return rows[:, 1:].tobytes(), n_bytes


def write_archives(docs: DataFrame, folder: str | None = None, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, str]:
    """Store each text as an image in the task's archives.  Returns the manifest
    (archive, n_members, n_bytes) and the folder.  A null text counts as empty.  Every
    attempt of a task has archives of its own; the manifest names those that count."""
    spark = ready(docs.sparkSession)
    folder = folder or new_folder(spark, "media")
    rows = docs.select(docs[f"`{key}`"].cast("string").alias("key"), docs[f"`{text}`"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, members, attempt = TaskContext.get().partitionId(), 0, 0, uuid.uuid4().hex[:8]
        buffer = io.BytesIO()
        archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)

        def flush() -> pa.RecordBatch:
            nonlocal buffer, archive, members, seq
            archive.close()
            name = f"part-{part:06d}-{seq:04d}-{attempt}.zip"
            size = put(f"{folder}/{name}", buffer.getbuffer())
            out = pa.RecordBatch.from_pylist([{"archive": name, "n_members": members, "n_bytes": size}])
            buffer, members, seq = io.BytesIO(), 0, seq + 1
            archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
            return out

        for batch in batches:
            keys = batch.column(0).to_pylist()
            raw, at = column_bytes(batch.column(1))
            for i, doc in enumerate(keys):
                own = raw[at[i] : at[i + 1]].tobytes()
                entry = zipfile.ZipInfo(f"{members:08d}/{'' if doc is None else quote('k' + doc, safe='-')}.png")
                archive.writestr(entry, as_image(padded(own), len(own)))
                members += 1
                if buffer.tell() >= ARCHIVE_BYTES:
                    yield flush()
        if members:
            yield flush()

    manifest = written(rows.mapInArrow(run, "archive string, n_members long, n_bytes long"), "media-manifest")
    return manifest, folder


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, stop: int):
        super().__init__((archive, start, stop))
        self.archive, self.start, self.stop = archive, start, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.manifest = options.get("manifest")

    def partitions(self) -> list[ByteRange]:
        """Byte ranges over the archives: their names and sizes are all that is asked
        for.  With a manifest they are its archives, else all in the directory."""
        from pyarrow import dataset, fs

        where, path = filesystem(self.folder)
        if self.manifest:
            held, name = filesystem(self.manifest)
            files = [f.path for f in held.get_file_info(fs.FileSelector(name, allow_not_found=True)) if f.path.endswith(".parquet")]
            rows = dataset.dataset(files, filesystem=held, format="parquet").to_table(columns=["archive", "n_bytes"]) if files else None
            sizes = sorted((f"{path}/{a}", n) for a, n in zip(rows["archive"].to_pylist(), rows["n_bytes"].to_pylist())) if files else []
        else:
            found = where.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
            sizes = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".zip"))
        return [ByteRange(p, a, min(a + self.range_bytes, n)) for p, n in sizes for a in range(0, n, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        where, _ = filesystem(self.folder)
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("name", pa.string()), ("media", pa.binary()), ("error", pa.string())])
        with where.open_input_file(partition.archive) as f:
            members = [m for m in zipfile.ZipFile(f).infolist() if partition.start <= m.header_offset < partition.stop]
        rows, held = [], 0
        shared = where.open_input_file(partition.archive)
        for m in members:
            media, error = None, None
            for attempt in range(TRIES):
                try:
                    if attempt:  # this member alone, by a handle of its own
                        time.sleep(0.1 * 2**attempt)
                        with where.open_input_file(partition.archive) as own:
                            media = member_bytes(own, m)
                    else:
                        media = member_bytes(shared, m)
                    error = None
                    break
                except OSError:  # storage that stays away is the task's failure, not the member's
                    if attempt == TRIES - 1:
                        raise
                except (ValueError, struct.error) as e:
                    error = f"{type(e).__name__}: {e}"
            rows.append((partition.archive, m.header_offset, m.filename, media, error))
            held += len(media or b"")
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        shared.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def member_bytes(f, m: zipfile.ZipInfo) -> bytes:
    """A stored member by its offset, against its checksum."""
    head = f.read_at(30, m.header_offset)
    if head[:4] != b"PK\3\4":
        raise ValueError("no member begins here")
    name, extra = struct.unpack_from("<HH", head, 26)
    data = f.read_at(m.file_size, m.header_offset + 30 + name + extra)
    if zlib.crc32(data) != m.CRC:
        raise ValueError("checksum differs")
    return data


class ArchiveSource(DataSource):
    """``spark.read.format("media-archives").load(folder)``; options ``rangebytes`` and
    ``manifest``, a Parquet table (archive, n_bytes) of the archives that count."""

    @classmethod
    def name(cls) -> str:
        return "media-archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, manifest: DataFrame | None = None) -> DataFrame:
    """The members of the archives of ``folder``: those of ``manifest`` if given, else all."""
    ready(spark).dataSource.register(ArchiveSource)
    reader = spark.read.format("media-archives").option("rangebytes", range_bytes)
    return (reader.option("manifest", manifest.written_to) if manifest is not None else reader).load(folder)


def feature(payload: bytes) -> str:
    """Mean, standard deviation and entropy of the samples, and a 64-bit hash of
    which of 64 equal parts are brighter than the whole."""
    sample = np.frombuffer(payload, np.uint8)
    count = np.bincount(sample, minlength=256)
    share = count[count > 0] / len(sample)
    level = np.arange(256)
    mean = float((count * level).sum() / len(sample))
    spread = float(np.sqrt((count * (level - mean) ** 2).sum() / len(sample)))
    edges = np.arange(65) * len(sample) // 64
    parts = np.add.reduceat(sample, edges[:-1], dtype=np.int64) / np.diff(edges)
    bits = np.packbits(parts > mean).tobytes().hex()
    return f"mean={mean:.4f};std={spread:.4f};entropy={max(0.0, float(-(share * np.log2(share)).sum())):.4f};hash={bits}"


def media_features(members: DataFrame, key: str = "doc_id", kind="long") -> DataFrame:
    """Digests and features of the members read back, the key as ``kind``.  A damaged
    member, in its archive or inside its image, keeps its row, with nulls and its ``error``;
    one that storage doesn't give fails the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(key, pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])
        for batch in batches:
            rows = []
            for name, media, error in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                stem = unquote(name.partition("/")[2].removesuffix(".png"))
                row = {key: stem[1:] if stem else None, "error": error}
                try:
                    payload, n_bytes = (None, None) if media is None else from_image(media)
                except (ValueError, struct.error, zlib.error) as e:
                    payload, row["error"] = None, f"{type(e).__name__}: {e}"
                if payload is not None:
                    row |= {"n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(payload)}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    text, number = StringType(), LongType()
    out = fields(**{key: text, "n_bytes": number, "payload_bytes": number, "payload_sha256": text, "tail_crc32": number, "media_bytes": number, "media_sha256": text, "feature": text, "error": text})
    found = members.select("name", "media", "error").mapInArrow(run, out)
    return found.withColumn(key, F.col(f"`{key}`").cast(kind))


def media_columns(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write every text of ``docs`` to archives, read them back by the data source
    and compute the features.

    Null texts count as empty; a long text is one member, whole; null keys stay null
    and other keys keep their (atomic) type; repeated rows stay repeated; other columns
    are not read; an empty table gives an empty one."""
    manifest, folder = write_archives(docs, text=text, key=key)
    kind = docs.select(docs[f"`{key}`"]).schema[0].dataType
    return media_features(read_archives(docs.sparkSession, folder, manifest=manifest), key, kind)
