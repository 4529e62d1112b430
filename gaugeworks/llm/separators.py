"""Operator 3: token counts of documents in flat token files without an index.

The files hold ids only, documents closed by an end-of-document id.  They are read
in byte blocks that know nothing of documents; each block is searched for the end
id in one vectorised pass.  A running sum over a file's blocks (a few numbers a
block) carries the ordinal of the first document and the ids left open by the
blocks before, which stitches documents that cross blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from gaugeworks.llm.arrowtext import column_bytes, pieces
from gaugeworks.llm.bpe import PIECE
from gaugeworks.llm.byte_tokens import tokens_of
from gaugeworks.llm.cluster import fields, filesystem, new_folder, put, ready, written

FILE_BYTES = 64 << 20
BLOCK_BYTES = 2 << 20


def write_flat_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, str]:
    """Encode each text where it lies (no shuffle) and append ids and ``end_id`` to
    the task's flat files.  Returns which document stands at which place of which
    file, (file, ordinal, key), and the folder.

    A null text counts as empty.  Strings of special tokens are ordinary text, so
    the end id never stands inside a document.  Every attempt of a task has file names
    of its own, and only those of the attempt that counts are returned.
    """
    spark = ready(docs.sparkSession)
    folder = folder or new_folder(spark, "flat-tokens")
    rows = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    kind = rows.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex[:8]
        tokens = tokens_of(tokenizer_path, special_is_text=True)
        end = np.array([end_id], tokens.type).tobytes()
        width = tokens.type.itemsize
        keys, ids, held, n = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, ids, held, n, seq
            name = f"part-{part:06d}-{seq:04d}-{attempt}.ids{8 * width}"
            put(f"{folder}/{name}", b"".join(ids))
            out = pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n)), pa.concat_arrays(keys), pa.array([held] * n, pa.int64())], names=["file", "ordinal", "key", "n_bytes"])
            keys, ids, held, n, seq = [], [], 0, 0, seq + 1
            return out

        for batch in batches:
            _, at = column_bytes(batch.column(1))
            for i, j in pieces(at, PIECE):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                keys.append(batch.column(0).slice(i, j - i))
                n += j - i
                for found in tokens.encode_texts(texts):
                    ids += [found, end]
                    held += len(found) + width
                if held >= FILE_BYTES:
                    yield flush()
        if keys:
            yield flush()

    placed = rows.mapInArrow(run, fields(file=StringType(), ordinal=LongType(), key=kind, n_bytes=LongType()))
    return written(placed, "flat-places"), folder


def scan_flat_files(spark: SparkSession, files: DataFrame, folder: str, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the flat ``files`` (file,
    n_bytes); the end id is not counted.  Ids after a file's last end id belong to
    no document.  A file's name ends in the bits of its ids; blocks are whole ids
    (a multiple of four bytes, or of two for 16-bit files)."""
    ready(spark)
    blocks = files.select("file", "n_bytes", F.explode(F.sequence(F.lit(0), F.col("n_bytes") - 1, F.lit(block_bytes))).alias("offset")).where("n_bytes > 0")
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, total, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, path = filesystem(f"{folder}/{name}")
                with where.open_input_file(path) as f:
                    width = int(name.rpartition(".ids")[2]) // 8
                    ids = np.frombuffer(f.read_at(min(block_bytes, total - offset), offset), f"<u{width}")
                ends = np.flatnonzero(ids == end_id)
                inner = np.diff(ends) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name], pa.string()),
                        pa.array([offset], pa.int64()),
                        pa.array([len(ends)], pa.int64()),
                        pa.array([int(ends[0]) if len(ends) else 0], pa.int64()),
                        pa.array([len(ids) - 1 - int(ends[-1]) if len(ends) else len(ids)], pa.int64()),
                        pa.array([inner.tolist()], pa.list_(pa.int64())),
                    ],
                    names=["file", "offset", "n_ends", "head", "tail", "inner"],
                )

    found = blocks.mapInArrow(run, "file string, offset long, n_ends long, head long, tail long, inner array<long>")
    before = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.withColumn("first", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    # ids left open: all tails up to here less those before the last block that closed a document
    scanned = scanned.withColumn("sum_tail", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    closed = F.when(F.col("n_ends") > 0, F.col("sum_tail"))
    scanned = scanned.withColumn("left_open", F.col("sum_tail") - F.coalesce(F.last(closed, ignorenulls=True).over(before), F.lit(0)))
    sizes = F.when(F.col("n_ends") > 0, F.concat(F.array(F.col("head") + F.col("left_open")), F.col("inner")))
    each = scanned.where("n_ends > 0").select("file", "first", F.posexplode(sizes).alias("k", "n_tokens"))
    return each.select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame, tokenizer_path: str, end_id: int, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_tokens) of every row of ``docs``, counted by writing flat token files
    and scanning them.  A null or empty text has 0 tokens; texts of any length are
    counted whole, across blocks; repeated rows are counted each; keys of any type may
    be null or repeat; other columns are not read; an empty table gives an empty one.

    Counts and keys meet by file and ordinal in a shuffle of these few numbers: as many
    rows as documents on either side, so neither is broadcast."""
    spark = docs.sparkSession
    placed, folder = write_flat_files(docs, tokenizer_path, end_id, text=text, key=key)
    files = placed.where("ordinal = 0").select("file", "n_bytes")
    found = scan_flat_files(spark, files, folder, end_id, block_bytes).hint("merge")
    return placed.select("file", "ordinal", "key").join(found, ["file", "ordinal"]).select(F.col("key").alias(key), "n_tokens")
