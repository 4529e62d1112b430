"""Operator 10: token ids in binary files with Elias-Fano document boundaries.

The rows are dealt out by ranges of ``doc_id``, then of a text hash and the row's place
in the input, so that even rows of one id spread over many tasks, and sorted so within
each (one shuffle of the texts, no total order in one place): a repeated task writes the
same files.  Each task encodes its texts and writes files of bounded size.  A file is::

    magic, id width in bytes, rows with a null doc_id, least doc_id, size of the codes
    Elias-Fano of doc_id - least                                        (ascending)
    Elias-Fano of the end of each document, in ids
    the ids of all documents, end ids included, little-endian

Each code carries its select directory.  A reader fetches the codes, finds boundaries
by select and reads ranges of ids, never a file as a whole.
The number of all ids before a file comes from running sums over the files' manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.arrowtext import column_bytes, pieces
from gaugeworks.llm.bpe import PIECE
from gaugeworks.llm.byte_tokens import tokens_of
from gaugeworks.llm.cluster import filesystem, new_folder, put, ready, whole_key, written
from gaugeworks.llm.eliasfano import EliasFano

MAGIC = b"TOKEF02\n"
HEAD = struct.Struct("<8sQQqQ")
FILE_BYTES = 32 << 20
#: Bytes of ids that a reader holds at a time, or one document.
READ_BYTES = 4 << 20
#: Bytes fetched when a file is opened; boundaries beyond them take one more read.
OPEN_BYTES = 64 << 10
MANIFEST = "part int, seq int, path string, least long, n_docs long, n_ids long, n_bytes long"


def packed(doc_ids: np.ndarray, n_null: int, sizes: np.ndarray, ids: bytes, width: int) -> bytes:
    """One file.  ``doc_ids`` ascend; the ``n_null`` rows without one come first."""
    least = int(doc_ids[0]) if len(doc_ids) else 0
    codes = EliasFano.of((doc_ids - least).astype(np.uint64)).tobytes() + EliasFano.of(np.cumsum(sizes)).tobytes()
    return b"".join([HEAD.pack(MAGIC, width, n_null, least, len(codes)), codes, ids])


class TokenFile:
    """A file read by ranges: the boundaries when it is opened, documents by select and
    the range of their ids.  ``read_at(size, offset)`` gives bytes."""

    def __init__(self, read_at: Callable[[int, int], bytes]):
        head = read_at(OPEN_BYTES, 0)
        magic, width, self.n_null, self.least, size = HEAD.unpack_from(head)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.begin = HEAD.size + size
        if self.begin > len(head):
            head += read_at(self.begin - len(head), len(head))
        self.docs, at = EliasFano.frombytes(head, HEAD.size)
        self.ends, _ = EliasFano.frombytes(head, at)
        self.read_at, self.type = read_at, np.dtype(f"<u{width}")

    @classmethod
    def of(cls, data: bytes) -> TokenFile:
        return cls(lambda size, offset: data[offset : offset + size])

    def __len__(self) -> int:
        return self.ends.n

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """The ids of documents ``i`` to ``j - 1``."""
        known = self.docs.select_range(max(0, i - self.n_null), max(0, j - self.n_null))
        return [None] * max(0, min(j, self.n_null) - i) + (known.astype(np.int64) + self.least).tolist()

    def places(self, doc_id: int) -> range:
        """Where the documents with this id stand."""
        value = doc_id - self.least
        if value < 0:
            return range(0)
        first = self.docs.last_at_most(value - 1) if value else 0
        return range(self.n_null + first, self.n_null + self.docs.last_at_most(value))

    def ends_from(self, i: int, j: int) -> np.ndarray:
        """Where document ``i`` begins and documents ``i`` to ``j - 1`` end, in ids."""
        ends = self.ends.select_range(max(0, i - 1), j).astype(np.int64)
        return ends if i else np.concatenate([[0], ends])

    def ids(self, a: int, b: int) -> np.ndarray:
        width = self.type.itemsize
        return np.frombuffer(self.read_at((b - a) * width, self.begin + a * width), self.type)

    def document(self, i: int) -> np.ndarray:
        a, b = self.ends_from(i, i + 1).tolist()
        return self.ids(a, b)

    def runs(self, most: int) -> Iterator[tuple[int, int]]:
        """Runs of documents of about ``most`` bytes, found by select."""
        i, most = 0, max(1, most // self.type.itemsize)
        while i < len(self):
            base = self.ends.select(i - 1) if i else 0
            j = max(i + 1, self.ends.last_at_most(base + most))
            yield i, j
            i = j


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the files and return their manifest, one row a file.

    A null text counts as empty and has the end id alone.  Long texts are encoded whole.
    Rows with a null key come first.  Rows with equal keys stand together, by the hash of
    their texts; repeated rows are written each.  Keys must be integers.  Other columns
    are not read.  An empty table writes nothing.
    """
    spark = ready(docs.sparkSession)
    folder = folder or new_folder(spark, "token-files")
    rows = docs.select(whole_key(docs, key).alias("key"), docs[f"`{text}`"].alias("text"))
    order = ["key", "hash", "place"]
    rows = rows.select("key", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex[:8]
        tokens = tokens_of(tokenizer_path)
        width = tokens.type.itemsize
        end = np.array([end_id], tokens.type).tobytes()
        keys, nulls, sizes, ids, held = [], 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, nulls, sizes, ids, held, seq
            doc_ids = np.array(keys, np.int64)
            uri = f"{folder}/part-{part:06d}-{seq:04d}-{attempt}.tok"
            n_bytes = put(uri, packed(doc_ids, nulls, np.array(sizes), b"".join(ids), width))
            least = int(doc_ids[0]) if not nulls else None
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": uri, "least": least, "n_docs": len(sizes), "n_ids": held // width, "n_bytes": n_bytes}], schema=manifest)
            keys, nulls, sizes, ids, held, seq = [], 0, [], [], 0, seq + 1
            return row

        manifest = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("least", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
        for batch in batches:
            _, at = column_bytes(batch.column(1))
            for i, j in pieces(at, PIECE):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                for k, found in zip(batch.column(0).slice(i, j - i).to_pylist(), tokens.encode_texts(texts), strict=True):
                    keys += [] if k is None else [k]
                    nulls += k is None
                    ids += [found, end]
                    sizes.append(len(found) // width + 1)
                    held += len(found) + width
                if held >= FILE_BYTES:
                    yield flush()
        if sizes:
            yield flush()

    return written(dealt.mapInArrow(run, MANIFEST), "token-manifest")


def numbered(manifest: DataFrame) -> DataFrame:
    """(path, base): the ids of all files before each.  Parts are ranges in order, so a
    part's files are summed by themselves and only one row a part is summed in one place."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(offsets, "part").select("path", (F.col("offset") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base"))


def read_token_files(spark: SparkSession, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document, from the files: ``doc_id``, ``start`` (ids of all
    documents before it), ``n_tokens``, ``ids_crc32``.  A task holds a file's boundaries
    and ``READ_BYTES`` of its ids."""
    spark = ready(spark)
    files = numbered(manifest).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, name = filesystem(path)
                with where.open_input_file(name) as f:
                    file = TokenFile(f.read_at)
                    for i, j in file.runs(READ_BYTES):
                        ends = file.ends_from(i, j)
                        ids, cut = file.ids(int(ends[0]), int(ends[-1])), (ends - ends[0]).tolist()
                        crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(cut, cut[1:])]
                        yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids(i, j), pa.int64()), pa.array(ends[:-1] + base), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")
