"""A table that grows by batches, of which each is there once, whole or not at all.

A batch is a folder of Parquet files in ranges of the key, with a Bloom filter of the key a
file.  It counts once an entry of its number is created in the log, which only one attempt
can do; the folder of an attempt that comes second is deleted, so a repeated batch adds
nothing.  Readers take what the log names and so never see half a batch.  Of rows of one key
those of the latest batch count, where all of a key's rows of one batch count together."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Most keys whose look-up is pushed down to the files' statistics and Bloom filters.
FEW = 200
#: Most rows of a file.
ROWS = 2_000_000


class BatchLog:
    """The batches under ``folder``, with rows told apart by ``key``, a text column."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        path = self._fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entries(self) -> dict[str, dict]:
        path, files = self._path("log")
        if not files.exists(path):
            return {}
        rows = self.spark.read.option("wholetext", True).text(f"{self.folder}/log").select(F.col("_metadata.file_name"), "value")
        return {name: json.loads(text) for name, text in rows.collect() if text.endswith("}")}

    def _live(self) -> tuple[str | None, list[str]]:
        """The log's latest summary and the entries after it, in order."""
        names = sorted(self._entries())
        last = max((n for n in names if n.endswith("-all")), default=None)
        return last, [n for n in names if not n.endswith("-all") and (last is None or n > last)]

    def _write(self, rows: DataFrame, entry: str) -> bool:
        data = f"data/{uuid.uuid4().hex}"
        rows.repartitionByRange(self.key).sortWithinPartitions(self.key).write.option("compression", "zstd").option("maxRecordsPerFile", ROWS).option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.folder}/{data}")
        path, files = self._path(f"log/{entry}")
        try:
            out = files.create(path, False)
        except Exception:
            if not files.exists(path):
                raise
            if entry in self._entries():
                self._drop(data)
                return False
            out = files.create(path, True)  # of an attempt that was lost before it could say what it wrote
        out.write(json.dumps({"data": data, "schema": rows.schema.jsonValue()}).encode())
        out.close()
        return True

    def _drop(self, name: str) -> None:
        path, files = self._path(name)
        files.delete(path, True)

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Add ``rows`` as batch number ``batch``; False if that one is there already, or in
        what was compacted."""
        entry = f"{batch:012d}"
        last, names = self._live()
        if entry in names or last is not None and entry <= last[:12]:
            return False
        return self._write(rows.withColumn("__batch", F.lit(batch).cast("long")), entry)

    def rows(self, keys: DataFrame | None = None) -> DataFrame:
        """The latest rows of each key, with ``__batch``; of ``keys`` (a column of the
        key's name) if given.  Up to ``FEW`` keys are pushed down to the files; more meet
        the table by a join.  A null key is a key, but never looked up."""
        last, names = self._live()
        entries = self._entries()
        found = [entries[n] for n in ([last] if last else []) + names]
        if not found:
            raise FileNotFoundError(f"no batch in {self.folder}")
        schema = StructType.fromJson(found[-1]["schema"])
        held = self.spark.read.schema(schema).parquet(*(f"{self.folder}/{e['data']}" for e in found))
        if keys is not None:
            wanted = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
            few = [r[0] for r in wanted.limit(FEW + 1).collect()]
            if len(few) <= FEW:
                held = held.where(reduce(lambda a, b: a | b, (F.col(self.key) == k for k in few), F.lit(False)))
            else:
                held = held.join(wanted, self.key, "left_semi")
        newest = held.groupBy(F.col(self.key).alias("__k")).agg(F.max("__batch").alias("__newest"))
        same = F.col(self.key).eqNullSafe(F.col("__k")) & (F.col("__batch") == F.col("__newest"))
        return held.join(newest, same, "left_semi")

    def compact(self) -> None:
        """One summary of all batches so far.  What it replaces goes at the compaction after
        it, so that a reader under way keeps its files."""
        before, names = self._live()
        if not names:
            return
        entries = self._entries()
        if self._write(self.rows(), f"{names[-1]}-all"):
            for old in entries:
                if before is not None and old < before:
                    self._drop(f"log/{old}")
                    self._drop(entries[old]["data"])
