"""What operators need from the session: a shared folder, file access from
tasks, bounded Arrow batches and an importable package on the workers."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructField, StructType

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])

#: Rows and bytes of one Arrow batch: what a Python worker holds at a time.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
#: A key is hot above so many rows and above this share of all; that bounds the hot ones.
HOT_ROWS = 1000
HOT_KEYS = 50_000


def ready(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and let the Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, paths)])
        # workers give large freed arrays back instead of keeping them for later tasks
        env.setdefault("MALLOC_MMAP_THRESHOLD_", str(8 << 20))
        env.setdefault("MALLOC_TRIM_THRESHOLD_", str(64 << 20))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see.  Only where the cluster names none (as in
    tests on one machine) is a temporary one made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        found = posixpath.dirname(held) if held else "file://" + tempfile.mkdtemp(prefix="gaugeworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared one, for files that tasks write."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage
    ends there, and lost executors cost nothing that was written."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that no later result reads."""
    for df in tables:
        path = getattr(df, "written_to", None)
        if path:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def carried(docs: DataFrame, made: StructType, text: str) -> tuple[DataFrame, StructType, int]:
    """What a map over ``docs`` reads and returns: the columns that no made one replaces
    (names are compared without case, as Spark does) and the text as the last one; the
    schema of those columns and the made ones; how many columns are kept."""
    names = [f.name.lower() for f in docs.schema.fields]
    taken = {f.name.lower() for f in made.fields}
    kept = [k for k, n in enumerate(names) if n not in taken]
    own = docs.toDF(*(f"c{k}" for k in range(len(names))))
    at = docs.columns.index(text) if text in docs.columns else names.index(text.lower())
    source = own.select(*(f"c{k}" for k in kept), F.col(f"c{at}").alias("t"))
    return source, StructType([*(docs.schema.fields[k] for k in kept), *made.fields]), len(kept)


def fields(**types: object) -> StructType:
    return StructType([StructField(name, kind) for name, kind in types.items()])


def whole_key(docs: DataFrame, key: str):
    """The key column as a long.  Keys are integers (or all null); others are refused
    before any work, as their order and their place in files are not defined."""
    kind = docs.select(docs[f"`{key}`"]).schema[0].dataType
    if not isinstance(kind, IntegralType) and kind.typeName() != "void":
        raise ValueError(f"{key} is {kind.simpleString()}; integers are needed")
    return docs[f"`{key}`"].cast("long")


def join_with_hot(rows: DataFrame, named: DataFrame, key: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``named`` (one row a key, ``weight`` rows of ``rows`` each, of
    ``total`` in all), where a few keys may hold most rows.  Keys above a ``HOT_KEYS``-th of
    ``total`` are fewer than ``HOT_KEYS``, whatever the input: those are broadcast and
    their rows stay where they are; the others meet by a shuffle."""
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot, rest = named.where(F.col(weight) > least), named.where(F.col(weight) <= least)
    marked = F.broadcast(hot.select(*key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(marked, key, "left_anti").join(rest, key))


def filesystem(uri: str):
    """pyarrow filesystem and path of a URI, usable in a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def put(uri: str, payload) -> int:
    """Write a whole file under its final name in one rename, so that a repeated
    task attempt replaces the file by the same content."""
    where, path = filesystem(uri)
    where.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(part) as out:
        out.write(payload)
    where.move(part, path)
    return len(payload)


