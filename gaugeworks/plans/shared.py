"""Tables between the steps of a query, in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows up to which a settled table is sent to all executors where it is joined.
BROADCAST_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names.  Only where none is set, as in tests
    on one machine, is a temporary one made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = "file://" + tempfile.mkdtemp()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: lineage ends, and what is
    planned next knows the table's size (a checkpoint passes on an estimate, which grows
    with every join until planning itself takes minutes).  How joins meet it is told by its
    rows: a million keys can be a file of a few bytes each hundred, which Spark would take
    for small and gather on the driver."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out = out.hint("broadcast" if out.count() <= BROADCAST_ROWS else "merge")
    out.written_to = path
    return out


class Tables:
    """``settled`` that remembers its tables, so that a query can delete those that its
    result does not read.  With ``key`` they are kept in ``buckets`` by it, so that what is
    joined or grouped by the key is not shuffled again."""

    def __init__(self, key: str | None = None, buckets: int = 1) -> None:
        self.held: list[tuple[SparkSession, str, str | None]] = []
        self.key, self.buckets = key, buckets

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.key is None:
            out = settled(df)
            self.held.append((df.sparkSession, out.written_to, None))
            return out
        spark, name = df.sparkSession, f"settled_{uuid.uuid4().hex[:12]}"
        path = f"{shared_folder(spark)}/{name}"
        self.held.append((spark, path, name))
        dealt = df.repartition(self.buckets, self.key)  # left out by Spark where rows lie so already
        dealt.write.bucketBy(self.buckets, self.key).option("compression", "zstd").option("path", path).saveAsTable(name)
        out = spark.table(name)
        out = out.hint("broadcast" if out.count() <= BROADCAST_ROWS else "merge")
        out.written_to = path
        return out

    def last(self, df: DataFrame) -> DataFrame:
        """``df`` as a table of its own; all others are deleted."""
        out = settled(df)
        for spark, path, name in self.held:
            if name:
                spark.sql(f"drop table if exists {name}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.held = []
        return out
