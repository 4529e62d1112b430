"""Live forms: state folds over event streams, windowed counts, filtered log lines.

The fold is the batch aggregation; as a stream its state is one row a key.  Event time
only bounds state: where a watermark is given, keys come with windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.functions.expr import classify_line
from gaugeworks.operators.state import fold


def read_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream over a folder or file of Parquet events."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")


def live_fold(events: DataFrame, key: str, sequence: Sequence[str], fields: Mapping[str, Column]) -> DataFrame:
    """Current state of each key, for complete or update output."""
    return fold(events, key, sequence, fields)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by key and tumbling window; windows close ``late`` after the newest event."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def lines_of(lines: DataFrame, kind: str | None = None, text: str = "value") -> DataFrame:
    """The log lines of a kind, or all."""
    return lines if kind is None else lines.where(classify_line(F.col(text)) == kind)


def flushed_lines(lines: DataFrame, folder: str, checkpoint: str, kind: str | None = None, text: str = "value", every: str | None = "75 milliseconds") -> StreamingQuery:
    """Write a stream's lines of a kind as text, those that arrived since the last flush
    together, each line once; without ``every`` what is there now, and then end."""
    rows = lines_of(lines, kind, text).select(F.col(text).alias("value"))
    when = {"processingTime": every} if every else {"availableNow": True}
    return rows.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(**when).start()


def settled(stream: DataFrame, folder: str) -> DataFrame:
    """Run what is there now and return the whole state, which the executors write to
    Parquet in ``folder``, each batch over the one before."""
    spark, state = stream.sparkSession, f"{folder}/state"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(state)

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(state)

    query = stream.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(state)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run what is there now into an in-memory table of the driver and return it (tests)."""
    query: StreamingQuery = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
