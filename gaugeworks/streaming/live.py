"""Keyed state of a stream that is kept and written by changes.

Each key has its own typed state in the state store; a batch reads and writes the keys of
its events only and puts out those whose state changed, with what it was before.  Changes
are appended, a folder a batch; a table of the current state is the last change of each
key.  Totals are kept by differences: what a change takes away and adds, summed."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def order(at: Sequence) -> tuple:
    """Nulls come before all values."""
    return tuple((x is not None, x) if x is not None else (False,) for x in at)


class LastValues(StatefulProcessor):
    """Of every field the last value that is not null, by a sequence that need not be the
    order of arrival.  With ``forget``, a key that a batch leaves with ``done`` (a field that
    is true then) is forgotten when the watermark has moved on by so many milliseconds."""

    def __init__(self, names: Sequence[str], seqs: Sequence[str], state: StructType, done: str | None = None, forget: int | None = None):
        self.names, self.seqs, self.state, self.done, self.forget = list(names), list(seqs), state, done, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, m = len(self.names), len(self.seqs)
        there = self.held.exists()
        held = list(self.held.get()) if there else [None] * (n + n * m)
        before = held[:n]
        for row in rows:
            at = [row[c] for c in self.seqs]
            for k, name in enumerate(self.names):
                value, own = row[name], slice(n + k * m, n + (k + 1) * m)
                if value is not None and (held[k] is None or order(at) > order(held[own])):
                    held[k], held[own] = value, at
        self.held.update(tuple(held))
        if self.forget is not None and self.done and held[self.names.index(self.done)]:
            self.handle.registerTimer(max(0, timerValues.getCurrentWatermarkInMs()) + self.forget)
        if not there or held[:n] != before:
            yield Row(**dict(zip(self.names, held[:n])), **{f"was_{m}": v for m, v in zip(self.names, before)}, is_new=not there, **{"__key": key[0]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def changes(events: DataFrame, key: str, sequence: Sequence[str], fields: Mapping[str, Column], done: str | None = None, forget: int | None = None, time: str | None = None, late: str = "0 seconds") -> DataFrame:
    """A stream of the keys whose state changed: key, the fields, ``was_`` each field before
    and ``is_new``.  Events without a key change nothing.  A value with a null sequence is
    before all others.  State that is to be forgotten (``done``, ``forget``) needs the events'
    ``time`` and how ``late`` they may be."""
    seqs = [f"__seq{k}" for k in range(len(sequence))]
    told = events.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), *(F.col(c).alias(n) for n, c in zip(seqs, sequence)), *(c.alias(n) for n, c in fields.items()), *([F.col(time).cast("timestamp").alias("__t")] if time else []))
    told = told.withWatermark("__t", late) if time else told
    env = events.sparkSession.sparkContext.environment  # the state's class is imported by the workers
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, paths)])
    kinds = {f.name: f.dataType for f in told.schema.fields}
    state = StructType([*(StructField(n, kinds[n]) for n in fields), *(StructField(f"at_{n}{s}", kinds[s]) for n in fields for s in seqs)])
    out = StructType([*(StructField(n, kinds[n]) for n in fields), *(StructField(f"was_{n}", kinds[n]) for n in fields), StructField("is_new", BooleanType()), StructField("__key", kinds["__key"])])
    moved = told.groupBy("__key").transformWithState(LastValues(list(fields), seqs, state, done, forget if time else None), out, "Update", "EventTime" if time else "None")
    return moved.withColumnRenamed("__key", key)


@contextmanager
def state_store(spark: SparkSession):
    """Typed state needs the store that keeps it on disk; the session's own one comes back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def kept_changes(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run what is there now; every batch's changes go to ``folder``/changes/batch=n, from
    the executors, so that a batch that is run again replaces its own.  ``each`` sees the
    written changes of a batch."""
    spark = stream.sparkSession

    def put(batch: DataFrame, n: int) -> None:
        path = f"{folder}/changes/batch={n}"
        batch.write.mode("overwrite").parquet(path)
        if each:
            each(batch.sparkSession.read.schema(batch.schema).parquet(path), n)

    with state_store(spark):
        query = stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()


def current(spark: SparkSession, folder: str, key: str, fields: Sequence[str]) -> DataFrame:
    """The state of each key: its last change."""
    log = spark.read.parquet(f"{folder}/changes")
    last = F.max_by(F.struct(*fields), F.col("batch"))
    return log.groupBy(key).agg(last.alias("s")).select(key, *(F.col(f"s.{f}").alias(f) for f in fields))


def differences(changed: DataFrame, measures: Callable[[Callable[[str], Column]], Mapping[str, Column]]) -> dict[str, float]:
    """What the changes add to totals: ``measures`` gives each total's share of a row as
    a column of its fields; new rows take nothing away."""
    after = measures(lambda n: F.col(n))
    before = measures(lambda n: F.col(f"was_{n}"))
    taken = {k: F.when(F.col("is_new"), 0).otherwise(F.coalesce(before[k], F.lit(0))) for k in after}
    row = changed.agg(*(F.coalesce(F.sum(F.coalesce(after[k], F.lit(0)) - taken[k]), F.lit(0)).alias(k) for k in after)).first()
    return row.asDict()


class Totals:
    """Totals kept by differences, one small file a batch: the totals after batch n are those
    after the one before and the differences of n, so a repeated batch gives the same."""

    def __init__(self, spark: SparkSession, folder: str, measures):
        self.spark, self.folder, self.measures = spark, folder, measures

    def _file(self, n: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals/{n}.json")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def after(self, n: int) -> dict[str, float]:
        files, path = self._file(n)
        if n < 0 or not files.exists(path):
            return {}
        return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0])

    def __call__(self, changed: DataFrame, n: int) -> None:
        before, more = self.after(n - 1), differences(changed, self.measures)
        total = {k: before.get(k, 0) + v for k, v in more.items()}
        files, path = self._file(n)
        out = files.create(path, True)
        out.write(bytearray(json.dumps(total, sort_keys=True), "utf-8"))
        out.close()
