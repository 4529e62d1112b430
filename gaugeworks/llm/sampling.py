"""Bounded, deterministic samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: More classes than this are an error: no model with a weight a class could hold them.
MOST_CLASSES = 20_000
#: Longer texts are no examples, so that a sample is bounded in bytes too.
MOST_BYTES = 256 << 10


def bucket_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal doc_id modulo ``parts``; null ids fall in no bucket."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def example_texts(docs: DataFrame, text: str, key: str, *others: str) -> DataFrame:
    """(key, text, others) of the documents that may be examples."""
    body = docs[f"`{text}`"]
    return docs.select(docs[f"`{key}`"].alias("key"), body.alias("text"), *others).where(F.octet_length("text") <= MOST_BYTES)


def first_rows(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the distinct rows, the first ones by a hash of the whole row."""
    order = [F.xxhash64(*rows.columns), *rows.columns]
    return rows.distinct().orderBy(*order).limit(most)


def per_class(rows: DataFrame, label: str, each: int) -> DataFrame:
    """About ``each`` distinct rows of every class (all of a smaller one), chosen by a
    hash of the whole row: the same rows on every run and cluster, never more than
    ``2 * each`` times the number of classes.  Only a count a class reaches the driver;
    more than ``MOST_CLASSES`` classes raise an error."""
    spark = rows.sparkSession
    counts = rows.groupBy(label).count().limit(MOST_CLASSES + 1).collect()
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    if not counts:
        return rows.limit(0)
    whole = 1 << 30
    shares = StructType([StructField("__label", rows.schema[label].dataType), StructField("__below", LongType())])
    limits = spark.createDataFrame([(value, whole if n <= each else int(each / n * whole)) for value, n in counts], shares)
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(whole))
    found = rows.join(F.broadcast(limits), F.col(label).eqNullSafe(F.col("__label"))).where(place < F.col("__below"))
    return first_rows(found.select(*rows.columns), 2 * each * len(counts))
