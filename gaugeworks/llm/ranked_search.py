"""Operator 12: ranked lexical search by a threshold-seeded join.

1. One scan turns every text into a row of the forward table: its length and the query
   terms it holds with their occurrences.  A bit map of fixed size over the queries' term
   hashes keeps other terms out; what it lets through by chance drops at the next join.
2. Terms get their document frequency, weight and, stored with them, the ``k`` documents
   of highest impact.  The least of those impacts bounds the k-th score of every item that
   holds the term from below.  Documents stored for several terms of an item bound it
   better: all stored documents of an item's terms are scored exactly, and the k-th of those
   scores is the item's threshold.
3. Terms of an item are put in descending order of their highest impact.  The suffix of
   terms whose highest impacts together stay beneath the threshold can't bring a document
   into the first k: only the terms before it generate candidates.
4. Candidates carry what those terms give them.  The most promising ones are scored exactly
   and raise the threshold; where a candidate's part and the suffix bound stay beneath it,
   the candidate goes.  The others are scored exactly from the forward table.

Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.arrowtext import column_bytes, pieces, span_hashes, words
from gaugeworks.llm.cluster import discard, join_with_hot, ready, whole_key, written
from gaugeworks.llm.vectors import lists

#: Bits of the map over the queries' terms: half a megabyte for each task, whatever the input.
MAP_BITS = 22
BITMAP = 1 << 15
FIRST = 10
#: So many times ``k`` candidates raise an item's threshold before the others are scored,
#: and the suffix of terms stays beneath this share of it, so that the rest can decide.
AGAIN = 5
SLACK = 0.7


def term_rows(texts: DataFrame, admitted: bytes | None = None) -> DataFrame:
    """``texts`` (id, text) as (id, n, terms, tfs): all words, then the distinct ones that
    ``admitted`` (a map of ``MAP_BITS``) lets through, hashed, and their occurrences."""
    ready(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if admitted is None else np.unpackbits(np.frombuffer(admitted, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            raw, at = column_bytes(batch.column(1))
            for i, j in pieces(at, 2 << 20):
                low, start, end, word_at = words(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                found, text = span_hashes(low, start, end), np.repeat(np.arange(j - i), np.diff(word_at))
                if bits is not None:
                    keep = bits[found >> np.uint64(64 - MAP_BITS)]
                    found, text = found[keep], text[keep]
                order = np.lexsort((found, text))
                found, text = found[order], text[order]
                first = np.flatnonzero(np.append(True, (found[1:] != found[:-1]) | (text[1:] != text[:-1]))) if len(found) else np.zeros(0, np.int64)
                tf = np.diff(np.append(first, len(found)))
                ends = pa.array(np.searchsorted(text[first], np.arange(j - i + 1)).astype(np.int32))
                own = batch.slice(i, j - i).column(0)
                terms = pa.ListArray.from_arrays(ends, pa.array(found[first].view(np.int64)))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.diff(word_at)), terms, pa.ListArray.from_arrays(ends, pa.array(tf))], names=["id", "n", "terms", "tfs"])

    return texts.mapInArrow(run, "id long, n long, terms array<long>, tfs array<long>")


def term_map(terms: DataFrame) -> bytes:
    """The bit map of a table of terms: pieces of 4 KB, at most 2^22 bits in all."""
    place = F.shiftrightunsigned("term", 64 - MAP_BITS)
    pieces_of = terms.groupBy((place / BITMAP).cast("long").alias("at")).agg(F.bitmap_construct_agg(place % BITMAP).alias("bits"))
    out = bytearray((1 << MAP_BITS) // 8)
    for at, bits in pieces_of.collect():
        out[at * BITMAP // 8 : (at + 1) * BITMAP // 8] = bits
    return bytes(out)


def scored(found: DataFrame) -> DataFrame:
    """(q, rid, score) of rows (q, rid, terms, xs, qterms, qws): the sum of ``qws`` times
    ``xs`` over the terms that both have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (terms, at), (xs, _), (asked, asked_at), (weight, _) = (lists(batch.column(k)) for k in ("terms", "xs", "qterms", "qws"))
            n = batch.num_rows
            key = np.concatenate([terms, asked])
            row = np.concatenate([np.repeat(np.arange(n), np.diff(at)), np.repeat(np.arange(n), np.diff(asked_at))])
            value = np.concatenate([xs, weight])
            order = np.lexsort((key, row))  # equal terms of a row: the document's, then the item's
            key, row, value = key[order], row[order], value[order]
            both = np.flatnonzero((key[1:] == key[:-1]) & (row[1:] == row[:-1])) if len(key) else np.zeros(0, np.int64)
            score = np.zeros(n, np.int64)
            np.add.at(score, row[both], value[both] * value[both + 1])
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("rid"), pa.array(score)], names=["q", "rid", "score"])

    return found.select("q", "rid", "terms", "xs", "qterms", "qws").mapInArrow(run, "q long, rid long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = FIRST, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The first ``k`` rows of ``docs`` for every item of ``items``: (item, ``rank`` from
    1, document, ``score``), highest scores first, ties by the smaller key, then any order;
    scores are above 0.  Words are runs of digits, letters and non-ASCII, A-Z lower-cased.
    With N documents of at least one word, L words in all, n in a document, df documents
    of a term and tf occurrences in one, the score sums ``w * ((10^9 tf) div (1000 tf +
    8 m))`` over the item's distinct terms, where ``w = floor(1000 ln((2N + 2) / (2df + 1)))``
    and ``m = 10 + (90 n N) div L``.

    Null, empty and wordless texts match nothing; long ones count whole.  Rows that repeat are
    documents of their own; a null key is above all others.  Rows of one item key are one item
    of all their terms; those of a null key take no part.  Keys are integers.  Other columns
    are not read.  Empty tables give an empty one."""
    asked = term_rows(items.select(whole_key(items, item_key).alias("id"), items[f"`{item_text}`"].alias("text")).where("id is not null"))
    sets = asked.select("id", F.explode("terms").alias("term")).groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    sets = written(sets, "items")
    classes = written(sets.groupBy("terms").agg(F.count("*").alias("copies")).withColumn("q", F.monotonically_increasing_id()), "questions")
    wanted = classes.select("q", F.explode("terms").alias("term"))
    vocabulary = written(wanted.groupBy("term").count(), "vocabulary")

    # the forward table: a row a document, with a number of its own once it is written
    source = docs.select(whole_key(docs, key).alias("key"), docs[f"`{text}`"].alias("text"))
    plain = written(term_rows(source.toDF("id", "text"), term_map(vocabulary)).where("n > 0"), "plain")
    known = plain.agg(F.count("*"), F.sum("n")).first()
    count, length = known[0], known[1] or 1
    m = F.expr(f"10 + cast((cast(90 * n as decimal(19, 0)) * {count}) div {length} as long)")
    x = F.expr("transform(tfs, tf -> (1000000000 * tf) div (1000 * tf + 8 * m))")
    forward = plain.where(F.size("terms") > 0).withColumn("m", m).select("id", "terms", x.alias("xs"), F.monotonically_increasing_id().alias("rid"))
    forward = written(forward, "forward")
    postings = forward.select("rid", F.explode(F.arrays_zip("terms", "xs")).alias("p")).select("rid", F.col("p.terms").alias("term"), F.col("p.xs").alias("x")).where("x > 0")

    # terms: frequency, weight, highest impact and the k documents of highest impact
    held = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(vocabulary.select("term"), "term")
    weight = F.floor(1000 * F.log((2 * F.lit(count) + 2) / (2 * F.col("df") + 1)))
    weights = written(held.select("term", weight.cast("long").alias("w")).where("w > 0"), "weights")
    best = Window.partitionBy("term").orderBy(F.desc("x"), "rid")
    stored = written(postings.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k), "stored")
    weighted = written(wanted.join(weights, "term").join(stored.where("nth = 1").select("term", F.col("x").alias("top")), "term").withColumn("top", F.col("w") * F.col("top")), "weighted")
    questions = written(weighted.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("t")).select("q", F.col("t.term").alias("qterms"), F.col("t.w").alias("qws")), "weighted-questions")

    def exactly(pairs: DataFrame) -> DataFrame:
        return scored(pairs.join(forward.select("rid", "terms", "xs"), "rid").join(questions, "q"))

    # thresholds: the k-th exact score among the documents stored for an item's terms
    seeds = weighted.select("q", "term").join(stored.select("term", "rid"), "term").select("q", "rid").distinct()
    down = Window.partitionBy("q").orderBy(F.desc("score"), "rid")

    def kth_score(pairs: DataFrame) -> DataFrame:
        return exactly(pairs).withColumn("nth", F.row_number().over(down)).where(F.col("nth") == k).select("q", F.col("score").alias("least"))

    kth = kth_score(seeds)
    suffix = Window.partitionBy("q").orderBy("top", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounded = weighted.join(kth, "q", "left").withColumn("least", F.coalesce("least", F.lit(0))).withColumn("rest", F.sum("top").over(suffix))
    bounded = written(bounded.withColumn("leads", F.col("rest") >= SLACK * F.col("least")), "bounded")
    limits = written(bounded.groupBy("q").agg(F.first("least").alias("least"), F.coalesce(F.max(F.when(~F.col("leads"), F.col("rest"))), F.lit(0)).alias("rest")), "limits")

    # candidates of the leading terms; the most promising raise the threshold once more
    leading = bounded.where("leads").select("term", "q", "w")
    partial = written(postings.join(leading, "term").groupBy("q", "rid").agg(F.sum(F.col("w") * F.col("x")).alias("part")), "partial")
    promising = Window.partitionBy("q").orderBy(F.desc("part"), "rid")
    firsts = partial.withColumn("nth", F.row_number().over(promising)).where(F.col("nth") <= AGAIN * k).select("q", "rid")
    limits = written(limits.join(kth_score(firsts).withColumnRenamed("least", "again"), "q", "left").withColumn("least", F.greatest("least", F.coalesce("again", "least"))), "raised")
    candidates = partial.join(limits, "q").where(F.col("part") + F.col("rest") >= F.col("least")).select("q", "rid")
    final = exactly(candidates).where("score > 0").join(forward.select("rid", F.col("id").alias("key")), "rid")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("key"), "rid")
    top = written(final.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rank", "key", "score"), "top")

    # items of equal terms share their answer
    of = classes.join(top.groupBy("q").count(), "q").select("terms", "q", "copies")
    named = join_with_hot(sets, of, ["terms"], "copies", max(1, sets.count())).select("q", F.col("id").alias(item_key))
    out = written(named.join(top, "q").select(item_key, F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score"), "ranked")
    discard(sets, classes, vocabulary, plain, forward, weights, stored, weighted, questions, bounded, limits, top)
    return out
