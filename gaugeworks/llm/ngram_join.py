"""Operator 9: n-gram Jaccard join by MinHash banding.

1. Every text is cut into the set of its word n-grams; ``rows x bands`` min-hashes
   give a hash for each band, the numbers chosen for the target recall at the
   threshold.
2. Exact copies become one class; the classes shuffle on the band hashes, and the
   least class of a bucket is linked with the others (a star: as many links as
   members).  Components of these links hold every pair that shares a bucket.
3. Inside a component every pair that can be alike is verified on the full n-gram
   sets.  A large component is cut by set size into
   steps of the threshold, as sets of sizes further apart than one step are never
   alike, and a step into chunks; each pair of chunks of one step or of neighbours is a
   group of its own, so the work of one is bounded.  A group returns counts and a
   spanning forest of the links, never the links.
4. Components of the verified links are the classes of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.arrowtext import column_bytes, pieces, shingles, span_hashes, words
from gaugeworks.llm.cluster import discard, join_with_hot, ready, whole_key, written
from gaugeworks.llm.components import connected_components

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 192
#: Texts of one chunk of a component and n-grams of their sets (or one text): a group
#: verifies one chunk or a pair of them.
MEMBERS = 256
CHUNK_GRAMS = 1 << 20
#: Classes up to this number are sent to all executors (32 bytes each).
BROADCAST_ROWS = 1_000_000


def bands_for(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding whose recall at ``threshold`` is at
    least ``recall`` with at most ``most`` hashes."""
    for rows in range(most, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else int(np.ceil(np.log1p(-recall) / np.log1p(-hit))) if hit > 1e-12 else most + 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall; allow more hashes")


@cache
def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def ngram_sets(raw: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, and their n+1 text offsets."""
    low, start, end, word_at = words(raw, at)
    found, found_at = shingles(span_hashes(low, start, end), word_at, n)
    text = np.repeat(np.arange(len(at) - 1), np.diff(found_at))
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.append(True, (found[1:] != found[:-1]) | (text[1:] != text[:-1])) if len(found) else np.zeros(0, bool)
    return found[new], np.searchsorted(text[new], np.arange(len(at)))


def band_hashes(raw: np.ndarray, at: np.ndarray, n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have n-grams, their band hashes)."""
    low, start, end, word_at = words(raw, at)
    found, found_at = shingles(span_hashes(low, start, end), word_at, n)
    full = np.flatnonzero(np.diff(found_at) > 0)
    out = np.zeros((len(full), bands), np.uint64)
    if not len(full):
        return full, out
    small = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    begin = found_at[:-1][full]
    a, b = multipliers(bands * rows)
    turned = np.empty_like(small)
    for band in range(bands):
        h = np.full(len(full), band + 1, np.uint64)
        for k in range(band * rows, band * rows + rows):
            np.multiply(small, a[k], out=turned)
            np.bitwise_xor(turned, b[k], out=turned)
            least = np.minimum.reduceat(turned, begin).astype(np.uint64)
            h = (h ^ least) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, band] = h
    return full, out


def signatures(docs: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """(key, hash, n_grams, bands) of every row; ``hash`` names the exact text,
    ``n_grams`` is the size of its set, ``bands`` is empty for texts without words."""
    spark = ready(docs.sparkSession)
    body = docs[f"`{text}`"]
    source = docs.select(whole_key(docs, key).alias("key"), F.unhex(F.md5(body.cast("binary"))).alias("hash"), body.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = column_bytes(batch.column(2))
            for i, j in pieces(at, 1 << 20):
                part, own_at = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                full, found = band_hashes(part, own_at, n, bands, rows)
                has = np.zeros(j - i, np.int64)
                has[full] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has)]).astype(np.int32)), pa.array(found.view(np.int64).reshape(-1)))
                size = np.diff(ngram_sets(part, own_at, n)[1]).astype(np.int32)
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(size), lists], names=["key", "hash", "n_grams", "bands"])

    return source.mapInArrow(run, "key long, hash binary, n_grams int, bands array<long>")


def candidate_links(classes: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Stars over the buckets: (u, v) of class ids that share a band hash with v, once a
    bucket; and the table of buckets that they read.
    ``total`` is the number of classes and bands, of which a bucket may hold a large part."""
    spread = classes.select("id", F.explode("bands").alias("band"))
    least = written(spread.groupBy("band").agg(F.min("id").alias("v"), F.count("*").alias("n")).where("n > 1"), "buckets")
    return join_with_hot(spread, least, ["band"], "n", total).where("id <> v").select(F.col("id").alias("u"), "v"), least


def chunked(members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``members`` (comp, n_grams, ...) with ``step``, how many chunks that step of
    their component has (``own``) and those below and above it (``below``, ``above``), and
    ``whole``: the component is one chunk; and the table of steps that it reads."""
    width = -np.log(threshold) * (1 + 1e-9)
    sized = members.withColumn("step", F.floor(F.log(F.col("n_grams").cast("double")) / width).cast("int"))
    each = sized.groupBy("comp", "step").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"))
    by = Window.partitionBy("comp")
    next_to = by.orderBy("step")

    def chunks(n: str, grams: str):
        return F.ceil(F.greatest(F.col(n) / MEMBERS, F.col(grams) / CHUNK_GRAMS)).cast("int")

    each = each.withColumn("whole", (F.sum("n").over(by) <= MEMBERS) & (F.sum("grams").over(by) <= CHUNK_GRAMS)).withColumn("own", chunks("n", "grams"))

    def beside(off: int):
        near = F.when(F.lag("step", off).over(next_to) == F.col("step") - off, F.lag("own", off).over(next_to))
        return F.coalesce(near, F.lit(0))

    each = written(each.select("comp", "step", "whole", "own", beside(1).alias("below"), beside(-1).alias("above"), "n"), "steps")
    total = each.agg(F.sum("n")).first()[0] or 0
    return join_with_hot(sized, each, ["comp", "step"], "n", total), each


def text_sets(docs: DataFrame, members: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(comp, id, copies, whole, step, own, below, above, grams) of the candidates.  Where
    they are too many to send to all executors, only those of very many copies are, whose
    rows stay where they are; rows of equal key and text give equal rows."""
    kept = ["comp", "id", "copies", "whole", "step", "own", "below", "above"]
    body = docs[f"`{text}`"]
    source = docs.select(docs[f"`{key}`"].cast("long").alias("key"), F.unhex(F.md5(body.cast("binary"))).alias("hash"), body.alias("text"))
    if members.count() <= BROADCAST_ROWS:
        joined = source.join(F.broadcast(members), "hash")
    else:
        joined = join_with_hot(source, members, ["hash"], "copies", members.agg(F.sum("copies")).first()[0])
    joined = joined.where("key <=> rep_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = column_bytes(batch.column(len(kept)))
            for i, j in pieces(at, 2 << 20):
                found, found_at = ngram_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], n)
                lists = pa.ListArray.from_arrays(pa.array(found_at.astype(np.int32)), pa.array(found.view(np.int64)))
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(len(kept))), lists], names=[*kept, "grams"])

    return joined.select(*kept, "text").mapInArrow(run, "comp long, id long, copies long, whole boolean, step int, own int, below int, above int, grams array<long>")


def paired_chunks(sets: DataFrame) -> DataFrame:
    """Every set in each group that compares it: ``chunk`` is its own, ``i`` and ``j`` the
    two of the group, numbered by step and place."""
    wide = 1 << 32

    def number(off: int, place):
        return (F.col("step").cast("long") + off) * wide + place

    def numbers(count: str, off: int):
        places = F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda place: number(off, place))

    mine = number(0, F.pmod(F.xxhash64("id"), F.col("own")))
    placed = sets.withColumn("chunk", F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(mine))
    others = F.concat(numbers("below", -1), numbers("own", 0), numbers("above", 1))
    others = F.when(F.col("whole"), F.array(F.lit(0).cast("long"))).otherwise(others)
    met = placed.select("comp", "id", "copies", "grams", "whole", "chunk", F.explode(others).alias("x"))
    return met.select("comp", "id", "copies", "grams", "whole", "chunk", F.least("chunk", "x").alias("i"), F.greatest("chunk", "x").alias("j"))


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of the matrix of intersection sizes: (first left row, rows x all right).
    Only grams that several sets hold matter; columns go in bounded slices."""
    sets = left + (right or [])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    grams = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(sets)), sizes)
    distinct, place, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[place]
    own, column = own[keep], number[place[keep]]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    n_left, n_columns = len(left), int(shared.sum())
    width = max(64, min(4096, (32 << 20) // max(1, 4 * len(sets))))
    block = max(1, min(n_left, (16 << 20) // max(1, 4 * (len(right) if right is not None else n_left))))
    other = slice(n_left, len(sets)) if right is not None else slice(0, n_left)
    for r in range(0, n_left, block):
        n_rows = min(block, n_left - r)
        total = np.zeros((n_rows, other.stop - other.start), np.float32)
        for c in range(0, n_columns, width):
            a, b = np.searchsorted(column, [c, c + width])
            matrix = np.zeros((len(sets), min(width, n_columns - c)), np.float32)
            matrix[own[a:b], column[a:b] - c] = 1
            total += matrix[r : r + n_rows] @ matrix[other].T
        yield r, total


def verified(copies: np.ndarray, sets: list[np.ndarray], chunk: np.ndarray, i: int, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(documents linked with each member, a root of each member's links) among the
    pairs of chunk ``i`` with chunk ``j``, or within one chunk."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    rows = np.flatnonzero(chunk == i)
    columns = rows if i == j else np.flatnonzero(chunk == j)
    links, root = np.zeros(n, np.int64), np.arange(n)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r, both in intersections([sets[k] for k in rows], None if i == j else [sets[k] for k in columns]):
        mine = rows[r : r + len(both)]
        either = size[mine][:, None] + size[columns][None, :] - both
        linked = (both >= threshold * either - 1e-6) & (both > 0)
        if i == j:
            linked[np.arange(len(mine)), np.arange(r, r + len(mine))] = False
        links[mine] += linked @ copies[columns]
        if i != j:
            links[columns] += linked.T @ copies[mine]
        for k in range(len(mine)):
            near = columns[np.flatnonzero(linked[k])]
            if len(near):
                tops = np.unique(root[near])
                whole = {top(int(x)) for x in tops} | {top(int(mine[k]))}
                root[list(whole)] = min(whole)
                root[near] = root[mine[k]] = min(whole)
    return links, np.array([top(x) for x in range(n)], np.int64)


def near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, text: str = "text", key: str = "doc_id", survivors: bool = False) -> DataFrame:
    """One row a row of ``docs``: ``key``, ``hash`` (of the exact text), ``class_id``
    (least key among the documents connected by links, own one included),
    ``n_links`` (other rows whose n-gram set is at least ``threshold`` alike, exact
    copies included) and ``rep_key`` (least key among exact copies).

    Texts of fewer than ``n`` words, but not none, have one n-gram, all their words; long
    texts have all of theirs.  Null texts and texts without words have no links and stand
    alone.  Rows of equal key and text are copies of one another.  Keys must be integers;
    rows with a null key come before all keys.  Other columns are not read.  An empty
    table gives an empty one.

    With ``survivors`` also ``stays``: whether the row has the key and text of the one
    of its class with the least key, then the least hash.  Rows that are equal in key
    and text stay together, rows that stand alone stay.
    """
    bands, rows = bands_for(threshold, recall)
    each = written(signatures(docs, key, text, n, bands, rows), "signatures")
    worded = each.where("n_grams > 0")
    classes = worded.groupBy("hash").agg(F.min(F.struct(F.col("key").isNotNull().alias("known"), "key")).alias("low"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    classes = classes.select("hash", F.col("low.key").alias("rep_key"), "copies", "n_grams", "bands", F.monotonically_increasing_id().alias("id"))
    classes = written(classes, "classes")
    links, buckets = candidate_links(classes, bands * classes.count())
    found = connected_components(links)
    discard(buckets)
    parts = found.select(F.col("node").alias("id"), F.col("root").alias("comp"))

    placed, steps = chunked(classes.select("hash", "rep_key", "copies", "n_grams", "id").join(parts, "id"), threshold)
    members = written(placed.drop("n", "n_grams"), "members")
    sets = written(text_sets(docs, members, key, text, n).dropDuplicates(["id"]), "gram-sets")
    paired = paired_chunks(sets)

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        grams = group.column("grams").combine_chunks()
        grams = pa.concat_arrays(grams.chunks) if isinstance(grams, pa.ChunkedArray) else grams
        at, flat = grams.offsets.to_numpy(), grams.values.to_numpy(zero_copy_only=False)
        own = [flat[a:b] for a, b in zip(at, at[1:])]
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        links, root = verified(group.column("copies").to_numpy().astype(np.int64), own, group.column("chunk").to_numpy(), i, j, threshold)
        return pa.table({"id": ids, "root": ids[root], "links": links, "whole": group.column("whole")})

    checked = written(paired.groupBy("comp", "i", "j").applyInArrow(run, "id long, root long, links long, whole boolean"), "checked")
    discard(sets, members, steps)
    single = checked.where("whole").select("id", "root")
    several = checked.where("not whole")
    roots = single
    if not several.isEmpty():
        roots = single.unionByName(connected_components(several.select(F.col("id").alias("u"), F.col("root").alias("v"))).toDF("id", "root"))
    links = checked.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("hash", "rep_key", "copies", "id").join(roots, "id", "left").join(links, "id", "left")
    known = written(known.withColumn("root", F.coalesce("root", "id")), "known")
    least = [F.col("rep_key").isNotNull().alias("known"), "rep_key", *(["hash"] if survivors else [])]
    low = written(known.groupBy("root").agg(F.min(F.struct(*least)).alias("low"), F.count("*").alias("n")), "least")
    low_columns = [F.col("low.rep_key").alias("class_id"), *([F.col("low.hash").alias("class_hash")] if survivors else [])]
    extra = ["class_hash"] if survivors else []
    named = join_with_hot(known, low.select("root", "n", *low_columns), ["root"], "n", classes.count())
    named = named.select("hash", "rep_key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies", *extra)
    named = written(named, "named")
    alone = each.where("n_grams = 0").select("key", "hash", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("rep_key"))
    linked = join_with_hot(worded.select("key", "hash"), named, ["hash"], "copies", each.count()).select("key", "hash", "class_id", "n_links", "rep_key", *extra)
    if survivors:
        stays = F.col("key").eqNullSafe(F.col("class_id")) & (F.col("hash") == F.col("class_hash"))
        linked, alone = linked.withColumn("stays", stays).drop("class_hash"), alone.withColumn("stays", F.lit(True))
    out = written(linked.unionByName(alone).withColumnRenamed("key", key), "near-copies")
    discard(each, classes, found, checked, known, low, named)
    return out


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with one row of each class of near copies: the one of
    least key, then least hash of the text (any one of those if rows of equal key and
    text repeat).  Rows whose text is null or has no word all stay.  All columns stay as
    they are."""
    found = near_copies(docs, n, threshold, recall, text, key, survivors=True)
    own = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    at = dict(zip(docs.columns, own.columns))
    hashed = own.withColumn("hash", F.unhex(F.md5(F.col(at[text]).cast("binary"))))
    this = F.col(at[key]).cast("long")

    def of(rows: DataFrame) -> DataFrame:
        named = rows.select(F.col(key).alias("key"), F.col("hash").alias("other"))
        return F.broadcast(named) if named.count() <= BROADCAST_ROWS else named

    gone = of(found.where("not stays").select(key, "hash").distinct())
    same = this.eqNullSafe(F.col("key")) & F.col("hash").eqNullSafe(F.col("other"))
    kept = hashed.join(gone, same, "left_anti")
    repeated = found.where(F.col("stays") & (F.col("n_links") > 0)).groupBy(key, "hash").count().where("count > 1")
    if not repeated.isEmpty():  # rows of equal key and text: copies combine before they shuffle
        several = of(repeated)
        one = kept.join(several, same, "left_semi").dropDuplicates([at[key], "hash"])
        kept = kept.join(several, same, "left_anti").unionByName(one)
    return kept.select(*own.columns).toDF(*docs.columns)
