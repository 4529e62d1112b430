"""Operator 5: removal of repeated 200-byte strings by merged Burrows-Wheeler
transforms.

1. Every 200-byte window of a text has an anchor, the least of its hashed 32-byte
   runs; equal windows have equal anchors at equal places.  Consecutive windows of one
   anchor form a segment.  Only the segments' hashes are shuffled.
2. Segments whose anchor occurs once hold no repeated window.  Equal segments are
   pre-aggregated to one with a count.  What remains, different segments of one
   anchor, is dealt by anchor into buckets.
3. In a bucket every shard of segments gets its Burrows-Wheeler transform; the
   transforms are merged by refining their interleave, eight bytes a round.
   Neighbours part in the round that holds the end of their common prefix; those that
   stay together through 200 bytes are repeated intervals.  The suffixes of the
   bucket are not sorted again.
4. An anchor with very many different segments, of a passage in many texts, is not left
   to one bucket: its segments are cut again at anchors of another hash, and so on.
5. Repeated windows go back to their texts as spans; a last pass cuts them out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.arrowtext import column_bytes, eights, mixed, pieces, span_hashes
from gaugeworks.llm.cluster import HOT_KEYS, HOT_ROWS, discard, join_with_hot, ready, written

LENGTH = 200
RUN = 32
FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def anchors(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of every segment, in order.
    Windows lie within their texts.  Each level hashes the runs in another way."""
    n = len(raw)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    view = eights(raw)[: n - 7]
    h = view * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    run = 8
    while run < RUN:
        h = h[: len(h) - run] * np.uint64(0xD6E8FEB86659FD93) + h[run:]
        h ^= h >> np.uint64(29)
        run *= 2
    h = mixed(h + np.uint64(level * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    # sliding minimum over the runs of a window, in blocks: a suffix of one and a prefix of the next
    wide = length - RUN + 1
    blocks = np.full(-(-len(least) // wide) * wide, FAR)
    blocks[: len(least)] = least
    blocks = blocks.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - length + 1
    lowest = np.minimum(back[:starts], ahead[wide - 1 : wide - 1 + starts]) & np.uint64(0xFFFFFFFF)
    inside = np.ones(starts, bool)
    for back_off in range(1, length):  # windows that cross into the next text
        place = at[1:-1] - back_off
        inside[place[(place >= 0) & (place < starts)]] = False
    windows = np.flatnonzero(inside)
    if not len(windows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    where = lowest[windows]
    new = np.append(True, (where[1:] != where[:-1]) | (windows[1:] != windows[:-1] + 1))
    first = np.flatnonzero(new)
    return h[where[first].astype(np.int64)], windows[first], np.diff(np.append(first, len(windows)))


def segments(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, level: int = 0) -> tuple[np.ndarray, ...]:
    """(text, anchor, segment hash, number of windows, offsets, first windows): equal
    segments of one text stand together, as a list of the places they begin."""
    anchor, first, n = anchors(raw, at, length, level)
    name = span_hashes(raw, first, first + n + length - 1)
    text = np.searchsorted(at, first, "right") - 1
    order = np.lexsort((first, name, anchor, text))
    text, anchor, name, n, first = text[order], anchor[order], name[order], n[order], first[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1])
    begin = np.flatnonzero(new)
    return text[begin], anchor[begin], name[begin], n[begin], np.append(begin, len(text)), first - at[text]


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys (pairs of 32 bits, in any order) in order, and their stable order.  If pairs and
    places fit in 63 bits, plain values are sorted, which numpy does several times faster."""
    first, second = keys >> 32, keys & 0xFFFFFFFF
    low, place = int(second.max(initial=0)).bit_length(), len(keys).bit_length()
    if int(first.max(initial=0)).bit_length() + low + place > 63:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    packed = np.sort((first << low | second) << place | np.arange(len(keys)))
    return packed >> place, packed & ((1 << place) - 1)


class Transform:
    """The Burrows-Wheeler transform of a shard of strings.

    Row ``i`` is the ``i``-th suffix of all strings in order, the empty ones included
    (a string's end comes before any byte; equal suffixes by place): ``suffix[i]`` is its
    place.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        n = len(raw)
        end = np.repeat(at[1:], np.diff(at))
        left = end - np.arange(n)
        self.view = view = eights(raw)[:n].byteswap()
        short = np.minimum(left, 8).astype(np.uint64)
        view = view & ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (short * np.uint64(8) % np.uint64(64)) * (short < 8).astype(np.uint64)) if n else view
        rank = self._ranked(view, short)
        depth = 8
        order = np.argsort(rank, kind="stable")
        # ties keep their rows; only they are ordered by the rank that follows them
        group = np.arange(n)
        while depth < int(np.diff(at).max(initial=0)):
            r = rank[order[group]]
            same = r[1:] == r[:-1]
            tied = np.append(False, same) | np.append(same, False)
            tied &= left[order[group]] >= depth  # those of shorter ones are equal to their ends
            group = group[tied]
            if not len(group):
                break
            places = order[group]
            follow = np.where(left[places] > depth, rank[np.minimum(places + depth, n - 1)] + 1, 0)
            both, inner = ordered(rank[places] << 32 | follow)
            places = places[inner]
            order[group] = places
            new = np.append(True, both[1:] != both[:-1])
            rank[places] = group[np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))]
            depth *= 2
        # the strings' empty suffixes come first
        strings = len(at) - 1
        self.row = np.empty(n, np.int32)
        self.row[order] = np.arange(strings, n + strings, dtype=np.int32)
        self.suffix = np.concatenate([at[1:], order])
        self.begin = np.concatenate([at[:-1], np.repeat(at[:-1], np.diff(at))[order]])

    def before(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, bytes, led): the rows with ``width`` bytes (8 at most) before them in
        their string, those bytes as one integer in their order, and the rows of the
        suffixes that they lead."""
        rows = np.flatnonzero(self.suffix - width >= self.begin)
        led = self.suffix[rows] - width
        return rows, self.view[led] >> np.uint64(64 - 8 * width), self.row[led]

    @staticmethod
    def _ranked(view: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rank of each suffix by its first eight bytes: the row of the first equal one."""
        order = np.lexsort((size, view))
        v, s = view[order], size[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (s[1:] != s[:-1])
        rank = np.empty(len(v), np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
        return rank


def numbered(lead: np.ndarray) -> np.ndarray:
    """The number of each value among those that occur twice or more, in their order;
    -1 for those that occur once."""
    order = np.argsort(lead)
    v = lead[order]
    parts = v[1:] != v[:-1]
    alone = np.append(True, parts) & np.append(parts, True)
    out = np.empty(len(lead), np.int32)
    out[order] = np.where(alone, -1, np.cumsum(np.append(True, parts) & ~alone) - 1)
    return out


def distributed(number: np.ndarray, most: int) -> np.ndarray:
    """The stable order of numbers up to ``most``, by 16 bits a pass."""
    order = np.argsort(number.astype(np.uint16), kind="stable")
    for shift in range(16, int(most).bit_length(), 16):
        order = order[np.argsort((number[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def merged_repeats(shards: list[Transform], length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each shard the suffixes whose first ``length`` bytes (even) another suffix
    of any shard shares, in order of their places, and the repeated interval of each:
    suffixes of one interval have a common prefix of ``length`` bytes or more, those of
    different ones a shorter one, and intervals are numbered in the order of their strings.

    The interleave of the shards' rows is refined by ``w`` bytes a round, the most of 8, 4
    and 2 that divides ``length``: if it is in order by ``w k`` bytes, a stable distribution
    by the ``w`` bytes before each row puts the rows led by them in order by ``w k + w``.
    Neighbours part in the round that holds the end of their common prefix.
    Only rows that lead to a whole string of ``length`` bytes are taken.
    A row that stands alone has no repeat at this length, nor has any row it leads, so
    both drop out and only repeated intervals are refined further; so do rows led by
    bytes that occur once.
    """
    width = next(w for w in (8, 4, 2) if length % w == 0)
    base = np.cumsum([0, *(len(s.suffix) for s in shards)])
    interleave = np.concatenate([np.flatnonzero(s.suffix - length >= s.begin) + b for s, b in zip(shards, base)]).astype(np.int32)
    block = np.zeros(len(interleave), np.int32)
    rows, lead, led = (np.concatenate(x) for x in zip(*([own + b, bytes_, to + b] for (own, bytes_, to), b in zip((s.before(width) for s in shards), base))))
    number = numbered(lead)
    again = number >= 0
    most = int(number.max(initial=0))
    # by row: the number of the bytes before it and the row that they lead
    back = np.full(base[-1], -1, np.int32)
    back[rows[again]] = led[again]
    pair = np.zeros(base[-1], np.uint16 if most < 1 << 16 else np.int32)
    pair[rows[again]] = number[again]
    for _ in range(length // width):
        led = back[interleave]
        has = np.flatnonzero(led >= 0)
        lead, led, block = pair[interleave[has]], led[has], block[has]
        order = distributed(lead, most)
        lead, interleave, block = lead[order], led[order], block[order]
        if len(interleave) < 2:
            return [(np.zeros(0, np.int64), np.zeros(0, np.int32)) for _ in shards]
        parts = (lead[1:] != lead[:-1]) | (block[1:] != block[:-1])
        stay = np.flatnonzero(~(np.append(True, parts) & np.append(parts, True)))
        block = np.append(np.int32(0), np.cumsum(parts, dtype=np.int32))[stay]
        interleave = interleave[stay]
    owner, out = np.searchsorted(base, interleave, "right") - 1, []
    for k, s in enumerate(shards):
        place = s.suffix[interleave[owner == k] - base[k]]
        order = np.argsort(place)
        out.append((place[order], block[owner == k][order]))
    return out


def repeated_windows(texts: list[bytes], length: int = LENGTH, shard_bytes: int = 64 << 10) -> list[np.ndarray]:
    """For each string the places where a string of ``length`` bytes begins that also
    begins elsewhere in ``texts``."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    cuts = list(pieces(at, shard_bytes))
    shards = [Transform(raw[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in cuts]
    places = np.concatenate([found + at[i] for (found, _), (i, _) in zip(merged_repeats(shards, length), cuts)]) if cuts else np.zeros(0, np.int64)
    cut = np.searchsorted(places, at)
    return [places[a:b] - s for a, b, s in zip(cut[:-1], cut[1:], at[:-1])]


#: Segment bytes that meet in one bucket.  The segments of an anchor with more than
#: ``SPLIT_BYTES`` are cut at the anchors of the next level; what ``LEVELS`` of them leave
#: above ``MOST_BYTES`` in one place is told apart window by window.
BUCKET_BYTES = 128 << 10
SPLIT_BYTES = 1 << 20
MOST_BYTES = 8 << 20
LEVELS = 3
#: Bits of the map of repeated anchors, whatever the input: 8 MB.
MAP_BITS = 26


def distinct_texts(docs: DataFrame, text: str, partitions: int, name: str) -> DataFrame:
    """The table ``name`` of exact texts (hash, body, copies), in buckets by hash so that later
    joins on it move no text.  Copies meet as partial aggregates."""
    spark = docs.sparkSession
    body = F.coalesce(docs[f"`{text}`"].cast("binary"), F.lit(b""))
    rows = docs.select(F.unhex(F.md5(body)).alias("hash"), body.alias("body"))
    each = rows.groupBy("hash").agg(F.first("body").alias("body"), F.count("*").alias("copies"))
    each.write.bucketBy(partitions, "hash").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def all_segments(texts: DataFrame, length: int, level: int) -> DataFrame:
    """(hash, copies, anchor, seg, n_windows, firsts): 32-bit places packed in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = column_bytes(batch.column(2))
            for i, j in pieces(at, 512 << 10):
                text, anchor, name, n, offset, first = segments(raw[at[i] : at[j]], at[i : j + 1] - at[i], length, level)
                take = pa.array(text + i)
                firsts = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((offset * 4).astype(np.int32)), pa.py_buffer(first.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor.view(np.int64)), pa.array(name.view(np.int64)), pa.array(n.astype(np.int32)), firsts], names=["hash", "copies", "anchor", "seg", "n_windows", "firsts"])

    return texts.where(F.octet_length("body") >= length).select("hash", "copies", "body").mapInArrow(run, "hash binary, copies long, anchor long, seg long, n_windows int, firsts binary")


def maybe_repeated(found: DataFrame, anchors_: DataFrame) -> DataFrame:
    """The segments whose anchor may be among ``anchors_``: a bit map of fixed size
    tells, so a shuffle carries few of the others."""
    spark = found.sparkSession
    bit = F.shiftrightunsigned("anchor", 64 - MAP_BITS)
    marks = anchors_.select(F.shiftright(bit, 6).alias("word"), bit.alias("bit"))
    marks = marks.select("word", F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    held = np.zeros(1 << (MAP_BITS - 6), np.int64)
    held[marks.column("word").to_numpy()] = marks.column("mask").to_numpy()
    shipped = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shipped.value.view(np.uint64)
        for batch in batches:
            place = batch.column(2).to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS)
            yield batch.filter(pa.array(((words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)))

    return found.mapInArrow(run, found.schema)


def cut_out(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments (hash, anchor, seg, several, first, n_windows),
    which are gathered by text; ``bucket`` goes along."""
    gathered = wanted.groupBy("hash").agg(F.collect_list(F.struct("anchor", "seg", "bucket", "first", "n_windows", "several")).alias("want"))
    joined = texts.select("hash", "body").join(gathered, "hash").select("body", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = column_bytes(batch.column(0))
            lists = batch.column(1)
            own = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            want = lists.flatten()
            anchor, seg, bucket, first, n, several = (want.field(k) for k in range(6))
            begin = at[:-1][own] + first.to_numpy()
            size = n.to_numpy() + length - 1
            for a in range(0, len(own), 20000):
                b = min(a + 20000, len(own))
                cut = np.concatenate([[0], np.cumsum(size[a:b])])
                index = np.repeat(begin[a:b] - cut[:-1], size[a:b]) + np.arange(cut[-1])
                body = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[index]))])
                yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in (bucket, anchor, seg, several)), body], names=["bucket", "anchor", "seg", "several", "body"])

    return joined.mapInArrow(run, "bucket long, anchor long, seg long, several boolean, body binary")


def _runs(places: np.ndarray) -> bytes:
    """Consecutive places as packed pairs of first and end."""
    if not len(places):
        return b""
    cut = np.flatnonzero(np.diff(places) > 1)
    return np.stack([places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)] + 1], axis=1).astype("<u4").tobytes()


def merged_in_buckets(bodies: DataFrame, length: int) -> DataFrame:
    """(anchor, seg, runs) of the segments with repeated windows, by merged transforms.
    Those that are repeated as a whole (``several``) meet the others but have no row."""

    def run(group: pa.Table) -> pa.Table:
        found = [_runs(places) for places in repeated_windows(group.column("body").to_pylist(), length)]
        out = pa.table({"anchor": group.column("anchor"), "seg": group.column("seg"), "runs": pa.array(found, pa.binary())})
        return out.filter(pa.array([bool(f) and not s for f, s in zip(found, group.column("several").to_pylist())], pa.bool_()))

    return bodies.groupBy("bucket").applyInArrow(run, "anchor long, seg long, runs binary")


def told_apart_by_window(bodies: DataFrame, length: int, held: list[DataFrame]) -> DataFrame:
    """The same for anchors with more segments than one task should hold: every
    window's hash meets its equals in an aggregation that combines before it shuffles, and
    windows of a hot hash stay where they are."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = column_bytes(batch.column(4))
            n = np.diff(at) - length + 1
            own = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            begin = at[:-1][own] + place
            for a in range(0, len(own), 50000):
                part = slice(a, a + 50000)
                h = [span_hashes(raw, begin[part], begin[part] + length).view(np.int64), span_hashes(raw[::-1].copy(), len(raw) - begin[part] - length, len(raw) - begin[part]).view(np.int64)]
                take = pa.array(own[part])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in (1, 2, 3)), pa.array(place[part].astype(np.int32)), pa.array(h[0]), pa.array(h[1])], names=["anchor", "seg", "several", "place", "h1", "h2"])

    windows = bodies.mapInArrow(spread, "anchor long, seg long, several boolean, place int, h1 long, h2 long")
    windows = written(windows, "windows")
    several = written(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "several")
    held += [windows, several]
    places = join_with_hot(windows.where("not several"), several, ["h1", "h2"], "n", windows.count()).groupBy("anchor", "seg").agg(F.array_sort(F.collect_list("place")).alias("places"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [_runs(np.array(p)) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.binary())], names=["anchor", "seg", "runs"])

    return places.mapInArrow(join, "anchor long, seg long, runs binary")


def repeated_spans(texts: DataFrame, length: int, level: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """(hash, spans): for each text with repeats its segments' places and the runs of
    repeated windows in them (null: all windows); and the tables it still reads."""
    found = written(all_segments(texts, length, level), "segments")
    counted = found.groupBy("anchor").agg(F.sum(F.octet_length("firsts") / 4 * F.col("copies")).alias("n"), F.count("*").alias("rows"), F.min("seg").alias("low"), F.max("seg").alias("high"))
    repeated = written(counted.where("n > 1").select("anchor", "rows", (F.col("low") == F.col("high")).alias("one")), "anchors")
    maybe = written(maybe_repeated(found, repeated), "maybe")
    near = join_with_hot(maybe, repeated, ["anchor"], "rows", found.count())
    near = written(near.drop("rows"), "near")
    discard(found, repeated, maybe)
    whole = near.where("one").select("hash", "firsts", "n_windows", F.lit(None).cast("binary").alias("runs"))
    mixed_ = near.where("not one")
    kinds = mixed_.groupBy("anchor", "seg").agg(F.sum(F.octet_length("firsts") / 4 * F.col("copies")).alias("n"), F.count("*").alias("rows"), F.min(F.struct("hash", "firsts", "n_windows")).alias("low"))
    kinds = kinds.select("anchor", "seg", (F.col("n") > 1).alias("several"), "rows", "low.hash", "low.firsts", "low.n_windows")
    kinds = written(kinds, "kinds")
    weight = kinds.groupBy("anchor").agg(F.sum(F.col("n_windows") + length - 1).alias("bytes"), F.sum("rows").alias("rows"))
    total, most, n_rows = weight.agg(F.sum("bytes"), F.max("bytes"), F.sum("rows")).first()
    buckets = max(1, -(-(total or 0) // BUCKET_BYTES))
    wanted = kinds.select("anchor", "seg", "several", "hash", "n_windows", _first_place("firsts").alias("first"), F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("long").alias("bucket"))
    bodies, held = cut_out(texts, wanted, length), [near, kinds]
    limit = SPLIT_BYTES if level + 1 < LEVELS else MOST_BYTES
    if (most or 0) <= limit:
        runs = merged_in_buckets(bodies, length)
    else:
        bodies = written(bodies, "bodies")
        large = written(weight.where(F.col("bytes") > limit).select("anchor"), "large")
        rest = bodies.join(large, "anchor", "left_anti").select(*bodies.columns)
        hot = bodies.join(large, "anchor", "left_semi").select(*bodies.columns)
        split = split_again(hot, length, level + 1, held) if level + 1 < LEVELS else told_apart_by_window(hot, length, held)
        runs = merged_in_buckets(rest, length).unionByName(split)
        held += [bodies, large]
    runs = runs.select("anchor", "seg", F.lit(1).cast("long").alias("rows"), "runs").unionByName(kinds.where("several").select("anchor", "seg", "rows", F.lit(None).cast("binary").alias("runs")))
    runs = written(runs, "runs")
    parts = join_with_hot(mixed_, runs, ["anchor", "seg"], "rows", n_rows or 0).select("hash", "firsts", "n_windows", "runs")
    return whole.unionByName(parts).groupBy("hash").agg(F.collect_list(F.struct("firsts", "n_windows", "runs")).alias("spans")), [*held, runs]


def split_again(bodies: DataFrame, length: int, level: int, held: list[DataFrame]) -> DataFrame:
    """(anchor, seg, runs) of segments of hot anchors: each is a text of its own, cut at
    the anchors of the next level.  Equal windows have equal anchors at every level, so a
    window of another anchor can't be its repeat."""
    named = bodies.withColumn("hash", F.unhex(F.concat(F.lpad(F.hex("anchor"), 16, "0"), F.lpad(F.hex("seg"), 16, "0"))))
    texts = written(named.select("hash", "body", F.lit(1).cast("long").alias("copies"), "anchor", "seg", "several"), "hot")
    spans, more = repeated_spans(texts.select("hash", "body", "copies"), length, level)
    held += [texts, *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_runs(np.flatnonzero(inside(n, spans_))) for n, spans_ in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["anchor", "seg", "runs"])

    whole = texts.where("not several").select("hash", "anchor", "seg", (F.octet_length("body") - (length - 1)).alias("n"))
    return whole.join(spans, "hash").select("anchor", "seg", "n", "spans").mapInArrow(run, "anchor long, seg long, runs binary")


def _first_place(packed: str):
    """The first 32-bit little-endian place of a packed list."""
    digits = F.hex(F.substring(packed, 1, 4))
    turned = F.concat(*(F.substring(digits, k, 2) for k in (7, 5, 3, 1)))
    return F.conv(turned, 16, 10).cast("long")


def inside(n: int, spans, reach: int = 1) -> np.ndarray:
    """Which of ``n`` places lie in a repeated window's first ``reach`` bytes."""
    edge = np.zeros(n + 1, np.int32)
    for span in spans or ():
        first = np.frombuffer(span["firsts"], "<u4").astype(np.int64)
        runs = np.array([[0, span["n_windows"]]]) if span["runs"] is None else np.frombuffer(span["runs"], "<u4").astype(np.int64).reshape(-1, 2)
        np.add.at(edge, (first[:, None] + runs[:, 0]).reshape(-1), 1)
        np.add.at(edge, (first[:, None] + runs[:, 1] + reach - 1).reshape(-1), -1)
    return np.cumsum(edge[:-1]) > 0


def cut_texts(docs: DataFrame, text: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """(hash, copies, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every exact text."""
    spark = ready(docs.sparkSession)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = "hash binary, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, copies, spans_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n = len(body)
                if copies > 1 and n >= length:
                    gone = np.ones(n, bool)
                elif spans_:
                    gone = inside(n, spans_, length)
                else:
                    gone = None
                if gone is None or not gone.any():
                    row = (n, 0, 0, body)
                else:
                    kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                    row = (n, int(gone.sum()), int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])), kept)
                out.append((*row[:3], hashlib.sha256(row[3]).hexdigest(), *([row[3].decode(errors="ignore")] if with_text else [])))
            columns = list(zip(*out)) or [()] * (4 + with_text)
            types = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(columns, types))], names=["hash", "copies", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    name = "texts_" + uuid.uuid4().hex[:12]
    try:
        texts = distinct_texts(docs, text, partitions, name)
        spans, held = repeated_spans(texts, length)
        joined = texts.select("hash", "body", "copies").join(spans, "hash", "left").select("hash", "body", "copies", "spans")
        result = written(joined.mapInArrow(run, fields), "cut-texts")
    finally:
        spark.sql(f"drop table if exists {name}")
    discard(*held)
    return result


def dedup_report(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """One row a row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a string of ``length`` bytes that begins anywhere else too,
    in the same text included, is removed.  Null texts count as empty; texts shorter
    than ``length`` keep all; copies of a longer text lose all; long texts are treated
    whole; rows with null or repeated keys are told apart by their text only; other
    columns are not read, whatever their names; an empty table gives an empty one.
    """
    cut = cut_texts(docs, text, length)
    rows = docs.select(docs[f"`{key}`"].alias("own_key"), F.unhex(F.md5(F.coalesce(docs[f"`{text}`"].cast("binary"), F.lit(b"")))).alias("hash"))
    total = cut.agg(F.sum("copies")).first()[0] or 0
    return join_with_hot(rows, cut, ["hash"], "copies", total).select(F.col("own_key").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, text: str = "text", size: str | None = "n_chars", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``; bytes of a character cut
    in two go with it.  Where a text changes, ``size`` (if such a column is there) gets
    its new number of characters.  Null texts stay null; long texts are treated whole;
    equal texts of ``length`` bytes or more become empty; all rows and columns stay,
    whatever the columns are called; an empty table gives an empty one."""
    whole = cut_texts(docs, text, length, with_text=True)
    least = max(HOT_ROWS, (whole.agg(F.sum("copies")).first()[0] or 0) // HOT_KEYS)
    cut = whole.where("n_removed > 0").select(F.col("hash").alias("cut_hash"), "kept", "copies")
    own = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    body = F.col(f"c{docs.columns.index(text)}")
    rows = own.withColumn("own_hash", F.unhex(F.md5(body.cast("binary"))))
    same = F.col("own_hash") == F.col("cut_hash")
    # copies lose everything, so what is sent of the hot ones is their hash
    hot = F.broadcast(cut.where(F.col("copies") > least).select("cut_hash", "kept"))
    cold = rows.join(hot, same, "left_anti").join(cut.where(F.col("copies") <= least).select("cut_hash", "kept"), same, "left")
    joined = rows.join(hot, same).unionByName(cold)
    changed, out = F.col("cut_hash").isNotNull(), []
    for k, f in enumerate(docs.schema.fields):
        column = F.col(f"c{k}")
        if f.name == text:
            column = F.when(changed, F.col("kept")).otherwise(column)
        elif f.name == size:
            column = F.when(changed, F.length("kept").cast(f.dataType)).otherwise(column)
        out.append(column.alias(f.name))
    return joined.select(*out)
