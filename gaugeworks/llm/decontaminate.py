"""Operator 8: benchmark decontamination by a positional inverted index.

The index is dealt by documents: every shard holds the sorted terms of its
documents, their posting lists (token positions, ascending) and where each document
begins, and is stored as one row of a table.  A shard answers all benchmark windows
of a query block at once: windows with an absent term fall out, the others start
from the postings of their rarest term in the shard and intersect the
offset-adjusted lists of the other terms, rarest first.  Neither postings nor
matches are shuffled; a common term costs only the shards it stands in.

The benchmark is the stated query set.  Tasks cut it into blocks of bounded size and
store them in the shared folder.  A task takes some shards at a time and loads one block
after the other for all of them, so neither the driver nor a task holds more than a few
blocks, however large the benchmark, and each is read once for ``SHARDS`` shards.

Words are compared by 64-bit hashes: a false hit needs another word of the same hash
where the other words of the window agree.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeworks.llm.arrowtext import by_text, column_bytes, pieces, shingles, span_hashes, words
from gaugeworks.llm.cluster import filesystem, new_folder, put, ready, whole_key, written

WINDOW = 13
#: Text of one block of the benchmark, and occurrences of terms followed at a time.
BLOCK_BYTES = 1 << 20
FOLLOWED = 1 << 20
SHARD_BYTES = 4 << 20
#: Shards that are judged in one pass over the blocks.
SHARDS = 12
INDEX = "keys binary, nulls binary, word_at binary, terms binary, term_at binary, positions binary"
HIGH = np.uint64(32)


@dataclass
class Windows:
    """The distinct windows of a block of items, over the block's own terms."""

    items: list[str]
    terms: np.ndarray  # sorted word hashes
    parts: np.ndarray  # window x WINDOW places in terms; -1 after the end of a short one
    size: np.ndarray
    owner_at: np.ndarray  # window -> range of owner
    owner: np.ndarray  # places in items

    @classmethod
    def of(cls, items: list[str], texts: list[str], window: int = WINDOW) -> Windows:
        raw, at = column_bytes(pa.array(texts, pa.string()))
        low, start, end, word_at = words(raw, at)
        hashes = span_hashes(low, start, end)
        name, win_at = shingles(hashes, word_at, window)
        own = np.repeat(np.arange(len(texts)), np.diff(win_at))
        pairs = np.unique(np.stack([name, own.astype(np.uint64)]), axis=1)
        distinct, owner_at = np.unique(pairs[0], return_index=True)
        _, first = np.unique(name, return_index=True)
        begin = word_at[:-1][own[first]] + first - win_at[:-1][own[first]]
        size = np.minimum(np.diff(word_at)[own[first]], window)
        terms = np.unique(hashes)
        place = np.append(np.searchsorted(terms, hashes), np.full(window, -1))
        parts = place.astype(np.int32)[begin[:, None] + np.arange(window)]
        parts[np.arange(window) >= size[:, None]] = -1
        return cls(items, terms, parts, size, np.append(owner_at, pairs.shape[1]), pairs[1].astype(np.int64))


class Shard:
    """Positional postings of some documents."""

    def __init__(self, word_at: np.ndarray, terms: np.ndarray, term_at: np.ndarray, positions: np.ndarray):
        self.word_at, self.terms, self.term_at, self.positions = word_at, terms, term_at, positions

    @classmethod
    def of(cls, raw: np.ndarray, at: np.ndarray) -> Shard:
        low, start, end, word_at = words(raw, at)
        hashes = span_hashes(low, start, end)
        positions = np.argsort(hashes, kind="stable")
        ordered = hashes[positions]
        begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        return cls(word_at.astype(np.int32), ordered[begin], np.append(begin, len(ordered)).astype(np.int32), positions.astype(np.int32))

    def blobs(self) -> list[bytes]:
        return [self.word_at.tobytes(), self.terms.tobytes(), self.term_at.tobytes(), self.positions.tobytes()]

    @classmethod
    def from_blobs(cls, word_at: bytes, terms: bytes, term_at: bytes, positions: bytes) -> Shard:
        return cls(np.frombuffer(word_at, np.int32), np.frombuffer(terms, np.uint64), np.frombuffer(term_at, np.int32), np.frombuffer(positions, np.int32))

    def find(self, query: Windows, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of every occurrence.  With ``slop``, every term may
        stand up to so many words from its place, in the same document."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.terms) or not len(query.terms):
            return none
        place = np.minimum(np.searchsorted(self.terms, query.terms), len(self.terms) - 1)
        place[self.terms[place] != query.terms] = -1
        parts = np.where(query.parts >= 0, place[query.parts], -2)
        live = np.flatnonzero((parts != -1).all(axis=1))
        if not len(live):
            return none
        parts = parts[live]
        length = np.diff(self.term_at.astype(np.int64))
        rarity = np.argsort(np.where(parts >= 0, length[parts], np.iinfo(np.int64).max), axis=1, kind="stable")
        lead = rarity[:, 0]
        count = np.cumsum(length[parts[np.arange(len(live)), lead]])
        keys = (np.repeat(np.arange(len(self.terms)), length).astype(np.uint64) << HIGH) | self.positions.astype(np.uint64)
        cuts, first = [], 0
        while first < len(live):  # windows whose rarest terms occur FOLLOWED times in all, or one window
            last = max(first + 1, int(np.searchsorted(count, (count[first - 1] if first else 0) + FOLLOWED, "right")))
            part = slice(first, last)
            row, begin = self._followed(parts[part], rarity[part], query.size[live[part]], keys, slop)
            cuts.append((live[part][row], begin))
            first = last
        return np.concatenate([w for w, _ in cuts]), np.concatenate([b for _, b in cuts])

    def _followed(self, parts: np.ndarray, rarity: np.ndarray, size: np.ndarray, keys: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``parts``, first word) where windows occur.  ``keys`` are all
        postings as term and position."""
        lead = rarity[:, 0]
        lead_term = parts[np.arange(len(parts)), lead]
        count = np.diff(self.term_at.astype(np.int64))[lead_term]
        row = np.repeat(np.arange(len(parts)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = self.positions[self.term_at[lead_term][row] + nth].astype(np.int64)
        begin = at - lead[row]
        doc = np.searchsorted(self.word_at, at, "right") - 1
        low, high = self.word_at[doc].astype(np.int64), self.word_at[doc + 1].astype(np.int64)
        good = (begin >= low - slop) & (begin + size[row] <= high + slop)
        row, begin, low, high = row[good], begin[good], low[good], high[good]
        for k in range(1, parts.shape[1]):
            if not len(row):
                break
            offset = rarity[row, k]
            term = parts[row, offset]
            test = np.flatnonzero(term >= 0)
            want = begin[test] + offset[test]
            least = np.maximum(want - slop, low[test])
            most = np.minimum(want + slop, high[test] - 1)
            base = term[test].astype(np.uint64) << HIGH
            found = np.searchsorted(keys, base | np.maximum(least, 0).astype(np.uint64))
            hit = keys[np.minimum(found, len(keys) - 1)]
            fits = (found < len(keys)) & (least <= most) & (hit >= base) & (hit <= (base | np.maximum(most, 0).astype(np.uint64)))
            good = np.ones(len(row), bool)
            good[test[~fits]] = False
            row, begin, low, high = row[good], begin[good], low[good], high[good]
        return row, begin

    def judged(self, query: Windows) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which words stand in an occurrence, and each document's items (sorted places)."""
        window, begin = self.find(query)
        n = int(self.word_at[-1])
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + query.size[window], -1)
        hit = np.cumsum(edge[:-1]) > 0
        doc = np.searchsorted(self.word_at, begin, "right") - 1
        found: list = [np.zeros(0, np.int64)] * (len(self.word_at) - 1)
        if len(window):
            pair = np.unique(np.stack([doc, window]), axis=1)
            many = np.diff(query.owner_at)[pair[1]]
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            owner = query.owner[np.repeat(query.owner_at[:-1][pair[1]], many) + nth]
            pair = np.unique(np.stack([np.repeat(pair[0], many), owner]), axis=1)
            for d in np.unique(pair[0]).tolist():
                found[d] = pair[1][pair[0] == d]
        return hit, found


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The stored index: a row a shard of some megabytes of text.  Documents keep
    their order inside a shard; a null text has no words."""
    spark = ready(docs.sparkSession)
    rows = docs.select(whole_key(docs, key).alias("key"), docs[f"`{text}`"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = column_bytes(batch.column(1))
            for i, j in pieces(at, SHARD_BYTES):
                own = batch.column(0).slice(i, j - i)
                shard = Shard.of(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                blobs = [own.fill_null(0).to_numpy().tobytes(), own.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), *shard.blobs()]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], names=["keys", "nulls", "word_at", "terms", "term_at", "positions"])

    return written(rows.mapInArrow(run, INDEX), "postings")


def store_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Write the benchmark's windows to files of the shared folder, a block of about
    ``block_bytes`` of text each, and return the files' places."""
    spark = ready(benchmark.sparkSession)
    folder = new_folder(spark, "benchmark")
    rows = benchmark.select(benchmark[f"`{item}`"].cast("string").alias("item"), benchmark[f"`{text}`"].alias("text")).where("item is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal items, texts, held
            uri = f"{folder}/{uuid.uuid4().hex}.windows"
            put(uri, pickle.dumps(Windows.of(items, texts, window)))
            items, texts, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([uri])], names=["uri"])

        for batch in batches:
            for name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                items.append(name)
                texts.append(body)
                held += len(body)
                if held >= block_bytes:
                    yield flush()
        if items:
            yield flush()

    return sorted(r.uri for r in rows.mapInArrow(run, "uri string").collect())


@lru_cache(maxsize=2)
def stored_block(uri: str) -> Windows:
    where, path = filesystem(uri)
    with where.open_input_stream(path) as f:
        return pickle.loads(f.read())


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def search_index(index: DataFrame, blocks: list[str], key: str = "doc_id") -> DataFrame:
    """One row a document: words, words hit, number and digest of the items of the
    stored ``blocks`` with occurring windows, ``contaminated``, and the ``items``."""
    ready(index.sparkSession)
    names = [key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"]
    empty = items_digest([])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Shard]]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, nulls, *blobs = (batch.column(c)[k].as_py() for c in range(batch.num_columns))
                yield pa.array(np.frombuffer(keys, np.int64), mask=np.frombuffer(nulls, np.uint8).astype(bool)), Shard.from_blobs(*blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, (n_words, n_hit, found) in judged_together(shards(batches), blocks):
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids,
                    pa.array(n_words),
                    pa.array(n_hit),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([items_digest(f) if f else empty for f in found]),
                    pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
                    pa.array(found, pa.list_(pa.string())),
                ],
                names=names,
            )

    out = f"`{key}` long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    return index.mapInArrow(run, out)


class Verdict:
    """Words hit and items found of a shard's documents, over the blocks so far."""

    def __init__(self, shard: Shard):
        self.shard = shard
        self.hit = np.zeros(int(shard.word_at[-1]), bool)
        self.found: list[list[str]] = [[] for _ in range(len(shard.word_at) - 1)]

    def add(self, query: Windows) -> None:
        own, items = self.shard.judged(query)
        self.hit |= own
        for d, places in enumerate(items):
            self.found[d] += [query.items[p] for p in places.tolist()]

    def result(self) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Words, words hit and items of each document."""
        at = self.shard.word_at.astype(np.int64)
        return np.diff(at), by_text(self.hit.astype(np.int64), at), [sorted(set(f)) if f else f for f in self.found]


def judged_together(shards: Iterable[tuple[Any, Shard]], blocks: list[str], load: Callable[[str], Windows] = stored_block, most: int = SHARDS) -> Iterator[tuple[Any, tuple]]:
    """(what came with a shard, its verdict): ``most`` shards in each pass over the blocks."""
    shards = iter(shards)
    while held := [(what, Verdict(shard)) for what, shard in islice(shards, most)]:
        for block in blocks:
            query = load(block)
            for _, verdict in held:
                verdict.add(query)
        for what, verdict in held:
            yield what, verdict.result()


def decontamination_report(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Store the index of ``docs`` and judge every document against ``benchmark``.

    Null texts have no words and are clean; long texts are judged whole; rows are
    judged one by one, repeated ones too; with an empty benchmark all documents are
    clean.  Items without words have no windows, items with a null id or text are no
    items.  Keys must be integers or null; other columns are not read; an empty table
    gives an empty one.
    """
    return search_index(build_index(docs, text, key), store_blocks(benchmark, item, item_text), key)


def phrase_matches(index: DataFrame, blocks: list[str], slop: int = 0, key: str = "doc_id") -> DataFrame:
    """(key, item, first_word, exact): where windows of the items occur, word by word
    (``slop`` 0) or with every word within ``slop`` places of its own."""
    ready(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, nulls, *blobs = (batch.column(c)[k].as_py() for c in range(batch.num_columns))
                shard, doc_ids, rows = Shard.from_blobs(*blobs), np.frombuffer(keys, np.int64), []
                for query in map(stored_block, blocks):
                    exact = set(zip(*(x.tolist() for x in shard.find(query)), strict=True))
                    for w, begin in zip(*(x.tolist() for x in shard.find(query, slop)), strict=True):
                        doc = int(np.searchsorted(shard.word_at, max(begin, 0), "right")) - 1
                        doc_id = None if nulls[doc] else int(doc_ids[doc])
                        rows += [(doc_id, query.items[o], begin - int(shard.word_at[doc]), (w, begin) in exact) for o in query.owner[query.owner_at[w] : query.owner_at[w + 1]].tolist()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.bool_()))], names=[key, "item", "first_word", "exact"])

    return index.mapInArrow(run, f"`{key}` long, item string, first_word long, exact boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are.  Each
    task indexes its own rows, so the verdict falls on the row itself whatever ids
    repeat, and no text is shuffled.  Null, empty and wordless texts stay; an empty
    benchmark keeps all rows."""
    ready(docs.sparkSession)
    blocks = store_blocks(benchmark, item, item_text)
    place = docs.columns.index(text)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Shard]]:
        for batch in batches:
            raw, at = column_bytes(batch.column(place))
            for i, j in pieces(at, SHARD_BYTES):
                yield batch.slice(i, j - i), Shard.of(raw[at[i] : at[j]], at[i : j + 1] - at[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, (n_words, n_hit, _) in judged_together(shards(batches), blocks):
            yield rows.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= n_words))))

    return docs.mapInArrow(run, docs.schema)
