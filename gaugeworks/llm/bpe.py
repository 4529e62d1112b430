"""Operator 4: BPE encoding and decoding.

Encoding merges a word's symbols in rank order: a priority queue holds the ranks
of adjacent pairs, the symbols form a doubly linked list, and an entry whose pair
no longer stands as pushed is stale and skipped.  Decoding concatenates the
vocabulary strings of the ids.

Words repeat, so a worker merges each distinct word once and keeps the result
(bounded); the split into words is array work over a batch.  The job has no
shuffle: texts stream through ``mapInArrow``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType

from gaugeworks.llm.arrowtext import column_bytes, pieces
from gaugeworks.llm.cluster import carried, fields, ready
from gaugeworks.llm.pretokens import Known, Split, other_lower


#: Bytes of text encoded at a time.
PIECE = 2 << 20


@cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable Latin-1, else the
    next free one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    rest = [b for b in range(256) if b not in letters]
    return [letters.get(b) or chr(256 + rest.index(b)) for b in range(256)]


class WordEndBpe:
    """A BPE vocabulary with word ends: lower-cased NFC text, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[left], self.ids[right]] = rank, self.ids[left + right]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.mark = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = Known(self._words)

    @staticmethod
    def normalized(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        newer, lower = other_lower()
        if newer and newer.search(text):
            text = text.translate(lower)
        return text.replace("Σ", "σ").lower()  # letter by letter: no final sigma

    def merged(self, word: str) -> list[int]:
        """Ids of one word."""
        letters = byte_letters()
        spelled = [letters[b] for b in word.encode()]
        spelled[-1] += self.suffix
        symbol = [self.ids[s] for s in spelled if s in self.ids]
        n = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges = self.merges
        queue = []
        for i in range(n - 1):
            found = merges.get((symbol[i], symbol[i + 1]))
            if found:
                queue.append((found[0], i, found[1], symbol[i], symbol[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, whole, left, right = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue  # stale: one of the two has been merged since
            symbol[i], symbol[j] = whole, -1
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                found = merges.get((whole, symbol[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, found[1], whole, symbol[k]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbol[h], whole))
                if found:
                    heapq.heappush(queue, (found[0], h, found[1], symbol[h], whole))
        return [s for s in symbol if s >= 0]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, packed: what a worker keeps."""
        return [array("I", self.merged(word)).tobytes() for word in words]

    def decode(self, ids: Sequence[int]) -> str:
        """The vocabulary strings one after the other, a blank between them (the
        vocabulary names no decoder of its own)."""
        return " ".join([self.strings[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        (ids, _, _), = self.encode_texts([text])
        return [int(x) for x in ids.split()]

    def encode_texts(self, texts: Sequence[str]) -> list[tuple[str, str, int]]:
        """For each text its ids in decimal joined by blanks, its decoded text and
        the number of ids."""
        plain, special = [], []
        for i, text in enumerate(texts):
            parts = self.mark.split(text) if self.mark and "<|" in text else [text]
            plain.append([self.normalized(p) for p in parts[::2]])
            if len(parts) > 1:
                special.append((i, parts[1::2]))
        flat = [p for parts in plain for p in parts]
        split = Split(flat, spaces_attach=False)
        values, place = self.known.of(split)
        packed = [array("I", v) for v in values]
        ids, strings = [" ".join(map(str, v)) for v in packed], [self.decode(v) for v in packed]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed))
        total = np.concatenate([[0], np.cumsum(sizes[place])])
        order, at = place.tolist(), split.at.tolist()
        all_ids, all_strings = list(map(ids.__getitem__, order)), list(map(strings.__getitem__, order))
        done = [(" ".join(all_ids[a:b]), " ".join(all_strings[a:b]), int(total[b] - total[a])) for a, b in zip(at, at[1:])]
        if not special:
            return done
        marks, out, k = dict(special), [], 0
        for i, parts in enumerate(plain):
            own, k = done[k : k + len(parts)], k + len(parts)
            if i in marks:
                inner = [(str(self.special[m]), m, 1) for m in marks[i]]
                own = [x for pair in zip(own, [*inner, ("", "", 0)]) for x in pair if x[2]]
                own = [(" ".join(x[0] for x in own), " ".join(x[1] for x in own), sum(x[2] for x in own))]
            out.append(own[0])
        return out


_loaded: dict[str, WordEndBpe] = {}


def tokenizer(path: str) -> WordEndBpe:
    if path not in _loaded:
        _loaded[path] = WordEndBpe(path)
    return _loaded[path]


def bpe_encode(docs: DataFrame, tokenizer_path: str, text: str = "text", outputs: Sequence[str] = ("n_tokens", "ids")) -> DataFrame:
    """All columns of ``docs`` and the chosen outputs: ``n_tokens``, ``ids``
    (decimal, blank-joined), ``decoded``, ``ids_sha256``, ``decoded_sha256``.

    A null text counts as empty: no ids, an empty decoded text.  An output whose
    name ``docs`` already has, in any case, replaces that column.  Texts are encoded
    whole, however long; repeated rows give repeated rows; an empty table an empty one.
    """
    made = fields(**{o: LongType() if o == "n_tokens" else StringType() for o in outputs})
    source, schema, kept = carried(docs, made, text)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        for batch in batches:
            texts = batch.column(kept)
            _, at = column_bytes(texts)
            for i, j in pieces(at, PIECE):
                found = bpe.encode_texts([t or "" for t in texts.slice(i, j - i).to_pylist()])
                outcome = {
                    "n_tokens": lambda: pa.array([f[2] for f in found], pa.int64()),
                    "ids": lambda: pa.array([f[0] for f in found], pa.string()),
                    "decoded": lambda: pa.array([f[1] for f in found], pa.string()),
                    "ids_sha256": lambda: pa.array([hashlib.sha256(f[0].encode()).hexdigest() for f in found], pa.string()),
                    "decoded_sha256": lambda: pa.array([hashlib.sha256(f[1].encode()).hexdigest() for f in found], pa.string()),
                }
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(kept)), *(outcome[o]() for o in outputs)], names=names)

    ready(docs.sparkSession)
    return source.mapInArrow(run, schema)
