"""Split texts into the pretokens of a byte-level or a word-end BPE tokenizer,
for a whole batch at once, and look their tokens up by distinct pretoken.

The two patterns split at changes between letters, numbers, white space and the
rest, so the split is array work on the code points of a batch:

* byte-level: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
* word-end: ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
from tokenizers import Regex, normalizers, pre_tokenizers

from gaugeworks.llm.arrowtext import same_spans, span_hashes

LETTER, NUMBER, SPACE, OTHER, BETWEEN = range(5)
# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def every_letter() -> str:
    """The code points that may be letters or numbers: none are from U+40000 on."""
    return "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x40000)))


@cache
def classes() -> np.ndarray:
    """Class of every code point.  The patterns' engine says which are letters and numbers:
    its Unicode is newer than Python's and older than that of other modules."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        found = "".join(piece for piece, _ in split.pre_tokenize_str(every_letter()))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    out[WHITE_SPACE] = SPACE
    return out


@cache
def other_lower() -> tuple[re.Pattern | None, dict[int, str]]:
    """Letters that the vocabularies' normalizer lower-cases otherwise than Python, which
    does not know them yet: a pattern that finds one, and what becomes of each."""
    letters = every_letter()
    lower = normalizers.Lowercase().normalize_str
    blocks = (letters[i : i + 1024] for i in range(0, len(letters), 1024))
    unlike = {ord(c): lower(c) for block in blocks if lower(block) != block.lower() for c in block if lower(c) != c.lower()}
    return (re.compile("[" + "".join(map(chr, unlike)) + "]") if unlike else None), unlike


class Split:
    """Pretokens of a list of texts: spans of ``raw`` (UTF-8) and, for each text,
    the range of its pretokens."""

    def __init__(self, texts: Sequence[str], spaces_attach: bool):
        joined = "\0".join(texts) + "\0"
        char = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        stop = np.cumsum(sizes) - 1
        kind = classes()[char]
        kind[stop] = BETWEEN

        start = np.ones(len(char), bool)
        start[1:] = kind[1:] != kind[:-1]
        if spaces_attach:
            # the last white space before a word stands alone or, if a blank, leads the word
            word = np.flatnonzero(start[1:] & (kind[:-1] == SPACE) & (kind[1:] != BETWEEN)) + 1
            start[word - 1] = True
            start[word[char[word - 1] == 0x20]] = False
        else:
            start |= kind == NUMBER
        self._contractions(char, kind, start)

        where = np.flatnonzero(start)
        keep = kind[where] != BETWEEN
        if not spaces_attach:
            keep &= kind[where] != SPACE
        width = np.ones(len(char), np.uint8)
        for least in (0x80, 0x800, 0x10000):
            width += char >= least
        byte = np.zeros(len(char) + 1, np.int64)
        np.cumsum(width, out=byte[1:])
        ends = np.append(where[1:], len(char))
        self.data = joined.encode()
        self.raw = np.frombuffer(self.data, np.uint8)
        first = where[keep]
        self.start, self.end = byte[first], byte[ends[keep]]
        self.at = np.concatenate([[0], np.searchsorted(first, stop)])

    @staticmethod
    def _contractions(char: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
        quote = np.flatnonzero(start & (char == ord("'")))
        if not len(quote):
            return
        after = np.append(char, [0, 0])
        one, two = after[quote + 1], after[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for found, size in ((quote[short], 2), (quote[long & ~short], 3)):
            start[found + 1] = False
            start[found + size] = True

    def hashes(self) -> np.ndarray:
        return span_hashes(self.raw, self.start, self.end)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].decode()


class Known:
    """What was computed for distinct pretokens, kept for the next batches of the
    same worker and forgotten all at once when ``most`` are held.  Pretokens are sorted
    by a hash and then compared byte by byte, so equal hashes never pass for equal words."""

    def __init__(self, compute: Callable[[list[str]], list], most: int = 400_000):
        self.compute, self.most, self.held = compute, most, {}

    def of(self, split: Split) -> tuple[list, np.ndarray]:
        """The values of the distinct pretokens, and for each pretoken its place there."""
        distinct, first, place = np.unique(split.hashes(), return_index=True, return_inverse=True)
        place = place.reshape(-1)
        lead = first[place]
        other = np.flatnonzero(~same_spans(split.raw, split.start, split.end, split.start[lead], split.end[lead]))
        if len(other):  # another word of the same hash stands for itself
            place = place.copy()
            place[other] = len(first) + np.arange(len(other))
            first = np.concatenate([first, other])
        start, end = split.start[first].tolist(), split.end[first].tolist()
        words = [split.data[a:b] for a, b in zip(start, end)]
        if len(self.held) > self.most:
            self.held.clear()
        held = self.held
        new = [w for w in dict.fromkeys(words) if w not in held]
        if new:
            held.update(zip(new, self.compute([w.decode() for w in new]), strict=True))
        return [held[w] for w in words], place
