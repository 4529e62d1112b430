"""Token ids of whole texts by the tokenizers library, asked once for each distinct
pretoken of a worker instead of once for each occurrence."""

from __future__ import annotations

import os
from array import array
from collections.abc import Sequence

import numpy as np

from gaugeworks.llm.bpe import WordEndBpe, byte_letters
from gaugeworks.llm.pretokens import Known, Split


class ByteTokens:
    """A BPE file of the tokenizers library: byte-level, or with word ends and then
    lower-cased and without white space.

    ``special_is_text``: strings of special tokens in a text are ordinary text;
    otherwise they become their ids, as in the library.
    """

    def __init__(self, path: str, special_is_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = special_is_text
        self.special = [] if special_is_text else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.word_ends = self.library.normalizer is not None
        self.model, self.letters = self.library.model, dict(enumerate(byte_letters()))
        self.known = Known(self._pretokens)

    def _pretokens(self, pretokens: list[str]) -> list[bytes]:
        """The model alone is asked, as a pretoken is not split further."""
        ids, letters, kind = self.model.tokenize, self.letters, "HI"[self.type.itemsize // 4]
        return [array(kind, [t.id for t in ids(p.encode().decode("latin-1").translate(letters))]).tobytes() for p in pretokens]

    def _encoded(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def encode_texts(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``self.type``."""
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        plain = ["" if i in whole else t for i, t in enumerate(texts)] if whole else texts
        if self.word_ends:
            plain = [WordEndBpe.normalized(t) for t in plain]
        split = Split(plain, spaces_attach=not self.word_ends)
        values, place = self.known.of(split)
        flat = list(map(values.__getitem__, place.tolist()))
        at = split.at.tolist()
        out = [b"".join(flat[a:b]) for a, b in zip(at, at[1:])]
        for i in whole:
            out[i] = self._encoded(texts[i])
        return out


_loaded: dict[tuple[str, bool], ByteTokens] = {}


def tokens_of(path: str, special_is_text: bool = False) -> ByteTokens:
    key = path, special_is_text
    if key not in _loaded:
        _loaded[key] = ByteTokens(path, special_is_text)
    return _loaded[key]
