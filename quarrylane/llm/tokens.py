"""Token ids of whole texts, exactly as one ``tokenizers`` file gives them, with cached words and bounded memory."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Sequence
from itertools import compress, count, repeat
from operator import is_

import numpy as np

# Characters beyond these ranges may change under NFC or lower-casing: texts with one of them are split at white space and
# otherwise left to the library. Within them NFC changes nothing and lower-casing maps each character by itself.
_WIDE = re.compile("[\u0130\u0180-\u200f\u2028-\u202f\u205f-\u20ab\u20ad-\U0010ffff]")
# A full stop or comma before white space is a piece of its own unless another symbol stands before it: anything that isn't
# white space, a digit or one of the letters of these ranges, so multiplication and division signs are symbols.
_JOINED = re.compile("[^a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f0-9\\s][.,]\\s")
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u017f]+")
# Python splits at the information separators too, which aren't white space to the tokenizer.
_ODD = "\x1c\x1d\x1e\x1f"


class CachedEncoder:
    """For tokenizer files whose pre-tokenizer drops white space and never spans it.

    A text's ids are then those of its white-space-separated chunks, one after the other, so each distinct chunk goes
    through the library once and its ids are kept as bytes, up to ``limit`` chunks in two generations: when the newer is
    full it becomes the older, and what is met again there moves back, so rare chunks go and frequent ones stay. Texts
    that Python would split elsewhere go through the library whole; chunks are lower-cased beforehand, so that one entry
    serves both cases, only in texts whose every character Python and the library lower alike."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.cache, self.older = limit, {}, {}
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        self.bytes, self.model = self._byte_letters(), self.tokenizer.model
        probe = ["the", "straße", "ciónmente", "ñandú", "żółw", "œuvre"]
        self.plain = all(self._word(w) == self._whole(w) for w in probe)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """The printable character that byte-level BPE writes for each byte: itself, or the next from 256 on."""
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in own]
        return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case word of letters alone: one piece, which the model takes as it is."""
        piece = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _chunks(self, text: str) -> list[str]:
        if not text.isascii() and _WIDE.search(text):
            return text.split()
        if self.lowers and "<|" not in text:
            text = text.lower()
        if not _JOINED.search(text):
            text = text.replace(". ", " . ").replace(".\n", " .\n").replace(", ", " , ")
        return text.split()

    def encode_batch(self, texts: Sequence[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null and empty texts have none."""
        split = [None if t and any(c in t for c in _ODD) else self._chunks(t or "") for t in texts]
        found = [x and list(map(self.cache.get, x)) for x in split]
        # Only the places without ids are filled: one in nine or so, and the others need no step of Python.
        gaps = [(x, f, list(compress(count(), map(is_, f, repeat(None))))) for x, f in zip(split, found, strict=True) if x and None in f]
        if gaps:
            cache = self._with({x[i] for x, _, at in gaps for i in at})
            for x, f, at in gaps:
                for i in at:
                    f[i] = cache[x[i]]
        return [self._whole(t) if x is None else b"".join(x) for t, x in zip(texts, found, strict=True)]

    def _with(self, new: set[str]) -> dict[str, bytes]:
        """The cache with the chunks that it lacks."""
        if len(self.cache) + len(new) > self.limit // 2:
            self.cache, self.older = {}, self.cache
        met = new & self.older.keys()
        self.cache.update(zip(met, map(self.older.__getitem__, met), strict=True))
        new -= met
        if self.plain:
            words = list(filter(_LETTERS.fullmatch, new))
            every = "\n".join(words)
            if every != every.lower():
                words = [c for c in words if c == c.lower()]
            self.cache.update(zip(words, map(self._word, words), strict=True))
            new.difference_update(words)
        rest = list(new)
        for at in range(0, len(rest), 5000):
            part = rest[at : at + 5000]
            for chunk, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.cache[chunk] = np.array(e.ids, "<u4").tobytes()
        return self.cache


_encoders: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]
