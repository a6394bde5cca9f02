"""Cutting long texts where no match of the byte-level split pattern can cross, and the tokenizers library behind a cache."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import regex

#: Behind a letter or number, white space or punctuation always begins a new match; no match looks back over it.
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \t\n\r]|\p{P})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
#: Texts of these characters alone are split by ``_PLAIN``, which matches there as the byte-level split pattern does:
#: they have had the same classes in all versions of Unicode. Other texts go to the library whole.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ȳΑ-ΡΣ-ωА-яぁ-ゔァ-ヺ一-龥"
_OTHER = re.compile(rf"[^\t\n\r\x20-\x7e¡-±´-¸»¿×÷‐-‧‰-⁞€{_LETTERS}]")
_PLAIN = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{_LETTERS}0-9]+| ?[0-9]+|\s+(?!\S)|\s+")


def split_safely(text: str, limit: int = 1 << 16) -> Iterator[str]:
    """Cuts a text behind ``limit`` characters at the next safe boundary; a run without one stays whole."""
    first = 0
    while len(text) - first > limit:
        cut = _SAFE.search(text, first + limit)
        if not cut:
            break
        yield text[first : cut.start()]
        first = cut.start()
    yield text[first:] if first else text


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in seen)
    return {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


#: Matches in a generation of the cache. Two full ones of this size take some 170 MB in each worker process.
KEEP = 600_000


class _Matches(dict):
    """Ids of matches of the split pattern, by the library's model. What is not here may be in ``before``."""

    letters = _byte_letters()

    def __init__(self, model, before: dict[str, bytes]):
        super().__init__()
        self.model, self.before = model, before

    def __missing__(self, match: str) -> bytes:
        ids = self.before.get(match)
        if ids is None:
            tokens = self.model.tokenize(match.encode().decode("latin-1").translate(self.letters))
            ids = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        self[match] = ids
        return ids


class LibraryEncoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library, as bytes of little-endian unsigned 32-bit integers.

    The library splits a text and applies its model to each match by itself. So each distinct match goes to the model once
    and is kept: those of late, up to twice ``keep``.
    Stretches that might be split otherwise go to the library, and so does the whole text if it holds an added token (such as
    ``<|endoftext|>``, which the library takes for its own id), or if its file asks for more than byte-level splitting.
    """

    _made: dict[tuple[str, int], LibraryEncoder] = {}

    def __init__(self, path: str, keep: int = KEEP):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        steps = json.loads(self.library.to_str())
        split = steps["pre_tokenizer"] or {}
        whole = steps["normalizer"] is None and steps["truncation"] is None and steps["padding"] is None
        self.plain = whole and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
        self.added = tuple(token["content"] for token in steps["added_tokens"])
        self.keep, self.matches = keep, _Matches(self.library.model, {})

    @classmethod
    def of(cls, path: str, keep: int = KEEP) -> LibraryEncoder:
        """The one of this worker process."""
        if (path, keep) not in cls._made:
            cls._made[path, keep] = cls(path, keep)
        return cls._made[path, keep]

    def encode(self, text: str) -> bytes:
        if not self.plain or any(token in text for token in self.added):
            return self._by_library(text)
        out = []
        for part in split_safely(text):
            if _OTHER.search(part):
                out.append(self._by_library(part))
                continue
            if len(self.matches) > self.keep:
                self.matches.before = {}
                self.matches = _Matches(self.library.model, dict(self.matches))
            found = _PLAIN.findall(part)
            out += itemgetter(*found)(self.matches) if len(found) > 1 else map(self.matches.__getitem__, found)
        return b"".join(out)

    def _by_library(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
