"""Pre-tokens of texts and their pieces, without running the whole tokenizer over each text.

Texts of ASCII and Latin letters and common punctuation are split by the tokenizer's own pattern here; a text with any
other character goes through the library's splitter, whose Unicode tables may differ from ours.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

#: Characters whose classes and lower case are the same in all versions of Unicode that matter here.
_PLAIN = regex.compile(r"[\t\n\x0b\x0c\r\x20-\x7e\xa1-\xac\xae-įĲ-ɏ‐-‧‰-⁞€]*")
# The patterns of the tokenizers' files.
_BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Chunks, and words, kept with their ids in a worker: a young and an old generation of so many each.
REMEMBERED = 300_000
#: Characters of texts whose new words are learned together.
TOGETHER = 1_000_000
_PLAIN_ASCII = bytes([9, 10, 11, 12, 13, *range(32, 127)])
_ENDINGS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(text: str) -> bool:
    return not text.encode().translate(None, _PLAIN_ASCII) if text.isascii() else _PLAIN.fullmatch(text) is not None


class ByteLevel:
    """Of a byte-level BPE tokenizer without normalizer: pre-tokens, and the special strings among them."""

    def __init__(self, path: str) -> None:
        self.library = tokenizer(path)
        if self.library.normalizer is not None:
            raise ValueError(f"{path}: a tokenizer with a normalizer is not handled here")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings."""
        parts = self._split.split(text) if self._split and any(s in text for s in self.special) else [text]
        out: list[str] = []
        for part in parts:
            if plain(part):
                out += _BYTE_LEVEL.findall(part)
            elif part:
                out += [part[s:e] for _, (s, e) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out, len(parts) - 1

    def counts(self, pretokens: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(pretokens, add_special_tokens=False)]


class _Known(dict):
    """A bounded memory: what was not asked for since the old generation was young is forgotten."""

    def __init__(self) -> None:
        self.old: dict = {}

    def room(self, n: int) -> None:
        if len(self) + n > REMEMBERED:
            self.old = dict(self)
            self.clear()

    def again(self, key: str) -> bytes | None:
        """What the old generation knows, young again."""
        value = self.old.get(key)
        if value is not None:
            self[key] = value
        return value


class WordLevel:
    """Of a lower-casing BPE tokenizer with word ends: the ids of texts, as little-endian unsigned 32-bit bytes.

    Pre-tokens never hold white space, so what stands between it is looked up whole; what is new is split into
    pre-tokens, and those that are new go through the library in few strings, whose ids part at the ends of words.
    """

    def __init__(self, path: str, end: str = "</w>") -> None:
        self.library = tokenizer(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith(end)]] = True
        self._chunks, self._words = _Known(), _Known()

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Of each text in turn."""
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size > TOGETHER or i + 1 == len(texts):
                yield from self._together(texts[start : i + 1])
                start, size = i + 1, 0

    def _together(self, texts: list[str]) -> list[bytes]:
        out, open_, new, known = [], [], set(), self._chunks
        for text in texts:
            if not plain(text) or any(s in text for s in self.special):
                out.append([np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()])
                continue
            chunks = text.lower().split()
            found = list(map(known.get, chunks))
            if None in found:
                holes = [(i, chunks[i]) for i, ids in enumerate(found) if ids is None]
                new.update([c for _, c in holes])
                open_.append((found, holes))
            out.append(found)
        if new:
            learned = self._learn(new)
            for found, holes in open_:
                for i, c in holes:
                    found[i] = learned[c]
        return list(map(b"".join, out))

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks, which are remembered."""
        self._chunks.room(len(chunks))
        learned, split = {}, {}
        for c in chunks:
            ids = self._chunks.again(c)
            if ids is not None:
                learned[c] = ids
            elif c.isalpha():
                split[c] = (c,)
            elif (stem := c.rstrip(_ENDINGS)).isalpha():
                split[c] = (stem, c[len(stem) :])
            else:
                split[c] = _WORD_LEVEL.findall(c)
        self._words.room(len(split))
        words = {}
        for own in split.values():
            for w in own:
                if w not in words:
                    words[w] = self._words.get(w) or self._words.again(w)
        new = [w for w, ids in words.items() if ids is None]
        if new:
            lines = [" ".join(new[i : i + 64]) for i in range(0, len(new), 64)]  # the library's time grows faster than a string
            ids = np.array(list(chain.from_iterable(e.ids for e in self.library.encode_batch_fast(lines, add_special_tokens=False))), "<u4")
            stops = (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
            if len(stops) == len(new) and stops[-1] == ids.nbytes:
                data, start = ids.tobytes(), 0
                for w, stop in zip(new, stops):
                    words[w] = self._words[w] = data[start:stop]
                    start = stop
            else:  # a tokenizer that does not mark every end
                for w in new:
                    words[w] = self._words[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        for c, own in split.items():
            learned[c] = self._chunks[c] = words[own[0]] if len(own) == 1 else b"".join([words[w] for w in own])
        return learned


@lru_cache(maxsize=1)
def word_level(path: str) -> WordLevel:
    """Made once in a worker, whose later tasks find what earlier ones learned."""
    return WordLevel(path)
