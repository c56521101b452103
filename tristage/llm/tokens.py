"""Token ids of the tokenizers library, with the encodings of words kept in a bounded cache.

For tokenizers that drop white space, such as word-level BPE with word ends: a text's ids are those
of its space-separated words one after another, so the library only sees words that the cache lacks.
A plain word (Latin letters, perhaps with a full stop or comma at its end) goes straight to the
library's BPE model: for it the normaliser only lower-cases and the pre-tokenizer splits off the mark.
All other words go through the whole tokenizer.
"""

from __future__ import annotations

import functools
import os
import re
import struct

import numpy as np

CACHE_WORDS = 350_000  # of each of the two generations
# Composed Latin letters whose lower case is one such letter.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]+)([.,]?)")


class WordTokenizer:
    def __init__(self, path: str, cache_words: int | None = None):
        self.cache_words = cache_words or CACHE_WORDS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's cores are Spark's to give out
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        shown = lambda c: letters.pre_tokenize_str(c)[0][0]
        self.shown = {ord(c): shown(c) for c in map(chr, range(0xC0, 0x180))}
        self.recent: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.marks = {m: self._whole([m])[0] for m in ".,"} | {"": b""}

    def _whole(self, words: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(found.ids, "<u4").tobytes() for found in encode(words, add_special_tokens=False)]

    def _stem(self, stem: str) -> bytes:
        ids = self.stems.get(stem)
        if ids is None:
            found = self.model.tokenize(stem if stem.isascii() else stem.translate(self.shown))
            ids = struct.pack(f"<{len(found)}I", *[t.id for t in found])
            if len(self.stems) >= self.cache_words:
                self.stems.clear()
            self.stems[stem] = ids
        return ids

    def _learn(self, words: list[str]) -> None:
        recent, before, other = self.recent, self.before, []
        for word in words:
            ids = before.get(word)
            if ids is None:
                plain = PLAIN.fullmatch(word)
                if plain is None:
                    other.append(word)
                    continue
                ids = self._stem(plain[1].lower()) + self.marks[plain[2]]
            recent[word] = ids
        recent.update(zip(other, self._whole(other)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words, recent = text.replace("\n", " ").split(" "), self.recent
        try:
            return b"".join(map(recent.__getitem__, words))
        except KeyError:
            if len(recent) > self.cache_words:  # what is still in use comes over from the last generation
                self.before, self.recent = recent, {"": b""}
                recent = self.recent
            self._learn(list({w for w in words if w not in recent}))
            return b"".join(map(recent.__getitem__, words))


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str, cache_words: int | None = None) -> WordTokenizer:
    """One tokenizer per worker; tasks that reuse the worker reuse its cache."""
    return WordTokenizer(path, cache_words)
