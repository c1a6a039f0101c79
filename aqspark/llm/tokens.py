"""Token ids of whole texts, worked out once for each distinct word of a slice.

White space never reaches the vocabulary's merges, so a text's ids are its
words' ids one after the other. A word made of letters and trailing ASCII
punctuation splits into those two parts, which are kept apart in the cache.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from aqspark.llm.common import encoded_words, slices

CACHE_WORDS = 400_000
CACHE_PARTS = 800_000


class WordTokenizer:
    """Caches of one vocabulary file; both are emptied when full, which changes no result."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    @staticmethod
    def split(word: str) -> tuple[str, str]:
        core = word.rstrip(string.punctuation)
        if not (core.isalpha() and core.lower().isalpha()):  # one capital becomes a letter and a mark
            return word, ""
        # lower case is the vocabulary's own step; doing it here is safe below U+0130
        return core.lower() if max(core) < "İ" else core, word[len(core) :]

    def encode(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        fresh = {w: self.split(w) for w in words if w not in self.words}
        missing = list({p for pair in fresh.values() for p in pair if p not in self.parts})
        found = {}
        for at in range(0, len(missing), 10_000):
            part = missing[at : at + 10_000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                found[p] = np.array(e.ids, "<u4").tobytes()
        part_ids = lambda p: found[p] if p in found else self.parts[p]
        new = {w: part_ids(a) + part_ids(b) for w, (a, b) in fresh.items()}
        out = [new[w] if w in new else self.words[w] for w in words]
        if len(self.parts) + len(found) > CACHE_PARTS:
            self.parts = {"": b""}
        self.parts.update(found)
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words = {}
        self.words.update(new)
        return out


_LOADED: dict[str, WordTokenizer] = {}


def text_tokens(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Ids of each text in turn; null counts as empty."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    for _, part in slices(texts):
        vocabulary, index, bounds = encoded_words(part)
        coded = _LOADED[path].encode(vocabulary)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        table = np.frombuffer(b"".join(coded), "<u4")
        counts = sizes[index]
        ends = np.cumsum(counts)
        shift = (np.cumsum(sizes) - sizes)[index] - (ends - counts)
        at = np.repeat(shift, counts)
        at += np.arange(len(at), dtype=np.int32)  # in place: these are the largest arrays of a task
        ids = table[at]
        cuts = np.concatenate(([0], ends))[bounds]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield ids[a:b]
