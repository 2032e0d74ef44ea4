"""Distinct words of a batch of texts, so that per-word work is done once per distinct word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words whose hash a task remembers.
MAX_HASHED = 500_000


def batch_words(texts: pa.Array, lower: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, index of every word in a row, bounds of each text). Words are runs without white space; nulls have none."""
    texts = texts.fill_null("")
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts) if lower else texts)
    values = split.values.dictionary_encode()
    words, index, offsets = values.dictionary.to_pylist(), values.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    if "" in words:  # pieces at the ends of a text
        keep = index != words.index("")
        kept = np.concatenate(([0], np.cumsum(keep)))
        index, offsets = index[keep], kept[offsets]
    return words, index, offsets


class _WordHashes(dict):
    """64-bit hash of a word, remembered; forgets everything when it holds MAX_HASHED words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_HASHED:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


hashed_words = _WordHashes()
