"""Sets of word shingles, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from decilens.llm._bytes import LOWER, SPACE, hashed, mix, slices, windows

#: Stands for a text with fewer words than a shingle has; told apart by the number of words.
_SHORT = np.uint64(0xA0761D6478BD642F)


def shingle_sets(column: pa.Array, width: int, seed: int = 0) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; seeds give independent ones.

    A-Z is lower-cased; words are ``[^\\x20\\x09-\\x0D]+``. A text with fewer words than
    ``width`` has its whole sequence as one shingle; one without words has none.
    """
    for part in slices(column):
        start, end, first = part.runs(~SPACE)
        words = hashed(part.data(LOWER), start, end, seed)
        grams = windows(words, width)
        for i in range(part.n):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= width:
                yield np.unique(grams[lo : hi - width + 1])
            elif hi > lo:
                h = np.full(1, _SHORT + np.uint64(hi - lo))
                for j in range(lo, hi):
                    h = mix(h * np.uint64(3) + words[j : j + 1])
                yield h
            else:
                yield np.zeros(0, np.uint64)
