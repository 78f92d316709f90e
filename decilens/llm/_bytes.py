"""Vectorised work on the UTF-8 bytes of an Arrow string column.

Texts are handled in slices of about a megabyte, so that memory does not depend on how
many rows a batch has; one text longer than that is a slice of its own. All ranges of a
slice (its words, say) are hashed at once, eight bytes a step, so a step is a few array
operations and there is no Python call per word; long ranges go to BLAKE2 one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Ranges up to so many bytes are hashed and compared together.
STEPS = 64
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters and every byte of a character beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Slice:
    """Some consecutive texts of a column: ``buf`` holds their bytes, ``off`` their limits."""

    def __init__(self, first: int, buf: np.ndarray, off: np.ndarray):
        self.first, self.buf, self.off = first, buf, off
        self.n = len(off) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes in ``member`` within a text: starts, ends, and the index of
        each text's first run (n + 1 values)."""
        inside = member[self.buf]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edge = self.off[(self.off > 0) & (self.off < len(self.buf))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return start, end, np.searchsorted(start, self.off)

    def data(self, fold: np.ndarray | None = None) -> np.ndarray:
        """The bytes, each replaced by ``fold[byte]``, as ``hashed`` and ``same`` take them."""
        return padded(self.buf if fold is None else fold[self.buf])


def padded(buf: np.ndarray) -> np.ndarray:
    """Eight more bytes behind ``buf``, so that a word can be read at each of its places."""
    return np.concatenate((buf, np.zeros(8, np.uint8)))


def _words(data: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word that begins at each byte."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ranges of ``data``; other seeds give independent hashes.

    Each step mixes the next eight bytes into the hash so far by a bijection, so ranges of
    one length up to eight bytes never share a hash.
    """
    size = end - start
    h = mix(size.astype(np.uint64) + _BASE + np.uint64(seed << 32))
    words = _words(data)
    left = np.flatnonzero(size > 0)
    long = left[size[left] > STEPS]
    if len(long):
        left, raw = left[size[left] <= STEPS], memoryview(data)
        key = bytes([seed])
        h[long] = np.frombuffer(
            b"".join([hashlib.blake2b(raw[a:b], digest_size=8, key=key).digest() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]), np.uint64
        )
    at = 0
    while len(left):
        rest = size[left] - at
        h[left] = mix(h[left] ^ (words[start[left] + at] & _MASK[np.minimum(rest, 8)]))
        left, at = left[rest > 8], at + 8
    return h


def same(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each range of ``data`` has the bytes of the range of ``other`` beside it."""
    size = end - start
    out = size == last - first
    one, two = _words(data), _words(other)
    left = np.flatnonzero(out & (size > 0))
    for i in left[size[left] > STEPS].tolist():
        out[i] = np.array_equal(data[start[i] : end[i]], other[first[i] : last[i]])
    left, at = left[size[left] <= STEPS], 0
    while len(left):
        rest = size[left] - at
        equal = ((one[start[left] + at] ^ two[first[left] + at]) & _MASK[np.minimum(rest, 8)]) == 0
        out[left[~equal]] = False
        left, at = left[equal & (rest > 8)], at + 8
    return out


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """``column`` is a string column without nulls."""
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield Slice(lo, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive word hashes (texts are not told apart)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, width):
        h = (h ^ (h >> np.uint64(29))) * _BASE + words[j : j + n]
    return mix(h)
